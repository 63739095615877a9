"""Sharding by k-d tree partitioning.

Rows of equal text form a group that stays together (a group heavier than `split_share` of a shard and than FEW of its
texts is dealt into portions of that weight, or near-equal shards would be impossible). Each group has a point in metadata space: length, source,
language and a hash of the text. From the root, every node splits along its widest dimension at the weighted median
of its bytes, level by level, until each leaf is one shard holding its share of the bytes.

Medians are found by radix refinement: per round one partial aggregation into 4096 bins per open node; only the bin
that holds the median is opened further. The driver sees bin sums (at most nodes x 4096 rows), never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of
from .minhash import small

#: Bits of a dimension's value, and of the hash that orders equal values.
VALUE_BITS, TIE_BITS, BIN_BITS = 12, 48, 12
#: Copies that no portion parts, however heavy.
FEW = 4


@dataclass
class Node:
    """An open node: its number, the shards below it, and its bytes."""

    number: int
    first_shard: int
    shards: int


def _scaled(column: Column) -> Column:
    """A value in [0, 1) as VALUE_BITS bits."""
    top = (1 << VALUE_BITS) - 1
    return F.least(F.lit(top), F.greatest(F.lit(0), F.floor(column * top))).cast("long")


def points(frame: DataFrame, id_col: str, text_col: str, meta_cols: list[str]) -> DataFrame:
    """id, size, text_crc32, group hash and one scaled long per dimension d0, d1, ...

    The dimensions are the size (logarithm) and each metadata column (hash order; null has a place of its own); a
    group's point is that of its text alone where copies disagree, see `shard`.
    """
    text = text_of(text_col)
    size = F.octet_length(text) + 8
    hashed = [F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << VALUE_BITS)) for c in meta_cols]
    return frame.select(
        F.col(id_col).alias("id"),
        size.cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        _scaled(F.log2(size.cast("double")) / 40.0).alias("d0"),
        *[h.alias(f"d{i + 1}") for i, h in enumerate(hashed)],
    )


def _widest(items: DataFrame, dims: list[str]) -> dict[int, str]:
    """For each node, the dimension along which its bytes are spread widest: the standard deviation weighted by bytes,
    all dimensions having the same range. On a tie, the first."""
    weight = F.sum("weight").cast("double")
    mean = [(F.sum(F.col("weight") * F.col(d)) / weight).alias(f"m_{d}") for d in dims]
    square = [(F.sum(F.col("weight").cast("double") * F.col(d) * F.col(d)) / weight).alias(f"s_{d}") for d in dims]
    rows = items.groupBy("node").agg(*mean, *square).collect()
    return {r["node"]: max(dims, key=lambda d: (round(r[f"s_{d}"] - r[f"m_{d}"] ** 2, 6), -dims.index(d))) for r in rows}


def _lookup(values: dict[int, int | str]) -> Column:
    """A small node -> value map as a column over `node`; null for other nodes."""
    out = F.lit(None)
    for node, value in values.items():
        out = F.when(F.col("node") == node, F.lit(value)).otherwise(out)
    return out


def _cuts(keyed: DataFrame, wanted: dict[int, float], tolerance: float) -> dict[int, int]:
    """For each node, the key below which its share `wanted` (of 1) of the bytes lies, nearest to it.

    keyed: node, key (long, VALUE_BITS + TIE_BITS bits), weight.
    """
    shift = VALUE_BITS + TIE_BITS
    low = {n: 0 for n in wanted}  # prefix of the open bin, in units of the current shift
    below: dict[int, float] = {n: 0.0 for n in wanted}
    totals: dict[int, float] = {}
    cut: dict[int, int] = {}
    while shift > 0 and len(cut) < len(wanted):
        step = min(BIN_BITS, shift)
        open_ = {n: low[n] for n in wanted if n not in cut}
        inside = keyed.where(F.col("node").isin(list(open_)))
        if totals:
            inside = inside.where(F.shiftright("key", shift) == _lookup(open_))
        sums: dict[int, dict[int, float]] = {}
        for r in inside.groupBy("node", F.shiftright("key", shift - step).alias("bin")).agg(F.sum("weight").alias("w")).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = float(r["w"])
        first = not totals
        for n in open_:
            bins = sorted(sums.get(n, {}).items())
            if first:
                totals[n] = sum(w for _, w in bins)
            if not bins:
                cut[n] = low[n] << shift
                continue
            goal, at = wanted[n] * totals[n], below[n]
            for b, w in bins:
                if at + w > goal or b == bins[-1][0]:
                    # ending before or after this bin may already be near enough
                    before, after = goal - at, at + w - goal
                    if before <= tolerance * totals[n]:
                        cut[n] = b << (shift - step)
                    elif 0 <= after <= tolerance * totals[n] or shift == step:
                        cut[n] = (b if shift == step and before <= after else b + 1) << (shift - step)
                    else:
                        low[n], below[n] = b, at
                    break
                at += w
        shift -= step
    return cut


def kd_tree(items: DataFrame, dims: list[str], shards: int, tolerance: float = 2e-4) -> DataFrame:
    """items (group, part, weight, dims) with the column shard."""
    nodes, done = [Node(1, 0, shards)], {}
    placed = items.withColumn("node", F.lit(1))
    while nodes:
        widest = _widest(placed, dims)
        nodes = [n for n in nodes if n.number in widest]  # a node without rows is left alone
        if not nodes:
            break
        if nodes[0].shards == 1:  # one shard in all
            done[1] = 0
            break
        key = F.lit(None).cast("long")
        for n in nodes:
            key = F.when(F.col("node") == n.number, F.col(widest[n.number])).otherwise(key)
        # copies in several portions lie next to each other: the group's hash leads, the portion follows
        tie = F.pmod(F.xxhash64("group"), F.lit(1 << (TIE_BITS - 12))) * (1 << 12) + F.pmod(F.col("part"), F.lit(1 << 12))
        keyed = placed.withColumn("key", F.shiftleft(key, TIE_BITS) + tie)
        cuts = _cuts(keyed, {n.number: (n.shards // 2) / n.shards for n in nodes}, tolerance)
        step = F.col("node")
        after = []
        for n in nodes:
            left = n.shards // 2
            after += [Node(2 * n.number, n.first_shard, left), Node(2 * n.number + 1, n.first_shard + left, n.shards - left)]
            step = F.when(
                F.col("node") == n.number, F.when(F.col("key") < cuts[n.number], 2 * n.number).otherwise(2 * n.number + 1)
            ).otherwise(step)
        placed = saved(keyed.withColumn("node", step).drop("key"))
        nodes = [n for n in after if n.shards > 1]
        done |= {n.number: n.first_shard for n in after if n.shards == 1}
    return placed.withColumn("shard", F.coalesce(_lookup(done), F.lit(0)).cast("int"))


def shard(
    frame: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang"), split_share: float = 0.05, bucket_rows: int = 50_000,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Sizes (UTF-8 bytes and 8) are near equal over shards. Null and empty texts are one group of size 8. Copies stay
    together unless they outweigh `split_share` of a shard and are more than FEW; their group takes the least metadata
    among them. Ties go by the group's hash. Repeated rows are rows of their own. An empty table gives no rows. A text
    longer than a shard makes its shard that much larger. Only the columns named are read.
    """
    kind = dict(frame.dtypes)[id_col]
    dims = [f"d{i}" for i in range(len(meta_cols) + 1)]
    rows = saved(points(frame, id_col, text_col, list(meta_cols)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    portion = max(1, int(total / shards * split_share))
    # how many portions a group has follows from its weight; a row's portion from its id
    groups = (
        rows.groupBy("group")
        .agg(F.sum("size").alias("group_weight"), F.max("size").alias("largest"), *[F.min(d).alias(d) for d in dims])
        .withColumn("portions", F.greatest(F.lit(1), F.ceil(F.col("group_weight") / F.greatest(F.lit(portion), F.col("largest") * FEW))))
        .withColumn("portions", F.least("portions", F.lit(1 << 12)).cast("int"))
    )
    heavy = groups.where("portions > 1").select("group", "portions")
    # at most shards / split_share groups can outweigh a portion; their number is checked all the same
    dealt = rows.join(small(saved(heavy)), "group", "left").withColumn(
        "part", F.when(F.col("portions") > 1, F.pmod(F.xxhash64("id", "size"), F.col("portions"))).otherwise(0).cast("int")
    )
    items = dealt.groupBy("group", "part").agg(F.sum("size").alias("weight"), *[F.min(d).alias(d) for d in dims])
    items = items.drop(*dims).join(groups.select("group", *dims), "group") if meta_cols else items
    placed = kd_tree(saved(items), dims, shards).select("group", "part", "shard")
    homes = dealt.select("id", "size", "text_crc32", "group", "part").join(placed, ["group", "part"])
    return with_slots(homes.select("id", "size", "text_crc32", "shard"), bucket_rows).withColumnRenamed("id", id_col)


def with_slots(homes: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """Add slot, gapless from 0 in each shard, ordered by bucket, then id. Buckets hold about `bucket_rows` rows."""
    homes = saved(homes)
    buckets = max(1, -(-homes.count() // bucket_rows))
    put = homes.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "text_crc32"), F.lit(buckets)))
    counts = put.groupBy("shard", "bucket").count()
    # the table of (shard, bucket) has one row per bucket: far smaller than the rows, shards x buckets at most
    base = counts.selectExpr(
        "shard", "bucket",
        "sum(count) over (partition by shard order by bucket rows between unbounded preceding and current row) - count as base",
    )
    ranked = put.selectExpr(
        "*", "row_number() over (partition by shard, bucket order by id, size, text_crc32) - 1 as place"
    )
    return ranked.join(base, ["shard", "bucket"]).select(
        "id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot")
    )
