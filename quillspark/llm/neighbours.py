"""Embedding near-dedup by NN-descent.

Exact copies (same label and vector) are one class. Vectors travel as one signed byte a component; the error that this
can make in a cosine has a proven bound, so an edge is a possible link unless the bound rules it out, and only possible
links are compared in double precision, a vector being sent to a task once however many of its edges meet there.

The neighbour graph starts from a few hash tables of random hyperplanes and random edges and is refined by neighbours-of-neighbours joins:
each vector gathers its neighbours and those that have it as theirs, the members of such a neighbourhood are compared
with each other, and every list keeps its best entries. Later rounds look at neighbourhoods with a new edge that a link
can follow from. When few lists change, lists that are full of possible links (saturated) are doubled, up to LONGEST.

Links are the edges at or above the threshold. A component with a vector of LIST or more possible links is crowded:
there, every member is compared with all others by blocks inside tasks, which only emit counts (lists enlarged to the
whole component, without a row a pair), and those vectors get further lists of neighbours outside their own component, by
the same descent, until none of them holds a link. So no cap on a list hides a link. An audit compares a bounded sample of vectors with all vectors of their label: links that it
misses are added, a recall of edges under WANTED starts another descent from further tables, and one under LEAST at the
end is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components
from .minhash import small

#: Entries of a list at first and at most; edges of a vector that the first EXPLORED rounds follow however long they are.
LIST, LONGEST, WAYS, EXPLORED = 8, 16, 3, 1
#: Members of a start bucket (about), tables of a start, rounds at most, and the share of lists under which a change is small.
BUCKET, TABLES, ROUNDS, SETTLED = 128, 8, 4, 0.002
#: Members of a block, rows and pairs of a task group, about.
BLOCK, CELL_ROWS, CELL_PAIRS = 2048, 8_000, 20_000
#: Audited vectors (about), the recall of edges that is wanted and that which is required, and descents at most.
AUDITED, WANTED, LEAST, ATTEMPTS = 256, 0.99, 0.9, 3


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: with a label, not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    # dividing by the largest component first keeps tiny and huge vectors from under- and overflowing
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as signed bytes and the step of each."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), step


def _decoded(codes, steps) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and what each adds to the largest error of a cosine: half a step times the other's sum of components."""
    q = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)
    steps = np.asarray(steps)
    return q.astype(np.float32) * steps[:, None].astype(np.float32), 0.5 * steps * (math.sqrt(q.shape[1]) * (1 + 0.5 * steps.max()) + q.shape[1] * steps.max()) + 1e-6


def coded(reps: DataFrame) -> DataFrame:
    """rep, label, size, code, step of each class."""
    label = dict(reps.dtypes)["label"]

    def run(batches):
        for batch in batches:
            for _, part in batch.groupby("size", sort=False):
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    q, step = encode(_unit(some["vec"]))
                    yield pd.DataFrame({"rep": some["rep"].values, "label": some["label"].values, "size": some["size"].values, "code": [r.tobytes() for r in q], "step": step})

    return reps.select("rep", "label", "size", "vec").mapInPandas(run, f"rep long, label {label}, size int, code binary, step double")


EDGES = "src long, dst long, sim double, may boolean"


def _edges(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Rows of EDGES from the arrays of `_top`."""
    kinds = {"src": np.int64, "dst": np.int64, "sim": np.float64, "may": bool}
    return pd.DataFrame({name: np.concatenate([f[n] for f in found] or [np.empty(0, kind)]).astype(kind) for n, (name, kind) in enumerate(kinds.items())})


def _top(ids: np.ndarray, x: np.ndarray, spare: np.ndarray, parts: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Each row's k nearest rows of other parts: source, target, cosine, whether it may be a link."""
    if len(x) < 2:
        return ids[:0], ids[:0], np.empty(0), np.empty(0, bool)
    s = x @ x.T
    s[parts[:, None] == parts[None, :]] = -3
    k = min(k, len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(s, near, 1)
    i, j = np.nonzero(value > -2.5)
    to, value = near[i, j], value[i, j]
    return ids[i], ids[to], value, value + spare[i] + spare[to] >= threshold


def start_graph(vectors: DataFrame, threshold: float, seed: int = 0, k: int = LIST) -> DataFrame:
    """Edges from TABLES tables of random hyperplanes and one of random buckets, whose edges join what hyperplanes part;
    only vectors of different `part` count as neighbours.

    A bucket of many near vectors meets in slices: they have neighbours enough there, and the descent finds the rest.
    """
    most = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(most / BUCKET)))
    def hashed(batches):
        for batch in batches:
            for size, part in batch.groupby("size", sort=False):
                x, _ = _decoded(part["code"], part["step"])
                out = part[["own", "size", "rep", "part", "code", "step"]]
                random = (part["rep"].values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % (1 << bits)
                yield out.assign(bucket=random * (TABLES + 1) + TABLES, at=np.float32(0))
                for t in range(TABLES):
                    planes = np.random.RandomState(1000 + 100 * seed + t).standard_normal((size, bits + 1)).astype(np.float32)
                    side = x @ planes
                    bucket = ((side[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield out.assign(bucket=bucket * (TABLES + 1) + t, at=side[:, bits])

    dealt = vectors.select(F.xxhash64("label").alias("own"), "size", "rep", "part", "code", "step").mapInPandas(
        hashed, "own long, size int, rep long, part long, code binary, step double, bucket long, at float"
    )
    # a bucket is named by a hash of its label, vector size, table and code
    dealt = dealt.select(F.xxhash64("own", "size", "bucket").alias("bucket"), "size", "at", "rep", "part", "code", "step")
    # a bucket of very many near vectors is dealt in random slices; how large buckets are is counted first
    large = saved(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    slices = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
    cells = max(1, math.ceil(vectors.count() * (TABLES + 1) / CELL_ROWS))
    dealt = dealt.join(small(large), "bucket", "left").withColumn("slice", F.pmod(F.xxhash64("rep"), slices)).drop("n")
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("bucket", "slice"), F.lit(cells)))

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, same in batch.groupby("size", sort=False):
            same = same.sort_values(["bucket", "slice", "at", "rep"])
            ids, parts = same["rep"].values, pd.factorize(same["part"])[0]
            x, spare = _decoded(same["code"], same["step"])
            group = same.groupby(["bucket", "slice"], sort=False).ngroup().values
            ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
            for begin, end in zip(np.append(0, ends[:-1]), ends):
                for low in range(begin, end, 256):
                    some = slice(max(begin, low - 32), min(end, low + 256))
                    found.append(_top(ids[some], x[some], spare[some], parts[some], k, threshold))
        return _edges(found)

    return dealt.groupBy("cell").applyInPandas(meet, EDGES)


def shortened(edges: DataFrame, lengths: DataFrame | None = None, k: int = LIST) -> DataFrame:
    """Each source's best edges: k of them, or as many as `lengths` (src, k) gives it."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("may").alias("may"))
    ranked = once.selectExpr("*", "row_number() over (partition by src order by sim desc, dst) as r")
    if lengths is None:
        return ranked.where(F.col("r") <= k).drop("r")
    return ranked.join(small(lengths), "src", "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).drop("r", "k")


def descend(ways: DataFrame, vectors: DataFrame, threshold: float, hubs: DataFrame | None = None, back: int = LONGEST, emitted: int = 4) -> DataFrame:
    """One neighbours-of-neighbours join: the members of each vector's neighbourhood (`ways` from it, the best of those
    to it, itself) meet; each of them gives its `emitted` nearest others of other parts. Only `hubs` (v) have a
    neighbourhood, all vectors without them."""
    to = ways.selectExpr("src", "dst", "row_number() over (partition by dst order by sim desc, src) as r").where(F.col("r") <= back)
    both = ways.select(F.col("src").alias("v"), F.col("dst").alias("u")).union(to.select(F.col("dst").alias("v"), F.col("src").alias("u")))
    both = both.union(ways.select(F.col("src").alias("v"), F.col("src").alias("u")))
    both = saved((both if hubs is None else both.join(small(hubs), "v", "left_semi")).distinct())
    cells = max(1, math.ceil(both.count() / CELL_ROWS))
    put = both.join(vectors.select(F.col("rep").alias("u"), "part", "size", "code", "step"), "u")
    put = put.withColumn("cell", F.pmod(F.xxhash64("v"), F.lit(cells)))

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, same in batch.groupby("size", sort=False):
            ids, parts = same["u"].values, pd.factorize(same["part"])[0]
            x, spare = _decoded(same["code"], same["step"])
            for rows in same.groupby("v", sort=False).indices.values():
                found.append(_top(ids[rows], x[rows], spare[rows], parts[rows], emitted, threshold))
        return _edges(found).drop_duplicates(["src", "dst"])

    return put.groupBy("cell").applyInPandas(meet, EDGES)


def refined(lists: DataFrame, vectors: DataFrame, threshold: float, ways: DataFrame | None = None) -> DataFrame:
    """`lists` after the descent; edges of `ways` are ways to neighbours too, but no entries of lists.

    Two links in a row leave a cosine of 2 t * t - 1 at least, so edges under that are followed in the first EXPLORED
    rounds alone, the best WAYS of each vector.
    """
    reach = 2 * threshold * threshold - 1 - 0.05
    lengths = None
    for turn in range(ROUNDS):
        near = lists if ways is None else lists.unionByName(ways)
        useful = near.where((F.col("sim") >= reach) | F.col("may"))
        if turn < EXPLORED:
            first = near.selectExpr("src", "dst", "sim", "may", "row_number() over (partition by src order by sim desc, dst) as r")
            found = descend(saved(first.where((F.col("r") <= WAYS) | F.col("may") | (F.col("sim") >= reach)).drop("r")), vectors, threshold, None, WAYS + LIST)
        else:
            found = descend(useful, vectors, threshold, hubs)
        after = saved(shortened(lists.union(found), lengths))
        new = saved(after.join(lists.select("src", "dst"), ["src", "dst"], "left_anti").where((F.col("sim") >= reach) | F.col("may")))
        held = after.where("may").groupBy("src").agg(F.count("*").alias("n"))
        every = after.groupBy("src").agg(F.count("*").alias("n"), F.count_if("may").alias("good"))
        # lists that are full of possible links are doubled
        known = F.lit(LIST) if lengths is None else F.coalesce("k", F.lit(LIST))
        sized = every if lengths is None else every.join(small(lengths), "src", "left")
        longer = sized.where((F.col("good") == F.col("n")) & (F.col("n") >= known) & (known < LONGEST)).select("src", (known * 2).alias("k"))
        longer = saved(longer)
        changed, full, lists = new.select("src").distinct().count(), longer.count(), after
        if turn >= EXPLORED - 1 and changed <= SETTLED * held.count() and not full:
            break
        if full:
            rest = longer if lengths is None else lengths.join(longer, "src", "left_anti").union(longer)
            lengths = saved(rest)
        hubs = new.select(F.col("src").alias("v")).union(new.select("dst")).union(longer.select("src")).distinct()
        hubs = saved(hubs)
    return lists


def confirmed(edges: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the possible links whose cosine in double precision is at least the threshold.

    Classes have a block each and pairs meet in the cell of their two blocks, which gets a vector once.
    """
    pairs = saved(edges.where("may").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    blocks = max(1, math.ceil((pairs.count() / CELL_PAIRS) ** 0.5))

    def block(column: str):
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    dealt = pairs.withColumn("cell", block("a") * blocks + block("b"))
    needed = dealt.select(F.col("cell").alias("unit"), F.col("a").alias("rep")).union(dealt.select("cell", "b")).distinct()
    shipped = needed.join(reps.select("rep", "vec"), "rep")

    def check(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return batch[["a", "b"]]
        ids, good = pd.Index(known["rep"]), np.zeros(len(batch), bool)
        left, right = ids.get_indexer(batch["a"]), ids.get_indexer(batch["b"])
        sizes = known["vec"].map(len).values
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x, place = _unit(known["vec"].values[rows]), np.full(len(known), -1)
            place[rows] = np.arange(len(rows))
            own = np.flatnonzero((place[left] >= 0) & (place[right] >= 0))
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                good[some] = (x[place[left[some]]] * x[place[right[some]]]).sum(axis=1) >= threshold
        return batch.loc[good, ["a", "b"]]

    return saved(dealt.groupBy("cell").cogroup(shipped.groupBy("unit")).applyInPandas(check, "a long, b long"))


def across(
    full: DataFrame, lists: DataFrame, links: DataFrame, classes: DataFrame, vectors: DataFrame, reps: DataFrame, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """`links` and `classes` with what full lists hide: the vectors of `full` (rep) get lists of neighbours outside
    their component, until these hold no link. A vector whose list has room finds its links itself.
    """
    held, seed = saved(vectors.drop("part").join(small(full), "rep", "left_semi")), 50
    while True:
        placed = held.join(classes.select(F.col("node").alias("rep"), F.col("component_id").alias("part")), "rep")
        several = placed.groupBy("label", "size").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
        apart = saved(placed.join(several.select("label", "size"), ["label", "size"], "left_semi"))
        if apart.isEmpty():
            return links, classes
        start = saved(shortened(start_graph(apart, threshold, seed)))
        outside = refined(start, apart, threshold, lists)
        home = classes.select(F.col("node").alias("dst"), "component_id")
        more = confirmed(outside.join(home, "dst", "left_semi"), reps, threshold)
        if more.isEmpty():
            return links, classes
        links, seed = saved(links.union(more).distinct()), seed + 1
        classes = saved(components(links))


def audit(reps: DataFrame, threshold: float, total: int) -> DataFrame:
    """(a, b): all links of a sample of about AUDITED vectors, by comparison with every vector of their label."""
    share = max(1, total // AUDITED)
    asked = reps.where(F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(share)) == 0).select("rep", "label", "size", "vec").limit(4 * AUDITED).toPandas()
    groups = {key: (part["rep"].values, _unit(part["vec"])) for key, part in asked.groupby(["label", "size"])}

    def ask(batches):
        for batch in batches:
            for key, part in batch.groupby(["label", "size"], sort=False):
                if key in groups:
                    ids, x = groups[key]
                    for at in range(0, len(part), 2000):
                        some = part.iloc[at : at + 2000]
                        i, j = np.nonzero(_unit(some["vec"]) @ x.T >= threshold)
                        a, b = some["rep"].values[i], ids[j]
                        yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    found = reps.select("rep", "label", "size", "vec").mapInPandas(ask, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, n_links) in each component, copies counted: members have component_id, rep, vec, copies."""
    sizes = members.groupBy("component_id").agg(F.count("*").alias("members"))
    put = members.join(sizes, "component_id").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    put = put.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # every member is dealt once a block, so rows are counted as they are after that
    cells = max(1, math.ceil((sizes.agg(F.sum(F.col("members") * F.ceil(F.col("members") / BLOCK))).first()[0] or 0) / CELL_ROWS))
    put = put.select(
        "component_id", "rep", "vec", "copies", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    ).withColumn("cell", F.pmod(F.xxhash64("component_id", "low", "high"), F.lit(cells)))

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, low, high), unit in batch.groupby(["component_id", "low", "high"], sort=False):
            x, copies, side = _unit(unit["vec"]), unit["copies"].values.astype(np.int64), unit["side"].values
            rows = np.arange(len(x))
            left = rows[side == 0]
            right = rows[side == 1] if low != high else left
            for some in np.array_split(left, max(1, len(left) // 256)):
                near = x[some] @ x[right].T >= threshold
                if low == high:
                    near[some[:, None] == right[None, :]] = False
                out.append((unit["rep"].values[some], near @ copies[right]))
                if low != high:
                    out.append((unit["rep"].values[right], copies[some] @ near))
        return pd.DataFrame({"rep": np.concatenate([r for r, _ in out]), "n_links": np.concatenate([n for _, n in out])})

    counted = put.groupBy("cell").applyInPandas(count, "rep long, n_links long")
    return counted.groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(
    frame: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> tuple[DataFrame, dict]:
    """One row per input row (id, n_links, component_id, kept), and figures: recall of the audited edges before they
    are added, audited_links, attempts, dense (vectors with LIST or more possible links).

    Vectors link when their labels are equal and their cosine is at least `threshold`. Null, empty or zero vectors,
    vectors with a null or non-finite component and vectors without a label link with nothing, nor do vectors of
    different lengths; rows with a null id are not linked. Rows that repeat an id are rows of their own, linked by their
    own vectors. Ties between equally near neighbours go by an inner number and decide no link. An empty table gives no
    rows. Other columns are not read.
    """
    element = "float" if dict(frame.dtypes)[vec_col] == "array<float>" else "double"
    rows = frame.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vec"), F.col("label")) & F.col("id").isNotNull())
    # two hashes of 64 bits stand for the label and the vector
    rows = rows.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "vec")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "vec"))})
    same = rows.where("ok").groupBy("h1", "h2").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    reps = saved(same.withColumn("rep", F.monotonically_increasing_id()).withColumn("size", F.size("vec")))
    total = reps.count()
    figures = {"recall": 1.0, "audited_links": 0, "attempts": 0, "dense": 0}
    counted, classes = None, None
    if total:
        vectors = saved(coded(reps)).withColumn("part", F.col("rep"))
        lists = None
        true = saved(audit(reps, threshold, total))
        for attempt in range(ATTEMPTS):
            start = start_graph(vectors, threshold, attempt)
            lists = saved(shortened(start if lists is None else lists.union(start), None, LIST if lists is None else LONGEST))
            lists = refined(lists, vectors, threshold)
            links = confirmed(lists, reps, threshold)
            classes = saved(components(links))
            state = lists.where("may").groupBy("src").agg(F.count("*").alias("good"))
            full = saved(state.where(F.col("good") >= LIST).select(F.col("src").alias("rep")))
            dense = full.count()
            if dense:
                links, classes = across(full, lists, links, classes, vectors, reps, threshold)
            crowded = saved(classes.join(full.withColumnRenamed("rep", "node"), "node", "left_semi").select("component_id").distinct())
            home = classes.join(crowded.withColumn("crowded", F.lit(True)), "component_id", "left")
            judged = true.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left")
            judged = judged.join(home.select(F.col("node").alias("a"), F.col("component_id").alias("ca"), "crowded"), "a", "left")
            judged = judged.join(home.select(F.col("node").alias("b"), F.col("component_id").alias("cb")), "b", "left")
            seen = judged.agg(F.count("*").alias("n"), F.count_if(F.col("linked") | (F.col("crowded") & (F.col("ca") == F.col("cb")))).alias("found")).first()
            figures = {"recall": seen["found"] / seen["n"] if seen["n"] else 1.0, "audited_links": seen["n"], "attempts": attempt + 1, "dense": dense}
            if figures["recall"] >= WANTED:
                break
        if figures["recall"] < LEAST:
            raise RuntimeError(f"the neighbour lists miss too many links: {figures}")
        if figures["recall"] < 1.0:
            links = saved(links.union(true).distinct())
            classes = saved(components(links))
            crowded = saved(classes.join(full.withColumnRenamed("rep", "node"), "node", "left_semi").select("component_id").distinct())
        placed = saved(reps.join(classes.withColumnRenamed("node", "rep"), "rep"))
        counted = link_counts(placed.join(crowded, "component_id", "left_semi"), threshold)
        # elsewhere, links are the edges, copies counted
        sparse = placed.join(crowded, "component_id", "left_anti").select("rep", "copies")
        ends = links.select(F.col("a").alias("rep"), F.col("b").alias("to")).union(links.select("b", "a"))
        ends = ends.join(sparse.select("rep"), "rep", "left_semi").join(sparse.select(F.col("rep").alias("to"), "copies"), "to")
        counted = counted.union(ends.groupBy("rep").agg(F.sum("copies").alias("n_links")))
        parts = reps.select("h1", "h2", "rep", "id", "copies").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(counted, "rep", "left")
        parts = parts.select("h1", "h2", "id", "copies", "n_links", F.coalesce("component_id", "rep").alias("part"))
        least = parts.groupBy("part").agg(F.min("id").alias("home"))
        known = parts.join(least, "part").select("h1", "h2", "home", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        rows = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    else:
        rows = rows.select("id", F.lit(0).alias("n_links"), F.col("id").alias("home"))
    out = rows.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("home", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))), figures
