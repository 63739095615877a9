"""MinHash near-dedup by a multi-index Hamming join.

A document's set of five-word shingles gives a signature of 128 min-hashes, b = 16 bits of each. Two documents of
similarity 0.75 differ in each symbol with probability 0.25 at most, so the distance (symbols that differ) of a
linked pair is at most 51 of 128 but with probability 5e-5.

Pigeonhole: cut into 27 chunks, two signatures within 51 errors agree up to one error in at least one chunk (26 chunks
with two errors would be 52). Allowing one error in a chunk means to leave out each of its symbols in turn, so every
signature has 128 keys (chunk, symbol left out, the others) and every pair within the distance shares a key.

Equal sets are one class (`rep`, a number of its own, so ids may repeat) and join nothing twice. Buckets with the same
smallest member are one group, in which every class stands once however many keys it shares there.

Groups of at most NARROW members are compared in a join. Larger ones are dealt to tasks in random blocks of about BLOCK
members, anew in each round; every member proposes its NEAREST members of other components, proposals are checked on the
full sets, and links join components. When a round joins little, the pairs of different components that are left are
compared, all of them, by pairs of blocks; components larger than a block have blocks of their own, which do not meet.
A task emits only pairs within the distance whose shingle counts by leading bits leave room for enough common shingles
(an exact bound). A dense group thus costs a few rows a member, as its members are in one component before pairs are
enumerated; only pairs that are near and yet not similar enough are rows of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_of, tidy
from .components import components

SYMBOLS, ERRORS, CHUNKS, WORDS = 128, 51, 27, 5
BOUNDS = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]
#: Groups with more members than NARROW are compared by blocks of about BLOCK members, CELL_ROWS rows a task group.
NARROW, BLOCK, CELL_ROWS = 12, 2048, 2_000
#: Proposals of a member in a round, and rounds at most; after one that links less than WORTHWHILE of the members of open groups, the
#: rest is enumerated.
NEAREST, ROUNDS, WORTHWHILE = 3, 6, 0.02
#: Leading bits of a shingle's hash by which shingles are counted.
BIN_BITS = 10
#: Pairs that are checked in one task group, about; rows of a small key table that may be broadcast.
CELL_PAIRS, SMALL_ROWS = 2_000, 1_000_000
#: Signatures whose keys are made in one task, about: what a task adds up by key stays small.
KEYED_ROWS = 4_000
#: Pairs whose bins are compared at a time, 1 << BIN_BITS bytes a side each.
BIN_PAIRS = 2_048
#: Distinct words whose hashes a task remembers (twice as many at most).
REMEMBERED = 30_000

_ODD = np.random.RandomState(20240).randint(1, 2**62, SYMBOLS + WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _STEP
    return x ^ (x >> _SHIFT)


class WordHashes:
    """64-bit hashes of words; those of the last REMEMBERED distinct words, about, are remembered while it lives (a task)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for i, h in enumerate(found):
                if h is None:
                    h = self.older.get(words[i])
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i]) if h is None else h
            if len(known) > REMEMBERED:
                self.known, self.older = {}, known
        return np.array(found, np.uint64)


def shingles(text: str | None, hashes: WordHashes | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles; of all its words where it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = (hashes or WordHashes())(words)
    with np.errstate(over="ignore"):
        if len(h) >= WORDS:
            n = len(h) - WORDS + 1
            total = np.zeros(n, np.uint64)
            for i in range(WORDS):
                total += h[i : i + n] * _ODD[SYMBOLS + i]
        else:
            total = (h * _ODD[SYMBOLS : SYMBOLS + len(h)]).sum(keepdims=True) + np.uint64(len(h))
        return np.unique(_mix(total))


def fingerprint(hashes: np.ndarray) -> tuple[int, int, int]:
    """Size, sum and exclusive or of a set of hashes: equal for equal sets alone (but for chance of about 2**-128)."""
    if not len(hashes):
        return 0, 0, 0
    with np.errstate(over="ignore"):
        return len(hashes), int(hashes.sum().astype(np.int64)), int(np.bitwise_xor.reduce(hashes).astype(np.int64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low-order 16 bits of each permuted minimum."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            part = hashes[at : at + 2048]
            least = np.minimum(least, (part[:, None] * _ODD[None, :SYMBOLS]).min(axis=0))
        return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def sketch(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n (set size), f1 and f2 (the set's fingerprint with n), sig (null for an empty set)."""
    kind = dict(frame.dtypes)[id_col]

    @tidy("minhash")
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingles(text, hashes)
                rows.append((*fingerprint(h), signature(h).tobytes() if len(h) else None))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "sig"])
            out.insert(0, "id", batch["id"].values)
            out.insert(1, "text_hash", batch["text_hash"].values)
            yield out

    text = text_of(text_col)
    picked = frame.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return picked.mapInPandas(run, f"id {kind}, text_hash long, n long, f1 long, f2 long, sig binary")


def _chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """For signatures (n x 128), their keys (n x 128); the low 5 bits of a key are its chunk."""
    keys = np.empty(sigs.shape, np.int64)
    wide = sigs.astype(np.uint64)
    with np.errstate(over="ignore"):
        for chunk in range(CHUNKS):
            low, high = BOUNDS[chunk], BOUNDS[chunk + 1]
            terms = _mix(wide[:, low:high] * _ODD[None, low:high] + _ODD[None, low:high])
            whole = terms.sum(axis=1, dtype=np.uint64)
            for s in range(low, high):
                h = _mix(whole - terms[:, s - low] + np.uint64(s))
                keys[:, s] = ((h << np.uint64(5)) | np.uint64(chunk)).astype(np.int64)
    return keys


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, SYMBOLS)


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, rep) for every key of every signature, those of about KEYED_ROWS signatures a task."""
    cells = max(1, -(-reps.count() // KEYED_ROWS))

    @tidy("minhash")
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                keys = _chunk_keys(_sigs(part["sig"]))
                yield pd.DataFrame({"key": keys.ravel(), "rep": np.repeat(part["rep"].values, SYMBOLS)})

    return reps.select("rep", "sig").repartition(cells, "rep").mapInPandas(run, "key long, rep long")


def small(frame: DataFrame) -> DataFrame:
    """A written table of few columns of longs, broadcast while it has at most SMALL_ROWS rows; beyond, joined by shuffle."""
    return F.broadcast(frame) if frame.count() <= SMALL_ROWS else frame


def groups_of(reps: DataFrame) -> DataFrame:
    """(g, rep, members): the members of the buckets whose smallest member is g, each once, and how many they are.

    Which keys are shared is one partial aggregation, so a key of very many members is added up before the shuffle.
    """
    index = index_keys(reps)
    ends = index.groupBy("key").agg(F.min("rep").alias("g"), F.max("rep").alias("high"))
    shared = saved(ends.where("g <> high").select("key", "g"))
    held = saved(index.join(small(shared), "key").select("g", "rep").distinct())
    return saved(held.join(held.groupBy("g").agg(F.count("*").alias("members")), "g"))


def could_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, bins: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be similar enough: sets share at most the sum over bins of the smaller count."""
    most, full = np.empty(len(i), np.int64), np.empty(len(i), bool)
    for at in range(0, len(i), BIN_PAIRS):
        part = slice(at, at + BIN_PAIRS)
        left, right = bins[i[part]], bins[j[part]]
        most[part] = np.minimum(left, right).sum(axis=1, dtype=np.int64)
        full[part] = (left == 255).any(axis=1) & (right == 255).any(axis=1)  # 255 stands for 255 or more
    fewer = np.minimum(n[i], n[j])
    most = np.where(full, fewer, np.minimum(most, fewer))
    return most * 100 >= percent * (n[i] + n[j] - most)


def near_in_unit(
    sigs: np.ndarray, n: np.ndarray, bins: np.ndarray, parts: np.ndarray, sides: np.ndarray, mixed: bool, percent: int, nearest: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a unit (a block, or two of them) within the distance, of different components, that the bins do
    not rule out: all of them, or each member's `nearest` ones.

    `mixed` units hold two blocks (sides 0 and 1) and only pairs across count.
    """
    rows = np.flatnonzero(sides == 0) if mixed else np.arange(len(sigs))
    columns = np.flatnonzero(sides == 1) if mixed else rows
    left, right = [], []
    for at in range(0, len(rows), 16):
        some = rows[at : at + 16]
        apart = parts[some][:, None] != parts[columns][None, :]
        if not mixed and nearest is None:
            apart &= some[:, None] < columns[None, :]
        meet = np.flatnonzero(apart.any(axis=0))
        others = columns[meet]
        far = (sigs[some][:, None, :] != sigs[others][None, :, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero((far <= ERRORS) & apart[:, meet])
        value = far[i, j]
        i, j = some[i], others[j]
        good = could_link(i, j, n, bins, percent)
        i, j, value = i[good], j[good], value[good]
        if nearest is not None and len(i):
            order = np.lexsort((j, value, i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)
            few = np.arange(len(i)) - first < nearest
            i, j = i[few], j[few]
        left.append(i)
        right.append(j)
    empty = np.empty(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def sets_of(wanted: DataFrame, docs: DataFrame, column: str, shape) -> DataFrame:
    """(rep, column): what `shape` makes of the shingle set of each wanted class (rep, id, n, f1, f2).

    Documents are found by id, broadcast while they are few, and recognised by their set, as ids may repeat.
    """
    wanted = saved(wanted)
    ids = saved(wanted.select("id").distinct())

    @tidy("minhash")
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                sets = [shingles(t, hashes) for t in batch["text"].iloc[at : at + 500]]
                out = pd.DataFrame([fingerprint(h) for h in sets], columns=["n", "f1", "f2"])
                yield out.assign(**{column: [shape(h) for h in sets]})

    found = docs.join(small(ids), "id", "left_semi").select("text").mapInPandas(run, f"n long, f1 long, f2 long, {column} binary")
    return found.join(small(wanted.select("rep", "n", "f1", "f2")), ["n", "f1", "f2"]).groupBy("rep").agg(F.first(column).alias(column))


def _bins(hashes: np.ndarray) -> bytes:
    """How many shingles have each value of the leading bits, 255 standing for 255 or more."""
    counts = np.bincount((hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def compared(units: DataFrame, reps: DataFrame, bins: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """(a, b, n_a, n_b) with a < b for units given as (g, low, high, side, rep, part): see `near_in_unit`."""
    units = saved(units)
    cells = max(1, -(-units.count() // CELL_ROWS))
    put = units.withColumn("cell", F.pmod(F.xxhash64("g", "low", "high"), F.lit(cells)))
    put = put.join(reps.select("rep", "n", "sig").join(bins, "rep"), "rep")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "b", "n_a", "n_b")})]
        for (_, low, high), unit in batch.groupby(["g", "low", "high"], sort=False):
            parts = unit["part"].values
            if (parts == parts[0]).all():
                continue
            counts = np.frombuffer(b"".join(unit["bins"]), np.uint8).reshape(len(unit), -1)
            n, rep = unit["n"].values, unit["rep"].values
            i, j = near_in_unit(_sigs(unit["sig"]), n, counts, parts, unit["side"].values, low != high, percent, nearest)
            i, j = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
            out.append(pd.DataFrame({"a": rep[i], "b": rep[j], "n_a": n[i], "n_b": n[j]}))
        return pd.concat(out).drop_duplicates()

    return put.groupBy("cell").applyInPandas(compare, "a long, b long, n_a long, n_b long").distinct()


def single_blocks(rows: DataFrame, turn: int) -> DataFrame:
    """Units of one random block each, for groups given as (g, rep, part, members): every row once."""
    own = F.pmod(F.xxhash64(F.lit(turn), "rep"), F.ceil(F.col("members") / BLOCK))
    return rows.select("g", own.alias("low"), own.alias("high"), F.lit(0).alias("side"), "rep", "part")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Units in which every pair of different components of a group (g, rep, part, members) meets.

    A component with BLOCK members or more in a group has blocks of its own; pairs of blocks that hold one single
    component are left out.
    """
    sizes = rows.groupBy("g", "part").agg(F.count("*").alias("size"))
    large = F.col("size") >= BLOCK
    turn = F.pmod(F.xxhash64("rep"), F.ceil(F.when(large, F.col("size")).otherwise(F.col("members")) / BLOCK))
    held = saved(rows.join(sizes, ["g", "part"]).select("g", "rep", "part", F.xxhash64(F.when(large, F.col("part")).otherwise(-1), turn).alias("own")))
    edges = held.groupBy("g", "own").agg(F.min("part").alias("least"), F.max("part").alias("most"))
    one, two = edges.alias("x"), edges.alias("y")
    met = one.join(two, F.expr("x.g = y.g and x.own <= y.own and (x.least <> x.most or y.least <> y.most or x.least <> y.least)"))
    met = saved(met.select("x.g", F.col("x.own").alias("low"), F.col("y.own").alias("high")))
    sides = met.select("g", F.col("low").alias("own"), "low", "high", F.lit(0).alias("side"))
    sides = sides.union(met.where("low <> high").select("g", "high", "low", "high", F.lit(1)))
    return held.join(sides, ["g", "own"]).select("g", "low", "high", "side", "rep", "part")


@F.pandas_udf(T.IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Symbols in which two signatures differ."""
    if not len(a):
        return pd.Series([], dtype="int32")
    return pd.Series((_sigs(a) != _sigs(b)).sum(axis=1).astype("int32"))


def near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within the signature distance whose sizes do not rule them out, with the sizes n_a and n_b."""
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return both.where(distance("sig_a", "sig_b") <= ERRORS).select("a", "b", "n_a", "n_b")


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose full sets are similar enough, as (a, b).

    Classes have a block each and pairs meet in the cell of their two blocks. A cell gets a class's set once, however
    many of its pairs it holds, so a dense group ships its sets a few times, not once per pair.
    """
    pairs = saved(pairs)
    sides = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = sets_of(sides.join(reps.select("rep", "id", "n", "f1", "f2"), "rep"), docs, "set", np.ndarray.tobytes)
    blocks = max(1, math.ceil((pairs.count() / CELL_PAIRS) ** 0.5))

    def block(column: str):
        return F.pmod(F.xxhash64(column), F.lit(blocks))

    dealt = pairs.withColumn("cell", block("a") * blocks + block("b"))
    needed = dealt.select(F.col("cell").alias("unit"), F.col("a").alias("rep")).union(dealt.select("cell", "b")).distinct()
    shipped = needed.join(sets, "rep")

    def check(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        held = {key: np.frombuffer(raw, "<u8") for key, raw in zip(known["rep"], known["set"])}
        good = []
        for a, b, n_a, n_b in zip(batch["a"], batch["b"], batch["n_a"], batch["n_b"]):
            both = len(np.intersect1d(held[a], held[b], assume_unique=True))
            good.append(100 * both >= percent * (n_a + n_b - both))
        return batch.loc[good, ["a", "b"]]

    return saved(dealt.groupBy("cell").cogroup(shipped.groupBy("unit")).applyInPandas(check, "a long, b long"))


def opened(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, rep, members, part) of the groups that hold several components yet."""
    home = classes.select(F.col("node").alias("rep"), "component_id")
    placed = groups.join(home, "rep", "left").select("g", "rep", "members", F.coalesce("component_id", "rep").alias("part"))
    ends = placed.groupBy("g").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return saved(placed.join(ends.where("low <> high").select("g"), "g", "left_semi"))


def near_duplicates(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id),
    text_hash (xxhash64 of the text, empty where it is null).

    Links are pairs with 100 * intersection >= percent * union of their full shingle sets; `percent` may not be
    below 75, for which the distance bound is made. Null, empty and blank texts have an empty set and link with
    nothing. Rows with a null id are not linked. Rows that repeat an id are rows of their own, linked by their own
    texts, and all of them that hold their component's smallest id are kept. An empty table gives no rows; texts are
    taken whole. Other columns are not read.
    """
    if percent < 75:
        raise ValueError("the signature distance is set for similarities of 75 percent or more")
    docs = frame.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = saved(sketch(frame, id_col, text_col))
    sets = known.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    reps = saved(sets.withColumn("rep", F.monotonically_increasing_id()))
    groups = groups_of(reps)
    narrow, wide = groups.where(F.col("members") <= NARROW), groups.where(F.col("members") > NARROW)
    one, two = narrow.alias("x"), narrow.alias("y")
    met = one.join(two, F.expr("x.g = y.g and x.rep < y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    links = linked(near(met, reps, percent), reps, docs, percent)
    classes = saved(components(links))
    rows = opened(wide, classes)
    members = rows.select("rep").distinct()
    bins = saved(sets_of(members.join(reps.select("rep", "id", "n", "f1", "f2"), "rep"), docs, "bins", _bins))
    tried, turn = None, 0
    while not rows.isEmpty():
        last = turn == ROUNDS
        units = block_pairs(rows) if last else single_blocks(rows, turn)
        pairs = compared(units, reps, bins, percent, None if last else NEAREST)
        pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = linked(pairs, reps, docs, percent)
        links = links.union(found)
        classes = saved(components(links))
        if last:
            break
        tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
        turn = turn + 1 if found.count() > WORTHWHILE * rows.select("rep").distinct().count() else ROUNDS
        rows = opened(wide, classes)

    parts = reps.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", "id", F.coalesce("component_id", "rep").alias("part"))
    least = parts.groupBy("part").agg(F.min("id").alias("home"))
    homes = parts.join(least, "part").select("n", "f1", "f2", "home")
    return (
        known.select("id", "text_hash", "n", "f1", "f2")
        .join(homes, ["n", "f1", "f2"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("home", "id")).alias("component_id"),
            "text_hash",
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def without_near_duplicates(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """`frame` without the rows that `near_duplicates` does not keep; rows with a null id stay. Rows that repeat an id
    are told apart by their texts."""
    gone = saved(near_duplicates(frame, id_col, text_col, percent).where(f"not kept and `{id_col}` is not null").select(F.col(id_col).alias("gone_id"), "text_hash").distinct())
    kept = frame.select(F.struct("*").alias("row"), F.col(id_col).alias("gone_id"), F.xxhash64(text_of(text_col)).alias("text_hash"))
    return kept.join(small(gone), ["gone_id", "text_hash"], "left_anti").select("row.*")
