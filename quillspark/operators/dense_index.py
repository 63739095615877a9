"""Dense search by inverted lists: k-means lists, residual bytes with a proven error, probes that widen until a bound closes.

Vectors are scaled to length 1. A list holds the vectors nearest to its centre c as bytes of x - c; each row states the length of
what the bytes lose, so a query's cosine is known within that error. No vector of a list can have a cosine above q.c + r, r being
the list's radius. A query reads lists by that bound, twice as many each round, until the bound of the next is below its k-th
best; what may be among the k best is then compared exactly. The result is that of a search of all vectors, unless `most_lists`
stops a query before: then the recall is measured, and too low a recall is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved
from .retrieval import cosine, dense_top, ranked, small

#: Vectors that centres are fitted on for each list, lists at most; rows of a slice of a list, queries that meet it at once.
SAMPLE_A_LIST, MOST_LISTS, SLICE, BLOCK = 128, 2048, 8192, 1024
#: Scores are compared at six places.
MARGIN = 2e-6


@dataclass(frozen=True)
class Lists:
    """A built index: centres (at most MOST_LISTS), and a written table (list, slice, id, code, scale, error)."""

    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    rows: DataFrame
    vectors: DataFrame


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in column])
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, seed: int = 7) -> Lists:
    """Lists of all vectors that are not null (equally long, finite). Centres are fitted on a bounded sample."""
    held = saved(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    total = held.count()
    lists = max(1, min(MOST_LISTS, total, lists or round(total**0.5)))
    share = min(1.0, SAMPLE_A_LIST * lists / max(1, total))
    if total:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x))
        scaled = held.select(F.when(norm == 0, F.col("vec")).otherwise(F.transform("vec", lambda x: x / norm)).alias("vec"), "id")
        some = saved(scaled.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) <= int(share * (1 << 20))).select(array_to_vector("vec").alias("features")))
        some = some if some.limit(1).count() else scaled.select(array_to_vector("vec").alias("features"))
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=10, initSteps=2).fit(some).clusterCenters())
    else:
        centres = np.zeros((1, 1))
    spread = held.sparkSession.sparkContext.broadcast(centres)

    def deal(batches):
        c = spread.value
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.iloc[low : low + 2048]
                x = _unit(part["vec"])
                at = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
                rest = x - c[at]
                scale = np.abs(rest).max(axis=1) / 127
                code = np.rint(rest / np.where(scale == 0, 1.0, scale)[:, None]).astype(np.int8)
                lost = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
                yield pd.DataFrame({"list": at.astype("int32"), "id": part["id"].values, "code": [r.tobytes() for r in code], "scale": scale, "error": lost, "far": np.sqrt((rest**2).sum(axis=1))})

    kind = dict(held.dtypes)["id"]
    dealt = saved(held.mapInPandas(deal, f"list int, id {kind}, code binary, scale double, error double, far double"))
    about = {r["list"]: (r["n"], r["far"]) for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # MOST_LISTS at most
    sizes, radius = (np.array([about.get(i, (0, 0.0))[j] for i in range(len(centres))], float) for j in (0, 1))
    slices = F.get(F.array(*[F.lit(int(-(-n // SLICE)) or 1) for n in sizes]), F.col("list"))
    return Lists(centres, radius + 1e-9, sizes, dealt.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).drop("far"), held)


def _probes(index: Lists, open_: DataFrame, low: int, high: int) -> DataFrame:
    """(q, query_vec, bar, list, slice, block) of each open query's lists from `low` to `high` by bound, as far as they reach its bar."""
    centres, radius, sizes = index.centres, index.radius, index.sizes

    def choose(batches):
        for batch in batches:
            x = _unit(batch["query_vec"])
            bound = x @ centres.T + radius[None, :]
            bound[:, sizes == 0] = -np.inf
            order = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
            reach = np.take_along_axis(bound, order, 1)
            i, j = np.nonzero((reach > -np.inf) & (reach >= batch["bar"].to_numpy(float)[:, None] - MARGIN))
            lists = order[i, j]
            counts = np.maximum(1, -(-sizes[lists].astype(int) // SLICE))
            i, lists = np.repeat(i, counts), np.repeat(lists, counts)
            piece = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.empty(0, int)
            yield pd.DataFrame({"q": batch["q"].values[i], "query_vec": pd.Series([batch["query_vec"].values[m] for m in i], dtype=object), "bar": batch["bar"].values[i], "list": lists.astype("int32"), "slice": piece.astype("int32")})

    kind = dict(open_.dtypes)
    rows = open_.select("q", "query_vec", "bar").mapInPandas(choose, f"q {kind['q']}, query_vec {kind['query_vec']}, bar double, list int, slice int")
    return rows


def search(
    index: Lists, queries: DataFrame, k: int, query_col: str = "query_id", id_col: str = "vec_id", first_lists: int = 4, most_lists: int | None = None,
    least_recall: float = 0.9, audited: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """The `k` nearest vectors of each query (query, query_vec): (query, id, score: cosine at six places, rank; ties by id), and
    what was read for it (query, n_lists, n_vectors). With `most_lists` a query reads no more lists than these; the recall over
    about `audited` queries is then compared with a search of all vectors, and one under `least_recall` raises."""
    asked = saved(queries.where("query_vec is not null").select(F.col(query_col).alias("q"), F.col("query_vec").cast("array<double>").alias("query_vec")))
    kinds = dict(index.rows.dtypes)["id"], dict(asked.dtypes)["q"]
    centres, low, width = index.centres, 0, first_lists
    end = len(centres) if most_lists is None else min(most_lists, len(centres))
    end = end if index.sizes.sum() else 0
    open_ = asked.withColumn("bar", F.lit(-2.0))
    seen, read = [], []

    def meet(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": one["q"].iloc[:0], "id": two["id"].iloc[:0], "low": np.empty(0), "high": np.empty(0)})
        x, centre = _unit(one["query_vec"]), centres[int(key[0])]
        rest = np.frombuffer(b"".join(two["code"]), np.int8).reshape(len(two), -1) * two["scale"].to_numpy()[:, None]
        lost, out = two["error"].to_numpy(), []
        for at in range(0, len(x), BLOCK):
            near = (x[at : at + BLOCK] @ centre)[:, None] + x[at : at + BLOCK] @ rest.T
            floor = near - lost[None, :]
            bar = one["bar"].to_numpy()[at : at + BLOCK]
            if floor.shape[1] >= k:
                bar = np.maximum(bar, np.partition(floor, floor.shape[1] - k, axis=1)[:, floor.shape[1] - k])
            i, j = np.nonzero(near + lost[None, :] >= bar[:, None] - MARGIN)
            out.append(pd.DataFrame({"q": one["q"].values[at + i], "id": two["id"].values[j], "low": floor[i, j], "high": near[i, j] + lost[j]}))
        return pd.concat(out)

    while low < end:
        probes = saved(_probes(index, open_, low, min(low + width, end)))
        if not probes.limit(1).count():
            break
        met = probes.groupBy("list", "slice").cogroup(index.rows.groupBy("list", "slice")).applyInPandas(meet, f"q {kinds[1]}, id {kinds[0]}, low double, high double")
        seen.append(saved(met))
        read.append(probes.groupBy("q").agg(F.count_distinct("list").alias("n_lists")))
        every = seen[0]
        for more in seen[1:]:
            every = every.unionAll(more)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "id"))
        bars = saved(every.withColumn("place", place).where(F.col("place") == k).select("q", F.col("low").alias("bar")))
        open_ = saved(asked.join(small(bars), "q", "left").select("q", "query_vec", F.coalesce("bar", F.lit(-2.0)).alias("bar")))
        low, width = low + width, 2 * width
    if not seen:
        none = asked.limit(0).select(F.col("q").alias(query_col), F.lit(None).cast(kinds[0]).alias(id_col), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return none, none.select(query_col, F.lit(0).cast("long").alias("n_lists"))
    close = every.join(small(open_.select("q", "bar")), "q").where(F.col("high") >= F.col("bar") - MARGIN).select("q", "id").distinct()
    exact = close.join(index.vectors, "id").join(small(asked), "q")
    scored = exact.select(F.col("q").alias(query_col), F.col("id").alias(id_col), F.round(cosine(F.col("query_vec"), F.col("vec")), 6).alias("score"))
    hits = ranked(scored, query_col, id_col, k)
    lists = read[0]
    for more in read[1:]:
        lists = lists.unionAll(more)
    lists = lists.groupBy(F.col("q").alias(query_col)).agg(F.sum("n_lists").alias("n_lists"))
    if most_lists is not None and most_lists < len(centres):
        hits = saved(hits)
        found = recall(index, asked, hits, k, query_col, id_col, audited)
        if found < least_recall:
            raise ValueError(f"recall {found:.3f} is under {least_recall}: read more lists")
    return hits, lists


def recall(index: Lists, asked: DataFrame, hits: DataFrame, k: int, query_col: str, id_col: str, audited: int = 64) -> float:
    """The share of the `k` nearest vectors that `hits` has, over about `audited` queries (by a hash of their ids)."""
    total = asked.count()
    some = saved(asked.where(F.pmod(F.xxhash64(F.lit(3), "q"), F.lit(1 << 20)) <= min(1.0, audited / max(1, total)) * (1 << 20)))
    true = dense_top(index.vectors, some.withColumnRenamed("q", query_col), k, "id", "vec", query_col)
    both = true.join(hits.select(query_col, F.col(id_col).alias("id"), F.lit(1).alias("hit")), [query_col, "id"], "left")
    row = both.agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
