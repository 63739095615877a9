"""Keyword search, dense search, rank fusion and what is done to ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms, table_key, token_estimate
from ..tables import saved

K1, B, RRF_K, POOL, LEXICAL_WEIGHT = 1.5, 0.75, 60, 50, 20.0
#: Rows and bytes of a side that may be broadcast.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def _bytes_of(frame: DataFrame) -> Column:
    """A row's bytes, about: texts and arrays by their length, anything else 8."""
    total = F.lit(8 * len(frame.columns))
    for name, kind in frame.dtypes:
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.aggregate(name, F.lit(0), lambda t, x: t + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith(("array", "map")):
            total = total + 16 * F.coalesce(F.size(name), F.lit(0))
    return total


def small(frame: DataFrame, bound: int = SMALL_ROWS, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """A broadcast hint where rows and bytes, measured first, are within bounds; else the frame as it is. Give it a written table
    where the frame is costly: measuring runs it."""
    seen = frame.limit(bound + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(_bytes_of(frame).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(frame) if seen["rows"] <= bound and seen["bytes"] <= most_bytes else frame


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of `size` words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, size)))


#: Windows of items that are looked for in the texts' own tasks, as a tree of words; more are joined by hashes.
MOST_WINDOWS = 500_000


def _tree(windows: list[tuple[str, ...]]) -> tuple[pa.Array, list[pa.Array], list[np.ndarray]]:
    """A tree of word sequences: the words; by depth the edges (parent's number times words, plus word) and the windows that end
    there (a window's place, or -1)."""
    words = {w: i for i, w in enumerate(dict.fromkeys(w for window in windows for w in window))}
    places = {window: i for i, window in enumerate(windows)}
    edges, ends, level = [], [], {(): 0}
    for depth in range(1, max(map(len, windows)) + 1):
        here = {window[:depth]: 0 for window in windows if len(window) >= depth}
        here = {start: i for i, start in enumerate(here)}
        edges.append(pa.array([level[start[:-1]] * len(words) + words[start[-1]] for start in here], pa.int64()))
        ends.append(np.array([places.get(start, -1) for start in here], np.int64))
        level = here
    return pa.array(list(words), pa.string()), edges, ends


def _held(tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, words) as (id, key): the distinct windows that each text holds, by place. Empty words are none."""

    def find(flat: pa.Array | np.ndarray, among: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(flat, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges, ends = tree.value
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
            word, doc = find(flat, words)[some], doc[some]
            at, node, found = np.arange(len(word)), np.zeros(len(word), np.int64), []
            for depth, (edge, end) in enumerate(zip(edges, ends)):
                inside = at + depth < len(word)
                at, node = at[inside], node[inside]
                fits = (word[at + depth] >= 0) & (doc[at + depth] == doc[at])
                at, node = at[fits], node[fits]
                node = find(pa.array(node * len(words) + word[at + depth]), edge)
                at, node = at[node >= 0], node[node >= 0]
                whole = end[node] >= 0
                found.append(np.stack([doc[at[whole]], end[node[whole]]]))
            row, key = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(key)], ["id", "key"])

    return held


def gold_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = 0.5, width: int = 5,
) -> DataFrame:
    """(item, doc, found, n): documents that hold at least `share` of an item's distinct windows of `width` words (of all its
    words where it has fewer), which makes them gold. The windows of all items are a tree of words that each task walks
    through its texts; beyond MOST_WINDOWS, windows of whole texts meet them by an equi-join of 64-bit hashes. Items
    without a word have no gold."""
    cut = lambda column: F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda w: w != "")
    asked = saved(items.select(F.col(item_col), cut(item_text_col).alias("words")).where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(width))))
    total = asked.agg(F.sum(F.size("words") - F.col("size") + 1)).first()[0]
    if total is None:
        return asked.select(item_col).crossJoin(docs.select(id_col).limit(0)).withColumns({"found": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    wanted, keys = _by_tree(docs, asked, id_col, text_col, item_col) if total <= MOST_WINDOWS else _by_hashes(docs, asked, id_col, cut(text_col), item_col)
    met = keys.join(small(saved(wanted)), "key").groupBy(item_col, id_col, "n").agg(F.count("*").alias("found"))
    return met.where(F.col("found") >= F.col("n") * share).select(item_col, id_col, "found", "n")


def _by_tree(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, n, key) of the items' windows and (doc, key) of those that texts hold, by a tree sent to the tasks."""
    rows, places = [], {}
    for item, words, size in asked.select(item_col, "words", "size").collect():  # MOST_WINDOWS words or so at most
        windows = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        rows += [(item, len(windows), places.setdefault(window, len(places))) for window in windows]
    spark, kinds = docs.sparkSession, dict(asked.dtypes)
    wanted = spark.createDataFrame(rows, f"{item_col} {kinds[item_col]}, n long, key long")
    tree = spark.sparkContext.broadcast(_tree(list(places)))
    texts = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+").alias("words"))
    return wanted, texts.mapInArrow(_held(tree), f"id {dict(docs.dtypes)[id_col]}, key long").withColumnRenamed("id", id_col)


def _by_hashes(docs: DataFrame, asked: DataFrame, id_col: str, words: Column, item_col: str) -> tuple[DataFrame, DataFrame]:
    """The same by 64-bit hashes of all windows of all texts."""
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # a window's words at most
    wanted = None
    for size in sizes:
        some = asked.where(F.col("size") == size).select(item_col, F.array_distinct(_windows(F.col("words"), size)).alias("keys"))
        some = some.select(item_col, F.size("keys").cast("long").alias("n"), F.explode("keys").alias("key"))
        wanted = some if wanted is None else wanted.unionAll(some)
    held = docs.select(id_col, words.alias("words"))
    return wanted, held.select(id_col, F.explode(F.array_distinct(F.concat(*[_windows(F.col("words"), size) for size in sizes]))).alias("key"))


def corpus_stats(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Chunks, average length in terms and distinct terms of a corpus, as one row."""
    terms = chunks.select(F.col(id_col), search_terms(F.col(text_col)).alias("terms"))
    sizes = terms.agg(F.count("*").alias("n_chunks"), F.avg(F.size("terms")).alias("avg_len"))
    vocabulary = terms.select(F.explode("terms").alias("term")).agg(F.countDistinct("term").alias("n_terms"))
    return sizes.crossJoin(vocabulary)  # one row each


def bm25(
    chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text", query_col: str = "query_id",
    query_text_col: str = "query", k1: float = K1, b: float = B, scope: DataFrame | None = None,
) -> DataFrame:
    """(query, chunk, score) of every chunk that shares a term with a query; a term counts once per query.

    The corpus statistics are those of all chunks even under a `scope` (a table of allowed chunk ids), which only
    filters postings. Texts are cut into terms once: the counts of the asked terms, and each chunk's length as the count
    of an empty term, are written, and the statistics come from there.
    """
    asked = saved(queries.select(F.col(query_col), F.explode(F.array_distinct(search_terms(F.col(query_text_col)))).alias("term")))
    wanted = small(asked.select("term").distinct().union(chunks.sparkSession.range(1).select(F.lit(""))))
    tokens = chunks.select(F.col(id_col), search_terms(F.col(text_col)).alias("terms"))
    each = tokens.select(id_col, F.size("terms").alias("len"), F.explode(F.array_append(F.coalesce("terms", F.array().cast("array<string>")), F.lit(""))).alias("term"))
    counted = saved(each.join(wanted, "term", "left_semi").groupBy("term", id_col, "len").agg(F.count("*").alias("tf")))
    corpus = counted.where("term = ''").agg(F.sum("tf").alias("n_chunks"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    postings = counted.where("term <> ''")
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    if scope is not None:
        postings = postings.join(scope.select(id_col), id_col, "left_semi")
    weighted = asked.join(frequency.crossJoin(corpus), "term")  # corpus is one row
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    matched = postings.join(small(weighted), "term")
    return matched.groupBy(query_col, id_col).agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def ranked(scores: DataFrame, query_col: str, id_col: str, n: int | None = None, digits: int = 9, score: str = "score") -> DataFrame:
    """Add rank 1.. per query: score (rounded) descending, then id; the first `n` where given."""
    order = Window.partitionBy(query_col).orderBy(F.round(score, digits).desc(), F.col(id_col))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= n) if n else out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; a zero norm divides by 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    def norm(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
        return F.when(length == 0, 1.0).otherwise(length)

    return dot / (norm(a) * norm(b))


def dense_top(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query_id",
    query_block: int = 2048, vector_block: int = 16384,
) -> DataFrame:
    """The k nearest vectors of each query (query, query_vec), exactly: score (cosine, six places) and rank.

    Blocks of queries meet blocks of vectors in a matrix product each, which gives its k best rows a query (with those
    that rounding may tie); one merge ranks them. Null vectors are left out; a zero norm counts as 1.
    """
    asked, held = saved(queries.where("query_vec is not null")), vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows, across = max(1, -(-asked.count() // query_block)), max(1, -(-held.count() // vector_block))
    left = asked.select(F.col(query_col).alias("q"), "query_vec", F.pmod(F.xxhash64(query_col), F.lit(rows)).alias("i"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<bigint>")))
    right = held.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(across))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, float) for v in column])
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm == 0, 1.0, norm)

    def best(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"q": one["q"].iloc[:0], "id": two["id"].iloc[:0], "sim": np.empty(0)})
        x, y, out = unit(one["query_vec"]), unit(two["vec"]), []
        for at in range(0, len(x), 256):
            s = x[at : at + 256] @ y.T
            least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            i, j = np.nonzero(s >= least[:, None] - 2e-6)
            out.append(pd.DataFrame({"q": one["q"].values[at + i], "id": two["id"].values[j], "sim": s[i, j]}))
        return pd.concat(out)

    kinds = dict(vectors.dtypes)[id_col], dict(queries.dtypes)[query_col]
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, f"q {kinds[1]}, id {kinds[0]}, sim double")
    scored = met.select(F.col("q").alias(query_col), F.col("id").alias(id_col), F.round("sim", 6).alias("score"))
    return ranked(scored, query_col, id_col, k)


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], query_col: str, id_col: str, k: int = RRF_K) -> DataFrame:
    """Fused score and rank of ids in weighted ranked lists (query, id, rank). Ties go to the place in the first list
    that holds the id, lists in order."""
    parts = [
        ranked_list.select(query_col, id_col, (F.lit(weight) / (k + F.col("rank"))).alias("part"), (F.lit(n * 1_000_000) + F.col("rank")).alias("seen"))
        for n, (ranked_list, weight) in enumerate(lists)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy(query_col, id_col).agg(F.sum("part").alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy(query_col).orderBy(F.round("score", 9).desc(), "seen", id_col)
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def keep_lexical_top(fused: DataFrame, lexical: DataFrame, n: int, limit: int, query_col: str, id_col: str) -> DataFrame:
    """Move the `n` best keyword hits that lie outside the first `limit` places into the last of these, in keyword
    order; everything else keeps its order."""
    top = lexical.where(F.col("rank") <= n).select(query_col, id_col, F.col("rank").alias("lexical_rank"))
    both = fused.join(top, [query_col, id_col], "left")
    missing = F.col("lexical_rank").isNotNull() & (F.col("rank") > limit)
    per_query = Window.partitionBy(query_col)
    marked = both.withColumn("missing", missing).withColumn("n_missing", F.count_if("missing").over(per_query))
    stays = F.sum(F.when(~F.col("missing"), 1).otherwise(0)).over(Window.partitionBy(query_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    slot = F.greatest(F.lit(0), F.lit(limit) - F.col("n_missing"))
    placed = marked.withColumn("stay", stays).withColumn(
        "key",
        F.when(F.col("missing"), F.struct(F.lit(1).alias("part"), F.col("lexical_rank").cast("long").alias("at")))
        .when(F.col("stay") <= slot, F.struct(F.lit(0).alias("part"), F.col("stay").cast("long").alias("at")))
        .otherwise(F.struct(F.lit(2).alias("part"), F.col("stay").cast("long").alias("at"))),
    )
    order = Window.partitionBy(query_col).orderBy("key")
    return placed.withColumn("new_rank", F.row_number().over(order)).select(query_col, id_col, "score", F.col("new_rank").alias("rank"))


def topic_boost(fused: DataFrame, hit: Column, query_col: str, bonus: float = 0.3, depth: int = 30) -> DataFrame:
    """Add bonus x the query's best score to the rows among its first `depth` where `hit` holds, and rank anew; equal
    scores keep their order."""
    best = F.max("score").over(Window.partitionBy(query_col))
    boosted = F.col("score") + F.when((F.col("rank") <= depth) & hit, bonus * best).otherwise(0.0)
    scored = fused.withColumn("boosted", boosted)
    order = Window.partitionBy(query_col).orderBy(F.round("boosted", 9).desc(), F.col("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order))


def first_per(frame: DataFrame, query_col: str, keys: list[str], limit: int) -> DataFrame:
    """The best row of each (query, keys), then the first `limit` per query, ranked anew."""
    first = frame.withColumn("r", F.row_number().over(Window.partitionBy(query_col, *keys).orderBy("rank"))).where("r = 1")
    again = first.withColumn("place", F.row_number().over(Window.partitionBy(query_col).orderBy("rank")))
    return again.where(F.col("place") <= limit).drop("r")


def fit_context(rows: DataFrame, query_col: str, id_col: str, text_col: str, budget: int, pool: int = POOL) -> DataFrame:
    """Passages that fit a token budget, best first: one that does not fit is skipped, the first is always kept.

    A fold over each query's ranked list, which `pool` bounds; a running sum would stop where this skips.
    """
    sized = rows.where(F.col("rank") <= pool).select(
        query_col, F.struct(F.col("rank").cast("int").alias("rank"), F.col(id_col).alias("id"), token_estimate(F.col(text_col)).alias("tokens")).alias("row")
    )
    lists = sized.groupBy(query_col).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    folded = F.aggregate(
        "rows", start,
        lambda state, row: F.when(
            (F.size(state["kept"]) == 0) | (state["used"] + row["tokens"] <= budget),
            F.struct((state["used"] + row["tokens"]).alias("used"), F.concat(state["kept"], F.array(row["rank"])).alias("kept")),
        ).otherwise(state),
    )
    chosen = lists.select(query_col, "rows", folded.alias("state"))
    kept = chosen.select(
        query_col, F.col("state.used").alias("used_tokens"),
        F.explode(F.filter("rows", lambda row: F.array_contains(F.col("state.kept"), row["rank"]))).alias("row"),
    )
    return kept.select(query_col, "used_tokens", F.col("row.id").alias(id_col), F.col("row.rank").alias("rank"), F.col("row.tokens").alias("tokens"))


def table_siblings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sibling_id): other pieces of the same table, same document, page, title and header."""
    tables = chunks.where("source_kind = 'table'").withColumn("key", table_key(F.col("text"))).where("key <> ''")
    left, right = tables.alias("l"), tables.alias("r")
    same = left.join(right, F.expr("l.doc_id = r.doc_id and l.page = r.page and l.key = r.key and l.chunk_id <> r.chunk_id"))
    return same.select(F.col("l.chunk_id").alias("chunk_id"), F.col("r.chunk_id").alias("sibling_id"))


def first_hits(hits: DataFrame, gold: DataFrame, query_col: str, page_col: str = "page", tolerance: int = 0) -> DataFrame:
    """Per query of `gold` the best rank of a retrieved page within `tolerance` of a gold page; null for a miss."""
    near = gold.alias("g").join(
        hits.alias("h"),
        F.expr(f"g.{query_col} = h.{query_col} and g.doc_id = h.doc_id and abs(g.{page_col} - h.{page_col}) <= {tolerance}"), "left",
    )
    return near.groupBy(F.col(f"g.{query_col}").alias(query_col)).agg(F.min("h.rank").alias("first_rank"))


def recall_and_mrr(first: DataFrame, slice_col: str, ks: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """n, recall at each k and MRR, overall (null slice) and per slice. A miss counts 0."""
    rates = [F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks]
    return first.rollup(slice_col).agg(F.count("*").alias("n"), *rates, F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def with_siblings(kept: DataFrame, siblings: DataFrame, query_col: str, id_col: str, budget: int) -> DataFrame:
    """Kept passages (query, id, rank, tokens) and those of their siblings (id, sibling_id, sibling_tokens) that fit the
    room left, each right after its own passage: (query, id, place). A sibling that does not fit is skipped; one that
    is there already is not added. A fold over each query's candidates, which its kept passages bound."""
    used = kept.groupBy(query_col).agg(F.sum("tokens").alias("used"), F.collect_set(id_col).alias("have"))
    asked = kept.join(siblings, id_col).select(
        query_col, F.struct(F.col("rank"), F.col("sibling_id"), F.col("sibling_tokens").cast("long").alias("tokens")).alias("c")
    )
    lists = used.join(asked.groupBy(query_col).agg(F.array_sort(F.collect_list("c")).alias("cs")), query_col)
    start = F.struct(F.col("used").alias("used"), F.col("have").alias("have"), F.filter("cs", lambda c: F.lit(False)).alias("added"))
    folded = F.aggregate(
        "cs", start,
        lambda state, c: F.when(
            ~F.array_contains(state["have"], c["sibling_id"]) & (state["used"] + c["tokens"] <= budget),
            F.struct((state["used"] + c["tokens"]).alias("used"), F.array_append(state["have"], c["sibling_id"]).alias("have"), F.array_append(state["added"], c).alias("added")),
        ).otherwise(state),
    )
    added = lists.select(query_col, F.explode(folded["added"]).alias("c")).select(query_col, F.col("c.sibling_id").alias(id_col), F.col("c.rank").alias("rank"), F.lit(1).alias("after"))
    every = kept.select(query_col, id_col, "rank", F.lit(0).alias("after")).unionByName(added)
    order = Window.partitionBy(query_col).orderBy("rank", "after", id_col)
    return every.select(query_col, id_col, F.row_number().over(order).alias("place"))
