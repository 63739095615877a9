"""A kept inverted index: postings written once, updated by document, searched exactly with block bounds.

Documents are dealt into ranges of a few dozen documents of like length; a range of a segment is a cell. A block holds a term's
postings in one cell, with the largest frequency and the smallest document length in it. BM25 rises with the one and
falls with the other, so the two bound a block's scores under any later statistics, and the sum over a query's terms
bounds every document of a cell. A search scores each query's most promising cells, takes the k-th score found as the bar,
and reads only the cells whose bound reaches it: a cell left out holds no better hit.

An index is a folder of segments and commits. An update writes a segment: blocks and forward rows of the changed documents,
changes of the document frequencies, and which earlier versions are dead. Its commit, written last, is one row that lists
the segments, so readers see all of an update or nothing. `compact` rewrites the living documents as one segment.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..tables import saved, shared_dir
from .retrieval import B, K1, small

#: Folders by term, documents of a cell (about), cells that a query scores before it has a bar.
BUCKETS, CELL_DOCS, FIRST_CELLS = 32, 48, 6


@dataclass(frozen=True)
class Index:
    """An open version of an index: its tables, the number of documents and their average length in terms."""

    path: str
    segments: tuple[str, ...]
    kind: str
    blocks: DataFrame
    forward: DataFrame
    frequency: DataFrame
    dead: DataFrame
    n_docs: int
    avg_len: float
    any_dead: bool


def _schemas(kind: str) -> dict[str, str]:
    """The tables of an index whose ids have the type `kind`."""
    return {
        "forward": f"id {kind}, len int, terms array<struct<term: string, tf: int>>, segment string, doc_bucket int",
        "blocks": f"term string, cell long, postings array<struct<id: {kind}, tf: int, len: int>>, n int, max_tf int, min_len int, segment string, bucket int",
        "frequency": "term string, df long", "sums": "n_docs long, len long", "dead": f"id {kind}, dead_segment string",
    }


def _latest(spark: SparkSession, path: str) -> tuple[int, list[str], str]:
    """Number, segments and type of ids of the last commit; 0 where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return 0, [], ""
    found = spark.read.schema("n long, segments array<string>, kind string").parquet(f"{path}/commits/*")
    row = found.orderBy(F.desc("n")).limit(1).collect()
    return (row[0]["n"], list(row[0]["segments"]), row[0]["kind"]) if row else (0, [], "")


def _commit(spark: SparkSession, path: str, n: int, segments: list[str], kind: str) -> None:
    """Two writers of the same number collide here: the folder may not be there."""
    row = spark.createDataFrame([(n, segments, kind)], "n long, segments array<string>, kind string")
    row.coalesce(1).write.mode("error").parquet(f"{path}/commits/{n:09d}")


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, terms): each document's terms with their frequencies. Of rows that repeat an id one with the most terms counts.

    Term lists are dealt by id once; the three aggregations after that stay where the rows are.
    """
    each = docs.select(F.col(id_col).alias("id"), F.coalesce(search_terms(F.col(text_col)), F.array().cast("array<string>")).alias("words"))
    sized = each.select("id", F.size("words").alias("len"), F.xxhash64("words").alias("version"), "words").repartition("id")
    tokens = sized.select("id", "len", "version", F.explode_outer("words").alias("term"))
    counted = tokens.groupBy("id", "len", "version", "term").agg(F.count("term").alias("tf"))
    # rows with the same text were counted together; how often is summed here, as inside the list it would be summed for every term
    rows = counted.groupBy("id", "len", "version").agg(
        F.array_sort(F.collect_list(F.when(F.col("tf") > 0, F.struct("term", "tf")))).alias("terms"), F.greatest(F.lit(1), F.sum("tf") / F.greatest(F.lit(1), "len")).cast("int").alias("times"),
    )
    best = rows.groupBy("id").agg(F.max_by(F.struct("len", "terms", "times"), F.struct("len", "version")).alias("d"))
    terms = F.transform("d.terms", lambda t: F.struct(t["term"].alias("term"), (t["tf"] / F.col("d.times")).cast("int").alias("tf")))
    return best.select("id", F.col("d.len").alias("len"), terms.alias("terms"))


def _write_segment(path: str, rows: DataFrame, old: DataFrame | None) -> str:
    """Write the segment of the documents `rows` (id, len, terms) that replace `old` (id, len, terms, segment)."""
    segment, spark = f"s-{uuid.uuid4().hex}", rows.sparkSession
    schemas = _schemas(dict(rows.dtypes)["id"])

    def write(frame: DataFrame, name: str, by: list[str]) -> None:
        frame.write.partitionBy(*by).parquet(f"{path}/{name}/segment={segment}")

    write(rows.withColumn("doc_bucket", _bucket("id")).repartition("doc_bucket"), "forward", ["doc_bucket"])
    forward = _read(spark, path, "forward", [segment], schemas)
    shards = max(1, -(-forward.count() // (CELL_DOCS * 8)))
    cell = F.least(F.floor(2 * F.log2(F.col("len") + 1)), F.lit(60)) * shards + F.pmod(F.xxhash64("id"), F.lit(shards))
    postings = forward.select("id", "len", cell.alias("cell"), F.explode("terms").alias("t")).select("*", "t.term", "t.tf")
    blocks = postings.groupBy("term", "cell").agg(
        F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("postings"), F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
    )
    dealt = blocks.withColumn("bucket", _bucket("term")).repartition("bucket", F.pmod(F.xxhash64("term", "cell"), F.lit(max(1, shards // 64))))
    write(dealt.sortWithinPartitions("bucket", "term", "cell"), "blocks", ["bucket"])
    change = forward.select(F.explode("terms.term").alias("term"), F.lit(1).alias("d"))
    sums = forward.select(F.lit(1).alias("n_docs"), "len")
    if old is not None:
        change = change.unionAll(old.select(F.explode("terms.term").alias("term"), F.lit(-1).alias("d")))
        sums = sums.unionAll(old.select(F.lit(-1).alias("n_docs"), -F.col("len")))
    dead = forward.limit(0) if old is None else old
    write(change.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0"), "frequency", [])
    write(sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")), "sums", [])
    write(dead.select("id", F.col("segment").alias("dead_segment")), "dead", [])
    return segment


def _read(spark: SparkSession, path: str, name: str, segments: list[str], schemas: dict[str, str]) -> DataFrame:
    places = [f"{path}/{name}/segment={s}" for s in segments]
    return spark.read.schema(schemas[name]).option("basePath", f"{path}/{name}").parquet(*places)


def build(docs: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """Write a new index of all of `docs` at `path`. Null ids are left out; a null text has no terms, but counts as a document."""
    spark = docs.sparkSession
    if _latest(spark, path)[0]:
        raise ValueError(f"{path} holds an index; update it")
    segment = _write_segment(path, _cut(docs.where(F.col(id_col).isNotNull()), id_col, text_col), None)
    _commit(spark, path, 1, [segment], dict(docs.dtypes)[id_col])
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """The last committed version. Later updates do not change it."""
    n, segments, kind = _latest(spark, path)
    if not n:
        raise ValueError(f"{path} holds no index")
    blocks, forward, frequency, sums, dead = (_read(spark, path, name, segments, _schemas(kind)) for name in ("blocks", "forward", "frequency", "sums", "dead"))
    total = sums.agg(F.sum("n_docs").alias("n"), F.sum("len").alias("len")).first()
    frequency = frequency.select("term", "df")
    if len(segments) > 1:
        frequency = frequency.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    dead = dead.select("id", F.col("dead_segment").alias("segment"))
    average = (total["len"] or 0) / total["n"] if total["n"] else 0.0
    return Index(path, tuple(segments), kind, blocks, forward, frequency, dead, total["n"] or 0, average, dead.limit(1).count() > 0)


def _living(index: Index) -> DataFrame:
    return index.forward.join(index.dead, ["id", "segment"], "left_anti") if index.any_dead else index.forward


def update(index: Index, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """Replace or add the documents `changed` and drop those whose ids `removed` (column `id_col`) holds. Work follows the
    number of these documents: their forward rows tell which frequencies change, and no block is rewritten."""
    spark = changed.sparkSession
    n, segments, _ = _latest(spark, index.path)
    if tuple(segments) != index.segments:
        raise ValueError("the index has been updated since it was opened")
    changed = changed.where(F.col(id_col).isNotNull())
    ids = changed.select(F.col(id_col).alias("id"))
    ids = saved((ids if removed is None else ids.unionAll(removed.select(F.col(id_col).alias("id")))).distinct().withColumn("doc_bucket", _bucket("id")))
    buckets = [r["doc_bucket"] for r in ids.select("doc_bucket").distinct().collect()]  # BUCKETS at most
    old = saved(_living(index).where(F.col("doc_bucket").isin(buckets)).join(small(ids.select("id")), "id", "left_semi").select("id", "len", "terms", "segment"))
    segment = _write_segment(index.path, _cut(changed, id_col, text_col), old)
    _commit(spark, index.path, n + 1, [*segments, segment], index.kind)
    return open_index(spark, index.path)


def compact(index: Index) -> Index:
    """Rewrite the living documents as the only segment."""
    spark = index.forward.sparkSession
    n, segments, _ = _latest(spark, index.path)
    if tuple(segments) != index.segments:
        raise ValueError("the index has been updated since it was opened")
    segment = _write_segment(index.path, _living(index).select("id", "len", "terms"), None)
    _commit(spark, index.path, n + 1, [segment], index.kind)
    return open_index(spark, index.path)


def _impact(index: Index, k1: float, b: float, tf: Column, length: Column) -> Column:
    """A posting's score over its term's weight."""
    relative = length / index.avg_len if index.avg_len else F.lit(0.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * relative))


def _scores(index: Index, wanted: DataFrame, k1: float, b: float, scope: DataFrame | None) -> DataFrame:
    """(query, id, score) of all documents in the wanted blocks (query, term, cell, segment, weight)."""
    hits = index.blocks.select("term", "cell", "segment", "postings").join(small(saved(wanted)), ["term", "cell", "segment"])
    each = hits.select("query", "segment", "weight", F.explode("postings").alias("p")).select("query", "segment", "weight", "p.id", "p.tf", "p.len")
    if index.any_dead:
        each = each.join(small(index.dead), ["id", "segment"], "left_anti")
    if scope is not None:
        each = each.join(small(scope), "id", "left_semi")
    return each.groupBy("query", "id").agg(F.sum(F.col("weight") * _impact(index, k1, b, F.col("tf"), F.col("len"))).alias("score"))


def search(
    index: Index, queries: DataFrame, k: int, query_col: str = "query_id", query_text_col: str = "query", id_col: str = "chunk_id",
    scope: DataFrame | None = None, k1: float = K1, b: float = B, first_cells: int = FIRST_CELLS,
) -> tuple[DataFrame, DataFrame]:
    """The `k` best documents of each query (query, id, score, rank: score rounded to nine places descending, then id), and what
    was read for it (query, n_cells, n_scored, n_postings, n_read). Exactly the rows of a search without bounds.

    A term counts once per query; a query without a term of the index gives no hits. Under a `scope` (ids in `id_col`) the
    statistics stay those of all documents.
    """
    spark = queries.sparkSession
    allowed = None if scope is None else saved(scope.select(F.col(id_col).alias("id")).distinct())
    asked = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(search_terms(F.col(query_text_col)))).alias("term"))
    asked = saved(asked.distinct())
    buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]  # BUCKETS at most
    idf = F.log(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = saved(index.frequency.join(small(asked), "term").select("query", "term", idf.alias("weight")))
    index = replace(index, blocks=index.blocks.where(F.col("bucket").isin(buckets)))
    heads = index.blocks.select("term", "cell", "segment", "n", "max_tf", "min_len").join(small(weights), "term")
    heads = saved(heads.withColumn("bound", F.col("weight") * _impact(index, k1, b, F.col("max_tf"), F.col("min_len"))))
    cells = saved(heads.groupBy("query", "cell", "segment").agg(F.sum("bound").alias("bound")))
    best_first = Window.partitionBy("query").orderBy(F.desc("bound"), "cell", "segment")
    first = saved(cells.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= first_cells).select("query", "cell", "segment"))
    keys = ["query", "cell", "segment"]
    block = heads.select("query", "term", "cell", "segment", "weight")
    early = saved(_scores(index, block.join(small(first), keys, "left_semi"), k1, b, allowed))
    by_score = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    bars = saved(early.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k).select("query", F.col("score").alias("bar")))
    open_cells = cells.join(small(bars), "query", "left").where("bar is null or bound >= bar - 1e-8").select(*keys)
    rest = saved(open_cells.join(small(first), keys, "left_anti"))
    late = _scores(index, block.join(small(rest), keys, "left_semi"), k1, b, allowed)
    ranked = early.unionAll(late).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    scored = first.unionAll(rest)
    read = heads.join(small(scored.withColumn("scored", F.lit(1))), keys, "left").groupBy("query").agg(
        F.count_distinct("cell", "segment").alias("n_cells"), F.count_distinct(F.when(F.col("scored") == 1, F.struct("cell", "segment"))).alias("n_scored"),
        F.sum("n").alias("n_postings"), F.sum(F.when(F.col("scored") == 1, F.col("n")).otherwise(0)).alias("n_read"),
    )
    hits = ranked.select(F.col("query").alias(query_col), F.col("id").alias(id_col), "score", "rank")
    return hits, read.withColumnRenamed("query", query_col)


def without_bounds(index: Index, queries: DataFrame, k: int, **named) -> DataFrame:
    """The same hits, every cell read: what tests and audits compare with."""
    return search(index, queries, k, first_cells=1 << 30, **named)[0]


#: Indexes of this application by what they were built from.
_KEPT: dict[tuple, Index] = {}


def version(spark: SparkSession, path: str) -> tuple:
    """Size, number and time of the files at `path`: another content is another version."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(place)
    return summary.getLength(), summary.getFileCount(), fs.getFileStatus(place).getModificationTime()


def kept_index(spark: SparkSession, table_path: str, id_col: str, text_col: str = "text") -> Index:
    """The index of a Parquet table, built at its first use in this application and read by all later ones, until the table
    changes."""
    key = (spark.sparkContext.applicationId, table_path, id_col, text_col, version(spark, table_path))
    if key not in _KEPT:
        docs = spark.read.parquet(table_path).select(id_col, text_col)
        _KEPT[key] = build(docs, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", id_col, text_col)
    return _KEPT[key]
