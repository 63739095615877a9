"""The corpus pipeline: toxicity, language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last return
the columns of `docs`. A stage's result is written as Parquet and read again as the next one's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, langid, minhash, packing, toxicity
from quillspark.llm.common import bounded_batches, crc_bucket, saved

#: Texts whose words are placed in a learned language with less than this probability, on average, are rejected.
LEAST_SURE = 0.5


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of toxicity 0.5 or more. Null and empty texts score like clean ones."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    name = _fresh(docs, "toxicity")
    return toxicity.score(docs, model, out_col=name).where(F.col(name) < 0.5).select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language: no letter (null and empty texts too), or words that the model cannot place.

    A document of clear words stays, however many languages it mixes. When no document has a language to learn from, nothing can be judged and all stay.
    """
    bounded_batches(spark)
    model = langid.train(docs.where(crc_bucket("doc_id", 3) != 1))
    if not model["langs"]:
        return docs
    lang, share, sure = (_fresh(docs, name) for name in ("lang_pred", "lang_score", "lang_sure"))
    tagged = langid.predict(docs, model, lang_out=lang, score_out=share, sure_out=sure)
    return tagged.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SURE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    bounded_batches(spark)
    return minhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item or a long part of one. Items of fewer than `decontam.SPACED` words
    remove nothing: so few words stand in clean documents, too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.overlaps(docs, decontam.long_items(benchmark))
    return decontam.without_ids(docs, found, "doc_id")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed into sequences of at most 4096 ids."""
    import public_tokenizers

    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
