"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, licenses, minhash, neighbours, packing, phrases, sharding, tokens, toxicity, urls, variants
from .common import crc_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and fuzzy notices of every document."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    fuzzy = F.transform("spans", lambda s: s["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", fuzzy)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "spans",
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every vector."""
    return neighbours.near_duplicates(_table(spark, sf_dir, "embeddings"))[0]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by line."""
    import public_tokenizers

    return tokens.section_tokens(
        _table(spark, sf_dir, "documents"), _tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose remainder is not 1."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_bucket("doc_id", 3) != 1))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels whose remainder is not 0."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_bucket("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language in all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the lexicon and decoded again, as digests."""
    docs, tokenizer = _table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json")
    lexicon = bpe.publish(spark, bpe.fit_lexicon(docs, tokenizer))
    return bpe.encode(docs, tokenizer, lexicon, decoded=True).select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_license_scans, op2_embedding_dedup, op3_url_filters, op4_packing, op5_minhash_dedup, op6_token_counts, op7_language_id, op8_decontamination, op9_sharding, op10_toxicity, op11_phrase_collocations, op12_spelling_variants, op13_bpe_encoding)}
_WORDS = r"list_filter(string_split(regexp_replace(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"


#: The definition, without seeds: every item laid over every document at every shift that gives equal words.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, ws, len(ws) AS size, CASE WHEN len(ws) < {decontam.SPACED} THEN len(ws) ELSE least(len(ws), {decontam.WINDOW}) END AS n,
    CASE WHEN len(ws) < {decontam.SPACED} THEN len(ws) ELSE ceil(least(len(ws), {decontam.WINDOW}) * {decontam.SHARE}) END AS least_agreeing
  FROM (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL) WHERE len(ws) > 0),
b AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM i),
laid AS (SELECT doc_id, item_id, p - k AS shift, list(k) AS ks, count(*) AS matched FROM d JOIN b USING (w) GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, shift, n, matched, least_agreeing,
    list_max(list_transform(ks, lambda s: len(list_filter(ks, lambda k: k >= s AND k < s + n)))) AS agreeing
  FROM laid JOIN i USING (item_id) WHERE matched >= least_agreeing),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, matched DESC, shift) AS r FROM best)
SELECT doc_id, item_id, CAST(shift AS BIGINT) AS doc_word, CAST(agreeing AS BIGINT) AS n_agreeing, CAST(n AS BIGINT) AS n_window,
  CAST(matched AS BIGINT) AS n_matched, CAST(agreeing AS DOUBLE) / n AS overlap
FROM ranked WHERE r = 1 AND agreeing >= least_agreeing
"""

_LONGEST, _FREQUENT = phrases.LONGEST, phrases.LEAST
#: Plain counting of all phrases; unary paths by recursion from their first edges.
OP11_SQL = rf"""
WITH RECURSIVE t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, ws, unnest(range(len(ws) - size + 1)) AS i FROM w, (SELECT unnest(range(1, {_LONGEST + 1})) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, size, array_to_string(ws[i + 1:i + size], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {_FREQUENT}),
part AS (SELECT *, string_split(phrase, ' ') AS ps FROM f),
cut AS (SELECT lang, phrase, size, a, k, array_to_string(ps[1:k], ' ') AS first_part, array_to_string(ps[k + 1:size], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM part WHERE size > 1)),
scored AS (SELECT cut.lang, cut.phrase, cut.size, cut.a, n, k, x.a AS l, y.a AS r, (CAST(1000 AS HUGEINT) * cut.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first_part JOIN f y ON y.lang = cut.lang AND y.phrase = rest JOIN total ON total.lang = cut.lang),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ps[1:size - 1], ' '), array_to_string(ps[2:size], ' ')]) AS phrase FROM part WHERE size > 2) GROUP BY lang, phrase),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, low.phrase) AS rank FROM low LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR most < low.a),
step AS (SELECT e.lang, e.phrase AS edge, x.phrase AS onward FROM part e JOIN part v ON v.lang = e.lang AND v.size = {_LONGEST - 1} AND v.a = e.a AND v.ps = e.ps[2:{_LONGEST}]
  JOIN part x ON x.lang = e.lang AND x.size = {_LONGEST} AND x.a = v.a AND x.ps[1:{_LONGEST - 1}] = v.ps WHERE e.size = {_LONGEST}),
chain AS (SELECT lang, edge AS head, edge, 1 AS i FROM step WHERE (lang, edge) NOT IN (SELECT (lang, onward) FROM step)
  UNION ALL SELECT chain.lang, head, onward, i + 1 FROM chain JOIN step ON step.lang = chain.lang AND step.edge = chain.edge),
path AS (SELECT lang, edge AS phrase, max(i) OVER (PARTITION BY lang, head) + {_LONGEST - 1} AS path_words FROM chain)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(coalesce(path_words, size) AS BIGINT) AS path_words
FROM ranked LEFT JOIN path USING (lang, phrase) WHERE rank <= {phrases.TOP}
"""

ORACLES: dict[str, str] = {"op8_decontamination": OP8_SQL, "op11_phrase_collocations": OP11_SQL}
