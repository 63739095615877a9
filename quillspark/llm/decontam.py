"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A mask such as 11011 looks at some words of a span and ignores the others, so a passage keeps most of its seeds
when single words are substituted. Documents and benchmark items give one hash per mask and place; equal hashes are
hits, and a hit fixes how the item lies over the document. The masks leave a hit in every window that the check
accepts: 12 equal words of 15 stand in runs of which one has four words, or all four have three and 11011 fits over
two of them; shorter items have fewer substitutions. There the words are compared one by one: the item counts
as found where some window of `window` words (all words of a shorter item) agrees in `share` of its places.
An item of fewer than SPACED words has one seed, all its words, and is found where these stand.

The benchmark's hashes are broadcast while they are at most SMALL_ROWS (counted first); a larger benchmark is joined
by shuffle. Only ids and places of hits leave the first pass; only documents with hits are read again, and of these only
the words that an item is laid over go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

# The masks of the seeds.
SEEDS = ("1111", "11011")
#: Items of at least SPACED words are searched for by SEEDS, shorter ones by all their words.
WINDOW, SHARE, SPACED = 15, 0.8, 8
#: Rows of a side that may be broadcast (about 40 bytes each).
SMALL_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """A text's words: runs of letters, digits and non-ASCII characters, lower-cased."""
    plain = F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, number: int, mask: str) -> Column:
    """The mask's hash at every place; an empty array for texts shorter than its span."""
    looked = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    at = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda p: F.xxhash64(F.lit(number), *[F.get(hashes, p + i) for i in looked]),
    )
    return F.when(last >= 0, at).otherwise(F.array().cast("array<bigint>"))


def seeds(frame: DataFrame, id_col: str, text_col: str, name: str, masks: tuple[str, ...] = SEEDS) -> DataFrame:
    """(name, n, place, seed): every mask's hash at every place of every text, and the text's words."""
    hashed = frame.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name), word_hashes(text_of(text_col)).alias("h"))
    counted = hashed.withColumn("n", F.size("h"))
    each = counted.select(name, "n", F.posexplode(F.concat(*[_seeds(F.col("h"), int(m, 2), m) for m in masks])).alias("at", "seed"))
    # places count on over the masks in turn
    place, passed = None, F.lit(0)
    for mask in masks:
        own = F.greatest(F.col("n") - len(mask) + 1, F.lit(0))
        here = F.col("at") - passed
        place = F.when(here < own, here) if place is None else place.when(here < own, here)
        passed = passed + own
    return each.select(name, "n", place.alias("place"), "seed")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= SMALL_ROWS else frame


def without_ids(frame: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """`frame` without the rows whose id is in `ids` (one column of that name); rows with a null id stay."""
    ids = saved(ids.select(id_col).distinct())
    return frame.join(_small(ids, ids.count()), id_col, "left_anti").select(frame.columns)


def long_items(benchmark: DataFrame, text_col: str = "text", words: int = SPACED) -> DataFrame:
    """The items of at least `words` words."""
    return benchmark.where(F.size(words_of(text_of(text_col))) >= words)


def _best(item: Column, text: Column, shift: Column, place: Column, window: int) -> Column:
    """Struct of the best window's agreeing words, its size, and all agreeing words, for the item laid at `shift` of `text`, which
    is `place` of the document."""
    same = F.transform(item, lambda w, k: F.when(F.coalesce(F.when(shift + k >= 0, F.get(text, shift + k)) == w, F.lit(False)), 1).otherwise(0))
    size = F.least(F.size(item), F.lit(window))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.size(item) - size),
            lambda s: F.aggregate(F.slice(same, s + 1, size), F.lit(0), lambda total, x: total + x),
        )
    )
    return F.struct(best.alias("agreeing"), F.aggregate(same, F.lit(0), lambda t, x: t + x).alias("matched"), (-place).alias("back"), size.alias("size"))


def overlaps(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, share: float = SHARE,
) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, doc_word (where the item's first word lies, may
    be negative), n_agreeing and n_window (of the best window), n_matched (of the whole item), overlap.

    Null and empty texts and items without a word give nothing; rows with a null id are not searched; rows that repeat an
    id are searched as one document. Equal items each get their rows. Of several places, the one with most agreeing
    words counts, the earliest on ties. Other columns are not read.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), text_of(item_text_col).alias("words"))
    items = saved(items.withColumn("item_h", word_hashes(F.col("words"))).withColumn("size", F.size("item_h")).where("size > 0"))
    # the lengths of the short items, a handful: each is a mask of its own
    short = [r["size"] for r in items.where(F.col("size") < SPACED).select("size").distinct().collect()]
    found = []
    spaced = items.where(F.col("size") >= SPACED)
    if spaced.limit(1).count():
        found.append(_laid_overlaps(documents, spaced, id_col, text_col, window, share))
    if short:
        masks = tuple("1" * size for size in sorted(short))
        whole = items.where(F.col("size") < SPACED)
        probes = None
        for mask in masks:
            some = seeds(whole.where(F.col("size") == len(mask)), "item", "words", "item", (mask,)).select("item", "n", "seed")
            probes = some if probes is None else probes.unionAll(some)
        probes = saved(probes.distinct())
        hits = seeds(documents, id_col, text_col, "id", masks).select("id", "place", "seed").join(_small(probes, probes.count()), "seed")
        first = hits.groupBy("id", "item", "n").agg(F.min("place").alias("place"))
        best = F.struct(F.col("n").alias("agreeing"), F.col("n").alias("matched"), (-F.col("place")).alias("back"), F.col("n").alias("size"))
        found.append(first.select("id", "item", best.alias("best")))
    if not found:
        kinds = dict(documents.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
        return documents.sparkSession.createDataFrame([], f"{id_col} {kinds[0]}, {item_col} {kinds[1]}, doc_word long, n_agreeing long, n_window long, n_matched long, overlap double")
    top = found[0] if len(found) == 1 else found[0].unionAll(found[1])
    return top.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("best.back")).cast("long").alias("doc_word"),
        F.col("best.agreeing").cast("long").alias("n_agreeing"), F.col("best.size").cast("long").alias("n_window"),
        F.col("best.matched").cast("long").alias("n_matched"), (F.col("best.agreeing") / F.col("best.size")).alias("overlap"),
    )


def _laid_overlaps(documents: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int, share: float) -> DataFrame:
    """(id, item, best) of the accepted items of at least SPACED words, by spaced seeds."""
    probes = saved(seeds(items, "item", "words", "item").withColumnRenamed("place", "item_place").distinct())
    hits = seeds(documents, id_col, text_col, "id").select("id", "place", "seed").join(_small(probes, probes.count()), "seed")
    laid = saved(hits.select("id", "item", F.col("n").alias("size"), (F.col("place") - F.col("item_place")).alias("shift")).distinct())
    wanted = saved(laid.select("id").distinct())
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(_small(wanted, wanted.count()), "id", "left_semi").select("id", word_hashes(text_of("text")).alias("h"))
    # of a document only the words under the item leave the join
    under = F.slice("h", F.greatest("shift", F.lit(0)) + 1, F.greatest(F.col("size") + F.least("shift", F.lit(0)), F.lit(0)))
    both = laid.join(texts, "id").select("id", "item", "shift", under.alias("under"))
    both = both.join(_small(items.select("item", "item_h"), probes.count()), "item")  # an item has fewer words than seeds
    judged = both.select("id", "item", _best(F.col("item_h"), F.col("under"), F.least("shift", F.lit(0)), F.col("shift"), window).alias("best"))
    top = judged.groupBy("id", "item").agg(F.max("best").alias("best"))
    return top.where(F.col("best.agreeing") >= F.ceil(F.col("best.size") * F.lit(share)))
