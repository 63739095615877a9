"""The numbered operators against plain versions of the same rule, and the edge cases of the pipeline's stages."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, licenses, minhash, packing, sharding, tokens, toxicity, urls
from quillspark.llm.common import crc_bucket

from .test_llm_operators import docs, prose

tokenizers = pytest.importorskip("public_tokenizers")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_spans_equal_all_word_windows():
    """The least edit distance over all runs of words, for every notice, with insertions and deletions."""
    rng = random.Random(17)
    for _ in range(60):
        label = rng.choice(sorted(licenses.NOTICES))
        notice = rng.choice(licenses.NOTICES[label])
        broken = list(notice)
        for _ in range(rng.randint(0, licenses.allowed_errors(notice) + 1)):
            at = rng.randrange(1, len(broken) - 1)
            if rng.random() < 0.5:
                broken[at] = rng.choice(["", "e", "x"]) if broken[at] != " " else " "
            else:
                broken.insert(at, rng.choice("aeq"))
        words = licenses.normal_form(f"foo bar {''.join(broken)} baz qux").split()
        text = " ".join(words)
        k = licenses.allowed_errors(notice)
        best = min(edits(notice, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
        found = [s[3] for s in licenses.fuzzy_spans(text) if s[0] == label]
        if best <= k:
            assert found and min(found) <= best
        for name, start, end, errors, _ in licenses.fuzzy_spans(text):
            assert min(edits(n, text[start:end]) for n in licenses.NOTICES[name]) <= errors
            assert (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


def test_license_spans_of_neighbouring_notices():
    text = "creative commons attributon and creative commons attribution"
    assert [(s[1], s[2], s[3]) for s in licenses.fuzzy_spans(text)] == [(0, 27, 1), (32, 60, 0)]
    many = "all rights reservd " * 500
    assert len(licenses.fuzzy_spans(licenses.normal_form(many))) == 500


def test_license_base_places_equal_word_windows():
    rng = random.Random(2)
    for _ in range(50):
        words = [rng.choice(["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x"]) for _ in range(40)]
        places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(40) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        wanted = (len(places), min(starts, default=None), max(starts, default=None), sorted({label for _, label in places}))
        assert licenses.base_hits(" ".join(words)) == wanted


def test_url_model_on_hosts_that_its_table_does_not_hold():
    bad = "casino-win free-bets cheap-pills adult-zone spam-king ad-tracker jackpot-city pornhost".split()
    good = "gardeners mapmaker schoolbooks weathermap historian cookbook universities rivers newsroom musicians".split()
    assert not {*bad, *good} & {*urls.BLOCKED_HOSTS, *urls.ALLOWED_HOSTS}
    weights, bias = urls.trained()
    said = {h: urls.score_url(f"{h}.example.net", "/en/17", weights, bias) >= 0.5 for h in bad + good}
    assert sum(said[h] for h in bad) >= 6 and sum(not said[h] for h in good) >= 9


def test_token_spans_equal_the_encodings_own():
    encoding, sizes = tokens._encoding(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    for text in ["plain words here", "naïve café, 中文字符 and 🙂🙂!", "a\n\nb  c", "", "x" * 5000]:
        starts, stops = tokens.offsets(encoding, sizes, text)
        ids = encoding.encode_ordinary(text)
        whole, own = encoding.decode_with_offsets(ids)
        assert whole == text and starts.tolist() == own
        lows, highs = tokens.lines_of(text, width=7)
        for k, section in enumerate(tokens.attribute(starts, stops, lows, highs)):
            shared = [max(0, min(stops[k], h) - max(starts[k], low)) for low, h in zip(lows, highs)]
            assert section == (int(np.argmax(shared)) if shared and max(shared) else -1)


def test_kd_tree_equals_plain_weighted_medians(spark):
    """Few items of distinct values: the same recursion in Python gives the same shards."""
    rng = random.Random(5)
    rows = [(i, 0, rng.randint(1, 50), a, b) for i, (a, b) in enumerate(zip(rng.sample(range(4096), 60), rng.sample(range(0, 4096, 7), 60)))]
    frame = spark.createDataFrame(rows, "group long, part int, weight long, d0 long, d1 long")
    got = {r["group"]: r["shard"] for r in sharding.kd_tree(frame, ["d0", "d1"], 6, tolerance=0.0).collect()}

    def split(items, first, shards):
        if shards == 1:
            return {r[0]: first for r in items}
        w = np.array([r[2] for r in items], float)
        spread = []
        for d in (3, 4):
            v = np.array([r[d] for r in items], float)
            spread.append((w * v * v).sum() / w.sum() - ((w * v).sum() / w.sum()) ** 2)
        d = 3 if spread[0] >= spread[1] else 4
        items, left = sorted(items, key=lambda r: r[d]), shards // 2
        goal, at, cut = w.sum() * left / shards, 0, 0
        while cut < len(items) and at + items[cut][2] <= goal:
            at += items[cut][2]
            cut += 1
        if cut < len(items) and goal - at > at + items[cut][2] - goal:
            cut += 1
        return split(items[:cut], first, left) | split(items[cut:], first + left, shards - left)

    assert got == split(rows, 0, 6)


def test_widest_dimension_at_the_root(spark):
    rows = [(i, 0, 1, i * 40, i) for i in range(100)]
    frame = spark.createDataFrame(rows, "group long, part int, weight long, d0 long, d1 long").withColumn("node", F.lit(1))
    assert sharding._widest(frame, ["d0", "d1"]) == {1: "d0"} and sharding._widest(frame, ["d1", "d0"]) == {1: "d0"}


def test_small_groups_of_copies_stay_in_one_shard(spark, sf_dir):
    frame = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    placed = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sharding.shard(frame), "doc_id")
    per = placed.groupBy("text").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n"))
    assert per.where("shards > 1 and n <= 4").count() == 0


def test_kernel_equals_plain_subsequences():
    def plain(a, b):
        def features(word):
            codes, found = toxicity.letters(word), {}
            for i, j, k in itertools.combinations(range(len(codes)), 3):
                if k - i < toxicity.SPAN:
                    key = tuple(codes[[i, j, k]])
                    found[key] = found.get(key, 0) + toxicity.DECAY ** (k - i + 1)
            return found

        fa, fb = features(a), features(b)
        norm = lambda f: np.sqrt(sum(v * v for v in f.values()))
        return sum(v * fb.get(key, 0) for key, v in fa.items()) / norm(fa) / norm(fb)

    words = ["idiot", "id1ot", "ixdiot", "grbnik", "hello", "aaaa"]
    cut = [toxicity.letters(w) for w in words]
    got = toxicity.kernel(cut, cut)
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words], atol=1e-4)
    assert got[0, 2] > got[0, 4]


def test_long_witnesses_are_seen_through_their_best_window():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("bcfghjklm") for _ in range(n))
    bad = [noise(12) + "stupidity" for _ in range(40)]
    good = [noise(21) for _ in range(80)]
    table, bias = toxicity.fit_svm([w.encode() for w in bad], [w.encode() for w in good])
    value = lambda w: toxicity.word_scores([w.encode()], table, bias)[0]
    assert value(noise(12) + "stupidity") > 0 and value("stupidity") > 0 > value(noise(20))


def test_language_id_of_clear_words_of_three_languages(spark):
    rng = random.Random(19)
    stems = {"aa": "kri krono mak".split(), "bb": "sul selo vish".split(), "cc": "dorp zand wijk".split()}
    make = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["en", "ar", "it"]) for _ in range(n))
    rows = [(i, make(lang, 30), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, " ".join(make(x, 12) for x in stems), None, "x"), (901, None, "aa", "x"), (902, "12 34", "aa", "x"), (0, make("bb", 30), "bb", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, LANG_SURE string")
    got = langid.predict(frame, langid.train(frame), sure_out="sure").collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    mixed = by[900, rows[-4][1]]
    assert mixed["lang_score"] < 0.5 < 0.8 < mixed["sure"] and by[901, None]["sure"] == by[902, "12 34"]["sure"] == 0


@pytest.fixture(scope="module")
def stage_docs(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, "  "), (None, "some plain words"), (9004, None), (9005, "word " * 30_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.lit(3).cast("long")})
    again = given.where("doc_id < 5")
    return given.unionByName(more).unionByName(again).withColumns(
        {"gone_id": F.lit(7), "Text_Hash": F.lit("a"), "toxicity": F.lit("b"), "LANG_pred": F.lit("c"), "row": F.lit(1), "sequence_id": F.lit(1)}
    )


@pytest.mark.parametrize("stage", range(5))
def test_stage_keeps_rows_and_columns(spark, sf_dir, stage_docs, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, stage_docs, sf_dir)
    empty = run(spark, stage_docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0
    if name == "packing":
        per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
        assert per.where("n > 4096").count() == 0 and out.where("start = 0").count() == stage_docs.count()
        return
    assert out.schema == stage_docs.schema
    before = {(r["doc_id"], r["text"]): r["n"] for r in stage_docs.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    after = {(r["doc_id"], r["text"]): r["n"] for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert all(before[key] == n for key, n in after.items())  # rows stay whole, repeated ones too
    assert len(after) >= 0.6 * len(before)
    if name != "language_id":
        assert (None, "some plain words") in after and (9001, None) in after
    else:
        assert (9001, None) not in after and (None, "some plain words") in after


def test_models_do_not_depend_on_row_order(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one, two = (toxicity.train(d, marks) for d in (given, given.orderBy(F.desc("doc_id")).repartition(3)))
    assert (one["table"] is None) == (two["table"] is None)
    if one["table"] is not None:
        assert np.allclose(one["table"], two["table"], atol=1e-5)
    one, two = (langid.train(d.where(crc_bucket("doc_id", 3) != 1)) for d in (given, given.repartition(3)))
    assert np.allclose(one["ngrams"], two["ngrams"], atol=1e-4)


def test_packing_of_repeated_rows_and_empty_tables(spark):
    frame = docs(spark, ["a b c", None]).union(docs(spark, ["a b c", None]))
    path = tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(frame, path).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert packing.pack(frame.limit(0), path).count() == 0
    long = packing.pack(docs(spark, ["word " * 20_000, prose(random.Random(1), 10)]), path)
    assert long.where("doc_id = 0").agg(F.sum("length"), F.max("doc_tokens")).first()[:] == (20_001, 20_001)


def test_bins_in_slices_rule_out_what_all_at_once_do():
    rng = np.random.RandomState(0)
    bins = rng.randint(0, 2, (300, 1 << minhash.BIN_BITS)).astype(np.uint8)
    bins[rng.randint(0, 300, 40), rng.randint(0, 1 << minhash.BIN_BITS, 40)] = 255
    n = bins.sum(axis=1).astype(np.int64)
    i, j = rng.randint(0, 300, 9_000), rng.randint(0, 300, 9_000)
    fewer, most = np.minimum(n[i], n[j]), np.minimum(bins[i], bins[j]).sum(axis=1, dtype=np.int64)
    full = (bins[i] == 255).any(axis=1) & (bins[j] == 255).any(axis=1)
    most = np.where(full, fewer, np.minimum(most, fewer))
    wanted = most * 100 >= 40 * (n[i] + n[j] - most)
    assert 0 < wanted.sum() < len(wanted) and (minhash.could_link(i, j, n, bins, 40) == wanted).all()
    assert minhash.could_link(i[:0], j[:0], n, bins, 75).shape == (0,)


def test_language_fit_holds_few_arrays_of_its_words():
    """The driver's memory: about a dozen arrays of words x languages, whichever the number of transitions."""
    rng = np.random.RandomState(3)
    words = sorted({bytes(rng.randint(97, 123, rng.randint(2, 10)).astype(np.uint8)) for _ in range(3000)})
    chains = [rng.randint(0, len(words), 50).tolist() for _ in range(3000)]
    labels = [np.full(50, i % 4) for i in range(len(chains))]
    tracemalloc.start()
    langid._fit(chains, labels, words, rng.rand(len(words), 4), 4, chain=True, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15 * sum(map(len, chains)) * 4 * 8


def test_expected_transitions_are_the_same_in_slices(monkeypatch):
    rng = np.random.RandomState(6)
    lengths, move = np.array([9, 1, 14, 6]), rng.rand(3, 3)
    _, _, forward, backward, scores = langid.marginals(rng.rand(30, 3), lengths, move)
    place = np.setdiff1d(np.arange(30), np.cumsum(lengths) - lengths)
    whole = langid._moved(forward, backward, scores, move, place)
    monkeypatch.setattr(langid, "PAIRS", 4)
    assert (langid._moved(forward, backward, scores, move, place) == whole).all() and abs(whole.sum() - len(place)) < 1e-9
