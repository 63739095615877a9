"""The numbered operators against brute force on small tables, with nulls, empty texts, repeats and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, decontam, langid, licenses, minhash, neighbours, packing, sharding, tokens, toxicity, urls

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, id int, word string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "extra") for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def test_license_base_phrases_and_fuzzy_spans(spark):
    texts = ["x All Rights Reserved. cc-by CC BY", None, "", "licensd under the apache licence, version 2.0", "clean words only", "all rights, reserved"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"]) == (8, 3, 1, 6)
    assert rows[0]["base_labels"] == ["cc-by", "reserved"]
    assert rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[1]["first_word"] is None
    assert {s["label"] for s in rows[3]["spans"]} == {"apache"} and all(s["errors"] >= 1 for s in rows[3]["spans"])
    assert rows[4]["spans"] == [] and rows[5]["n_base"] == 1


def test_license_seeds_miss_nothing():
    import regex

    rng = random.Random(3)
    for _ in range(40):
        label = rng.choice(sorted(licenses.NOTICES))
        notice = rng.choice(licenses.NOTICES[label])
        k = licenses.allowed_errors(notice)
        broken = list(notice)
        for at in rng.sample(range(len(notice)), k):
            broken[at] = "q"
        text = licenses.normal_form("foo bar " + "".join(broken) + " baz")
        if regex.search(f"(?:{regex.escape(notice, literal_spaces=True)}){{s<={k}}}", text):
            assert label in {s[0] for s in licenses.fuzzy_spans(text)}


def test_urls(spark):
    given = ["https://WWW.Example.com/en/1?x", "http://a.net/es/9", "nonsense", None, "http://casino-win.example.org/en/1", "http://xnet/es/", "http://example.com"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(frame).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.net", "/es/9", "net/es/", "block")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == (None, "block") and got[5][2] is None and got[6][1:3] == ("", None)
    for i, url in enumerate(given):
        assert urls.split_url(url) == got[i][:2]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7), (None, 4)]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component_id"] for r in components.components(frame).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}
    assert components.components(frame.limit(0)).count() == 0


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", "  ", "one two", "ONE two", "x " * 400, prose(rng, 2000)]
    for _ in range(6):
        base = prose(rng, 120).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    home = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    home[i] = min(home[i], home[j])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == home
    assert all(got[i]["kept"] == (home[i] == i) for i in range(len(texts)))


@pytest.fixture
def task_groups(monkeypatch):
    """Rows of the largest task group of each grouped map."""
    from pyspark.sql.group import GroupedData

    seen, plain = [], GroupedData.applyInPandas

    def counted(self, f, schema):
        seen.append((self.count().agg(F.sum("count"), F.max("count")).first()))
        return plain(self, f, schema)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    return seen


def test_large_groups_are_dealt_in_small_task_groups(spark, monkeypatch, task_groups):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "CELL_ROWS", 32)
    rng = random.Random(4)
    base = prose(rng, 60).split()
    texts = [" ".join(base[:at] + [f"new{at}"] + base[at + 1 :]) for at in range(1, 59)] * 2
    texts = [f"{t} tail{i}" for i, t in enumerate(texts)]
    frame = docs(spark, texts)
    reps = minhash.sketch(frame, "doc_id", "text").withColumn("rep", F.col("id"))
    bins = minhash.sets_of(reps.select("rep", "id", "n", "f1", "f2"), frame.select(F.col("doc_id").alias("id"), "text"), "bins", minhash._bins)

    def dealt(part, units):
        rows = reps.select(F.lit(5).cast("long").alias("g"), "rep", F.lit(len(texts)).cast("long").alias("members"), part.cast("long").alias("part"))
        return {(r["a"], r["b"]) for r in minhash.compared(units(rows), reps, bins, 75).collect()}

    everything = dealt(F.col("rep"), minhash.block_pairs)  # 15 blocks of about 8 members
    total, most = task_groups.pop()
    assert total > 1500 and most <= 160 and len(everything) > 1000
    odd = dealt(F.when(F.col("rep") == 3, 3).otherwise(0), minhash.block_pairs)  # one odd member: the others' blocks do not meet
    assert odd == {pair for pair in everything if 3 in pair} and task_groups.pop()[0] <= 2 * len(texts)
    some = dealt(F.col("rep"), lambda rows: minhash.single_blocks(rows, 1))
    assert some < everything and task_groups.pop()[0] == len(texts)


def test_signature_keys_are_made_by_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "KEYED_ROWS", 50)
    sigs = np.random.RandomState(8).randint(0, 65536, (1000, minhash.SYMBOLS)).astype("<u2")
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "rep long, sig binary").coalesce(1)
    rows = minhash.index_keys(reps).withColumn("task", F.spark_partition_id()).collect()
    tasks = Counter(r["task"] for r in rows)
    assert len(tasks) >= 15 and max(tasks.values()) <= 100 * minhash.SYMBOLS
    expected = minhash._chunk_keys(sigs)
    assert len(rows) == expected.size and {(r["key"], r["rep"]) for r in rows} == {(int(k), i) for i, keys in enumerate(expected) for k in keys}


def test_units_of_two_blocks_lose_no_pair():
    rng = np.random.RandomState(3)
    sigs = np.tile(rng.randint(0, 65536, minhash.SYMBOLS).astype("<u2"), (40, 1))
    n, bins, sides = np.full(40, 9), np.full((40, 256), 255, np.uint8), np.arange(40) % 2
    for parts in (np.where(sides == 0, np.arange(40) % 3, 1), np.where(sides == 1, np.arange(40) % 3, 2), np.zeros(40, int), np.arange(40)):
        i, j = minhash.near_in_unit(sigs, n, bins, parts, sides, True, 75)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2) if parts[a] != parts[b]}
        i, j = minhash.near_in_unit(sigs, n, bins, parts, sides * 0, False, 75)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(40) for b in range(a + 1, 40) if parts[a] != parts[b]}


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, b + " z"), (4, "something else entirely"), (None, a), (5, a), (5, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True), (None, None, False), (5, 1, False), (5, 1, False)], key=str)
    left = minhash.without_near_duplicates(frame.withColumn("TEXT_HASH", F.lit(1))).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, a), (1, b), (4, "something else entirely"), (None, a)], key=str)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_minhash_recall_on_planted_copies(spark):
    """Two thousand documents with groups of near copies, against all pairs that share a shingle."""
    rng = random.Random(31)
    texts = []
    while len(texts) < 2000:
        base = prose(rng, rng.randint(20, 200)).split()
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 999)}"
            texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    holders, common = {}, {}
    for i, s in enumerate(sets):
        for x in s:
            for j in holders.setdefault(x, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[x].append(i)
    home = list(range(len(texts)))
    links = [(i, j) for (i, j), n in common.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    for _ in range(20):
        for i, j in links:
            home[i] = home[j] = min(home[i], home[j])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    right = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 2000 and right >= 0.99 * len(links) and sum(got[i] == home[i] for i in got) >= 0.99 * len(got)


def test_dense_components_are_dealt_in_small_groups(spark, monkeypatch, task_groups):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rows = [(1, i, [1.0, i / 10000], 1) for i in range(120)]
    members = spark.createDataFrame(rows, "component_id long, rep long, vec array<float>, copies long")
    counted = {r["rep"]: r["n_links"] for r in neighbours.link_counts(members, 0.98).collect()}
    total, most = task_groups.pop()
    assert counted == dict.fromkeys(range(120), 119) and total == 120 * 15 and most <= 160


def test_bins_never_rule_out_a_link():
    rng = random.Random(5)
    for _ in range(50):
        base = [rng.getrandbits(64) for _ in range(200)]
        a, b = sorted(set(base[:180])), sorted(set(base[10:200]))
        bins = np.stack([np.frombuffer(minhash._bins(np.array(s, np.uint64)), np.uint8) for s in (a, b)])
        both = len(set(a) & set(b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert minhash.could_link(np.array([0]), np.array([1]), np.array([len(a), len(b)]), bins, 75)[0]


def test_neighbours_equal_brute_force(spark):
    rng = np.random.RandomState(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in v.astype(np.float32)], i % 2) for i, v in enumerate(base)]
    for i in range(40):
        v = (base[i % 7] + 0.05 * rng.standard_normal(16)).astype(np.float32)
        rows.append((100 + i, [float(x) for x in v], (i % 7) % 2))
    rows += [(200, rows[0][1], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] * 16, 1), (204, rows[1][1], None), (205, [None] * 16, 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vec string")
    good = [r for r in rows if r[0] < 201]
    x = np.array([r[1] for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(good), dtype=bool)
    ids = np.array([r[0] for r in good])
    home = ids.copy()
    for _ in ids:
        home = np.array([min([home[i], *home[link[i]]]) for i in range(len(ids))])
    found, figures = neighbours.near_duplicates(frame)
    got = {r["vec_id"]: r for r in found.collect()}
    assert [got[i]["n_links"] for i in ids] == link.sum(axis=1).tolist() and [got[i]["component_id"] for i in ids] == home.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(201, 206)) and figures["recall"] >= 0.9


def test_saturated_lists_hide_no_link(spark, monkeypatch):
    """Tight groups whose members fill each other's lists, linked with each other, without the audit's repair."""
    monkeypatch.setattr(neighbours, "audit", lambda reps, *_: reps.sparkSession.createDataFrame([], "a long, b long"))
    rng = np.random.RandomState(6)
    step = np.arccos(0.985)
    x = np.zeros((160, 16))
    for i in range(160):
        place = (0, 1, 2, 6)[i % 4]  # a chain of three groups and one apart
        x[i, :2] = np.cos(place * step), np.sin(place * step)
    x = (x + 1e-3 * rng.standard_normal(x.shape)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & ~np.eye(160, dtype=bool)
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(frame)[0].collect()}
    assert [got[i]["component_id"] for i in range(160)] == [3 if i % 4 == 3 else 0 for i in range(160)]
    assert [got[i]["n_links"] for i in range(160)] == link.sum(axis=1).tolist()


def test_descent_finds_what_the_start_graph_misses(spark, monkeypatch):
    """One table alone, without the audit's repair: buckets cut the pairs apart, neighbours' neighbours join them."""
    monkeypatch.setattr(neighbours, "audit", lambda reps, *_: reps.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(neighbours, "TABLES", 1)
    for name, value in {"BUCKET": 16, "WAYS": 8, "EXPLORED": 4, "ROUNDS": 7}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.RandomState(8)
    x = np.concatenate([c + 0.09 * rng.standard_normal((7, 16)) * np.linalg.norm(c) / 4 for c in rng.standard_normal((40, 16))])
    x = x.astype(np.float32)
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    reps = frame.select(F.col("vec_id").alias("rep"), "label", F.col("embedding").alias("vec"), F.size("embedding").alias("size"))
    vectors = neighbours.coded(reps).withColumn("part", F.col("rep"))
    start = {(min(r["src"], r["dst"]), max(r["src"], r["dst"])) for r in neighbours.start_graph(vectors, 0.98).where("may").collect()}
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(link)) if i < j}
    assert len(start) < 0.85 * len(true)
    found = sum(r["n_links"] for r in neighbours.near_duplicates(frame)[0].collect()) // 2
    assert 0.97 * len(true) <= found <= len(true)


def test_repeated_vector_ids_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.0], 0), (4, [1.0, 1.0], 0), (5, [-1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(frame)[0].collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    assert neighbours.near_duplicates(frame.limit(0))[0].count() == 0


def test_bytes_never_rule_out_a_link():
    rng = np.random.RandomState(5)
    x = rng.standard_normal((300, 24)) * np.exp(2 * rng.standard_normal((300, 24)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, step = neighbours.encode(x)
    y, spare = neighbours._decoded([r.tobytes() for r in q], step)
    assert (np.abs(x @ x.T - y.astype(float) @ y.T.astype(float)) <= spare[:, None] + spare[None, :]).all()


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", "word", "Ünïcode ＡＢ 中文 \x1c x", "ƐWE Əli Ɓa", "hello <|endoftext|> world", *[prose(rng, rng.randint(1, 900)) for _ in range(30)], prose(rng, 6000)]
    path = tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs(spark, texts), path).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_fast_ids_equal_the_tokenizers():
    """Every character up to U+2FFF between letters, and random mixtures of them."""
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    whole, fast = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(8)
    texts = [f"a{chr(c)}B {chr(c)}'{chr(c)}S" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(rng.choice("aB 'st.9\n" + chr(rng.randrange(32, 0x250)) * 3) for _ in range(40)) for _ in range(4000)]
    texts += ["<|endoftext|>", "x<|startoftext|>Y<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>"]
    for text, ids in zip(texts, fast(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_minimum_slack_is_optimal():
    from collections import Counter
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        capacity = rng.randint(1, 60)
        best = max(sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= capacity)
        taken = packing.minimum_slack(Counter(lengths), capacity)
        assert sum(taken) == best and not Counter(taken) - Counter(lengths)


def test_token_attribution(spark):
    texts = [None, "", "first line\nsecond, longer line\n\n" + "y" * 2500, "naïve café\n中文字符"]
    found = tokens.section_tokens(docs(spark, texts), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in found.collect()}
    for r in rows.values():
        assert sum(r["section_tokens"]) + r["outside"] == r["n_tokens"]
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0 and len(rows[2]["section_tokens"]) == 2 + 3
    starts, ends = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 10])
    # [3, 6) and [6, 9): the second token shares 2 characters with the first section; 5-9 shares 1 and 3
    assert tokens.attribute(starts, ends, np.array([3, 6]), np.array([6, 9])).tolist() == [-1, 0, 1, -1]


def test_language_id(spark):
    rng = random.Random(9)
    stems = {"aa": "kri krono mak".split(), "bb": "sul selo vish".split()}
    make = lambda lang, n: " ".join(rng.choice(stems[lang]) + rng.choice(["en", "ar", "it"]) for _ in range(n))
    rows = [(i, make(lang, 30) + "\n" + make(lang, 20), lang, 1) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa", 1), (901, "12 34 !!", "bb", 1), (902, make("bb", 40) + "\n" + make("aa", 8), None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.predict(frame, langid.train(frame.where("doc_id % 3 <> 1"))).collect()}
    held = [r for r in rows if r[0] % 3 == 1 and r[0] < 900]
    assert all(got[r[0]]["lang_pred"] == r[2] for r in held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["lang_score"] == 0.0
    assert got[902]["lang_pred"] == "bb" and 0.5 < got[902]["lang_score"] < 1
    assert langid.predict(frame, langid.train(frame.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.RandomState(0)
    emit, move = rng.standard_normal((4, 3)), rng.standard_normal((3, 3))
    weights = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(sum(emit[t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            weights[t, k] += w
    assert np.allclose(langid.marginals(emit, np.array([4]), move)[0], weights / weights.sum(axis=1, keepdims=True), atol=1e-6)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, 30), prose(rng, 16), "short item nowhere"]
    swapped = items[0].split()
    swapped[7] = swapped[20] = "other"
    texts = [prose(rng, 50) + " " + items[0].upper() + ", " + prose(rng, 5), "a b " + " ".join(swapped), prose(rng, 80), items[1], None, "", items[0][:60]]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (3, 1)}
    assert got[0, 0]["doc_word"] == 50 and got[0, 0]["n_matched"] == 30 and got[1, 0]["n_matched"] == 28
    left = decontam.without_ids(docs(spark, texts), decontam.overlaps(docs(spark, texts), bench), "doc_id")
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(21)
    items = [" ".join(rng.sample(WORDS, n)) for n in (8, 10, 12, 15)] + [prose(rng, 25), prose(rng, 60)]
    items += [" ".join(rng.sample(WORDS, n)) for n in (1, 2, 3, 5, 6, 7, 7)]
    texts = []
    for item in items:
        words = item.split()
        wrong = [set(c) for e in (1, 2, 3) for c in itertools.combinations(range(len(words)), e) if len(words) <= 15 and (len(words) - e) / len(words) >= 0.8]
        wrong += [set(range(phase, len(words), 5)) for phase in range(5)] + [set(range(phase, len(words), 4)) for phase in range(4)]
        texts += ["p q " + " ".join("z" if k in out else w for k, w in enumerate(words)) + " r" for out in wrong]
    texts += [" ".join("z" if k in (3, 7, 11) else w for k, w in enumerate(items[5].split()[20:35])), " ".join(items[0].split()[1:])]
    expected = set()
    for d, text in enumerate(texts):
        have = text.split()
        for i, item in enumerate(items):
            words = item.split()
            size = min(15, len(words))
            least = size if size < 8 else -(-size * 4 // 5)
            for shift in range(-len(words), len(have)):
                same = [0 <= shift + k < len(have) and have[shift + k] == w for k, w in enumerate(words)]
                if max(sum(same[s : s + size]) for s in range(len(words) - size + 1)) >= least:
                    expected.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs(spark, texts), bench).collect()} == expected
    assert len(expected) > 600


def test_decontamination_equals_its_sql(spark, tmp_path):
    """Edited, cut and short items, repeated ids, nulls, empty sides; and the given tables."""
    from quillspark.llm import queries

    from ..oracle import oracle_rows, rows_of

    rng = random.Random(12)
    items = [prose(rng, n) for n in (1, 2, 4, 7, 8, 9, 14, 15, 20, 40, 40)] + ["alpha1", None, "", "?!"]
    texts = [None, "", " . "]
    for item in items[:11] * 6:
        words = item.split()
        for _ in range(rng.randrange(len(words))):
            words[rng.randrange(len(words))] = rng.choice(("z", rng.choice(WORDS)))
        low = rng.randrange(len(words))
        texts.append(prose(rng, rng.randrange(30)) + " " + rng.choice((item, " ".join(words), " ".join(item.split()[low:]))).upper() + ". " + prose(rng, rng.randrange(30)))
    docs(spark, texts + ["very " * 30_000 + items[9]]).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    for d in ("b", "c"):
        spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0 if d == "b" else 10).write.parquet(f"{tmp_path}/{d}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/a/benchmark.parquet").limit(0 if d == "c" else 10).write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    sizes = []
    for d in ("a", "b", "c"):
        frame = queries.op8_decontamination(spark, f"{tmp_path}/{d}")
        rows = rows_of(frame.columns, frame.collect())
        sql = queries.OP8_SQL.replace("FROM documents", f"FROM '{tmp_path}/{d}/documents.parquet/*.parquet'").replace("FROM benchmark", f"FROM '{tmp_path}/{d}/benchmark.parquet/*.parquet'")
        columns, wanted = oracle_rows(sql, f"{tmp_path}/none")
        assert sorted(frame.columns) == columns and rows == wanted
        sizes.append(len(rows))
    assert sizes[0] > 40 and sizes[1:] == [0, 0]


def test_seeds_leave_a_hit_in_every_accepted_window():
    for size in range(decontam.SPACED, decontam.WINDOW + 1):
        for wrong in itertools.combinations(range(size), size - -(-size * 4 // 5)):
            assert any(
                all(at + k not in wrong for k, c in enumerate(mask) if c == "1")
                for mask in decontam.SEEDS for at in range(size - len(mask) + 1)
            )


def test_sharding(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(600)] + ["same text"] * 60 + [None, "", "é" * 10]
    frame = spark.createDataFrame([(i, t, f"s{i % 5}", "xy"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, shard int")
    rows = sharding.shard(frame, shards=7).collect()
    assert len(rows) == len(texts)
    sizes, slots = {}, {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) / min(sizes.values()) < 1.15
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "same text"}) == 1
    assert sharding.shard(frame.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["grobnik", "snarfle", "gro-bnik", "snarfle!"])
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(bad)))
    rows += [(900, None, 0.1), (901, "", 0.1), (902, prose(rng, 30) + " g r o b n i k " + prose(rng, 9), 0.1), (903, prose(rng, 30) + " gr.obn.ik", 0.1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame, marks.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(frame, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, y in labels if i % 4 == 0)
    assert right >= 0.97 * sum(i % 4 == 0 for i, _ in labels)
    assert got[902] >= 0.5 and got[903] >= 0.5 and got[900] < 0.5 and got[901] < 0.5
    plain = toxicity.score(frame, toxicity.train(frame, marks.limit(0)))
    assert plain.select("toxicity").distinct().count() == 1


def test_pipeline_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "minhash_dedup", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert 0 < out.select("doc_id").distinct().count() < rows.count()
