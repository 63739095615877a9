"""The transducer lexicon: minimal, exact, equal to the tokenizers library on anything."""

import hashlib
import random
import tempfile

import pytest

from quillspark.llm import bpe

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def opened(entries):
    file = tempfile.NamedTemporaryFile(delete=False)
    file.write(bpe.compile_lexicon(entries))
    file.close()
    return bpe.Lexicon(file.name)


def test_automaton_accepts_just_its_words_and_gives_their_ids():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(600)} | {"é".encode(), "née".encode()}
    entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in words}
    lexicon = opened(entries)
    asked = [*sorted(words), *[bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))) for _ in range(600)], b"", b"\xff"]
    for word, place in zip(asked, lexicon.places(asked).tolist()):
        assert (place >= 0) == (word in entries)
        if place >= 0:
            assert lexicon.outputs(place) == entries[word] and sorted(words)[place] == word


def test_automaton_is_minimal():
    """No two states accept the same endings, and states are fewer than a tree's."""
    words = [a + b for a in (b"walk", b"talk", b"jump", b"stalk") for b in (b"", b"s", b"ed", b"ing", b"er", b"ers")]
    lexicon = opened({w: [1] for w in words})
    steps = {}
    for key, target in zip(lexicon.keys.tolist(), lexicon.targets.tolist()):
        steps.setdefault(key // 256, []).append((key % 256, target))

    def endings(state):
        found = {b""} if lexicon.final[state] else set()
        return found | {bytes([letter]) + rest for letter, target in steps.get(state, []) for rest in endings(target)}

    languages = [frozenset(endings(s)) for s in range(len(lexicon.final))]
    assert len(set(languages)) == len(languages) and languages[lexicon.root] == frozenset(words)
    assert len(languages) < len({w[:k] for w in words for k in range(len(w) + 1)}) / 2


def test_no_words():
    lexicon = opened({})
    assert lexicon.places([b"a", b""]).tolist() == [-1, -1]


def test_merges_equal_the_model():
    from tokenizers import Tokenizer

    model, merges = Tokenizer.from_file(PATH).model, bpe.merges_of(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 120))) for _ in range(1500)] + ["a" * 900, "ab" * 500]
    for word in words:
        ids = [x.id for x in model.tokenize(word)]
        assert merges(word.encode()) == ids
        raw = [merges.first[b] for b in word.encode()[:-1]] + [merges.last[word.encode()[-1]]]
        assert merges._long(list(raw)) == merges._short(list(raw)) == ids


def test_encode_equals_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    texts = [
        None, "", " \n", "word", "Ünïcode ＡＢ 中文 \x1c x", "ƐWE Əli Ɓa ΣΑΣ ﬁ é", "hello <|endoftext|> world<|startoftext|>", "<|EndOfText|>",
        "it's we'LL 12 ½² \x85​", "same words again", "same words again", "q" * 100_000, "word " * 50_000,
        *["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(161, 0x600)))) for _ in range(80)) for _ in range(200)],
    ]
    frame = spark.createDataFrame([(i, t, 5, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, id int, n_tokens string, ids array<int>")
    lexicon = bpe.publish(spark, bpe.fit_lexicon(frame, PATH, words=50))
    for name in (lexicon, None):
        rows = bpe.encode(frame, PATH, name, decoded=True).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
        for r in rows:
            ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["ids"] == ids and r["n_tokens"] == len(ids), texts[r["doc_id"]]
            assert r["decoded"] == whole.decode(ids, skip_special_tokens=False)
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(frame, PATH), PATH).collect()}
    assert decoded == {r["doc_id"]: r["decoded"] for r in rows}
    assert bpe.encode(frame.limit(0), PATH, lexicon).count() == 0
    bpe.compile_lexicon({})
    assert bpe.publish(spark, bpe.fit_lexicon(frame.limit(0), PATH))


def test_lexicon_counts_all_documents(spark, tmp_path):
    """The most frequent words of all rows, more of them than any sample was made of; ties by byte order."""
    from pyspark.sql import functions as F

    def word(i):
        return F.translate(F.format_string("q%05d", i), "0123456789", "abcdefghij")

    rows = spark.range(30_000).select(F.when(F.col("id") > 9, F.concat_ws(" ", F.lit("the"), word(F.col("id").cast("int")), word(F.floor(F.col("id") / 2).cast("int")))).alias("text"))
    name = lambda i: ("q" + "".join("abcdefghij"[int(x)] for x in f"{i:05d}")).encode()
    file = tmp_path / "lexicon.bin"
    file.write_bytes(bpe.fit_lexicon(rows.withColumn("doc_id", F.monotonically_increasing_id()), PATH, words=20_000))
    lexicon = bpe.Lexicon(str(file))
    # the + 15,000 words of three rows (ten and over) or two (five to nine), then the first of those of one row
    often, once = [b"the", *(name(i) for i in range(5, 15_000))], [name(i) for i in range(15_000, 30_000)]
    assert (lexicon.places(often) >= 0).all()
    assert [p >= 0 for p in lexicon.places(once).tolist()] == [i < 20_000 - len(often) for i in range(len(once))]


def test_other_files(spark):
    """A byte-level file with a decoder: the round trip gives the text back."""
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["Hello  World\n it's", "中文 é <|endoftext|>x", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(frame, path, bpe.publish(spark, bpe.fit_lexicon(frame, path)), decoded=True).collect():
        assert r["ids"] == whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["decoded"] == texts[r["doc_id"]]


def test_query(spark, sf_dir):
    """Every row's digests against the library."""
    from tokenizers import Tokenizer

    from quillspark.llm import queries

    whole = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_bpe_encoding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
