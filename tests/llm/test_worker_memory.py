"""What a Python worker keeps, seen from a session of one core, whose tasks are all served by one worker."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import gc
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from quillspark.llm import langid, minhash, packing, toxicity
from quillspark.session import local_session

spark = local_session(cores=1, memory="1g")
docs = spark.createDataFrame([(i, f"one two three four five six seven word{i}") for i in range(40)], "doc_id long, text string")
path = public_tokenizers.path("word_bpe_49k.json")

def held():
    def look(batches):
        for _ in batches:
            pass
        from quillspark.llm.packing import WordIds
        import os
        yield pd.DataFrame({"pid": [os.getpid()], "n": [sum(isinstance(x, WordIds) for x in gc.get_objects())]})
    return tuple(spark.range(1).coalesce(1).mapInPandas(look, "pid long, n long").collect()[0])

def pack():
    return sorted(map(tuple, packing.pieces(docs, path).collect()))

weights = {"table": toxicity.np.zeros(toxicity.LETTERS**3, "float32"), "bias": 0.0, "weights": toxicity.np.zeros(5), "rate": 0.5}
model = {"langs": ["a", "b"], "ngrams": toxicity.np.zeros((langid.BUCKETS, 2)), "lexicon": {}, "scale": 1.0,
         "bias": toxicity.np.zeros(2), "move": toxicity.np.zeros((2, 2))}
first = pack()
assert len(first) == 40
seen = [held()]
for other in (lambda: toxicity.score(docs, weights), lambda: langid.predict(docs, model), lambda: minhash.sketch(docs, "doc_id", "text")):
    assert len(other().collect()) == 40
    seen.append(held())
    assert pack() == first and pack() == first
    seen.append(held())
assert len({pid for pid, _ in seen}) == 1, seen
assert [n for _, n in seen] == [1, 0, 1, 0, 1, 0, 1], seen
print("done")
"""


def test_a_worker_drops_the_words_of_packing_when_it_serves_another_stage():
    root = Path(__file__).resolve().parents[2]
    ran = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and ran.stdout.strip().endswith("done"), ran.stderr[-2000:]
