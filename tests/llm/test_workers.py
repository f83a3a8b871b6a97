"""Workers that lack the package, and models in several parts."""

import json
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa

from millrace.llm import langid, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Run in a process of its own: the driver finds the package by sys.path alone, which workers do not inherit.
BARE = """
import json, sys, tempfile
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.python.worker.reuse", "false").config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def sees(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("millrace") is not None] * b.num_rows)], names=["sees"])

there = spark.range(2).mapInArrow(sees, "sees boolean").collect()
sys.path.insert(0, ROOT)
from millrace.llm import queries
out = {"sees": any(r.sees for r in there)}
for name in NAMES:
    out[name] = queries.queries()[name](spark, "/root/testdata/sf0.001").count()
print("RESULT" + json.dumps(out))
"""


def test_bare_workers(tmp_path):
    """All queries of the subpackage, the pipeline included, where workers can't import the package."""
    code = BARE.replace("ROOT", repr(ROOT)).replace("NAMES", repr(list(queries.queries())))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=900)
    said = [x for x in done.stdout.splitlines() if x.startswith("RESULT")]
    assert said, done.stderr[-3000:]
    out = json.loads(said[0][6:])
    assert out.pop("sees") is False and len(out) == 14 and all(n > 0 for n in out.values())


def _prose(rng, k, n):
    return " ".join("".join(rng.choice(f"aeiou{chr(97 + k % 26)}{chr(0x430 + k)}") for _ in range(4)) for _ in range(n))


def test_many_languages_in_parts(spark):
    """A hundred languages, in parts of a few: all are learnt, and the parts count as one model does."""
    rng = random.Random(6)
    rows = [(i, _prose(rng, i % 100, 60), f"l{i % 100:03}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    from pyspark.sql import functions as F

    samples = langid.labelled_sample(docs, F.lit(True))
    assert len(samples) == 100
    one, many = langid.build_model(samples), langid.build_model(samples, table_bytes=40 << 20)
    assert len(one.parts) < len(many.parts) > 4 and one.languages == many.languages
    texts = pa.array([_prose(rng, k, 20) for k in range(0, 100, 9)])
    assert np.array_equal(langid.phrases(one, texts)[0], langid.phrases(many, texts)[0])
    asked = spark.createDataFrame([(k, _prose(rng, k, 30)) for k in range(100)] + [(100, None), (101, "1 2")], "k bigint, text string")
    out = {r.k: r.lang_pred for r in langid.identify(asked, many, keep=["k"]).collect()}
    assert sum(out[k] == f"l{k:03}" for k in range(100)) >= 97 and out[100] == out[101] == "und"
