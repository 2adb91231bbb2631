"""Functions of the operators travel to Python workers that cannot import this package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).parents[2])

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from ridemetrics.session import configure

builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
for key, value in (("spark.sql.shuffle.partitions", "2"), ("spark.checkpoint.dir", {shared!r}), ("spark.sql.warehouse.dir", {shared!r} + "/tables")):
    builder = builder.config(key, value)
spark = configure(builder).getOrCreate()


def hidden(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("ridemetrics") is None
        yield batch


assert spark.range(3).mapInArrow(hidden, "id long").count() == 3
from ridemetrics.llm import catalog

rows = [(i, "some words that come twice or more " * (1 + i % 3) + str(i % 7), "en", "s", 1) for i in range(40)]
spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet({shared!r} + "/t/documents.parquet")
turns = [(c, t, "user", "turn " + str(t * (c % 2))) for c in range(25) for t in range(3)]
spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet({shared!r} + "/t/conversations.parquet")
vectors = [(i, [float((i * k) % 11 - 5) for k in range(64)]) for i in range(30)]
spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet({shared!r} + "/t/embeddings.parquet")
for n in (2, 5, 8, 9, 10, 11, 12, 13):
    name = next(q for q in catalog.QUERIES if q.startswith(f"op{{n}}_"))
    assert catalog.QUERIES[name](spark, {shared!r} + "/t").count() > 0, name
print("all ran")
"""


def test_operators_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not os.path.isdir(f"{p}/ridemetrics"))
    script = SCRIPT.format(repo=REPO, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
