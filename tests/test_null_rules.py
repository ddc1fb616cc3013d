"""NULL keys are keys, NULL versions are the lowest, and the library stands without llm/."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from revlens.operators.transcript import after_last, drop_after_first
from revlens.sources.index import latest_per_id, upsert
from revlens.sources.pages import stop_at_first_failure

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ROWS = [(1, 1, "ok"), (1, 2, "bad"), (1, 3, "ok"), (None, 1, "ok"), (None, 2, "bad"), (None, 3, "ok"), (2, 1, "ok")]


def _frame(spark):
    return spark.createDataFrame(ROWS, "k long, n int, s string")


def _kept(df):
    return sorted((str(r.k), r.n) for r in df.collect())


def test_null_keys(spark):
    df, bad = _frame(spark), F.col("s") == "bad"
    assert _kept(stop_at_first_failure(df, ["k"], ["n"], bad)) == [("1", 1), ("2", 1), ("None", 1)]
    assert _kept(after_last(df, ["k"], ["n"], bad)) == [("1", 3), ("2", 1), ("None", 3)]
    assert _kept(drop_after_first(df, ["k"], ["n"], bad)) == [("1", 1), ("1", 2), ("2", 1), ("None", 1), ("None", 2)]
    assert stop_at_first_failure(df, ["k"], ["n"], bad).columns == ["k", "n", "s"]


def test_null_versions_and_ties(spark):
    schema = "id long, text string, lang string, seq int"
    base = spark.createDataFrame([(1, "old", "en", 1), (5, "stays", "en", 1)], schema)
    new = [(1, "text one", "en", None), (2, "a", "en", None), (2, "b", "en", 0), (3, "x", "en", 2), (3, "y", "en", 2), (None, "no id", "en", None)]
    got = {r.id: (r.text, r.seq) for r in upsert(base, spark.createDataFrame(new, schema), "id", "seq").collect()}
    assert got[1] == ("text one", None) and got[2] == ("b", 0) and got[5] == ("stays", 1) and got[None] == ("no id", None)
    assert got[3][0] in ("x", "y")
    for parts in (1, 3, 6):  # the same winner however the rows are split
        again = latest_per_id(spark.createDataFrame(new[::-1], schema).repartition(parts), "id", "seq")
        assert {r.id: r.text for r in again.collect()}[3] == got[3][0]
    tied = latest_per_id(spark.createDataFrame(new, schema), "id", "seq", tie_cols=["text"])
    assert {r.id: r.text for r in tied.collect()}[3] == "y"


def test_entry_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "revlens"), tmp_path / "revlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, f)):
            shutil.copy(os.path.join(ROOT, f), tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fold_runs' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
