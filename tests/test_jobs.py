"""Kept states, and the jobs over growing input."""

import json
import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import column_profiles, text_measures
from lattica.operators.profile import summarise
from lattica.operators.states import finish_states, merge_states, partial_states

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def config(job) -> dict:
    with open(job.CONFIG) as f:
        return json.load(f)


def close(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_merged_states_equal_one_scan(spark):
    rng = random.Random(1)
    odd = [math.nan, math.inf, -math.inf, None, 0.0]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(7), rng.choice(odd) if rng.random() < 0.1 else 1e6 + rng.gauss(0, 1) ** 3) for _ in range(900)] + [("one", 3, 5.0), ("none", 2, math.nan), ("flat", 0, 2.0), ("flat", 4, 2.0), ("flat", 4, 2.0), ("flat", 5, 2.0)]
    df = spark.createDataFrame(rows, "k string, part int, x double").repartition(3)
    states = partial_states(df, ["k", "part"], ["x"])
    for merged in (merge_states(states, ["k"]), merge_states(merge_states(states, ["part", "k"]), ["k"])):
        got = {r["k"]: r for r in finish_states(merged).collect()}
        assert set(got) == {"a", "b", None, "one", "none", "flat"}
        for k, r in got.items():
            own = df.where(F.col("k").eqNullSafe(F.lit(k)))
            want = summarise(own, {"x": F.col("x")})["x"]
            assert all(close(r[f], want[f]) or r[f] is None and want[f] is None for f in want), (k, [(f, r[f], want[f]) for f in want if not close(r[f], want[f])])
    everything = finish_states(merge_states(states, [])).first()
    assert close(everything["kurtosis"], summarise(df, {"x": F.col("x")})["x"]["kurtosis"])
    with pytest.raises(ValueError):
        partial_states(df.select("k"), ["k"])


TEXTS = "doc_id long, text string, lang string, source string"


def texts(k: int):
    rng = random.Random(k)
    return [(i, rng.choice([None, "", " \n", "one two\nthree ", "x" * rng.randrange(5000)]), rng.choice(["en", None]), f"s{rng.randrange(2)}") for i in range(40)]


def rows(spark, path):
    return sorted(map(repr, (tuple(r) for r in spark.read.parquet(path).collect())))


def test_text_measures_take_only_what_is_new(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    run = lambda **kw: text_measures.run(spark, src, out, mark, config(text_measures) | kw)
    parts = [spark.createDataFrame(texts(k), TEXTS).coalesce(1) for k in range(3)]
    parts[0].write.mode("append").parquet(src)
    parts[1].write.mode("append").parquet(src)
    assert run(files_per_batch=1) | {"rows_written": 0} == {"rows_read": 80, "batches": 2, "rows_written": 0}
    first = rows(spark, f"{out}/report")
    assert run()["rows_read"] == 0
    assert rows(spark, f"{out}/report") == first
    parts[2].write.mode("append").parquet(src)
    assert run()["rows_read"] == 40
    grown = rows(spark, f"{out}/report")
    assert grown != first
    # the same as taking everything at once
    text_measures.run(spark, src, f"{tmp_path}/once", f"{tmp_path}/fresh", config(text_measures))
    assert rows(spark, f"{tmp_path}/once/report") == grown
    # a batch that was written but not committed runs again and counts once
    for name in ("2", ".2.crc"):
        os.remove(f"{mark}/commits/{name}")
    assert run()["rows_read"] == 40
    assert rows(spark, f"{out}/report") == grown
    everything = next(r for r in spark.read.parquet(f"{out}/report").where("level = 'all' and measure = 'characters'").collect())
    assert everything["total"] + everything["nulls"] == 120


def test_text_measures_of_no_text(spark, tmp_path):
    spark.createDataFrame([], TEXTS).write.parquet(f"{tmp_path}/in")
    done = text_measures.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", config(text_measures))
    assert done["rows_read"] == done["rows_written"] == 0


def test_column_profiles_replace_the_tables_that_are_run(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    own = config(column_profiles) | {"tables": {"t": {"by": ["k"], "columns": {"x": "x", "y": "x * 2"}}, "u": {"by": ["k", "j"], "columns": {"x": "x"}}}}
    make = lambda n: spark.range(n).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, "even").alias("j"), (F.col("id") % 17 + F.when(F.col("id") % 3 == 0, 50).otherwise(0)).alias("x"))
    for name in "tu":
        make(300).write.parquet(f"{src}/{name}.parquet")
    done = column_profiles.run(spark, src, out, own)
    assert done == {"t": {"rows_read": 300, "rows_written": 6}, "u": {"rows_read": 300, "rows_written": 6}}
    first = rows(spark, f"{out}/profiles")
    assert {r["group"] for r in spark.read.parquet(f"{out}/profiles").where("apart and table = 't'").collect()} >= {"0"}
    assert "null" in {r["group"].split("/")[-1] for r in spark.read.parquet(f"{out}/profiles").where("table = 'u'").collect()}
    make(900).write.mode("overwrite").parquet(f"{src}/u.parquet")
    column_profiles.run(spark, src, out, own, ["u"])
    second = rows(spark, f"{out}/profiles")
    assert [r for r in second if r.endswith("'t')")] == [r for r in first if r.endswith("'t')")] and second != first
    column_profiles.run(spark, src, out, own)
    assert rows(spark, f"{out}/profiles") == second


def test_command_line(spark, tmp_path):
    spark.createDataFrame(texts(1), TEXTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    told = subprocess.run([sys.executable, f"{ROOT}/jobs/text_measures.py", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert told.returncode == 0, told.stderr[-2000:]
    assert "read 40 texts in 1 batches" in told.stderr
    assert spark.read.parquet(f"{tmp_path}/out/report").count() > 0


def test_jobs_import_nothing_of_the_optional_folders():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            with open(f"{ROOT}/jobs/{name}") as f:
                text = f.read()
            assert "lattica.llm" not in text and "corpus_pipeline" not in text
