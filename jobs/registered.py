"""The jobs as registered queries: each runs its job twice into a new folder and reads the output back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.store import shared_dir

from . import column_profiles, text_measures


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def job1_column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "job1"), _config(column_profiles.CONFIG)
    for _ in range(2):
        column_profiles.run(spark, sf_dir, out, config)
    # arrays as text, to be compared
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    found = spark.read.parquet(f"{out}/profiles")
    return found.select(*[c for c in found.columns if c not in ("edges", "counts")], F.element_at("edges", 1).alias("first_edge"), F.element_at("edges", -1).alias("last_edge"), joined("counts"))


def job2_text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _folder(spark, "job2"), _config(text_measures.CONFIG)
    # a pattern, as a stream's folder must not be a single file
    for _ in range(2):
        text_measures.run(spark, f"{sf_dir}/documents.parque[t]", out, f"{out}/checkpoint", config)
    return spark.read.parquet(f"{out}/report")


def _profiles_sql(config: dict) -> str:
    """The rows of job 1: histogram edges and bins by the rule of the profile, order statistics by DuckDB."""
    rows = []
    for name, t in config["tables"].items():
        label = " || '/' || ".join(f"coalesce({k}::VARCHAR, 'null')" for k in t["by"])
        rows += [f"SELECT '{name}' AS \"table\", {label} AS \"group\", '{c}' AS \"column\", ({e})::DOUBLE AS v FROM {name}" for c, e in t["columns"].items()]
    k, d, m = config["bins"], config["decimals"], config["moment_decimals"]
    return f"""
WITH s AS ({" UNION ALL ".join(rows)}),
w AS (SELECT "table", "column", median(v) AS common, mad(v) AS scale FROM s GROUP BY ALL),
b AS (SELECT "table", "group", "column", count(v) AS total, count(*) - count(v) AS nulls, count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_samp(v) AS sd, median(v) AS med, mad(v) AS m,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95, count(DISTINCT v) AS u, bool_and(v = floor(v)) AS whole FROM s GROUP BY ALL),
h AS (SELECT *, (whole AND hi > lo AND hi - lo + 1 <= {k}) AS fits, CASE WHEN hi > lo THEN 0 ELSE greatest(abs(lo) * 1e-9, 0.5) END AS pad FROM b),
e AS (SELECT *, CASE WHEN fits THEN lo - 0.5 ELSE lo - pad END AS f, CASE WHEN fits THEN hi + 0.5 ELSE hi + pad END AS l, CASE WHEN fits THEN (hi - lo + 1)::INTEGER ELSE {k} END AS n FROM h),
x AS (SELECT s.*, f, l, n, lo, least(greatest(floor((v - f) / ((l - f) / n))::INTEGER, 0), n - 1) AS bin, v - mu AS z, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS far FROM s JOIN e USING ("table", "group", "column") WHERE v IS NOT NULL),
c AS (SELECT "table", "group", "column", bin, count(*) AS k FROM x GROUP BY ALL),
j AS (SELECT "table", "group", "column", string_agg(coalesce(k, 0)::VARCHAR, ',' ORDER BY i) AS counts FROM (SELECT "table", "group", "column", unnest(range(n)) AS i FROM e WHERE total > 0) y LEFT JOIN (SELECT "table", "group", "column", bin AS i, k FROM c) z USING ("table", "group", "column", i) GROUP BY ALL),
o AS (SELECT "table", "group", "column", count(*) FILTER (WHERE far) AS outliers, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4 FROM x GROUP BY ALL)
SELECT e."table", e."group", e."column", total, total AS finite, nulls, zeros, coalesce(outliers, 0) AS outliers, CASE WHEN u <= 8192 THEN u END AS "distinct", round(lo, {d}) AS min, round(hi, {d}) AS max, round(mu, {m}) AS mean,
  round(CASE WHEN total > 0 THEN coalesce(sd, 0) END, {m}) AS std, round(CASE WHEN total > 0 THEN CASE WHEN total < 3 OR m2 = 0 THEN 0 ELSE m3 / pow(m2, 1.5) END END, {m}) AS skewness, round(CASE WHEN total > 0 THEN CASE WHEN total < 4 OR m2 = 0 THEN 0 ELSE m4 / (m2 * m2) - 3 END END, {m}) AS kurtosis,
  round(med, {d}) AS median, round(q3 - q1, {d}) AS iqr, round(m, {d}) AS mad, round(q1 - 1.5 * (q3 - q1), {d}) AS lower_fence, round(q3 + 1.5 * (q3 - q1), {d}) AS upper_fence, round(p5, {d}) AS p5, round(p95, {d}) AS p95,
  round(f, {d}) AS first_edge, round(l, {d}) AS last_edge, counts, round(CASE WHEN scale > 0 THEN abs(med - common) / scale END, {d}) AS shift, coalesce(CASE WHEN scale > 0 THEN abs(med - common) / scale END > {config["shift"]}, false) AS apart
FROM e LEFT JOIN o USING ("table", "group", "column") LEFT JOIN j USING ("table", "group", "column") JOIN w USING ("table", "column")
"""


#: The measures of job 2 in DuckDB's words.
_MEASURES = {
    "characters": "length(text)",
    "words": r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))",
    "lines": "length(text) - length(replace(text, chr(10), '')) + 1",
    "word_length": r"CASE WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0 THEN length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::DOUBLE / len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END",
}


def _measures_sql(config: dict) -> str:
    keys, d = config["keys"], config["decimals"]
    rows = " UNION ALL ".join(f"SELECT {', '.join(keys)}, '{m}' AS measure, ({_MEASURES[m]})::DOUBLE AS v FROM documents" for m in config["measures"])
    levels = " UNION ALL ".join(f"SELECT '{'+'.join(level) or 'all'}' AS level, {', '.join(k if k in level else f'NULL::VARCHAR AS {k}' for k in keys)}, measure, v FROM s" for level in config["levels"])
    on = " AND ".join(f"r.{k} IS NOT DISTINCT FROM g.{k}" for k in ("level", *keys, "measure"))
    group = ", ".join(("level", *keys, "measure"))
    return f"""
WITH s AS ({rows}), r AS ({levels}),
g AS (SELECT {group}, avg(v) AS mu FROM r GROUP BY ALL),
z AS (SELECT r.*, mu, v - mu AS e FROM r JOIN g ON {on}),
m AS (SELECT {group}, count(v) AS total, count(*) - count(v) AS nulls, count(*) FILTER (WHERE v = 0) AS zeros, min(v) AS lo, max(v) AS hi, any_value(mu) AS mu, stddev_samp(v) AS sd, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM z GROUP BY ALL)
SELECT {group}, total, total AS finite, nulls, zeros, round(lo, {d}) AS min, round(hi, {d}) AS max, round(mu, {d}) AS mean, round(CASE WHEN total > 0 THEN coalesce(sd, 0) END, {d}) AS std,
  round(CASE WHEN total > 0 THEN CASE WHEN total < 3 OR m2 = 0 THEN 0 ELSE m3 / pow(m2, 1.5) END END, {d}) AS skewness, round(CASE WHEN total > 0 THEN CASE WHEN total < 4 OR m2 = 0 THEN 0 ELSE m4 / (m2 * m2) - 3 END END, {d}) AS kurtosis,
  round(CASE WHEN lo >= 0 AND mu > 1e-12 THEN coalesce(sd, 0) / mu END, {d}) AS cv, round(CASE WHEN total > 0 THEN zeros / total END, {d}) AS sparsity
FROM m
"""


def queries():
    return {f.__name__: f for f in (job1_column_profiles, job2_text_measures)}


def oracle_sql() -> dict[str, str]:
    return {"job1_column_profiles": _profiles_sql(_config(column_profiles.CONFIG)), "job2_text_measures": _measures_sql(_config(text_measures.CONFIG))}
