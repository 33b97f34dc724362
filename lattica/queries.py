"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import dtype as D
from .functions import text as X
from .operators import grouped as G
from .operators import profile as P
from .operators import sketches as K
from .operators import slices as S
from .operators.sampling import bottom_k
from .plans import insights as I
from .plans import layout as L
from .plans import report as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison: additions may go in another order elsewhere."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- statistics

_PCT = ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS {P.percentile_name(p)}" for p in P.PERCENTILES)


def _profile_sql(source: str) -> str:
    """The profile of (column, v) rows of finite values, in SQL."""
    return f"""
WITH s AS ({source}),
m AS (SELECT "column" AS c, avg(v) AS mu, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1),
d AS (SELECT s."column" AS c, v, v - mu AS e, abs(v - med) AS dev, q1, q3, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS far FROM s JOIN m ON m.c = s."column"),
p AS (SELECT c, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4, median(dev) AS mad, count(*) FILTER (WHERE far) AS outliers FROM d GROUP BY c)
SELECT "column", count(*) AS total, count(*) AS finite, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS nan, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v < 0) AS negatives,
  count(*) FILTER (WHERE v > 0) AS positives, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS "range", round(sum(v) / 1e6, 6) AS sum_m, round(avg(v), 9) AS mean,
  round(var_samp(v) / greatest(1, avg(v) * avg(v)), 6) AS rel_variance, round(stddev_samp(v), 5) AS std, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem,
  round(CASE WHEN count(*) < 3 OR any_value(m2) = 0 THEN 0 ELSE any_value(m3) / pow(any_value(m2), 1.5) END, 6) AS skewness,
  round(CASE WHEN count(*) < 4 OR any_value(m2) = 0 THEN 0 ELSE any_value(m4) / (any_value(m2) * any_value(m2)) - 3 END, 6) AS kurtosis,
  round(CASE WHEN min(v) >= 0 AND avg(v) > 1e-12 THEN stddev_samp(v) / avg(v) END, 6) AS cv, round(sum(abs(v)) / 1e6, 6) AS l1_m, round(sqrt(sum(v * v)) / 1e3, 6) AS l2_k,
  round(count(*) FILTER (WHERE v = 0) / count(*), 9) AS sparsity, {_PCT}, round(median(v), 6) AS median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr,
  any_value(outliers) AS outliers, round(any_value(mad), 6) AS mad, CASE WHEN count(DISTINCT v) <= 8192 THEN count(DISTINCT v) END AS "distinct", count(DISTINCT v) <= 8192 AS unique_exact,
  bool_and(v = floor(v)) AS integral, (max(v) > min(v) AND min(v) >= 0 AND max(v) <= 1 AND NOT bool_and(v = floor(v))) AS unit_range
FROM s JOIN p ON p.c = s."column" GROUP BY "column"
"""


def _flat_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return _flat(P.profile(df, columns))


def _flat(p: DataFrame) -> DataFrame:
    r = lambda c, k=6: F.round(c, k).alias(c)
    plain = ["total", "finite", "nulls", "nan", "zeros", "negatives", "positives"]
    return p.select(
        "column", *plain, r("mean", 9), *[r(c) for c in ("min", "max", "range", "sem", "skewness", "kurtosis", "cv")], F.round(F.col("sum") / 1e6, 6).alias("sum_m"), F.round(F.col("variance") / F.greatest(F.lit(1.0), F.col("mean") * F.col("mean")), 6).alias("rel_variance"), r("std", 5),
        F.round(F.col("l1") / 1e6, 6).alias("l1_m"), F.round(F.col("l2") / 1e3, 6).alias("l2_k"), r("sparsity", 9), *[r(P.percentile_name(x)) for x in P.PERCENTILES], r("median"), r("iqr"), "outliers", r("mad"), "distinct", "unique_exact", "integral", "unit_range",
    )


@query(_profile_sql("SELECT 'l_extendedprice' AS \"column\", l_extendedprice AS v FROM lineitem"))
def profile_extendedprice(spark, d):
    return _flat_profile(_t(spark, d, "lineitem"), ["l_extendedprice"])


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_profile_sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in _LINE)))
def profile_by_column(spark, d):
    return _flat_profile(_t(spark, d, "lineitem"), _LINE)


@query(_profile_sql("SELECT CAST(l_suppkey AS VARCHAR) AS \"column\", l_extendedprice AS v FROM lineitem"))
def profile_by_supplier(spark, d):
    return _flat(G.profile_by(_t(spark, d, "lineitem"), ["l_suppkey"], ["l_extendedprice"]).withColumn("column", F.col("l_suppkey").cast("string")))


@query(_profile_sql("SELECT 's_acctbal' AS \"column\", s_acctbal AS v FROM supplier"))
def profile_signed(spark, d):
    return _flat_profile(_t(spark, d, "supplier"), ["s_acctbal"])


_DIRTY = "CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id % 19 = 0 THEN 0.0 WHEN event_id % 23 = 0 THEN NULL ELSE value END"


@query(f"""
WITH e AS (SELECT CAST({_DIRTY} AS DOUBLE) AS v FROM events)
SELECT count(v) AS total, count(*) FILTER (WHERE isfinite(v)) AS finite, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE isnan(v)) AS nan,
  count(*) FILTER (WHERE v = CAST('Infinity' AS DOUBLE)) AS pos_inf, count(*) FILTER (WHERE v = CAST('-Infinity' AS DOUBLE)) AS neg_inf, count(*) FILTER (WHERE v = 0) AS zeros,
  count(*) FILTER (WHERE isfinite(v) AND v < 0) AS negatives, count(*) FILTER (WHERE isfinite(v) AND v > 0) AS positives,
  round(count(*) FILTER (WHERE v = 0) / count(v), 9) AS sparsity, count(v) - count(*) FILTER (WHERE isfinite(v)) AS excluded_non_finite FROM e
""")
def composition(spark, d):
    return _rounded(P.composition(_t(spark, d, "events").select(F.expr(_DIRTY).cast("double").alias("v")), F.col("v")), 9)


_P_ROWS = " UNION ALL ".join(f"SELECT '{P.percentile_name(p)}' AS percentile, round(quantile_cont(o_totalprice, {p / 100}), 6) AS value FROM orders" for p in P.PERCENTILES)


@query(_P_ROWS)
def percentiles_11(spark, d):
    return _rounded(P.percentiles(_t(spark, d, "orders"), F.col("o_totalprice")))


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS med FROM events)
SELECT round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  (SELECT count(*) FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, (SELECT round(mad(value), 6) FROM events) AS mad FROM q
""")
def tukey_and_mad(spark, d):
    return _rounded(P.spread(_t(spark, d, "events"), F.col("value")))


def _hist_sql(table: str, column: str, bins: int = 64) -> str:
    return f"""
WITH b AS (SELECT min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS whole FROM (SELECT CAST({column} AS DOUBLE) AS v FROM {table})),
c AS (SELECT lo, hi, (whole AND hi > lo AND hi - lo + 1 <= {bins}) AS w, NOT hi > lo AS flat, greatest(abs(lo) * 1e-9, 0.5) AS pad FROM b),
p AS (SELECT CASE WHEN w THEN CAST(hi - lo + 1 AS INTEGER) ELSE {bins} END AS k, CASE WHEN w THEN lo - 0.5 WHEN flat THEN lo - pad ELSE lo END AS f, CASE WHEN w THEN hi + 0.5 WHEN flat THEN hi + pad ELSE hi END AS l FROM c),
n AS (SELECT least(greatest(CAST(floor((CAST({column} AS DOUBLE) - f) / ((l - f) / k)) AS INTEGER), 0), k - 1) AS bin, count(*) AS c FROM {table}, p GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bin, round(f + (l - f) / k * r.i, 8) AS "left", round(f + (l - f) / k * (r.i + 1), 8) AS "right", coalesce(c, 0) AS count
FROM p, range(256) AS r(i) LEFT JOIN n ON n.bin = r.i WHERE r.i < k
"""


@query(_hist_sql("lineitem", "l_extendedprice"))
def histogram_float(spark, d):
    return _rounded(P.histogram(_t(spark, d, "lineitem"), F.col("l_extendedprice")), 8)


@query(_hist_sql("part", "p_size"))
def histogram_integer(spark, d):
    return _rounded(P.histogram(_t(spark, d, "part"), F.col("p_size")), 8)


@query(_hist_sql("region", "(r_regionkey * 0 + 7)"))
def histogram_constant(spark, d):
    return _rounded(P.histogram(_t(spark, d, "region"), F.col("r_regionkey") * 0 + 7), 8)


@query("""
WITH n AS (SELECT l_extendedprice AS v, count(*) AS c FROM lineitem GROUP BY 1), t AS (SELECT least(greatest(CAST(floor((v - lo) / ((hi - lo) / 64)) AS INTEGER), 0), 63) AS bin, sum(c) AS c FROM n, (SELECT min(v) AS lo, max(v) AS hi FROM n) GROUP BY 1)
SELECT bin, CAST(c AS BIGINT) AS count, round(c / max(c) OVER (), 9) AS height, round(c / sum(c) OVER (), 9) AS share FROM t
""")
def histogram_bars(spark, d):
    return _rounded(R.histogram_bars(P.histogram(_t(spark, d, "lineitem"), F.col("l_extendedprice"))).where("count > 0").select("bin", "count", "height", "share"), 9)


@query("SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 12")
def top_values(spark, d):
    return P.top_values(_t(spark, d, "lineitem"), F.col("l_quantity"))


@query("""
WITH t AS (SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 12)
SELECT value, count, round(greatest(0.02, count / max(count) OVER ()), 9) AS width, round(count / (SELECT count(*) FROM lineitem), 9) AS share FROM t
""")
def frequency_bars(spark, d):
    line = _t(spark, d, "lineitem")
    n = line.agg(F.count("l_quantity").alias("n"))
    return _rounded(R.frequency_bars(P.top_values(line, F.col("l_quantity")).crossJoin(F.broadcast(n)), F.col("n")).drop("n"), 9)


_DISTINCT = [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("part", "p_size"), ("orders", "o_totalprice")]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 8192 THEN count(DISTINCT {c}) END AS \"distinct\", count(DISTINCT {c}) <= 8192 AS unique_exact FROM {t}" for t, c in _DISTINCT))
def distinct_capped(spark, d):
    out = None
    for t, c in _DISTINCT:
        one = P.distinct_capped(_t(spark, d, t), F.col(c)).select(F.lit(c).alias("column"), "distinct", "unique_exact")
        out = one if out is None else out.unionByName(one)
    return out


_AXIS = "count(*) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(0 AS BIGINT) AS nan, count(*) FILTER (WHERE v = 0) AS zeros"
_UNNEST = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS col FROM embeddings)"


@query(f"SELECT col AS index, 'Column ' || col AS label, {_AXIS} FROM {_UNNEST} GROUP BY col")
def axis_columns(spark, d):
    e = _t(spark, d, "embeddings").select(F.posexplode("embedding").alias("col", "value"))
    return _rounded(P.axis_stats(e, F.col("col"), F.col("value"), "Column"))


@query(f"""
SELECT 'Column' AS axis, col AS index, 'Column ' || col AS label, {_AXIS} FROM {_UNNEST} GROUP BY col UNION ALL SELECT 'Channel', CAST(label AS BIGINT), 'Channel ' || label, {_AXIS} FROM {_UNNEST} GROUP BY label
UNION ALL SELECT 'Frame', vec_id // 100, 'Frame ' || vec_id // 100, {_AXIS} FROM {_UNNEST} GROUP BY vec_id // 100
""")
def axes_together(spark, d):
    """Columns, channels and frames in one scan."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("col", "value"))
    return _rounded(P.axes_stats(e, {"Column": F.col("col"), "Channel": F.col("label"), "Frame": F.floor(F.col("vec_id") / 100)}, F.col("value")))


def _number_sql(v: str) -> str:
    """The text of a number: whole ones plain, tiny and huge ones with an exponent, else seven significant digits."""
    return f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) WHEN abs({v}) < 1e-4 OR abs({v}) >= 1e9 THEN regexp_replace(printf('%.4e', {v}), 'e([+-])0(\\d)', 'e\\1\\2') WHEN abs({v}) >= 9999999 THEN CAST(CAST(CAST(printf('%.6e', {v}) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE printf('%.7g', {v}) END"


@query(f"""
WITH a AS (SELECT 'Channel ' || label AS label, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_samp(v) AS sd, count(*) FILTER (WHERE v = 0) AS z FROM {_UNNEST} GROUP BY label),
t AS (SELECT label, [format('{{:,}}', n), {_number_sql("lo")}, {_number_sql("hi")}, {_number_sql("mu")}, {_number_sql("sd")}, '0', format('{{:,}}', z)] AS v, ['Count', 'Min', 'Max', 'Mean', 'Std', 'NaN', 'Zeros'] AS k FROM a)
SELECT label, CAST(unnest(range(7)) AS INTEGER) AS position, 'axis' AS section, unnest(k) AS key, unnest(v) AS value FROM t
""")
def axis_table(spark, d):
    e = _t(spark, d, "embeddings").select("label", F.explode("embedding").alias("value"))
    return R.axis_report(P.axis_stats(e, F.col("label"), F.col("value")))


@query(f"SELECT CAST(label AS BIGINT) AS index, 'Channel ' || label AS label, {_AXIS} FROM {_UNNEST} GROUP BY label")
def axis_channels(spark, d):
    e = _t(spark, d, "embeddings").select("label", F.explode("embedding").alias("value"))
    return _rounded(P.axis_stats(e, F.col("label"), F.col("value")))


@query("SELECT CAST(l_partkey AS DOUBLE) AS value, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT 4.0 * count(*) / 10000 FROM lineitem) ORDER BY count DESC, value LIMIT 12")
def heavy_values(spark, d):
    """The most frequent of any number of distinct values."""
    return K.heavy_values(_t(spark, d, "lineitem"), F.col("l_partkey"))


_BOTTOM = "ORDER BY substr(md5(l_orderkey || '|' || l_linenumber || '|0'), 1, 13), {rest} LIMIT {k}"


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem {_BOTTOM.format(rest='l_orderkey, l_linenumber, l_extendedprice', k=500)}")
def sample_hashed(spark, d):
    return bottom_k(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 500, ["l_orderkey", "l_linenumber"])


@query(f"""
WITH s AS (SELECT l_extendedprice AS v FROM lineitem {_BOTTOM.format(rest='l_orderkey, l_linenumber, l_extendedprice', k=5000)}), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, median(v) AS med FROM s), n AS (SELECT count(*) AS n FROM lineitem)
SELECT 'l_extendedprice' AS "column", n AS total, CAST(5000 AS BIGINT) AS sample_size, true AS approximate, round(med, 6) AS median, CAST(floor((SELECT count(*) FROM s WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * n / 5000 + 0.5) AS BIGINT) AS outliers,
  round((SELECT mad(v) FROM s), 6) AS mad, round((SELECT quantile_cont(v, 0.99) FROM s), 6) AS p99 FROM q, n
""")
def profile_sampled(spark, d):
    """Past an explicit limit, order statistics come from a sample of that size and say so."""
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _rounded(P.profile(line, ["l_extendedprice"], exact_limit=5000, sample_key=["l_orderkey", "l_linenumber"]).select("column", "total", "sample_size", "approximate", "median", "outliers", "mad", "p99"))


# -------------------------------------------------------- array slices, text

_ROW = "(SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings)"


def _matrix(spark, d) -> tuple[DataFrame, S.Plane]:
    """embeddings as a matrix in element form."""
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    rows = S.numbered(e, "vec_id").withColumnRenamed("pos", "r")
    out = rows.select("r", F.posexplode("embedding").alias("c", "v")).select((F.col("r") * 64 + F.col("c")).alias("pos"), F.col("v").cast("double").alias("value"))
    return out, S.Plane((e.count(), 64), 0, 1)


def _steps_sql(side: int) -> str:
    return f"(SELECT greatest(1, CAST(ceil(count(*) / {side}) AS BIGINT)) AS rs, greatest(1, CAST(ceil(64 / {side}) AS BIGINT)) AS cs FROM embeddings)"


@query(f"SELECT CAST(0 AS BIGINT) AS frame, r // rs AS row, c // cs AS col, CAST(0 AS BIGINT) AS channel, v AS value FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}), {_steps_sql(32)} WHERE r % rs = 0 AND c % cs = 0")
def block_decimated(spark, d):
    e, plane = _matrix(spark, d)
    return S.read_block(e, plane, max_side=32)


@query(f"SELECT min(v) AS block_min, max(v) AS block_max FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}), {_steps_sql(16)} WHERE r % rs = 0 AND c % cs = 0")
def block_bounds(spark, d):
    e, plane = _matrix(spark, d)
    return S.block_bounds(S.read_block(e, plane, max_side=16))


@query(f"SELECT row_number() OVER (ORDER BY r, c) - 1 AS i, v AS value FROM (SELECT r, CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}), {_steps_sql(8)} WHERE r % rs = 0 AND c % cs = 0")
def block_encoded(spark, d):
    """The block after its way through base64 of float32 numbers."""
    e, plane = _matrix(spark, d)
    return S.decode_block(S.encode_block(S.read_block(e, plane, max_side=8)))


@query(f"SELECT r AS row, c AS col, v AS value FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}) WHERE r BETWEEN 100 AND 199 AND c BETWEEN 0 AND 39")
def table_window(spark, d):
    e, plane = _matrix(spark, d)
    return S.table_window(e, plane, row0=100).select("row", "col", "value")


@query(f"WITH w AS (SELECT r, c, v FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}) WHERE r < 100 AND c < 40) SELECT r AS row, c AS col, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS shade FROM w")
def cell_shading(spark, d):
    e, plane = _matrix(spark, d)
    return _rounded(R.shade(S.table_window(e, plane)).select("row", "col", "shade"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS index, n_name FROM nation ORDER BY n_nationkey LIMIT 500")
def text_preview(spark, d):
    return S.text_preview(_t(spark, d, "nation"), "n_nationkey", ["n_name"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS index, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part ORDER BY p_partkey LIMIT 500")
def record_preview(spark, d):
    return S.text_preview(_t(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_size"])


@query("""
WITH e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT count(*) AS n FROM events),
b AS (SELECT c, CAST(floor(c * n / 100) AS BIGINT) AS first, CAST(floor((c + 1) * n / 100) AS BIGINT) - 1 AS last FROM range(100) AS r(c), n)
SELECT c AS bucket, min(value) AS low, max(value) AS high FROM b JOIN e ON i BETWEEN first AND last GROUP BY c
""")
def line_envelope(spark, d):
    e = S.numbered(_t(spark, d, "events").select("ts", "event_id", "value"), "ts", "event_id")
    return S.line_envelope(e, F.col("pos"), F.col("value"), _t(spark, d, "events").count(), 100)


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT 'o_totalprice' AS "column", round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) AS whisker_high FROM q
""")
def box_plot(spark, d):
    return _rounded(S.box_marks(P.profile(_t(spark, d, "orders"), ["o_totalprice"])))


@query("SELECT CAST(embedding[1] AS DOUBLE) AS value FROM embeddings ORDER BY vec_id LIMIT 1")
def scalar_value(spark, d):
    return S.scalar(_matrix(spark, d)[0]).select("value")


@query(f"SELECT r // 10 AS frame, r % 10 AS row, c AS col, v AS value FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}) WHERE r // 10 BETWEEN 8 AND 15")
def frame_page(spark, d):
    """The second page of eight frames of the matrix cut into planes of 10 x 64."""
    e, whole = _matrix(spark, d)
    plane = S.Plane((-(-whole.shape[0] // 10), 10, 64), 1, 2)
    return S.read_block(e, plane, S.frame_page(plane, 1, 8), max_side=64).select("frame", "row", "col", "value")


@query(f"""
WITH b AS (SELECT r, c, v, rs, cs FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW}), {_steps_sql(16)} WHERE r % rs = 0 AND c % cs = 0)
SELECT CAST(0 AS BIGINT) AS frame, r // rs AS row, c // cs AS col, '[' || format('{{:,}}', r) || ', ' || c || '] = ' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR)
  WHEN abs(v) < 1e-4 THEN regexp_replace(printf('%.3e', v), 'e-0', 'e-') ELSE CAST(CAST(printf('%.5e', v) AS DOUBLE) AS VARCHAR) END AS text FROM b
""")
def inspected_cells(spark, d):
    e, plane = _matrix(spark, d)
    return S.inspect(S.read_block(e, plane, max_side=16), S.block_steps(plane, 1, 16, 2_000_000))


# ----------------------------------------------------- colours and rendering

_CELL = f"(SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW})"


@query(f"""
WITH w AS (SELECT r, c, v FROM {_CELL}), b AS (SELECT min(v) AS lo, max(v) AS hi FROM w),
k AS (SELECT *, CASE WHEN lo > 0 THEN lo ELSE hi / 1e4 END AS ll, greatest(abs(lo), abs(hi), 1e-12) AS bound FROM b)
SELECT r AS row, c AS col, round((v - lo) / (hi - lo), 9) AS linear, round((ln(greatest(v, ll)) - ln(ll)) / (ln(hi) - ln(ll)), 9) AS log, round((sign(v) * ln(1 + abs(v)) / ln(1 + bound) + 1) / 2, 9) AS symlog FROM w, k
""")
def normalised(spark, d):
    w = _plane_values(spark, d)
    return _rounded(w.select("row", "col", *[C.normalise(F.col("v"), F.col("lo"), F.col("hi"), s).alias(s) for s in ("linear", "log", "symlog")]), 9)


def _plane_values(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the matrix as (row, col, v) with the bounds lo and hi of the whole plane."""
    e, plane = _matrix(spark, d)
    w = e.withColumns(plane.columns(F.col("pos"))).select("row", "col", F.col("value").alias("v"))
    return w.crossJoin(F.broadcast(w.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))


def _ramp_sql(name: str) -> str:
    a = C.anchors(name)
    rows = ", ".join(f"({i}, {r}.0::DOUBLE, {g}.0::DOUBLE, {b}.0::DOUBLE)" for i, (r, g, b) in enumerate(a))
    mix = lambda k: f"CAST(round_even(x.{k} + (y.{k} - x.{k}) * (t - x.j), 0) AS INTEGER) AS {k}"
    return f"SELECT '{name}' AS ramp, CAST(i AS INTEGER) AS i, {mix('r')}, {mix('g')}, {mix('b')} FROM (SELECT i, i / 255.0::DOUBLE * {len(a) - 1} AS t FROM range(256) AS q(i)) JOIN (VALUES {rows}) AS x(j, r, g, b) ON x.j = least(CAST(floor(t) AS INTEGER), {len(a) - 2}) JOIN (VALUES {rows}) AS y(j, r, g, b) ON y.j = x.j + 1"


@query(f"""
WITH w AS (SELECT r, c, v FROM {_CELL}), b AS (SELECT min(v) AS lo, max(v) AS hi FROM w), ramp AS ({_ramp_sql("viridis")})
SELECT w.r AS row, c AS col, ramp.r, ramp.g, ramp.b, 255 AS a FROM w, b JOIN ramp ON ramp.i = least(greatest(CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS INTEGER), 0), 255)
""")
def rendered_plane(spark, d):
    return C.colour(_plane_values(spark, d), F.col("v"), F.col("lo"), F.col("hi")).select("row", "col", "r", "g", "b", "a")


@query(f"""
WITH w AS (SELECT r // rs AS row, c // cs AS col, v FROM {_CELL}, {_steps_sql(64)} WHERE r % rs = 0 AND c % cs = 0), ramp AS ({_ramp_sql("coolwarm")})
SELECT CAST(0 AS BIGINT) AS frame, row, col, ramp.r, ramp.g, ramp.b, 255 AS a FROM w JOIN ramp ON ramp.i = least(greatest(CAST(floor((v + 1) / 2 * 255 + 0.5) AS INTEGER), 0), 255)
""")
def png_plane(spark, d):
    """All pixels of the picture, read back from its PNG."""
    e, plane = _matrix(spark, d)
    w = S.read_block(e, plane, max_side=64).withColumnRenamed("value", "v").withColumns({"lo": F.lit(-1.0), "hi": F.lit(1.0)})
    return C.png_pixels(C.png_planes(C.colour(w, F.col("v"), F.col("lo"), F.col("hi"), "coolwarm").select("frame", "row", "col", "r", "g", "b", "a")))


@query("SELECT round(-greatest(abs(min(s_acctbal)), abs(max(s_acctbal))), 6) AS low, round(greatest(abs(min(s_acctbal)), abs(max(s_acctbal))), 6) AS high FROM supplier")
def diverging_range(spark, d):
    b = _t(spark, d, "supplier").agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
    low, high = C.centred(F.col("a"), F.col("b"))
    return _rounded(b.select(low.alias("low"), high.alias("high")))


@query("SELECT CASE WHEN min(s_acctbal) < 0 AND max(s_acctbal) > 0 THEN 'coolwarm' ELSE 'magma' END AS signed, 'magma' AS picture FROM supplier")
def default_ramps(spark, d):
    b = _t(spark, d, "supplier").agg(F.min("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
    return b.select(C.default_ramp(F.col("a"), F.col("b"), F.lit(False), F.lit("magma")).alias("signed"), C.default_ramp(F.col("a"), F.col("b"), F.lit(True), F.lit("magma")).alias("picture"))


# ---------------------------------------------------- layout and observations

_TOLD = """
WITH s AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'one', CAST(1 AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'rare', CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END FROM lineitem UNION ALL SELECT 'standard', (l_quantity - 25.5) / 14.43 FROM lineitem UNION ALL SELECT 'steep', pow(l_extendedprice / 1e4, 12) FROM lineitem),
m AS (SELECT "column", avg(v) AS mu, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, count(DISTINCT v) AS u, bool_and(v = floor(v)) AS w, count(*) FILTER (WHERE v = 0) AS z FROM s GROUP BY 1),
p AS (SELECT s."column", avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3, avg(pow(v - mu, 4)) AS m4, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS o FROM s JOIN m USING ("column") GROUP BY 1),
k AS (SELECT *, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END AS sk, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS ku, (abs(mu) < 0.15 AND abs(sd - 1) < 0.2 AND NOT w) AS std1, (hi > lo AND lo >= 0 AND hi <= 1 AND NOT w) AS unit FROM m JOIN p USING ("column")),
t AS (SELECT "column", max(c) / sum(c) AS top FROM (SELECT "column", v, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT "column", unnest([
  CASE WHEN lo = hi THEN ['I6', 'warn', 'Constant array'] END, CASE WHEN z / n > 0.5 THEN ['I7', 'info', printf('%.1f', z / n * 100) || '% zeros'] END, CASE WHEN std1 THEN ['I8', 'good', 'Looks standardised'] END,
  CASE WHEN NOT std1 AND unit THEN ['I9', 'good', 'Normalised to [0, 1]'] END, CASE WHEN w AND u <= 2 AND lo >= 0 AND hi <= 1 THEN ['I11', 'info', 'Binary data'] END,
  CASE WHEN NOT (w AND u <= 2 AND lo >= 0 AND hi <= 1) AND w AND u <= 64 AND n > u * 4 THEN ['I12', CASE WHEN top > 0.6 THEN 'warn' ELSE 'info' END, 'Categorical — ' || u || ' distinct values'] END,
  CASE WHEN abs(sk) > 1 THEN ['I13', 'info', CASE WHEN sk > 0 THEN 'Right' ELSE 'Left' END || '-skewed distribution'] END, CASE WHEN ku > 3 THEN ['I14', 'info', 'Heavy tails'] END,
  CASE WHEN o > 0 AND o / n > 0.01 THEN ['I15', 'info', format('{:,}', o) || ' outliers'] END, CASE WHEN lo > 0 AND hi / lo > 1000 THEN ['I16', 'info', 'Wide dynamic range'] END,
  CASE WHEN lo <> hi THEN ['I20', 'good', 'No missing values'] END]) AS x FROM k JOIN t USING ("column"))
SELECT "column", x[1] AS rule, x[2] AS level, x[3] AS title FROM f WHERE x IS NOT NULL
"""


@query(_TOLD)
def observations(spark, d):
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    made = [F.lit(1.0).alias("one"), F.when(F.col("l_linenumber") == 1, quantity).otherwise(0.0).alias("rare"), ((quantity - 25.5) / 14.43).alias("standard"), F.pow(price / 1e4, F.lit(12.0)).alias("steep")]
    line = _t(spark, d, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", *made)
    return I.insights(P.profile(line)).select("column", "rule", "level", "title")


@query(f"SELECT r AS row, c AS col, CAST(round_even(least(greatest(v, 0), 1) * 255, 0) AS INTEGER) AS r, CAST(round_even(least(greatest(-v, 0), 1) * 255, 0) AS INTEGER) AS g, CAST(round_even(least(abs(v), 1) * 255, 0) AS INTEGER) AS b, 255 AS a FROM (SELECT r, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS c FROM {_ROW})")
def rendered_channels(spark, d):
    """Positive part, negative part and size of each cell as red, green and blue."""
    e, plane = _matrix(spark, d)
    v = F.col("value")
    parts = F.array(v, -v, F.abs(v))
    cells = e.withColumns(plane.columns(F.col("pos"))).select("frame", "row", "col", F.posexplode(parts).alias("channel", "value"))
    return C.render_rgb(cells, True).select("row", "col", "r", "g", "b", "a")


@query()
def observations_text(spark, d):
    return I.insights(P.profile(_t(spark, d, "lineitem"), _LINE))


_SHARE = "{c} || ' (' || CASE WHEN n = 0 OR {c} = 0 THEN '0%' WHEN {c} / n < 1e-4 THEN '<0.01%' WHEN {c} / n < 0.01 THEN printf('%.3f', {c} / n * 100) || '%' ELSE printf('%.2f', {c} / n * 100) || '%' END || ')'"


def _report_sql(source: str) -> str:
    """The report of (column, v) rows of finite values, fact by fact."""
    count, share = (lambda c: f"format('{{:,}}', {c})"), (lambda c: f"format('{{:,}}', {c}) || " + _SHARE.format(c=c).split("|| ", 1)[1])
    facts = [("overview", "Elements", count("n")), *[("overview", k, _number_sql(c)) for k, c in (("Mean", "mu"), ("Std", "sd"), ("Min", "lo"), ("Median", "med"), ("Max", "hi"))], ("overview", "Distinct", f"CASE WHEN u <= 8192 THEN {count('u')} ELSE 'more than 8,192' END")]
    facts += [("percentiles", f"{p:g}%", _number_sql(f"q[{i + 1}]")) for i, p in enumerate(P.PERCENTILES)]
    facts += [("composition", k, share(c)) for k, c in (("Finite", "n"), ("NaN", "none"), ("+Inf", "none"), ("-Inf", "none"), ("Zeros", "z"), ("Negative", "neg"), ("Positive", "pos"))]
    tail = "CASE WHEN abs(sk) < 0.5 THEN 'roughly symmetric' WHEN sk > 0 THEN 'right tail' ELSE 'left tail' END"
    peak = "CASE WHEN ku > 1 THEN 'heavier tails than normal' WHEN ku < -1 THEN 'lighter tails than normal' ELSE 'near-normal tails' END"
    facts += [("moments", "Variance", _number_sql("var")), ("moments", "Standard error", _number_sql("sem")), ("moments", "Skewness", f"{_number_sql('sk')} || ' — ' || {tail}"), ("moments", "Excess kurtosis", f"{_number_sql('ku')} || ' — ' || {peak}"), ("moments", "Coefficient of variation", f"coalesce({_number_sql('cv')}, '—')")]
    facts += [("moments", k, _number_sql(c)) for k, c in (("MAD", "dev"), ("L1 norm", "l1"), ("L2 norm", "l2"))] + [("moments", "Outliers", count("out"))]
    listed = ", ".join(f"['{s}', '{k}', {v}]" for s, k, v in facts)
    return f"""
WITH s AS ({source}), m AS (SELECT "column" AS c, avg(v) AS mu, median(v) AS med, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1),
b AS (SELECT c, count(*) AS n, any_value(mu) AS mu, any_value(med) AS med, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, var_samp(v) AS var, stddev_samp(v) / sqrt(count(*)) AS sem, count(DISTINCT v) AS u, quantile_cont(v, {[p / 100 for p in P.PERCENTILES]}) AS q, 0 AS none,
  count(*) FILTER (WHERE v = 0) AS z, count(*) FILTER (WHERE v < 0) AS neg, count(*) FILTER (WHERE v > 0) AS pos, avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5) AS sk, avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3 AS ku,
  CASE WHEN min(v) >= 0 AND any_value(mu) > 1e-12 THEN stddev_samp(v) / any_value(mu) END AS cv, mad(v) AS dev, sum(abs(v)) AS l1, sqrt(sum(v * v)) AS l2, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS out FROM s JOIN m ON c = "column" GROUP BY 1),
f AS (SELECT c, unnest(range({len(facts)})) AS position, unnest([{listed}]) AS x FROM b)
SELECT c AS "column", CAST(position AS INTEGER) AS position, x[1] AS section, x[2] AS key, x[3] AS value FROM f
"""


@query(_report_sql("SELECT 'l_quantity' AS \"column\", l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_extendedprice / 7 FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem"))
def stats_report(spark, d):
    """The price in sevenths: a value halfway between two texts, as hundredths give, is rounded up here and by its binary digits in SQL."""
    line = _t(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 7).alias("price"), "l_discount")
    return R.stats_report(P.profile(line))


# ------------------------------------------------------------- scalar functions

@query("SELECT event_id, round(sqrt(value * value + CAST(user_id AS DOUBLE) * user_id), 6) AS m FROM events")
def complex_magnitude(spark, d):
    return _rounded(_t(spark, d, "events").select("event_id", D.magnitude(F.col("value"), F.col("user_id").cast("double")).alias("m")))


@query("SELECT p_partkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (CASE WHEN b / 1024.0 < 10 THEN printf('%.2f', b / 1024.0::DOUBLE + 1e-9) ELSE printf('%.1f', b / 1024.0::DOUBLE + 1e-9) END) || ' KB' ELSE (CASE WHEN b / 1048576.0 < 10 THEN printf('%.2f', b / 1048576.0::DOUBLE + 1e-9) ELSE printf('%.1f', b / 1048576.0::DOUBLE + 1e-9) END) || ' MB' END AS size FROM (SELECT p_partkey, p_partkey * p_size * 7 AS b FROM part)")
def sizes_shown(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.size(F.col("p_partkey") * F.col("p_size") * 7).alias("size"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM documents")
def csv_cells(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.csv_cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS cell, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def cut_cells(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.cut_cell(F.col("text")).alias("cell"), X.escape_html(F.col("text")).alias("html"))


# ------------------------------------------------------------ array files


from . import array_queries  # noqa: E402, F401  (registers its queries here)
