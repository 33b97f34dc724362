"""Numbers, sizes, shapes and cells as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _exponential(v: Column, digits: int) -> Column:
    """``1.2345e-9``: an exponent without padding."""
    return F.regexp_replace(F.format_string(f"%.{digits}e", v), "e([+-])0(\\d)", "e$1$2")


def _significant(v: Column, digits: int) -> Column:
    """At most ``digits`` significant digits in plain notation, without zeros at the end."""
    plain = F.format_string(f"%.{digits - 1}e", v).cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, "(\\.\\d*?)0+$", "$1"), "\\.$", "")
    return F.regexp_replace(short, "^-0$", "0")


def number(v: Column) -> Column:
    """Text of a double: whole numbers below 1e15 plain, tiny and huge ones as 1.2345e-9, else 7 significant digits."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    tail = F.when((F.abs(v) < 1e-4) | (F.abs(v) >= 1e9), _exponential(v, 4)).otherwise(_significant(F.when(F.abs(v) < 1e15, v), 7))
    return F.when(F.isnan(v), "NaN").when(v == F.lit(INF), "inf").when(v == F.lit(-INF), "-inf").when(whole, F.when(whole, v).cast("long").cast("string")).otherwise(tail)


def _grouped(v: Column) -> Column:
    """Thousands separators in a plain decimal text."""
    head, tail = F.regexp_extract(v, "^(-?\\d+)", 1), F.regexp_extract(v, "(\\.\\d+)$", 1)
    return F.concat(F.regexp_replace(head, "(\\d)(?=(\\d{3})+$)", "$1,"), tail)


def short_number(v: Column) -> Column:
    """Six significant digits with separators; 1.234e+9 for the tiny and the huge."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    out = F.when((F.abs(v) < 1e-4) | (F.abs(v) >= 1e9), _exponential(v, 3)).otherwise(_grouped(_significant(F.when(F.abs(v) < 1e9, v), 6)))
    return F.when(v.isNull() | F.isnan(v), "NaN").when(v == F.lit(INF), "∞").when(v == F.lit(-INF), "-∞").when(whole, F.format_number(F.when(whole, v).cast("long"), 0)).otherwise(out)


def tick(v: Column) -> Column:
    """Axis label: 1.0e-5 style outside [1e-3, 1e6), without a plus sign; nothing for what is not finite."""
    far = (F.abs(v) < 1e-3) | (F.abs(v) >= 1e6)
    whole = v == F.floor(v)
    out = F.when(far, F.replace(_exponential(v, 1), F.lit("e+"), F.lit("e"))).when(whole, F.format_number(F.when(F.abs(v) < 1e6, v).cast("long"), 0)).otherwise(_significant(F.when(F.abs(v) < 1e6, v), 4))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(INF)), "").when(v == 0, "0").otherwise(out)


def count(n: Column) -> Column:
    return F.format_number(n, 0)


def size(n: Column) -> Column:
    """Bytes in steps of 1024: two decimals below 10, else one."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB")):
        v = n.cast("double") / float(1024 ** (i + 1))
        text = F.concat(F.when(v < 10, F.format_string("%.2f", v)).otherwise(F.format_string("%.1f", v)), F.lit(f" {unit}"))
        out = out.when(v < 1024, text) if i < 3 else out.otherwise(text)
    return out


def percent(part: Column, whole: Column) -> Column:
    """Share with 2 decimals, 3 below one percent; ``<0.01%`` for a trace."""
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when(r.isNull() | (r == 0), "0%").when(r < 1e-4, "<0.01%").when(r < 0.01, F.concat(F.format_string("%.3f", r * 100), F.lit("%"))).otherwise(F.concat(F.format_string("%.2f", r * 100), F.lit("%")))


def share(part: Column, whole: Column) -> Column:
    """Share as observations print it: 2 decimals, 3 below a thousandth."""
    r = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when(whole > 0, F.concat(F.when(r < 0.001, F.format_string("%.3f", r * 100)).otherwise(F.format_string("%.2f", r * 100)), F.lit("%"))).otherwise("0%")


def shape(dims: Column) -> Column:
    """``()``, ``(7,)`` or ``(2, 3)``."""
    return F.concat(F.lit("("), F.array_join(F.transform(dims, lambda d: d.cast("string")), ", "), F.when(F.size(dims) == 1, ",").otherwise(""), F.lit(")"))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", ms.cast("double") / 1000), F.lit(" s")))


def csv_cell(text: Column) -> Column:
    """A CSV cell, quoted only if it has a quote, a comma or a line feed."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[F.coalesce(csv_cell(c), F.lit("")) for c in cells])


def cut_cell(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters, the last three of a longer text being dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def complex_text(re_part: Column, im_part: Column) -> Column:
    """``1.5-2.5j``; a negative zero shows its sign."""
    minus = (im_part < 0) | (F.format_string("%f", im_part).startswith("-"))
    return F.concat(number(re_part), F.when(minus, "-").otherwise("+"), number(F.abs(im_part)), F.lit("j"))


def skewness_label(v: Column) -> Column:
    return F.when(F.abs(v) < 0.5, "roughly symmetric").when(v > 0, "right tail").otherwise("left tail")


def kurtosis_label(v: Column) -> Column:
    return F.when(v > 1, "heavier tails than normal").when(v < -1, "lighter tails than normal").otherwise("near-normal tails")


def shows_frequencies(distinct: Column, finite: Column, top_count: Column) -> Column:
    """Whether a frequency chart says more than a histogram."""
    return F.coalesce((top_count > 1) & (distinct >= 2) & (distinct * 2 <= finite), F.lit(False))
