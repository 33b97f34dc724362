import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}q" for _ in range(n))


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) pairs, over several partitions, with columns whose names the operators use inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS).repartition(3)
        if clash:
            from pyspark.sql import functions as F

            for c in ("d", "h", "c", "sha", "key", "part", "band", "comp", "marks", "row", "id", "size", "bucket", "node", "component", "value", "n", "left", "a", "b", "t", "root", "regs", "names", "sieve_row", "fp", "fan"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, a repeated row, ties and a long text."""
    rng = random.Random(3)
    long = words(rng, 30_000, 5000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (5, "another text of id five, which is a document of its own"), (None, "an id that is not there"), (None, "one more text without an id, longer than the other"), (None, None), (7, long), (8, long), (9, "ünïcödé 文字 🙂 " * 30)]
