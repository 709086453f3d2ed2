"""Likenesses in Column functions against the plain versions, at every length that one or more longs hold."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    made = [("", ""), ("", "a"), ("a", ""), ("a b c", "a b"), ("a", "b"), ("😀é x", "x 😀"), (None, "a"), ("a b\x1cc", "c  b"), ("ab" * 31, "ba" * 31), ("x" * 62, "x" * 63)]
    for n in (1, 3, 17, 61, 62, 63, 64, 124, 125, 150):
        for m in (1, 2, 16, 62, 63, 130):
            made.append((word(n, "abc d"), word(m, "abc d")))
    made += [(word(20, "abcdefgh"), word(20, "abcdefgh")) for _ in range(20)]
    return made


def test_likenesses(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(2)
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", fuzzy.common_length(a, b).alias("n"), fuzzy.likeness(a, b).alias("r"), fuzzy.partial_likeness(a, b).alias("p"), fuzzy.token_set_likeness(a, b).alias("t")).collect()
    assert len(got) == len(pairs)
    for r in got:
        if r.a is None:
            assert (r.n, r.r, r.p, r.t) == (None,) * 4
            continue
        assert (r.n, r.r, r.t) == (fuzzy.common_subsequence(r.a, r.b), fuzzy.ratio(r.a, r.b), fuzzy.token_set_ratio(r.a, r.b)), r
        assert r.p == fuzzy.partial_ratio(r.a, r.b), r


def test_no_python_in_the_plan(spark):
    lines = spark.createDataFrame([("x",)], "line string")
    assert "Python" not in fuzzy.is_printed_boilerplate(lines, "line")._jdf.queryExecution().toString()
