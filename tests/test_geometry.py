"""Hulls, cards, perspective and tilt against plain versions, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry


def plain_hull(points):
    """Every point that begins a side which no point lies outside of, clockwise as seen from the leftmost."""
    ps = sorted(set(points))
    if len(ps) == 1:
        return ps
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    beyond = lambda a, b, c: cross(a, b, c) == 0 and (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) > 0
    after = {a: b for a in ps for b in ps if a != b and all(cross(a, b, c) >= 0 and not beyond(a, b, c) for c in ps)}
    ring = [ps[0]]
    while (p := after[ring[-1]]) != ring[0]:
        ring.append(p)
    return ring


def test_hulls(spark):
    rng = random.Random(5)
    sets = {i: [(rng.randint(0, 12), rng.randint(-6, 6)) for _ in range(rng.randint(1, 40))] for i in range(40)}
    sets[40] = [(x, 3 * x) for x in range(-600, 600, 7)]  # a line through many slabs
    sets[41] = [(5, y) for y in range(9)]
    sets[42] = [(rng.randint(-2000, 2000), rng.randint(-2000, 2000)) for _ in range(60)]
    sets[43] = [(7, 7)] * 3
    rows = [(i, *p) for i, ps in sets.items() for p in ps * 2] + [(0, None, 3), (0, 3, None), (None, 1, 1), (99, None, None)]
    got = {r.image: [tuple(p) for p in r.ring] for r in geometry.hulls(spark.createDataFrame(rows, "image int, x int, y int")).collect()}
    assert got == {i: plain_hull(ps) for i, ps in sets.items()}


def test_hulls_over_many_batches(spark):
    rng = random.Random(6)
    sets = {str(i): [(rng.randint(-3000, 3000), rng.randint(-50, 50)) for _ in range(n)] for i, n in enumerate([1, 2, 300, 1, 7, 90])}
    sets["far"] = [(x * 2**33, y * 2**40 + 2**60) for x, y in sets["4"] + [(0, 0), (1, 1), (2, 2)]]
    sets["late"] = [(x, x * x) for x in range(60)] + [(60, -9)]  # its last point undoes one corner after the other
    rows = [(i, *p) for i, ps in sets.items() for p in ps]
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "image string, x long, y long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for image in (F.col("image"), F.struct(F.lit(1).alias("n"), "image")):
            got = geometry.hulls(given.withColumn("image", image)).collect()
            got = {r.image if isinstance(r.image, str) else r.image.image: [tuple(p) for p in r.ring] for r in got}
            assert got == {i: plain_hull(ps) for i, ps in sets.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hulls_of_nothing(spark):
    none = spark.createDataFrame([], "image int, x int, y int, width int")
    assert geometry.hulls(none).count() == geometry.lines(none).count() == geometry.skews(none).count() == 0


def quads(spark, outlines, size=(700, 600)):
    rows = [(i, *p) for i, ps in enumerate(outlines) for p in ps]
    hulls = geometry.hulls(spark.createDataFrame(rows, "image int, x int, y int"))
    return {r.image: ([tuple(p) for p in r.quad], r.aspect) for r in geometry.card_quads(hulls, F.lit(size[0]), F.lit(size[1])).collect()}


def test_cards(spark):
    card = [(50, 60), (550, 80), (540, 400), (40, 380)]
    upright = [(y, x) for x, y in card]
    rounded = [*card[1:], (55, 60), (50, 65)]
    square = [(50, 50), (450, 50), (450, 450), (50, 450)]
    bulging = [*card, (300, 10)]
    small = [(50, 60), (210, 60), (210, 160), (50, 160)]
    got = quads(spark, [card, upright, rounded, square, bulging, small, card[:3], [(0, 0), (500, 100)]])
    assert sorted(got) == [0, 1, 2]
    assert got[0][0] == card and got[0][1] == pytest.approx(math.hypot(500, 20) / math.hypot(10, 320))
    assert got[1][0] == [(380, 40), (400, 540), (80, 550), (60, 50)]  # from a long edge on
    assert set(got[2][0]) >= set(card[1:])
    assert not quads(spark, [card], (7000, 600))


def test_perspective_solves_the_equations(spark):
    rng = random.Random(8)
    given = [[(rng.randint(0, 60), rng.randint(0, 60)), (rng.randint(400, 600), rng.randint(0, 60)), (rng.randint(400, 600), rng.randint(250, 400)), (rng.randint(0, 60), rng.randint(250, 400))] for _ in range(20)]
    given.append([(0, 0), (1011, 0), (1011, 637), (0, 637)])
    df = spark.createDataFrame([(i, q) for i, q in enumerate(given)], "i int, q array<struct<x:bigint,y:bigint>>").select("i", "q", geometry.perspective(F.col("q")).alias("m"))
    df = df.withColumn("to", F.transform("q", lambda p: geometry.warped(F.col("m"), p["x"], p["y"])))
    frame = [(0, 0), (1011, 0), (1011, 637), (0, 637)]
    for r in df.collect():
        a, b = [], []
        for (x, y), (u, v) in zip(given[r.i], frame, strict=True):
            a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            b += [u, v]
        assert np.allclose(list(r.m), np.linalg.solve(np.array(a, float), np.array(b, float)), rtol=1e-7, atol=1e-9)
        assert np.allclose([tuple(p) for p in r.to], frame, atol=1e-6)


def drawn(slope, y0=100, xs=range(0, 800), width=800):
    return [(width, x, round(y0 + slope * x)) for x in xs]


def skews(spark, images, **more):
    rows = [(i, *p) for i, ps in images.items() for p in ps]
    return {r.image: (r.angle, r.n_lines) for r in geometry.skews(spark.createDataFrame(rows, "image string, width int, x int, y int"), **more).collect()}


def test_tilts(spark):
    rng = random.Random(3)
    tilt = lambda a: math.tan(math.radians(a))
    images = {
        "level": drawn(0.0), "twice": drawn(0.0) * 2, "down": drawn(tilt(4)) + drawn(tilt(4), 300), "up": drawn(tilt(-7.5), 500), "steep": drawn(tilt(30)), "upright": [(800, 50, y) for y in range(700)],
        "short": drawn(0.0, xs=range(0, 150)), "gaps": drawn(0.0, xs=[x for x in range(800) if x % 100 < 75]), "dashes": drawn(0.0, xs=[x for x in range(800) if x % 22 == 0]),
        "median": drawn(tilt(2), 100) + drawn(tilt(2), 200) + drawn(tilt(-10), 500), "noise": [(800, rng.randrange(800), rng.randrange(600)) for _ in range(500)], "alone": [(800, 4, 4)], "left": [(800, x - 900, 5) for x in range(800)],
    }
    got = skews(spark, images)
    assert set(got) == set(images)
    for name, want in {"level": 0, "twice": 0, "down": 4, "up": -7.5, "median": 2, "left": 0}.items():
        assert got[name][0] == pytest.approx(want, abs=0.3) and got[name][1] >= 1, name
    assert got["level"] == got["twice"] == (0.0, 1)
    for name in ("steep", "upright", "short", "gaps", "dashes", "noise", "alone"):
        assert got[name] == (0.0, 0), name
    assert skews(spark, {"gaps": images["gaps"]}, gap=30)["gaps"] == (0.0, 1)


def test_incomplete_points_take_no_part(spark):
    got = skews(spark, {"a": [*drawn(0.0), (None, 1, 1), (800, None, 1), (800, 1, None)], "b": [(800, None, 2)]})
    assert got == {"a": (0.0, 1)}
    with pytest.raises(ValueError):
        geometry.lines(spark.createDataFrame([], "image int, width int, x int, y int"), gap=64)


def test_turning(spark):
    df = spark.createDataFrame([(0.1,), (90.0,), (-90.0,), (None,)], "a double")
    at = geometry.turned(F.col("a"), F.lit(10.0), F.lit(0.0), F.lit(20), F.lit(20)).alias("p")
    small, right, left, none = (r.p for r in df.select(at).collect())
    assert (small.x, small.y) == (10, 0) and none.x is None
    assert (right.x, right.y) == pytest.approx((0, 10)) and (left.x, left.y) == pytest.approx((20, 10))
