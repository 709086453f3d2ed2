"""What goes through shuffles grows with the input and not with what is worked out from it."""

import random

from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import decode
from tessera.operators import geometry, grammar


def shuffled(df):
    """Rows written by each exchange of a run."""
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_points_are_shuffled_and_not_votes(spark):
    rng = random.Random(2)
    at = [(i, rng.randrange(1000), j % 7) for i in range(6) for j in range(600)]
    rows = [(i, 1000, x, 100 * j + x // 10) for i, x, j in at]
    points = spark.createDataFrame(rows, "image int, width int, x int, y int")
    assert 0 < max(shuffled(geometry.lines(points, 20, 60))) <= 2 * len(rows)


def test_each_template_is_read_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "{{ a.b }}" if i % 2 else None, "x" if i % 4 else None) for i in range(400)], "i int, t string, u string")
    read = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            read.add(len(b))
            yield b.assign(n=b["t"].fillna("-") + b["u"].fillna("-"))

    told = grammar.once_per_text(rows, ["t", "u"], "n", lambda texts: texts.mapInPandas(one, "t string, u string, n string")).cache()
    assert {(r.i, r.n) for r in told.collect()} == {(i, ("{{ a.b }}" if i % 2 else "-") + ("x" if i % 4 else "-")) for i in range(400)}
    assert told.count() == 400 and read.value == 3
    told.unpersist()
    spark.range(1000).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("template_reads", "template_uploads"):
        plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan, name


def test_points_of_outlines_are_shuffled_once(spark):
    points = spark.createDataFrame([(i, x, x * x % 97) for i in range(5) for x in range(90)], "image int, x int, y int")
    written = shuffled(geometry.hulls(points))
    assert len(written) == 2 and max(written) == 450 and min(written) <= 5 * 4


def test_blocks_are_spread_before_they_are_read(spark):
    rows = spark.range(50).select("id", F.lit("I" * 90).alias("raw")).coalesce(1)
    plan = decode.parse_td1(rows, "raw", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in plan
    values = spark.createDataFrame([("A1<z",), ("ZZ9",), ("",)], "v string").select("v", decode.check_digit(F.col("v")).alias("d"))
    assert {r.v: r.d for r in values.collect()} == {"A1<z": "3", "ZZ9": "9", "": "0"}


def test_outlines_are_looked_at_once(spark):
    points = spark.createDataFrame([(0, 50, 60), (0, 550, 80), (0, 540, 400), (0, 40, 380)], "image int, x int, y int")
    cards = geometry.card_quads(geometry.hulls(points), F.lit(700), F.lit(600))
    plan = cards.where("aspect > 1").selectExpr("image", "quad[0].x", "quad[1].y", "aspect", "aspect * 2")._jdf.queryExecution().optimizedPlan().toString()
    # A least for each corner, rings of points and rings of slabs; points are not grouped by pixel columns.
    assert plan.count("array_min") == 4 and "ArrowEvalPython" not in plan
    assert plan.count("MapInArrow") == 2 and plan.count("Aggregate") == 1
    assert cards.count() == 1


def test_lengths_of_sides_are_worked_out_once(spark):
    outlines = spark.createDataFrame([(0, [(50, 60), (550, 80), (540, 400), (40, 380)])], "image int, ring array<struct<x:bigint,y:bigint>>")
    cards = geometry.card_quads(outlines, F.lit(700), F.lit(600))
    # Two widths, two heights, the perimeter, and how far a point is from a side.
    assert cards._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 6
    assert [(r.aspect, r.quad[0].x) for r in cards.collect()] == [(((500**2 + 20**2) ** 0.5) / ((10**2 + 320**2) ** 0.5), 50)]
