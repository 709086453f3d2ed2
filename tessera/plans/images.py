"""Outlines, perspective and tilt over points that lines of orders stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geometry
from tessera.plans.registry import query, table

WIDTH, HEIGHT = 700, 600

OUTLINES = """card AS (SELECT l_orderkey AS image, l_linenumber, l_partkey, l_suppkey, l_partkey % 9 AS i, l_suppkey % 9 AS j, 60 + l_orderkey % 40 AS px, 40 + l_orderkey % 30 AS py, 300 + l_orderkey % 280 AS w, 200 + l_orderkey % 7 * 20 AS h, l_orderkey % 25 AS d FROM lineitem),
corner AS (SELECT image, px + i AS x, py + j AS y FROM card UNION ALL SELECT image, px + w - i, py + d + j FROM card UNION ALL SELECT image, px + w - d - i, py + h + d - j FROM card UNION ALL SELECT image, px - d + i, py + h - j FROM card),
point AS (SELECT DISTINCT image, CASE WHEN image % 3 = 0 THEN y ELSE x END AS x, CASE WHEN image % 3 = 0 THEN x ELSE y END AS y FROM corner),
side AS (SELECT a.image, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM point a JOIN point b ON a.image = b.image AND (a.x <> b.x OR a.y <> b.y)
 JOIN point c ON c.image = a.image GROUP BY ALL HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0))),
outline AS (SELECT image, count(*) AS n_corners, sum(xa * yb - ya * xb)::BIGINT AS twice_area, sum(sqrt(((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))::DOUBLE)) AS perimeter FROM side GROUP BY image)"""


def cards(spark, d):
    """Each line of an order says where the corners of the order's card are, up to some pixels inwards; a third of the cards lie sideways."""
    c = F.col
    k = c("l_orderkey")
    named = {"image": k, "i": c("l_partkey") % 9, "j": c("l_suppkey") % 9, "px": 60 + k % 40, "py": 40 + k % 30, "w": 300 + k % 280, "h": 200 + k % 7 * 20, "d": k % 25}
    return table(spark, d, "lineitem").select("l_linenumber", "l_partkey", "l_suppkey", *[v.alias(n) for n, v in named.items()])


def _laid(x, y):
    sideways = F.col("image") % 3 == 0
    return F.struct(F.when(sideways, y).otherwise(x).alias("x"), F.when(sideways, x).otherwise(y).alias("y"))


def outlines(spark, d):
    px, py, w, h, e, i, j = (F.col(n) for n in ("px", "py", "w", "h", "d", "i", "j"))
    four = F.array(_laid(px + i, py + j), _laid(px + w - i, py + e + j), _laid(px + w - e - i, py + h + e - j), _laid(px - e + i, py + h - j))
    return geometry.hulls(cards(spark, d).select("image", F.explode(four).alias("p")).select("image", "p.*"))


@query(f"WITH {OUTLINES} SELECT image, n_corners, twice_area, round(perimeter, 4) AS perimeter FROM outline")
def outline_hulls(spark, d):
    ring = F.col("ring")
    return outlines(spark, d).select("image", F.size("ring").cast("long").alias("n_corners"), geometry.twice_area(ring).alias("twice_area"), F.round(geometry.perimeter(ring), 4).alias("perimeter"))



def _off_sql(k: int) -> str:
    """How far the ring's point xa, ya is from side k."""
    a, b = f"q[{k + 1}]", f"q[{(k + 1) % 4 + 1}]"
    dx, dy, px, py = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)", f"(xa - {a}.x)", f"(ya - {a}.y)"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({px} * {dx} + {py} * {dy})::DOUBLE / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(({px} - {t} * {dx}) * ({px} - {t} * {dx}) + ({py} - {t} * {dy}) * ({py} - {t} * {dy}))"


def _turn_sql(i: int) -> str:
    o, a, b = (f"q[{(i + n) % 4 + 1}]" for n in range(3))
    return f"({a}.x - {o}.x) * ({b}.y - {o}.y) - ({a}.y - {o}.y) * ({b}.x - {o}.x) > 0"


def _aspect_sql(q: str) -> str:
    far = lambda a, b: f"sqrt((({q}[{a}].x - {q}[{b}].x) * ({q}[{a}].x - {q}[{b}].x) + ({q}[{a}].y - {q}[{b}].y) * ({q}[{a}].y - {q}[{b}].y))::DOUBLE)"
    return f"(({far(2, 1)} + {far(3, 4)}) / 2.0::DOUBLE) / (({far(4, 1)} + {far(3, 2)}) / 2.0::DOUBLE)"


_POINT = "{'x': xa, 'y': ya}"
QUADS = f"""{OUTLINES}, picked AS (SELECT image, [min_by({_POINT}, (xa + ya, xa, ya)), min_by({_POINT}, (ya - xa, xa, ya)), min_by({_POINT}, (-xa - ya, xa, ya)), min_by({_POINT}, (xa - ya, xa, ya))] AS q FROM side GROUP BY image),
held AS (SELECT image, any_value(q) AS q FROM picked JOIN outline USING (image) JOIN side USING (image)
 WHERE n_corners >= 4 AND twice_area >= 0.5 * {WIDTH} * {HEIGHT} AND {" AND ".join(map(_turn_sql, range(4)))} GROUP BY image, perimeter HAVING max(least({", ".join(map(_off_sql, range(4)))})) <= 0.02::DOUBLE * perimeter),
laid AS (SELECT image, CASE WHEN {_aspect_sql("q")} >= 1 THEN q ELSE [q[2], q[3], q[4], q[1]] END AS quad FROM held),
cards AS (SELECT image, quad, {_aspect_sql("quad")} AS aspect FROM laid WHERE {_aspect_sql("quad")} BETWEEN 1.45::DOUBLE AND 1.72::DOUBLE)"""


@query(f"WITH {QUADS} SELECT image, {', '.join(f'quad[{i + 1}].{v} AS {v}{i}' for i in range(4) for v in 'xy')}, round(aspect, 9) AS aspect FROM cards")
def card_outlines(spark, d):
    """The corners, from a long edge on, of the orders whose outline is a card's."""
    quads = geometry.card_quads(outlines(spark, d), F.lit(WIDTH), F.lit(HEIGHT))
    return quads.select("image", *[F.col("quad")[i][v].alias(f"{v}{i}") for i in range(4) for v in "xy"], F.round("aspect", 9).alias("aspect"))


# The SQL solves the eight equations by elimination; the operator knows the answer in closed form.
_EQUATIONS = ", ".join(
    row
    for i, (u, v) in enumerate(((0, 0), (1011, 0), (1011, 637), (0, 637)))
    for x, y in [(f"quad[{i + 1}].x::DOUBLE", f"quad[{i + 1}].y::DOUBLE")]
    for row in (f"[{x}, {y}, 1, 0, 0, 0, -{u}::DOUBLE * {x}, -{u}::DOUBLE * {y}, {u}]", f"[0, 0, 0, {x}, {y}, 1, -{v}::DOUBLE * {x}, -{v}::DOUBLE * {y}, {v}]")
)
SOLVED = f"""WITH RECURSIVE {QUADS}, solve AS (SELECT image, 1 AS step, [{_EQUATIONS}]::DOUBLE[][] AS m, NULL::DOUBLE[] AS p, 0 AS place FROM cards
 UNION ALL SELECT image, step + 1, list_transform(m, lambda r, i: CASE WHEN i = place THEN p ELSE list_transform(r, lambda v, j: v - r[step] * p[j]) END), NULL::DOUBLE[], 0 FROM (
  SELECT image, step, list_transform(m, lambda r, i: CASE WHEN i = step THEN m[big] WHEN i = big THEN m[step] ELSE r END) AS m, list_transform(m[big], lambda v: v / m[big][step]) AS p, step AS place
  FROM (SELECT *, list_position(sizes, list_max(sizes)) AS big FROM (SELECT image, step, m, list_transform(m, lambda r, i: CASE WHEN i < step THEN -1 ELSE abs(r[step]) END) AS sizes FROM solve WHERE step <= 8))))"""


@query(f"""{SOLVED}, spot AS (SELECT image, l_linenumber, l_partkey, l_suppkey, CASE WHEN image % 3 = 0 THEN sy ELSE sx END AS x, CASE WHEN image % 3 = 0 THEN sx ELSE sy END AS y FROM (SELECT *, px + l_partkey % 300 AS sx, py + l_suppkey % 200 AS sy FROM card))
SELECT image, l_linenumber, l_partkey, l_suppkey, floor(round((m[1][9] * x + m[2][9] * y + m[3][9]) / (m[7][9] * x + m[8][9] * y + 1) * 1000000) / 1000) / 1000 AS u, floor(round((m[4][9] * x + m[5][9] * y + m[6][9]) / (m[7][9] * x + m[8][9] * y + 1) * 1000000) / 1000) / 1000 AS v FROM spot JOIN solve USING (image) WHERE step = 9""")
def warped_spots(spark, d):
    """A spot of each line of an order whose outline is a card's, in the card's frame, cut to thousandths after millionths are rounded: two ways to solve differ in last digits, and exact halves of thousandths occur."""
    cut = lambda n: F.floor(F.rint(F.col(n) * 1000000) / 1000) / 1000
    quads = geometry.card_quads(outlines(spark, d), F.lit(WIDTH), F.lit(HEIGHT)).select("image", geometry.perspective(F.col("quad")).alias("m"))
    spot = _laid(F.col("px") + F.col("l_partkey") % 300, F.col("py") + F.col("l_suppkey") % 200)
    rows = cards(spark, d).withColumn("s", spot).join(quads, "image").withColumn("w", geometry.warped(F.col("m"), F.col("s.x"), F.col("s.y")))
    return rows.select("image", "l_linenumber", "l_partkey", "l_suppkey", cut("w.u").alias("u"), cut("w.v").alias("v"))


PAGE, LEAST, APART = 1000, 20, 60
_SLOPES = ", ".join(f"({k}, {s})" for k, s in geometry.slopes().items())

LINES = f"""p AS (SELECT DISTINCT l_suppkey AS image, l_partkey * 37 % {PAGE} AS x, 100 * l_linenumber + (l_partkey * 37 % {PAGE} * (l_suppkey % 41 - 20) / 100.0::DOUBLE)::INT AS y FROM lineitem),
vote AS (SELECT image, k, s, x, y, y + floor((32768 - (x - {PAGE // 2}) * s) / 65536.0::DOUBLE)::BIGINT AS o FROM p CROSS JOIN (VALUES {_SLOPES}) t(k, s)),
line AS (SELECT image, k, o, count(*) AS votes FROM vote GROUP BY ALL HAVING count(*) >= {LEAST}),
cut AS (SELECT *, coalesce(x - lag(x) OVER w > {APART}, false)::INT AS cut FROM vote JOIN line USING (image, k, o) WINDOW w AS (PARTITION BY image, k, o ORDER BY x)),
run AS (SELECT image, k, o, votes, min(x) AS x0, min_by(y, x) AS y0, max(x) AS x1, max_by(y, x) AS y1 FROM (SELECT *, sum(cut) OVER (PARTITION BY image, k, o ORDER BY x) AS r FROM cut) GROUP BY image, k, o, votes, r HAVING max(x) - min(x) >= {PAGE // 4}),
peak AS (SELECT * FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.image = a.image AND abs(b.k - a.k) <= 2 AND abs(b.o - a.o) <= 2 AND (b.votes, -abs(b.k), -b.k, -b.o) > (a.votes, -abs(a.k), -a.k, -a.o)))"""


def page_points(spark, d):
    """A supplier's page: points on seven tilted lines."""
    x, k = F.col("l_partkey") * 37 % PAGE, F.col("l_suppkey") % 41 - 20
    y = 100 * F.col("l_linenumber") + F.bround(x * k / F.lit(100.0)).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), F.lit(PAGE).alias("width"), x.alias("x"), y.alias("y"))


@query(f"WITH {LINES} SELECT image, k::INT AS bin, o AS off, votes, x0, y0, x1, y1 FROM peak")
def page_lines(spark, d):
    return geometry.lines(page_points(spark, d), LEAST, APART)


@query(f"""WITH {LINES}, tilt AS (SELECT image, degrees(atan2((y1 - y0)::DOUBLE, (x1 - x0)::DOUBLE)) AS a FROM peak),
skew AS (SELECT image, coalesce(median(a) FILTER (abs(a) <= 15), 0.0::DOUBLE) AS angle, count(a) FILTER (abs(a) <= 15) AS n_lines FROM (SELECT DISTINCT image FROM p) LEFT JOIN tilt USING (image) GROUP BY image)
SELECT image, round(angle, 6) AS angle, n_lines, round(CASE WHEN abs(angle) < 0.2::DOUBLE THEN 0.0::DOUBLE ELSE angle END, 6) AS turn FROM skew""")
def page_skews(spark, d):
    rows = geometry.skews(page_points(spark, d), LEAST, APART)
    return rows.select("image", F.round("angle", 6).alias("angle"), "n_lines", F.round(geometry.turn(F.col("angle")), 6).alias("turn"))
