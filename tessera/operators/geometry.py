"""Outlines and tilts of images from their edge points: convex hulls, corners of cards, perspective, and Hough votes.

Points are a table: image, x, y in whole pixels, y growing downwards; a point without any of the three takes no part, and a point
said again counts once. What finds edge points in pixels is no matter of this module.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.spatial import CARD_ASPECTS

# Fixed values.
CARD_FRAME, LEAST_AREA, SLACK = (1012, 638), 0.25, 0.02
MOST_TILT, LEAST_TILT, ANGLE_STEP, VOTES, GAP, LENGTH_SHARE = 15.0, 0.2, 0.5, 100, 20, 4

#: Columns of pixels whose points are brought to a ring at once; the rings of an image's slabs make another.
SLAB = 1024
#: One pixel in the whole numbers that slopes are counted in, as a power of two.
SHIFT = 16
#: Heights of lines, where they cross the middle of an image, that one task looks through.
STRIP = 1024
#: How far around a peak, in bins of slope and in offsets, fainter lines are the same line.
PEAK = 2

_POINTS = "array<struct<x:bigint,y:bigint>>"


def _complete(points: DataFrame, *more: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return points.select("image", *map(long, (*more, "x", "y"))).dropna(subset=["image", *more, "x", "y"])


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _rings():
    """What tasks make rings with. It all stands inside, as executors need not have this library."""

    def chain(of: np.ndarray, x: np.ndarray, y: np.ndarray, down: int) -> np.ndarray:
        """Places of the points on convex chains of least y under sets of points that ascend by x, one for an x; with down -1, of greatest y.

        A point on or beyond the stretch between two others of its set is no corner, so all that are seen to be so go at once, until
        a set loses none.
        """
        kept, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at) > 2:
            s, px, py = of[at], x[at], y[at]
            turn = (px[1:-1] - px[:-2]) * (py[2:] - py[:-2]) - (py[1:-1] - py[:-2]) * (px[2:] - px[:-2])
            out = np.r_[False, (s[:-2] == s[2:]) & (turn * down <= 0), False]
            kept[at[out]] = False
            losing = np.zeros(of[-1] + 1, bool)
            losing[s[out]] = True
            at = at[losing[s] & ~out]
        return np.flatnonzero(kept)

    def rings(of: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
        """The rings of sets of points; of says the set, numbered from 0 on."""
        order = np.lexsort((x, of))
        of, x, y = of[order], x[order], y[order]
        if max(abs(int(end)) for v in (x, y) for end in (v.min(), v.max())) >= 1 << 29:
            x, y = x.astype(object), y.astype(object)  # what turns are told by may not fit 64 bits
        column = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (x[1:] != x[:-1])])
        of, x, lo, hi = of[column], x[column], np.minimum.reduceat(y, column), np.maximum.reduceat(y, column)
        top, low = chain(of, x, lo, 1), chain(of, x, hi, -1)
        # Both chains have a set's first and last column: where that is one point, it is said once.
        end = np.r_[True, of[1:] != of[:-1], True]
        low = low[(lo != hi)[low] | ~(end[:-1] | end[1:])[low]]
        sets = np.r_[of[top], of[low]]
        order = np.lexsort((np.r_[top, 2 * len(of) - low], sets))
        xs, ys = (pa.array(v[order], pa.int64()) for v in (np.r_[x[top], x[low]], np.r_[lo[top], hi[low]]))
        ends = np.r_[0, np.cumsum(np.bincount(sets))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([xs, ys], ["x", "y"]))

    def differ(image: pa.Array) -> np.ndarray:
        if pa.types.is_nested(image.type):
            return np.array([p != q for p, q in pairwise(image.to_pylist())], bool)
        return pc.not_equal(image[1:], image[:-1]).to_numpy(zero_copy_only=False)

    def of_points(batches):
        """Rings of images whose points follow each other. The last of a batch goes on in the next as its ring."""
        held = None
        for batch in filter(len, batches):
            image, x, y = batch.column(0), *(batch.column(n).to_numpy() for n in (1, 2))
            if held:
                last, ring = held[0], held[1].flatten()
                image = pa.concat_arrays([last.take(pa.array(np.zeros(len(ring), int))), image])
                x, y = (np.r_[ring.field(n).to_numpy(), v] for n, v in enumerate((x, y)))
            new = np.r_[True, differ(image)]
            images, each = image.take(pa.array(np.flatnonzero(new))), rings(np.cumsum(new) - 1, x, y)
            yield pa.RecordBatch.from_arrays([images[:-1], each[:-1]], ["image", "ring"])
            held = images[-1:], each[-1:]
        if held:
            yield pa.RecordBatch.from_arrays(list(held), ["image", "ring"])

    def of_slabs(batches):
        """Of images and the rings of their slabs, the images' rings."""
        for image, many in (batch.columns for batch in batches):
            each = many.flatten()
            if len(each) > len(many):
                points, (n, m) = each.flatten(), (pc.list_value_length(v).to_numpy() for v in (many, each))
                each = rings(np.repeat(np.repeat(np.arange(len(n)), n), m), *(points.field(v).to_numpy() for v in ("x", "y")))
            yield pa.RecordBatch.from_arrays([image, each], ["image", "ring"])

    return of_points, of_slabs


def hulls(points: DataFrame) -> DataFrame:
    """image, ring: the corners of its points' convex hull, clockwise as seen, from the leftmost (of those the topmost) on.

    Points on a side are no corners; where all lie on a line the ring is its ends, or the one point. Slabs of pixel columns are spread, and a
    ring is made of an image's points batch by batch where they come together; then rings of slabs become those of the image: no task
    holds more of an image than a batch of points and its slabs' rings.
    """
    of_points, of_slabs = _rings()
    schema = StructType([points.schema["image"], *StructType.fromDDL(f"ring {_POINTS}")])
    rows = _complete(points).repartition("image", F.floor(F.col("x") / SLAB)).sortWithinPartitions("image")
    return rows.mapInArrow(of_points, schema).groupBy("image").agg(F.collect_list("ring").alias("rings")).mapInArrow(of_slabs, schema)


def _with(value: Column, use) -> Column:
    """What use makes of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sides(ring: Column) -> Column:
    """From and to of each side of a ring."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))


def twice_area(ring: Column) -> Column:
    return F.aggregate(_sides(ring), F.lit(0).cast("long"), lambda sum_, s: sum_ + s["a"]["x"] * s["b"]["y"] - s["a"]["y"] * s["b"]["x"])


def _length(a: Column, b: Column) -> Column:
    dx, dy = (a["x"] - b["x"]).cast("double"), (a["y"] - b["y"]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def perimeter(ring: Column) -> Column:
    return F.aggregate(_sides(ring), F.lit(0.0), lambda sum_, s: sum_ + _length(s["a"], s["b"]))


def corners(ring: Column) -> Column:
    """Four points of a ring: top left, top right, low right, low left, as their sums and differences say; of equals the leftmost, then topmost."""

    def first(by, y) -> Column:
        """The point of least by, which gives y together with x: so of equals the leftmost is one point."""
        least = F.array_min(F.transform(ring, lambda p: F.struct(by(p["x"], p["y"]).alias("by"), p["x"].alias("x"))))
        return _with(least, lambda p: F.struct(p["x"].alias("x"), y(p["by"], p["x"]).alias("y")))

    return F.array(
        first(lambda x, y: x + y, lambda by, x: by - x),
        first(lambda x, y: y - x, lambda by, x: by + x),
        first(lambda x, y: -x - y, lambda by, x: -by - x),
        first(lambda x, y: x - y, lambda by, x: x - by),
    )


def _sizes(quad: Column) -> tuple[Column, Column]:
    """The mean width and height of four corners. A quad turned on by one corner has them the other way round."""
    return (_length(quad[1], quad[0]) + _length(quad[2], quad[3])) / 2, (_length(quad[3], quad[0]) + _length(quad[2], quad[1])) / 2


def _share(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height).otherwise(0.0)


def aspect(quad: Column) -> Column:
    """The mean width of four corners over their mean height; 0 without a height."""
    return _share(*_sizes(quad))


def _stretch(a: Column, b: Column) -> Column:
    """Where a stretch begins, where it goes, and its length squared, if it has one."""
    x, y = a["x"].cast("double"), a["y"].cast("double")
    dx, dy = b["x"] - x, b["y"] - y
    return F.struct(x.alias("x"), y.alias("y"), dx.alias("dx"), dy.alias("dy"), F.nullif(dx * dx + dy * dy, F.lit(0.0)).alias("square"))


def _off(p: Column, s: Column) -> Column:
    """How far a point is from a stretch."""
    px, py = p["x"] - s["x"], p["y"] - s["y"]
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * s["dx"] + py * s["dy"]) / s["square"]))
    return _with(along, lambda t: F.sqrt((px - t * s["dx"]) * (px - t * s["dx"]) + (py - t * s["dy"]) * (py - t * s["dy"])))


def card_quads(outlines: DataFrame, width: Column, height: Column) -> DataFrame:
    """image, quad and aspect of the outlines (image, ring) that are a card's in a picture of that width and height.

    The ring takes up the least share of the picture, comes as near to its four corners' sides as a polygon of four would have to, and
    has a card's shape once the corners start from a long edge. Other outlines give no row: fewer than four different corners, a
    corner that doesn't turn, or an unknown size.
    """
    ring, q, w, h = F.col("ring"), [F.col(f"q{i}") for i in range(4)], F.col("w"), F.col("h")
    large = outlines.where((F.size("ring") >= 4) & (twice_area(ring) >= 2 * LEAST_AREA * width * height))
    # Made by a generator, as filters on columns of a projection would work them out again for each time they name them.
    at = lambda c: F.struct(*[c[i].alias(f"q{i}") for i in range(4)], *[v.alias(n) for v, n in zip(_sizes(c), "wh", strict=True)])
    rows = large.select("image", "ring", F.inline(F.array(_with(corners(ring), at))))
    long = _share(w, h) >= 1
    shape = F.when(long, _share(w, h)).otherwise(_share(h, w))
    turns = reduce(and_, (_cross(q[i], q[(i + 1) % 4], q[(i + 2) % 4]) > 0 for i in range(4)))
    held = F.struct((SLACK * perimeter(ring)).alias("most"), F.array(*[_stretch(q[i], q[(i + 1) % 4]) for i in range(4)]).alias("sides"))
    near = _with(held, lambda k: F.forall(ring, lambda p: F.exists(k["sides"], lambda s: _off(p, s) <= k["most"])))
    # What is soonest said comes first: only outlines of a card's shape are held to their sides.
    cards = rows.where(turns & shape.between(*CARD_ASPECTS) & near)
    return cards.select("image", F.when(long, F.array(*q)).otherwise(F.array(*q[1:], q[0])).alias("quad"), shape.alias("aspect"))


def perspective(quad: Column, frame: tuple[int, int] = CARD_FRAME) -> Column:
    """The eight numbers a to h that take a quad's corners, in order, to those of a frame: u = (ax + by + c) / (gx + hy + 1), v with d, e, f.

    The way from the unit square to the quad is known in closed form; its adjugate is the way back.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((quad[i]["x"].cast("double"), quad[i]["y"].cast("double")) for i in range(4))
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    den = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    a, b, d, e = x1 - x0 + g * x1, x3 - x0 + h * x3, y1 - y0 + g * y1, y3 - y0 + h * y3
    one = a * e - b * d
    u, v = frame[0] - 1.0, frame[1] - 1.0
    back = {
        "a": (e - y0 * h) * u, "b": (x0 * h - b) * u, "c": (b * y0 - x0 * e) * u,
        "d": (y0 * g - d) * v, "e": (a - x0 * g) * v, "f": (x0 * d - a * y0) * v,
        "g": d * h - e * g, "h": b * g - a * h,
    }
    return F.struct(*[(n / one).alias(k) for k, n in back.items()])


def warped(m: Column, x: Column, y: Column) -> Column:
    """Where a point of the picture comes in the frame."""
    w = m["g"] * x + m["h"] * y + 1.0
    return F.struct(((m["a"] * x + m["b"] * y + m["c"]) / w).alias("u"), ((m["d"] * x + m["e"] * y + m["f"]) / w).alias("v"))


def slopes(most: float = MOST_TILT) -> dict[int, int]:
    """Bins of tilt, a step apart up to the most on both sides, each with its slope in parts of a pixel."""
    n = math.floor(most / ANGLE_STEP)
    return {k: round(math.tan(math.radians(k * ANGLE_STEP)) * (1 << SHIFT)) for k in range(-n, n + 1)}


def _fall(slope: Column, x: Column) -> Column:
    """How far a line has gone up, in whole pixels, x from the middle of the picture."""
    return F.shiftright(F.lit(1 << (SHIFT - 1)) - x * slope, SHIFT)


def _strip_runs(tilts: dict[int, int], votes: int, gap: int, share: int):
    """Of the points of a strip, the stretches on lines with enough votes. A column of pixels has one height on a line, so a point on it is one vote."""

    def of(key, points):
        image, width, strip = key
        width, low = width.as_py(), strip.as_py() * STRIP
        mid = width // 2
        x, y = np.unique(np.stack([points["x"].to_numpy(), points["y"].to_numpy()]), axis=1)
        out = []
        for k, slope in tilts.items():
            o = y + (((1 << (SHIFT - 1)) - (x - mid) * slope) >> SHIFT) - low
            inside = (o >= 0) & (o < STRIP)
            many = np.bincount(o[inside], minlength=STRIP)
            on = np.flatnonzero(inside)
            on = on[many[o[on]] >= votes]
            if not len(on):
                continue
            # The points ascend by x, and a stable sort keeps them so on each line.
            on = on[np.argsort(o[on], kind="stable")]
            xs, os = x[on], o[on]
            cut = np.flatnonzero((np.diff(os) != 0) | (np.diff(xs) > gap))
            first, last = np.r_[0, cut + 1], np.r_[cut, len(on) - 1]
            long = xs[last] - xs[first] >= width // share
            first, last = first[long], last[long]
            out.append([np.full(len(first), k), np.full(len(first), slope), os[first] + low, many[os[first]], xs[first], xs[last]])
        bins, slope, off, n, x0, x1 = np.concatenate(out, axis=1) if out else np.empty((6, 0), np.int64)
        same = lambda v: pa.array([v] * len(bins), pa.int64())
        columns = {"image": pa.array([image.as_py()] * len(bins), image.type), "width": same(width), "bin": pa.array(bins, pa.int32())}
        return pa.table(columns | {"slope": slope, "off": off, "votes": n, "x0": x0, "x1": x1, "mid": same(mid)})

    return of


def lines(points: DataFrame, votes: int = VOTES, gap: int = GAP, share: int = LENGTH_SHARE, most: float = MOST_TILT) -> DataFrame:
    """image, bin, off, votes, x0, y0, x1, y1: stretches of near-horizontal lines through the points of images (image, width, x, y).

    A point votes for each bin of tilt and, in it, for the height at which such a line crosses the middle. A line has at least so
    many votes and is a peak: none within PEAK bins and heights has more (of equals the flatter, then the lesser bin and height).
    Its stretches are cut where more than gap columns are empty, and at least the share of the width long.

    Points are shuffled, not votes, of which each makes as many as there are bins. Of strips across an image, STRIP heights of the middle
    each, one has all points that vote in it, so its lines are counted and cut alone and no task holds more of an image than a strip;
    only stretches that are long enough leave it.
    """
    if not 0 < gap < 64:
        raise ValueError("a gap is of 1 to 63 columns")
    c = F.col
    tilts = slopes(most)
    end = lambda slope: c("y") + _fall(F.lit(slope).cast("long"), c("x") - c("mid"))
    steep = max(tilts.values())
    lo, hi = (F.floor(pick(end(steep), end(-steep)) / STRIP) for pick in (F.least, F.greatest))
    placed = _complete(points, "width").withColumn("mid", F.floor(c("width") / 2)).withColumn("strip", F.explode(F.sequence(lo, hi)))
    runs = placed.groupBy("image", "width", "strip")
    longs = "width bigint, bin int, slope bigint, off bigint, votes bigint, x0 bigint, x1 bigint, mid bigint"
    schema = StructType([points.schema["image"], *StructType.fromDDL(longs)])
    found = runs.applyInArrow(_strip_runs(tilts, votes, gap, share), schema)
    rank = F.struct("votes", (-F.abs("bin")).alias("flat"), (-c("bin")).alias("low"), (-c("off")).alias("high"))
    # An image's lines come together before they are said again for the bins around.
    near = found.repartition("image", "width").withColumn("rank", rank).withColumn("to", F.explode(F.sequence(c("bin") - PEAK, c("bin") + PEAK)))
    around = Window.partitionBy("image", "width", "to").orderBy("off").rangeBetween(-PEAK, PEAK)
    peaks = near.withColumn("best", F.max("rank").over(around)).where("to = bin and best = rank")
    y = lambda x: c("off") - _fall(c("slope"), x - c("mid"))
    return peaks.select("image", "bin", "off", "votes", "x0", y(c("x0")).alias("y0"), "x1", y(c("x1")).alias("y1"))


def skews(points: DataFrame, votes: int = VOTES, gap: int = GAP, share: int = LENGTH_SHARE, most: float = MOST_TILT) -> DataFrame:
    """image, angle, n_lines: the median tilt in degrees of an image's stretches of lines; 0 where it has none. Images without a whole point give no row."""
    found = lines(points, votes, gap, share, most)
    tilt = F.degrees(F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double")))
    tilts = found.select("image", tilt.alias("tilt")).where(F.abs("tilt") <= most)
    every = _complete(points, "width").groupBy("image").agg(F.lit(None).cast("double").alias("tilt"))
    return every.unionByName(tilts).groupBy("image").agg(F.coalesce(F.percentile("tilt", F.lit(0.5)), F.lit(0.0)).alias("angle"), F.count("tilt").alias("n_lines"))


def turn(angle: Column) -> Column:
    """The angle to turn an image by: none for a tilt too small to matter."""
    return F.when(F.abs(angle) < LEAST_TILT, 0.0).otherwise(angle)


def turned(angle: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Where a point comes when an image is turned by an angle about its middle."""
    turns = F.radians(turn(angle))
    cos, sin, mx, my = F.cos(turns), F.sin(turns), width / 2, height / 2
    return F.struct((mx + cos * (x - mx) + sin * (y - my)).alias("x"), (my - sin * (x - mx) + cos * (y - my)).alias("y"))
