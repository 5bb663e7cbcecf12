"""Box geometry as Column builders. A box is the four columns x0, y0, x1, y1 behind a prefix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return positive(self.x1 - self.x0)

    @property
    def height(self) -> Column:
        return positive(self.y1 - self.y0)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def intersection(self, o: Box) -> Column:
        return self.overlap_x(o) * self.overlap_y(o)

    def overlap_x(self, o: Box) -> Column:
        return positive(F.least(self.x1, o.x1) - F.greatest(self.x0, o.x0))

    def overlap_y(self, o: Box) -> Column:
        return positive(F.least(self.y1, o.y1) - F.greatest(self.y0, o.y0))

    def coverage(self, outer: Box) -> Column:
        """Share of this box inside another."""
        return ratio(self.intersection(outer), self.area)

    def center_inside(self, o: Box) -> Column:
        return self.cx.between(o.x0, o.x1) & self.cy.between(o.y0, o.y1)

    def narrower_overlap(self, o: Box) -> Column:
        """Horizontal overlap over the narrower width, which counts as 1 at least."""
        return self.overlap_x(o) / F.greatest(F.lit(1.0), F.least(self.x1 - self.x0, o.x1 - o.x0))

    def gap_y(self, o: Box) -> Column:
        return positive(F.greatest(self.y0, o.y0) - F.least(self.y1, o.y1))

    def gap_x(self, o: Box) -> Column:
        return positive(F.greatest(self.x0, o.x0) - F.least(self.x1, o.x1))

    def clipped(self, w, h) -> Box:
        return Box(*(F.greatest(F.lit(0.0), F.least(c, _c(m))) for c, m in ((self.x0, w), (self.y0, h), (self.x1, w), (self.y1, h))))

    def rounded(self) -> Box:
        """To whole pixels, halves to the even one."""
        return Box(*(F.bround(c).cast("long") for c in (self.x0, self.y0, self.x1, self.y1)))

    def rotated(self, degrees: Column) -> Box:
        """The box around the four corners in a frame turned by the angle: x inline, y block."""
        t = F.radians(degrees)
        xs = [x * F.cos(t) + y * F.sin(t) for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        ys = [y * F.cos(t) - x * F.sin(t) for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def valid(self) -> Column:
        finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (self.x0, self.y0, self.x1, self.y1)]
        return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (self.x1 > self.x0) & (self.y1 > self.y0), F.lit(False))


def points_to_pixels(left: Column, top: Column, right: Column, bottom: Column, origin: Column, page_w: Column, page_h: Column, px_w: Column, px_h: Column) -> Box:
    """A box in points, from either origin, as clipped pixels from the top left; null if a side is missing."""
    flipped = F.upper(F.coalesce(origin, F.lit("TOPLEFT"))) == "BOTTOMLEFT"
    t, b = (F.when(flipped, page_h - y).otherwise(y) for y in (top, bottom))
    sx, sy = px_w / page_w, px_h / page_h
    whole = left.isNotNull() & t.isNotNull() & right.isNotNull() & b.isNotNull()
    box = Box(F.least(left, right) * sx, F.least(t, b) * sy, F.greatest(left, right) * sx, F.greatest(t, b) * sy).clipped(px_w, px_h)
    return Box(*(F.when(whole, c) for c in (box.x0, box.y0, box.x1, box.y1)))


def normal_angle(value: Column) -> Column:
    """Degrees in [0, 360); null for what is no finite number."""
    x = value.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.pmod(x, F.lit(360.0)))


def angle_distance(a: Column, b: Column) -> Column:
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def parallel(a: Column, b: Column, tolerance: float = 12.0) -> Column:
    """Whether two directions lie along one line; null if either is unknown."""
    d = angle_distance(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(d, F.abs(180.0 - d)) <= tolerance)


def reliable_conflict(a: Column, a_confidence: Column, b: Column, b_confidence: Column, least: float = 0.75) -> Column:
    """Both directions are well known and not parallel."""
    return F.coalesce((a_confidence >= least) & (b_confidence >= least) & ~parallel(a, b), F.lit(False))


#: Types whose shape tells along which axis they read.
INFERRED = ["Text", "Caption", "List", "Footnote"]


def direction(angle: Column, confidence: Column, box: Box, kind: Column | None = None) -> Column:
    """The stated direction, else the long axis of a box of ratio 2 or more with confidence .45, else null.

    kind: the region's type; given, only texts' axes are inferred. Sides count as 1 at least.
    """
    w, h = F.greatest(F.lit(1.0), box.width), F.greatest(F.lit(1.0), box.height)
    inferred = F.when(h >= 2 * w, F.lit(90.0)).when(w >= 2 * h, F.lit(0.0))
    if kind is not None:
        inferred = F.when(kind.isin(INFERRED), inferred)
    stated = normal_angle(angle)
    return F.struct(
        F.coalesce(stated, inferred).alias("degrees"),
        F.when(stated.isNotNull(), F.coalesce(confidence, F.lit(1.0))).when(inferred.isNotNull(), F.lit(0.45)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(stated.isNotNull(), "explicit").when(inferred.isNotNull(), "axis").otherwise("unknown").alias("source"),
    )


def conflicting(a: Column, b: Column, least: float = 0.75) -> Column:
    """Whether two direction() structs are both stated, well known and not parallel."""
    stated = (a["source"] == "explicit") & (b["source"] == "explicit")
    return F.coalesce(stated & (a["confidence"] >= least) & (b["confidence"] >= least) & ~parallel(a["degrees"], b["degrees"]), F.lit(False))


def local_relation(candidate: Box, anchor: Box, degrees: Column | None) -> Column:
    """Struct of side, gap and overlap: where the candidate lies around the anchor in a frame turned by the angle; None: turned already.

    Sides are before and after along the stacking of lines, inline_before and inline_after along a line; of several the
    one with the least gap, in this order. Overlap is that of the other axis. Side is null where they meet or no angle is known.
    """
    c, a = (candidate, anchor) if degrees is None else (candidate.rotated(degrees), anchor.rotated(degrees))

    def over(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
        return positive(F.least(hi, other_hi) - F.greatest(lo, other_lo)) / F.greatest(F.lit(1.0), F.least(hi - lo, other_hi - other_lo))

    along, across = over(c.x0, c.x1, a.x0, a.x1), over(c.y0, c.y1, a.y0, a.y1)
    sides = [("before", c.y1 <= a.y0, a.y0 - c.y1, along), ("after", c.y0 >= a.y1, c.y0 - a.y1, along), ("inline_before", c.x1 <= a.x0, a.x0 - c.x1, across), ("inline_after", c.x0 >= a.x1, c.x0 - a.x1, across)]
    options = F.array(*[F.when(holds, F.struct(positive(gap).alias("gap"), F.lit(n).alias("rank"), F.lit(name).alias("side"), overlap.alias("overlap"))) for n, (name, holds, gap, overlap) in enumerate(sides)])
    return F.array_min(options)


def right_angle(degrees: Column) -> Column:
    """The nearest of 0, 90, 180 and 270; of two the smaller."""
    return F.array_min(F.array(*[F.struct(angle_distance(degrees, F.lit(x)).alias("d"), F.lit(x).alias("angle")) for x in (0.0, 90.0, 180.0, 270.0)]))["angle"]
