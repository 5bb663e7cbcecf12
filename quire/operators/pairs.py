"""Region pairs of a page: candidates by a sweep, their features and the ordered classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.barrier import decided, fixed
from quire.functions.geometry import Box, positive, ratio
from quire.plans.config import DEFAULT, Config

KEY = ["doc_id", "page_number"]
# The families of region types, tested in this order.
FAMILIES = {
    "asset": ["Table", "Figure"],
    "formula": ["Formula", "Equation"],
    "furniture": ["Page-header", "Page-footer", "Page-number"],
    "text": ["Caption", "Text", "Footnote", "Section-header", "Title", "List", "Reference", "Code"],
}
OWNED_TEXT = ["Text", "Footnote", "Unknown"]


def family(kind: Column) -> Column:
    out = F.when(kind.isin(FAMILIES["asset"]), "asset")
    for name in ("formula", "furniture", "text"):
        out = out.when(kind.isin(FAMILIES[name]), name)
    return out.otherwise("unknown")


def side(regions: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """Some columns of the regions, prefixed, with the key as it is."""
    return regions.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


_SIDE = ("region_id", "src_order", "type", "x0", "y0", "x1", "y1", "norm", "score")


def candidates(regions: DataFrame, near_ratio: float, band: float | None = None) -> DataFrame:
    """Pairs a, b of a page in the order of (y0, x0, source), where a's bottom and a margin reach b's top.

    An equi-join on the page with a range condition. With `band`, pages are also cut into bands of that height: a stands
    in all bands that it reaches, b in that of its top, so each pair meets once; crowded pages then spread over tasks.
    """
    r = regions.withColumn("norm", T.normalized(F.col("text")))
    a = r.select(*KEY, "page_w", "page_h", *[F.col(c).alias(f"a_{c}") for c in _SIDE])
    b = side(r, "b_", *_SIDE)
    margin = F.col("page_h") * near_ratio
    on = [*KEY]
    if band:
        a = a.withColumn("band", F.explode(F.sequence(F.floor(F.col("a_y0") / band), F.floor((F.col("a_y1") + margin) / band))))
        b = b.withColumn("band", F.floor(F.col("b_y0") / band))
        on.append("band")
    before = F.struct("a_y0", "a_x0", "a_src_order") < F.struct("b_y0", "b_x0", "b_src_order")
    joined = a.join(b, on).where(before & (F.col("a_y1") + margin >= F.col("b_y0")))
    return joined.drop("band") if band else joined


def features(pairs: DataFrame, full: bool = True) -> DataFrame:
    """Adds the geometric and textual evidence of pairs, symmetric and by direction. full: also what no rule asks for."""
    a, b = Box.of("a_"), Box.of("b_")
    w, h = F.col("page_w"), F.col("page_h")
    inter, iw, ih = a.intersection(b), a.overlap_x(b), a.overlap_y(b)
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    tokens = {"a_tokens": words("a_norm"), "b_tokens": words("b_norm")} if full else {}
    p = fixed(pairs, intersection=inter, iw=iw, ih=ih, a_area=a.area, b_area=b.area, **tokens)
    i, aa, ba = F.col("intersection"), F.col("a_area"), F.col("b_area")
    met = F.size(F.array_intersect("a_tokens", "b_tokens"))

    def overhang(x: Box, y: Box) -> Column:
        return F.greatest(positive(y.x0 - x.x0) / w, positive(x.x1 - y.x1) / w, positive(y.y0 - x.y0) / h, positive(x.y1 - y.y1) / h)

    rest = {
        "over_larger": ratio(i, F.greatest(aa, ba)),
        "a_vertical_coverage": ratio(F.col("ih"), a.height),
        "b_vertical_coverage": ratio(F.col("ih"), b.height),
        "a_token_coverage": ratio(met, F.size("a_tokens")),
        "b_token_coverage": ratio(met, F.size("b_tokens")),
        "token_jaccard": ratio(met, F.size(F.array_union("a_tokens", "b_tokens"))),
        "center_distance": F.sqrt(((a.cx - b.cx) / w) * ((a.cx - b.cx) / w) + ((a.cy - b.cy) / h) * ((a.cy - b.cy) / h)),
        "horizontal_gap": a.gap_x(b) / w,
        "left_alignment": F.abs(a.x0 - b.x0) / w,
        "right_alignment": F.abs(a.x1 - b.x1) / w,
    }
    return fixed(
        p,
        **(rest if full else {}),
        iou=ratio(i, aa + ba - i),
        a_containment=ratio(i, aa),
        b_containment=ratio(i, ba),
        over_smaller=ratio(i, F.least(aa, ba)),
        a_horizontal_coverage=ratio(F.col("iw"), a.width),
        b_horizontal_coverage=ratio(F.col("iw"), b.width),
        horizontal_overlap=ratio(F.col("iw"), F.least(a.width, b.width)),
        vertical_overlap=ratio(F.col("ih"), F.least(a.height, b.height)),
        area_ratio=ratio(F.least(aa, ba), F.greatest(aa, ba)),
        a_page_area=ratio(aa, w * h),
        b_page_area=ratio(ba, w * h),
        a_center_inside=a.center_inside(b),
        b_center_inside=b.center_inside(a),
        edge_delta=F.greatest(F.abs(a.x0 - b.x0) / w, F.abs(a.x1 - b.x1) / w, F.abs(a.y0 - b.y0) / h, F.abs(a.y1 - b.y1) / h),
        a_protrusion=overhang(a, b),
        b_protrusion=overhang(b, a),
        vertical_gap=(a.gap_y(b) / h),
        text_relation=T.relation(F.col("a_norm"), F.col("b_norm")),
        same_class=(F.col("a_type") == F.col("b_type")),
        a_family=family(F.col("a_type")),
        b_family=family(F.col("b_type")),
    )


def classified(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds kind, reason, action and status; the first rule that holds decides. Independent pairs are left out."""
    o, c = config.overlap, config.containment
    x = F.col
    touches = x("intersection") > 0
    both_text = (x("a_family") == "text") & (x("b_family") == "text")
    owned = touches & (((x("b_type") == "Figure") & x("a_type").isin(OWNED_TEXT) & x("a_center_inside")) | ((x("a_type") == "Figure") & x("b_type").isin(OWNED_TEXT) & x("b_center_inside")))
    same_place = (x("iou") >= o.duplicate_iou) & (x("area_ratio") >= o.duplicate_area) & (x("edge_delta") <= o.duplicate_edge_ratio)
    fitting = x("same_class") | (both_text & (x("text_relation") == "equal"))
    inside = (
        (x("over_smaller") >= c.strong)
        | (x("a_center_inside") & ((x("a_containment") >= c.center) | ((x("a_containment") >= c.near) & (x("a_protrusion") <= c.near_protrusion_ratio))))
        | (x("b_center_inside") & ((x("b_containment") >= c.center) | ((x("b_containment") >= c.near) & (x("b_protrusion") <= c.near_protrusion_ratio))))
    )
    depth = F.least(positive(x("a_y1") - x("b_y0")), positive(x("b_y1") - x("a_y0"))) / F.greatest(F.lit(1.0), F.least(x("a_y1") - x("a_y0"), x("b_y1") - x("b_y0")))
    grazing = touches & ((x("a_family") == "asset") | (x("b_family") == "asset")) & (depth <= o.boundary_overlap)
    fragment = both_text & (x("horizontal_overlap") >= o.fragment_horizontal) & (x("vertical_gap") <= o.fragment_gap_ratio) & (x("text_relation") == "different")
    rules = [
        (owned, "CONTAINMENT_CANDIDATE", "figure_center_owned_text_observed", "observe"),
        (same_place & fitting & x("text_relation").isin("equal", "unavailable"), "DUPLICATE", "near_identical_extent", "canonicalize"),
        (same_place & ~x("same_class"), "CLASS_CONFLICT", "near_identical_extent_different_class", "flag"),
        (inside, "CONTAINMENT_CANDIDATE", "directional_containment_observed", "observe"),
        (grazing, "ACCIDENTAL_INTERSECTION", "limited_boundary_penetration", "retain"),
        (touches & ~x("same_class"), "CLASS_CONFLICT", "material_cross_role_overlap", "flag"),
        (touches, "AMBIGUOUS_OVERLAP", "overlap_without_duplicate_evidence", "flag"),
        (fragment, "FRAGMENT_CANDIDATE", "aligned_nearby_unique_text", "retain"),
    ]
    verdict = F.coalesce(*[F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(action).alias("action"))) for cond, kind, reason, action in rules])
    status = F.when(x("kind") == "DUPLICATE", "observed").when(x("kind") == "CONTAINMENT_CANDIDATE", "observed_for_hierarchy_validation").when(x("kind").isin("CLASS_CONFLICT", "AMBIGUOUS_OVERLAP"), "unresolved_conflict").otherwise("preserved")
    return decided(pairs, verdict).withColumn("status", status)


def relationships(regions: DataFrame, config: Config = DEFAULT, band: float | None = None) -> DataFrame:
    """All classified pairs of the regions, with candidate parent and child where one contains the other."""
    found = classified(features(candidates(regions, config.overlap.fragment_gap_ratio, band), full=False), config)
    a_inside = F.col("a_containment") >= F.col("b_containment")
    contains = F.col("kind") == "CONTAINMENT_CANDIDATE"
    return found.withColumn("parent_id", F.when(contains, F.when(a_inside, F.col("b_region_id")).otherwise(F.col("a_region_id")))).withColumn("child_id", F.when(contains, F.when(a_inside, F.col("a_region_id")).otherwise(F.col("b_region_id"))))


def duplicates(regions: DataFrame, config: Config = DEFAULT, band: float | None = None) -> DataFrame:
    """The DUPLICATE pairs of relationships() alone: edges that lie close together are asked for before any feature."""
    near = config.overlap.duplicate_edge_ratio
    close = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.col(size) <= near for c, size in (("x0", "page_w"), ("x1", "page_w"), ("y0", "page_h"), ("y1", "page_h"))]
    some = candidates(regions, config.overlap.fragment_gap_ratio, band).where(close[0] & close[1] & close[2] & close[3])
    return classified(features(some, full=False), config).where("kind = 'DUPLICATE'")
