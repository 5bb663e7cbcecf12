"""Figure completion: whether a proposed larger box of a Figure is taken, by what it would capture and how much it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.barrier import decided, fixed
from quire.functions.geometry import Box, positive, ratio
from quire.operators.pairs import KEY

# Types that no figure may grow over, whatever they say.
STRUCTURE = ["Title", "Section-header", "Table", "Formula", "Code", "Page-header", "Page-footer"]
LIMITS = {"area": 4.0, "page_area": 0.65, "edge": 0.45, "paragraph": 80, "score": 7.0}


def decisions(regions: DataFrame, proposals: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """One row per proposal: decision, reason and the resolved box; six outcomes, the first that holds.

    proposals: page key, region_id, assignment (a score), n_x0, n_y0, n_x1, n_y1 (the proposed box). What a proposal
    captures are regions of its page covered half by the new box and less by the old one: one range join.
    """
    figure = regions.select(*KEY, "region_id", "x0", "y0", "x1", "y1", "page_w", "page_h").join(proposals, [*KEY, "region_id"])
    new = Box.of("n_").clipped(F.col("page_w"), F.col("page_h"))
    p = fixed(figure, c_x0=new.x0, c_y0=new.y0, c_x1=new.x1, c_y1=new.y1).drop("n_x0", "n_y0", "n_x1", "n_y1")
    others = regions.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("region_id", "type", "x0", "y0", "x1", "y1")], F.length(T.collapsed(F.col("text"))).alias("o_chars"))
    o, old, big = Box.of("o_"), Box.of(), Box.of("c_")
    other = F.col("o_region_id").isNotNull() & (F.col("o_region_id") != F.col("region_id"))
    captured = other & (o.coverage(big) >= 0.5) & (o.coverage(old) < 0.5)
    long = F.col("o_chars") >= limits["paragraph"]
    barrier = F.col("o_type").isin(STRUCTURE) | (F.col("o_type") == "Caption") | (F.col("o_type").isin("Text", "List", "Reference") & long)
    body = (F.col("o_type") == "Text") & long
    g = p.join(others, KEY, "left").groupBy(*KEY, "region_id", "assignment", "page_w", "page_h", "x0", "y0", "x1", "y1", "c_x0", "c_y0", "c_x1", "c_y1").agg(
        F.count_if(captured).alias("captured"),
        F.count_if(captured & barrier).alias("barriers"),
        F.count_if(captured & F.col("o_type").isin("Figure", "Table")).alias("competing"),
        F.count_if(captured & long).alias("long"),
        F.coalesce(F.bool_or(body & (F.col("o_x1") <= 0.55 * F.col("page_w"))), F.lit(False)).alias("left_column"),
        F.coalesce(F.bool_or(body & (F.col("o_x0") >= 0.45 * F.col("page_w"))), F.lit(False)).alias("right_column"),
    )
    w, h = F.col("page_w"), F.col("page_h")
    gutter = F.col("left_column") & F.col("right_column") & (F.col("x1") <= 0.60 * w) & (F.col("c_x1") >= 0.70 * w)
    growth = F.greatest(positive(old.x0 - big.x0) / w, positive(old.y0 - big.y0) / h, positive(big.x1 - old.x1) / w, positive(big.y1 - old.y1) / h)
    excessive = (ratio(big.area, old.area) > limits["area"]) | (big.area / F.greatest(w * h, F.lit(1.0)) > limits["page_area"]) | (growth > limits["edge"])
    rules = [
        (F.coalesce("assignment", F.lit(0.0)) < limits["score"], "ambiguous_visual_evidence", "caption_assignment_below_threshold"),
        (F.col("competing") > 0, "ambiguous_competing_asset", "proposal_captures_competing_asset"),
        (gutter, "rejected_barrier_crossing", "proposal_crosses_column_gutter"),
        (F.col("barriers") > 0, "rejected_barrier_crossing", "proposal_captures_structural_barrier"),
        (excessive, "rejected_excessive_growth", "proposal_exceeds_growth_limits"),
        ((F.col("captured") > 0) & (F.col("long") == 0), "accepted_with_nested_content", "validated_completion_geometry"),
        (F.lit(True), "accepted", "validated_completion_geometry"),
    ]
    verdict = F.coalesce(*[F.when(c, F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))) for c, d, r in rules])
    out = decided(g, verdict)
    taken = F.col("decision").startswith("accepted")
    return out.select(*KEY, "region_id", "decision", "reason", "captured", *[F.when(taken, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])
