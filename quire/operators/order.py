"""Reading order: at most two columns per page, split at the largest gap between region centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.pairs import KEY
from quire.plans.config import DEFAULT, Config


def column_splits(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Page key, gap and split (page-relative), for pages with a gap wide enough."""
    center = (F.col("x0") + F.col("x1")) / (2 * F.col("page_w"))
    narrow = regions.where((F.col("x1") - F.col("x0")) / F.col("page_w") < config.order.wide).select(*KEY, center.alias("center"))
    pairs = narrow.withColumn("left", F.lag("center").over(Window.partitionBy(*KEY).orderBy("center"))).where("left IS NOT NULL")
    best = pairs.groupBy(*KEY).agg(F.max(F.struct((F.col("center") - F.col("left")).alias("gap"), F.col("left").alias("a"), F.col("center").alias("b"))).alias("g"))
    return best.where(F.col("g.gap") >= config.order.column_gap_ratio).select(*KEY, F.col("g.gap").alias("gap"), ((F.col("g.a") + F.col("g.b")) / 2).alias("split"))


def reading_order(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Regions with reading_column and reading_order, by column, top, left and source."""
    center = (F.col("x0") + F.col("x1")) / (2 * F.col("page_w"))
    narrow = F.coalesce((F.col("x1") - F.col("x0")) / F.col("page_w") < config.order.wide, F.lit(False))
    # The split of column_splits() by windows over the page: no join, and one shuffle where the regions come by page.
    left = F.lag("__center").over(Window.partitionBy(*KEY, "__narrow").orderBy("__center"))
    gap = F.when(F.col("__narrow") & F.col("__left").isNotNull(), F.struct((F.col("__center") - F.col("__left")).alias("gap"), F.col("__left").alias("a"), F.col("__center").alias("b")))
    r = regions.withColumn("__center", center).withColumn("__narrow", narrow).withColumn("__left", left).withColumn("__gap", F.max(gap).over(Window.partitionBy(*KEY)))
    known = F.col("doc_id").isNotNull() & F.col("page_number").isNotNull()
    split = F.when(known & (F.col("__gap.gap") >= config.order.column_gap_ratio), (F.col("__gap.a") + F.col("__gap.b")) / 2)
    r = r.withColumn("split", split).withColumn("gap", F.when(F.col("split").isNotNull(), F.col("__gap.gap"))).drop("__center", "__narrow", "__left", "__gap")
    column = F.when(F.col("split").isNull(), "single").when(center < F.col("split"), "left").otherwise("right")
    w = Window.partitionBy(*KEY).orderBy(F.when(F.col("reading_column") == "right", 1).otherwise(0), "y0", "x0", "src_order")
    return r.withColumn("reading_column", column).withColumn("reading_order", F.row_number().over(w))
