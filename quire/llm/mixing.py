"""Mixing sources to target weights: repetition rates per source, then whole and Bernoulli copies per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, written

#: No source gives more than so many times its own size.
MOST = 3


def word_count(text) -> F.Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Sources in code-point order, null last, get the weights in turn and share the total size by weight.
    A target stops at `most` times its source's size and the excess is shared again by weight. The end of
    that resharing is target = least(most * size, level * weight) for one level; with sources ordered by
    size / weight the level is where the running sums first leave no next source above its cap. One row per
    source, so the windows over all rows here see as many rows as there are sources, not documents.
    Sources without words keep target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    ).withColumn("level", (F.col("all_size") - most * F.col("size_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")))
    # The first source, in order of size / weight, that its level leaves at or under its cap sets the level.
    fits = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("weight_before"), F.col("level")))
    return level.withColumn("fit", F.min(fits).over(everything)).select(
        "source", "source_size", "weight", F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("fit.level") * F.col("weight"), F.lit(float("inf")))).alias("target")
    )


def draw(doc_id, text, seed: str) -> F.Column:
    """A number in [0, 1) that depends on the id, or on the text where there is none, and the seed only; 52 bits of a digest."""
    who = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(who, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Adds size, source_size, target and copies to doc_id, source.

    docs: doc_id, text, source (others are left out). Rate = target / source_size; a document gets
    floor(rate) copies and one more if its draw is under the fraction. Null text has size 0; a null source is a
    source of its own; a row without doc_id draws by its text; repeated rows draw alike; no rows give no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    t = targets.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(t, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def mix_sources(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them: each row as many times as it has copies, with its own columns.

    Same rules as mix(). The per-source table is joined to the rows; texts are not shuffled for it unless that
    table outgrows the session's broadcast limit.
    """
    names = docs.columns
    d = docs.withColumn("__size", word_count(F.col("text")))
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # Written, so that its size is known when the join is planned: a small table is broadcast before any text is shuffled.
    t = written(source_targets(sizes).select(F.col("source").alias("__source"), F.try_divide("target", "source_size").alias("__rate")))
    rate = F.coalesce("__rate", F.lit(0.0))
    return (
        d.join(t, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__copies", (F.floor(rate) + (draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")).cast("int"))
        .withColumn("__copy", F.explode(F.expr("CASE WHEN __copies > 0 THEN sequence(1, __copies) ELSE array() END")))
        .select(*names)
    )


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(doc_id::VARCHAR, 'null:' || md5(COALESCE(text, ''))) AS who, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight FROM src
), filled AS (
  SELECT *, COALESCE(sum(source_size) OVER w, 0)::BIGINT AS size_before, COALESCE(sum(weight) OVER w, 0)::BIGINT AS weight_before,
    (sum(source_size) OVER ())::BIGINT AS all_size, (sum(weight) OVER ())::BIGINT AS all_weight
  FROM ranked
  WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (all_size - 3 * size_before)::DOUBLE / (all_weight - weight_before) AS level FROM filled
), pick AS (
  SELECT level FROM levels WHERE level * weight <= 3 * source_size ORDER BY weight_before LIMIT 1
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, COALESCE((SELECT level FROM pick) * weight, 'inf'::DOUBLE)) AS target FROM levels
), rated AS (
  SELECT doc_id, who, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(who || ':mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
