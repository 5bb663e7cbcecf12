"""Regions, pages, turns and run events from the driver's tables; and readers for exported layout data.

Every operator takes regions with these columns: doc_id, page_number, region_id, src_order, type, x0, y0, x1, y1, text, score,
page_w, page_h. (doc_id, page_number) is the key of all geometric work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = 1000.0
#: Ids that a text's lines have to themselves: no text has as many.
LINES = 10_000_000
REGION_COLUMNS = ["doc_id", "page_number", "region_id", "src_order", "type", "x0", "y0", "x1", "y1", "text", "score", "page_w", "page_h"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_regions(spark: SparkSession, sf_dir: str, pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A region per order line, a page per order; boxes are whole numbers, so sums and comparisons are exact.

    Rows are numbered by the whole key, so that what follows by page needs no other shuffle. pages: leaves out whole pages by
    their types and boxes, before anything else is done with them.
    """
    order = Window.partitionBy("doc_id", "page_number").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), F.col("l_orderkey").alias("page_number"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    kind = F.col("l_partkey") % 7
    named = F.when(kind == 0, "Figure").when(kind == 1, "Table").when(kind == 2, "Formula").when(kind == 3, "Caption").when(kind == 4, "Footnote").otherwise("Text")
    x0, y0 = ((F.col("l_partkey") * 37) % 600).cast("double"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 91) % 800).cast("double")
    x1, y1 = (F.col("x0") + 40 + 6 * F.col("l_quantity").cast("long")).cast("double"), (F.col("y0") + 20 + 15 * (F.col("l_partkey") % 11)).cast("double")
    if pages is not None:
        # Dealt and sorted by page as short rows: boxes are made behind that. The page number first, as it tells more rows apart.
        boxed = li.repartition("doc_id", "page_number").sortWithinPartitions("page_number", "doc_id").withColumns({"type": named, "x0": x0, "y0": y0, "page_w": F.lit(PAGE), "page_h": F.lit(PAGE)}).withColumns({"x1": x1, "y1": y1})
        li = pages(boxed).select(*li.columns)
    return (
        li.withColumn("src_order", F.row_number().over(order))
        .withColumn("x0", x0)
        .withColumn("y0", y0)
        .select(
            "doc_id",
            "page_number",
            (F.col("page_number") * 1000 + F.col("src_order")).alias("region_id"),
            F.col("src_order").cast("long").alias("src_order"),
            named.alias("type"),
            "x0",
            "y0",
            x1.alias("x1"),
            y1.alias("y1"),
            F.when(~kind.isin(0, 1), F.concat(F.lit("part "), (F.col("l_partkey") % 5).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" of "), (F.col("l_suppkey") % 3).cast("string"))).otherwise(""))).alias("text"),
            F.when(F.col("l_tax") != 0, F.col("l_discount") * 10).alias("score"),
            F.lit(PAGE).alias("page_w"),
            F.lit(PAGE).alias("page_h"),
        )
    )


def snapped(regions: DataFrame, step: int = 200) -> DataFrame:
    """The regions on a coarse grid of boxes, so that duplicates occur."""
    s = F.lit(float(step))
    return regions.withColumn("x0", F.floor(F.col("x0") / s) * s).withColumn("y0", F.floor(F.col("y0") / s) * s).withColumn("x1", F.col("x0") + s).withColumn("y1", F.col("y0") + s)


def document_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region per line of a text, a page per text, a document per source. The last two lines stand in the footer band."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = d.select("doc_id", "source", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.trim("text") != "")
    foot = F.col("pos") >= F.col("n") - 2
    y0 = F.when(foot, 930 + 25 * (F.col("pos") - (F.col("n") - 2))).otherwise(24 * (F.col("pos") % 40) + 10).cast("double")
    wide = F.when(foot, F.least(F.lit(200), 6 * F.length("text"))).otherwise(F.least(F.lit(900), 6 * F.length("text"))).cast("double")
    kind = F.col("pos") % 9
    return lines.select(
        F.col("source").alias("doc_id"),
        F.col("doc_id").alias("page_number"),
        (F.col("doc_id") * LINES + F.col("pos")).alias("region_id"),
        F.col("pos").cast("long").alias("src_order"),
        F.when(F.col("pos") == 0, "Title").when(kind == 4, "Section-header").when(kind == 7, "Caption").otherwise("Text").alias("type"),
        F.lit(50.0).alias("x0"),
        y0.alias("y0"),
        (50.0 + wide).alias("x1"),
        (y0 + 18.0).alias("y1"),
        "text",
        F.lit(None).cast("double").alias("score"),
        F.lit(PAGE).alias("page_w"),
        F.lit(PAGE).alias("page_h"),
    )


# Converter labels and the region types they stand for; other labels are title-cased.
TYPES = {
    "title": "Title", "section_header": "Section-header", "text": "Text", "paragraph": "Text", "reference": "Reference", "list_item": "List",
    "table": "Table", "document_index": "Table", "picture": "Figure", "chart": "Figure", "figure": "Figure", "caption": "Caption", "footnote": "Footnote",
    "formula": "Formula", "code": "Code", "page_header": "Page-header", "page_footer": "Page-footer", "form": "Form", "key_value_region": "Key-value",
    "field_region": "Field-region", "field_heading": "Field-heading", "field_item": "Field-item", "field_key": "Field-key", "field_value": "Field-value",
    "handwritten_text": "Handwritten-text",
}
# Html tags and the labels that stand for them.
TAGS = {"h1": "title", "h2": "section_header", "h3": "section_header", "p": "paragraph", "li": "list_item", "td": "field_value", "th": "field_key", "title": "page_header"}
#: What is no text; where a block begins; where one ends, if no other begins before; inline markup.
SILENT = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->"
BEGIN = r"(?i)<(h1|h2|h3|p|li|td|th|title)(?:\s[^>]*)?>"
END = r"(?is)</(?:h1|h2|h3|p|li|td|th|title|ul|ol|tr|table|div|article|section|header|footer|nav|head|body|html)\s*>.*$"
MARKUP = r"<[^>]*>"


def region_type(label):
    label = F.lower(F.coalesce(label, F.lit("unknown")))
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    titled = F.array_join(F.transform(F.split(label, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "-")
    return F.coalesce(F.try_element_at(known, label), titled)


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, tag, text and type of the text blocks of raw pages, with all the text within their inline markup.

    A block runs from its tag to the next block's, or to where its own or what holds it ends; empty ones are left out.
    """
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    # Two control characters that texts don't hold mark a tag and its end; what stands before the first is no block.
    marked = F.regexp_replace(F.regexp_replace("html", SILENT, " "), BEGIN, "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda x: F.contains(x, F.lit("\x02")))
    b = p.select("page_id", F.posexplode(parts).alias("pos", "part"))
    inner = F.regexp_replace(F.regexp_replace(F.split_part("part", F.lit("\x02"), F.lit(2)), END, ""), MARKUP, "")
    b = b.select("page_id", "pos", F.lower(F.split_part("part", F.lit("\x02"), F.lit(1))).alias("tag"), F.trim(F.regexp_replace(inner, r"[\s\p{Z}]+", " ")).alias("text")).where("text <> ''")
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return b.withColumn("type", region_type(F.try_element_at(tags, F.col("tag"))))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("event"), F.col("value").alias("elapsed"), "props")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


#: An exported converter document: lists of items with the places they were found at.
_PLACE = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>,orientation:double>>"
_ITEM = f"array<struct<label:string,text:string,orig:string,self_ref:string,content_layer:string,prov:{_PLACE}>>"
LISTS = ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")
EXPORT_SCHEMA = "document_id string, " + ", ".join(f"{n} {_ITEM}" for n in LISTS) + ", pages array<struct<page_number:int,page_width_pt:double,page_height_pt:double,image_width_px:int,image_height_px:int>>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, with a stated schema."""
    return spark.read.schema(EXPORT_SCHEMA).json(path)


def _page(number):
    return F.get(F.filter("pages", lambda p: p["page_number"] == number), 0)


def convert_export(documents: DataFrame, page_start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Regions, and per document the counts of items, places, and places skipped for their page or geometry.

    Items count by list, in the order of LISTS, then by position. A place's page is that of its number, else that
    of page_start + number - 1. A place with a side missing or an empty box after clipping is skipped.
    """
    from quire.functions.geometry import normal_angle, points_to_pixels

    lists = [documents.select("document_id", "pages", F.lit(rank).alias("rank"), F.posexplode(name).alias("pos", "item")) for rank, name in enumerate(LISTS)]
    items = lists[0]
    for more in lists[1:]:
        items = items.unionByName(more)
    order = Window.partitionBy("document_id").orderBy("rank", "pos")
    items = items.withColumn("doc_order", F.row_number().over(order) - 1)
    places = items.select("*", F.posexplode_outer("item.prov").alias("place_order", "place"))
    number = F.col("place.page_no")
    # The first page of a number, should it be there twice.
    page = F.coalesce(_page(number), _page(page_start + number - 1))
    placed = places.withColumn("page", page)
    b, pg = F.col("place.bbox"), F.col("page")
    box = points_to_pixels(b["l"], b["t"], b["r"], b["b"], b["coord_origin"], pg["page_width_pt"], pg["page_height_pt"], pg["image_width_px"].cast("double"), pg["image_height_px"].cast("double"))
    boxed = placed.select("*", box.x0.alias("x0"), box.y0.alias("y0"), box.x1.alias("x1"), box.y1.alias("y1"))
    sound = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    counts = boxed.groupBy("document_id").agg(
        F.countDistinct("doc_order").alias("items"),
        F.count_if(F.col("place").isNotNull()).alias("places"),
        F.count_if(F.col("place").isNotNull() & F.col("page").isNull()).alias("skipped_page"),
        F.count_if(F.col("page").isNotNull() & ~sound).alias("skipped_geometry"),
    )
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("doc_order", "place_order"))
    regions = boxed.where(F.col("page").isNotNull() & sound).select(
        F.col("document_id").alias("doc_id"),
        F.col("page.page_number").alias("page_number"),
        F.format_string("p%04d_d%06d_%02d", F.col("page.page_number"), F.col("doc_order"), F.col("place_order") + 1).alias("region_id"),
        n.cast("long").alias("src_order"),
        region_type(F.col("item.label")).alias("type"),
        "x0", "y0", "x1", "y1",
        F.coalesce(F.nullif("item.text", F.lit("")), "item.orig").alias("text"),
        F.lit(None).cast("double").alias("score"),
        F.col("page.image_width_px").cast("double").alias("page_w"),
        F.col("page.image_height_px").cast("double").alias("page_h"),
        normal_angle(F.col("place.orientation")).alias("angle"),
    )
    return regions, counts
