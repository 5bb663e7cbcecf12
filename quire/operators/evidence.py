"""What a document is, and what a publisher put on its first page: explainable evidence, never a text alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.barrier import fixed
from quire.operators.pairs import KEY
from quire.plans.config import DEFAULT, Config

# Signals of a first page, and the families that a text states outright, in order of precedence.
ABSTRACT_HEADING = r"(?im)^\s*(abstract|summary)\b"
KEYWORDS_HEADING = r"(?im)^\s*keywords?\b"
STATED = {"thesis": r"(?i)\b(thesis|dissertation)\b", "technical_report": r"(?i)\btechnical report\b|\breport no\.?\b", "book_or_chapter": r"(?i)\bchapter\s+\d+\b|\bisbn\b"}
# What publishers print on first pages, by profile.
PUBLISHERS = {
    "elsevier_sciencedirect": ["contents lists available", "science direct", "sciencedirect", "journal homepage", "elsevier", "check for updates", "crossmark", "cross mark"],
    "generic_academic_publishers": [
        "springer", "springer nature", "elsevier", "wiley", "blackwell", "taylor & francis", "taylor and francis", "sage", "mdpi", "frontiers",
        "nature portfolio", "biomed central", "bmc", "oxford university press", "cambridge university press",
    ],
}
#: Share of the page's height down to which a page's upper band reaches.
UPPER_BAND = 0.44


def _both(regions: DataFrame) -> Column:
    """The text, or where it is empty the original."""
    own = F.nullif(F.col("text"), F.lit(""))
    return F.coalesce(own, F.col("orig"), F.lit("")) if "orig" in regions.columns else F.coalesce(own, F.lit(""))


def document_families(regions: DataFrame) -> DataFrame:
    """Family, confidence and signals of each document.

    The texts of page one, in source order, hold the headings and the families that are stated; the types of all regions
    tell captions, references and forms. A stated family or a form wins; else two of three scholarly signals make an article.
    """
    first = F.when(F.col("page_number") == 1, F.struct("src_order", _both(regions).alias("text")))
    g = regions.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(first)).alias("lines"),
        F.bool_or(F.col("type").isin("Caption", "Reference")).alias("scholarly_labels"),
        F.bool_or(F.col("type").isin("Form", "Key-value")).alias("form"),
    )
    g = fixed(g, page=F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    named = {n: F.col("page").rlike(p) for n, p in STATED.items()}
    g = fixed(g, abstract_heading=F.col("page").rlike(ABSTRACT_HEADING), keywords_heading=F.col("page").rlike(KEYWORDS_HEADING), **named)
    signals = ["abstract_heading", "keywords_heading", "scholarly_labels"]
    score = sum((F.col(x).cast("int") for x in signals), F.lit(0))
    stated = F.coalesce(*[F.when(F.col(n), n) for n in (*STATED, "form")])
    return g.select(
        "doc_id",
        F.coalesce(stated, F.when(score >= 2, "scholarly_article"), F.lit("unknown")).alias("family"),
        F.when(stated.isNotNull(), 0.8).otherwise(F.round(score / 3, 3)).alias("confidence"),
        *signals, *STATED, "form",
    )


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(T.folded(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " "))


def publisher_profiles(text: Column, profiles: list[str]) -> Column:
    """The profiles, in their order, of which a term stands anywhere in the text."""
    known = [p for p in profiles if p in PUBLISHERS]
    hits = [F.when(F.exists(F.array(*[F.lit(t) for t in PUBLISHERS[p]]), lambda t: F.contains(_plain(text), t)), F.lit(p)) for p in known]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def publisher_terms(text: Column, profiles: list[str]) -> Column:
    """The terms of the profiles that stand in the text as whole words, sorted."""
    terms = sorted({t for p in profiles for t in PUBLISHERS.get(p, [])})
    hits = [F.when(_plain(text).rlike(rf"\b{re.escape(t)}\b"), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def publisher_decisions(regions: DataFrame, places: DataFrame, profiles: list[str], mode: str = "confirmatory") -> DataFrame:
    """Per region whether a publisher's words go: action keep, observe or exclude, its reason and the evidence.

    places: key, title_bottom, body_anchor (shares of the page's height, null where there is none). The words decide alone in
    mode active; in mode confirmatory they must stand in the upper band, before the body and not before the title's end; in
    any other mode they are observed.
    """
    r = regions.join(places, KEY, "left").withColumn("matches", publisher_profiles(_both(regions), profiles))
    center = (F.col("y0") + F.col("y1")) / 2 / F.col("page_h")
    r = fixed(
        r,
        center=center,
        matched=F.size("matches") > 0,
        upper_band=center <= UPPER_BAND,
        before_body=F.col("body_anchor").isNull() | (center < F.col("body_anchor")),
        after_title=F.col("title_bottom").isNull() | (center >= F.col("title_bottom")),
    )
    goes = {"active": F.col("matched"), "confirmatory": F.col("matched") & F.col("upper_band") & F.col("before_body") & F.col("after_title")}.get(mode, F.lit(False))
    return r.select(
        *KEY, "region_id", "matches", "center", "upper_band", "before_body", "after_title", goes.alias("destructive"),
        F.when(goes, "exclude").when(F.col("matched"), "observe").otherwise("keep").alias("action"),
        F.when(goes, "page1_upper_publisher_or_update_text").when(F.col("matched"), "publisher_evidence_observed").otherwise("no_publisher_evidence").alias("reason"),
    )


def page_places(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per page the end of its title and the start of its body as shares of its height, as page-one rules find them."""
    from quire.operators.filters import page_anchors

    found = page_anchors(regions, config)
    h = regions.groupBy(*KEY).agg(F.max("page_h").alias("h"))
    return found.join(h, KEY).select(*KEY, (F.col("title.y1") / F.col("h")).alias("title_bottom"), (F.col("anchor.y0") / F.col("h")).alias("body_anchor"))
