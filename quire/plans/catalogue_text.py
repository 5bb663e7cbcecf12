"""Catalogue: what texts say. References, families of documents, publishers' words, rules for first pages and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.barrier import fixed
from quire.operators import captions, evidence, filters
from quire.plans import oracles as O
from quire.plans.registry import query
from quire.sources import adapters as A

#: Lines of documents with texts put in at fixed places: condition and text, for the query and for its SQL alike.
PLACED = (
    ("src_order = 1 AND page_number % 4 = 0", "Journal homepage: ScienceDirect"),
    ("src_order = 0 AND page_number % 6 = 0", "Springer Nature, Berlin"),
    ("src_order = 6 AND page_number % 9 = 0", "Keywords: alpha, beta"),
    ("src_order = 7 AND page_number % 10 = 0", "A thesis on lines"),
    ("src_order = 7 AND page_number % 10 = 1", "Technical report no. 7"),
    ("src_order = 7 AND page_number % 10 = 2", "Chapter 12"),
    ("src_order = 2 AND page_number % 3 = 0", "Abstract"),
    ("src_order = 3 AND page_number % 8 = 0", "Table"),
    ("src_order = 3 AND page_number % 8 = 1", "Tab1e 4: sums"),
    ("src_order = 3 AND page_number % 8 = 2", "Table a See Table 2 for codes"),
    ("src_order = 3 AND page_number % 8 = 3", "as shown in Table S 3. of it"),
    ("src_order = 3 AND page_number % 8 = 4", "Tables 2 and 3 give (see Table 4) sums"),
    ("src_order = 3 AND page_number % 8 = 5", "Supplementary Table IV - values"),
    ("src_order = 3 AND page_number % 8 = 6", "• Fig. 3 (a) left (b) right"),
    ("src_order = 5 AND page_number % 7 = 0", "Conclusions"),
    ("src_order = 6 AND page_number % 7 = 0", "References"),
    ("src_order = 8 AND page_number % 5 = 0", "e-mail a@b.org, University of Lines"),
    ("src_order = 10 AND page_number % 2 = 0", "ARTICLE INFO"),
    ("src_order = 11 AND page_number % 2 = 0", "Article history"),
    ("src_order = 14 AND page_number % 3 = 0", "DOI: 10.1/x"),
)
_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in PLACED) + " ELSE text END"
FURNISHED = f"fu AS (SELECT * REPLACE ({_CASE} AS text) FROM dl)"


def furnished(spark, d) -> DataFrame:
    return A.document_regions(spark, d).withColumn("text", F.expr(_CASE))


def as_documents(r: DataFrame) -> DataFrame:
    """Each text a document of one page."""
    return r.withColumn("doc_id", F.col("page_number")).withColumn("page_number", F.lit(1).cast("long"))


# What SURVEY says, written out again.
_WORDS = r"len(regexp_extract_all(text, '[^\s\p{Z}]+'))"
_ANCHORS = rf"""ti AS (SELECT page_number, y0, y1, row_number() OVER (PARTITION BY page_number ORDER BY type = 'Title' DESC, x1 - x0 DESC, y0, src_order) AS rn FROM fu WHERE y0 / 1000.0 BETWEEN 0.15 AND 0.42 AND type IN ('Title', 'Text') AND {_WORDS} >= 3),
an AS (SELECT page_number, y0, region_id, row_number() OVER (PARTITION BY page_number ORDER BY y0, src_order, region_id) AS rn FROM fu WHERE regexp_matches(trim(text, ' '), '(?i)^(abstract|summary|article info|keywords?)\b') AND y0 / 1000.0 <= 0.7),
p1 AS (SELECT h.*, t.y0 AS t0, t.y1 AS t1, a.region_id AS aid, a.y0 AS a0, COALESCE(a.y0 / 1000.0, 0.44) AS fin FROM fu h LEFT JOIN (SELECT * FROM ti WHERE rn = 1) t ON t.page_number = h.page_number LEFT JOIN (SELECT * FROM an WHERE rn = 1) a ON a.page_number = h.page_number)"""
_PAGE1 = rf"""p2 AS (SELECT region_id, CASE WHEN t0 IS NOT NULL AND y1 / 1000.0 < t0 / 1000.0 THEN 'page1_upper_before_title' WHEN t0 IS NOT NULL AND y0 / 1000.0 > t1 / 1000.0 AND y1 / 1000.0 < fin AND (aid IS NULL OR aid <> region_id) THEN 'page1_upper_frontmatter'
  WHEN y0 / 1000.0 >= 0.68 AND (regexp_matches(text, '(?i)\b(correspond|e-?mail|doi|received|accepted|available online|copyright)\b')
    OR (regexp_matches(text, '(?i)\b(university|department|institute|laborator|faculty|hospital|school of|research cent)\w*\b') AND {_WORDS} < 35)) THEN 'page1_post_abstract_author_metadata'
  WHEN y0 / 1000.0 >= 0.92 AND type IN ('Footnote', 'Page-footer', 'Unknown') THEN 'page1_lower_metadata' END AS filter_reason FROM p1)"""


@query(O.doc(FURNISHED, _ANCHORS, _PAGE1, select="SELECT region_id, filter_reason FROM p2 WHERE filter_reason IS NOT NULL"))
def page1_rules(spark, d):
    """Every text counts as a first page here."""
    return filters.page_one(furnished(spark, d), page=F.lit(True)).select("region_id", "filter_reason")


_TAIL = r"""co AS (SELECT doc_id, max((page_number, y0)) AS c FROM fu WHERE regexp_matches(trim(text, ' '), '(?i)^(?:\d+(?:\.\d+)*\s*)?(conclusions?|discussion and conclusions?)\s*$') GROUP BY doc_id),
bk AS (SELECT h.doc_id, min((page_number, y0)) AS b, bool_or(c IS NOT NULL) AS anchored FROM fu h LEFT JOIN co USING (doc_id)
  WHERE regexp_matches(trim(text, ' '), '(?i)^(references|bibliography|acknowledg|conflict of interest|author contributions|data availability|appendix)\b') AND (c IS NULL OR (page_number, y0) > c) GROUP BY h.doc_id)"""


@query(
    O.doc(
        FURNISHED.replace("fu AS", "fu0 AS"), "fu AS (SELECT * REPLACE (page_number AS doc_id, 1 AS page_number) FROM fu0)", _TAIL,
        select="SELECT h.doc_id, bk.b[1]::BIGINT AS boundary_page, bk.b[2] AS boundary_y, CASE WHEN anchored THEN 'conclusion_anchor' ELSE 'direct_backmatter_fallback' END AS method, count(*) AS excluded FROM fu h JOIN bk USING (doc_id) WHERE (page_number, y0) >= b GROUP BY ALL",
    )
)
def tail_boundary(spark, d):
    r = as_documents(furnished(spark, d))
    return filters.document_tail(r).groupBy("doc_id", "boundary_page", "boundary_y", "method").agg(F.count("*").alias("excluded"))


_FAMILY = r"""pg AS (SELECT page_number AS doc_id, string_agg(text, chr(10) ORDER BY src_order) AS page, bool_or(type IN ('Caption', 'Reference')) AS scholarly_labels FROM fu GROUP BY page_number),
sg AS (SELECT *, regexp_matches(page, '(?im)^\s*(abstract|summary)\b') AS abstract_heading, regexp_matches(page, '(?im)^\s*keywords?\b') AS keywords_heading, regexp_matches(page, '(?i)\b(thesis|dissertation)\b') AS thesis,
  regexp_matches(page, '(?i)\btechnical report\b|\breport no\.?\b') AS technical_report, regexp_matches(page, '(?i)\bchapter\s+\d+\b|\bisbn\b') AS book_or_chapter FROM pg),
sc AS (SELECT *, abstract_heading::INT + keywords_heading::INT + scholarly_labels::INT AS score FROM sg)"""


@query(
    O.doc(
        FURNISHED, _FAMILY,
        select="""SELECT doc_id, CASE WHEN thesis THEN 'thesis' WHEN technical_report THEN 'technical_report' WHEN book_or_chapter THEN 'book_or_chapter' WHEN score >= 2 THEN 'scholarly_article' ELSE 'unknown' END AS family,
  CASE WHEN thesis OR technical_report OR book_or_chapter THEN 0.8::DOUBLE ELSE round(score::DOUBLE / 3, 3) END AS confidence, abstract_heading, keywords_heading, scholarly_labels, thesis, technical_report, book_or_chapter, false AS form FROM sc""",
    )
)
def document_family(spark, d):
    return evidence.document_families(as_documents(furnished(spark, d)))


_PLAIN = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{Z}]+', ' ', 'g'))"
_SCIENCE = "elsevier|contents lists available|science direct|sciencedirect|journal homepage|check for updates|crossmark|cross mark"
_GENERIC = "springer|elsevier|wiley|blackwell|taylor & francis|taylor and francis|sage|mdpi|frontiers|nature portfolio|biomed central|bmc|oxford university press|cambridge university press"
_PUBLISHER = f"""pb AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches({_PLAIN}, '{_SCIENCE}') THEN 'elsevier_sciencedirect' END, CASE WHEN regexp_matches({_PLAIN}, '{_GENERIC}') THEN 'generic_academic_publishers' END) AS profiles, (y0 + y1) / 2 / 1000.0 AS center FROM p1),
pd AS (SELECT *, profiles <> '' AND center <= 0.44 AND (a0 IS NULL OR center < a0 / 1000.0) AND (t1 IS NULL OR center >= t1 / 1000.0) AS goes FROM pb)"""


@query(
    O.doc(
        FURNISHED, _ANCHORS, _PUBLISHER,
        select="SELECT region_id, profiles, CASE WHEN goes THEN 'exclude' ELSE 'observe' END AS action, CASE WHEN goes THEN 'page1_upper_publisher_or_update_text' ELSE 'publisher_evidence_observed' END AS reason FROM pd WHERE profiles <> ''",
    )
)
def publisher_decisions(spark, d):
    """Publishers' words on pages that each count as a first one; regions without any are kept and left out here."""
    r = furnished(spark, d)
    out = evidence.publisher_decisions(r, evidence.page_places(r), list(evidence.PUBLISHERS)).where("action <> 'keep'")
    return out.select("region_id", F.array_join("matches", ",").alias("profiles"), "action", "reason")


@query(O.doc(FURNISHED, select=f"""SELECT region_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_PLAIN}, '\\b(science direct|sciencedirect|journal homepage|contents lists available|check for updates|crossmark|cross mark|elsevier|springer|wiley|blackwell|sage|mdpi|frontiers|bmc)\\b')
  || CASE WHEN regexp_matches({_PLAIN}, '\\bspringer nature\\b') THEN ['springer nature'] ELSE [] END)), ',') AS terms FROM fu WHERE regexp_matches({_PLAIN}, '\\b(science direct|sciencedirect|journal homepage|contents lists available|check for updates|crossmark|cross mark|elsevier|springer|wiley|blackwell|sage|mdpi|frontiers|bmc)\\b')"""))
def publisher_terms(spark, d):
    r = furnished(spark, d).withColumn("terms", evidence.publisher_terms(F.col("text"), list(evidence.PUBLISHERS)))
    return r.where(F.size("terms") > 0).select("region_id", F.array_join("terms", ",").alias("terms"))


_REF = r"(?i)^((?:(?:supplementary|supplemental|extended\s+data)\s+)?(fig(?:ure)?\.?|table|tab\.?|equation|eq\.?|algorithm|listing)\s*((?:[A-Z]\s*[.\-]?\s*)?\d+(?:\s*[.\-]\s*\d+)?|[IVXLCDM]+|[A-Z]))(?:\s*[:.\-])?(\s|$)"
_OCR = r"(?i)^((?:supplementary\s+|supplemental\s+)?(ta\s*b\s*[1il]\s*e)\s*((?:[A-Z]\s*)?\d+|[IVXLCDM]+))(?:\s*[:.\-])?(\s|$)"
#: Words end at any letter's end; RE2's \b knows ASCII letters only.
_CORE = r"((?:(?:supplementary|supplemental)\s+)?(?:table|tab\.?)\s*((?:[A-Z]\s*[.\-]?\s*)?\d+(?:\s*[.\-]\s*\d+)?|[IVXLCDM]+|[A-Z]))(?:[^\p{L}\p{N}_]|$)"
_MENTION = r"(?:^|[^\p{L}\p{N}_])" + _CORE
_CLEAN = r"""cl AS (SELECT region_id, type, trim(regexp_replace(translate(text, ' –—', ' --'), '[\s\p{Z}]+', ' ', 'g')) AS t FROM fu), c2 AS (SELECT *, regexp_replace(t, '^[\s•▪●|_]+', '') AS c FROM cl),
c3 AS (SELECT *, regexp_extract(c, '""" + _REF + r"""', 2) AS raw FROM c2),
c4 AS (SELECT *, CASE WHEN raw <> '' THEN regexp_extract(c, '""" + _REF + r"""', 0) END AS hit, CASE WHEN raw <> '' THEN regexp_extract(c, '""" + _REF + r"""', 4) END AS tail, length(t) - length(c) AS off FROM c3),
c5 AS (SELECT *, regexp_replace(substr(c, length(hit) + 1), '^[ .:\-]+', '') AS suffix, regexp_replace(regexp_extract(c, '""" + _REF + r"""', 3), '\s+', '', 'g') AS number FROM c4)"""


@query(
    O.doc(
        FURNISHED, _CLEAN,
        select=r"""SELECT region_id, CASE rtrim(lower(raw), '.') WHEN 'fig' THEN 'figure' WHEN 'tab' THEN 'table' WHEN 'eq' THEN 'equation' ELSE rtrim(lower(raw), '.') END AS kind, number, off::INT AS start, (off + length(hit) - length(tail))::INT AS stop,
  CASE WHEN off = 0 THEN 'leading' ELSE 'near_leading' END AS position, round(CASE WHEN off = 0 THEN 1.0::DOUBLE ELSE 0.94::DOUBLE END - CASE WHEN regexp_matches(number, '^[a-z]$') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN regexp_matches(suffix, '(?i)^(?:see\s+table\b|means?\s+(?:within|followed)\b|values?\s+in\s+parentheses\b|notes?\s*:|sources?\s*:)') THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN regexp_matches(suffix, '(?i)^(?:.{0,7}?[^\p{L}\p{N}_])?""" + _CORE + r"""') THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM c5 WHERE raw <> ''""",
    )
)
def caption_reference_parse(spark, d):
    """References that lead a text, and how good they are as a caption's."""
    r = fixed(furnished(spark, d), reference=T.caption_reference(F.col("text"))).where("reference IS NOT NULL")
    ref = F.col("reference")
    return r.select("region_id", "reference.kind", "reference.number", "reference.start", ref["end"].alias("stop"), "reference.position", F.round(T.reference_score(ref), 6).alias("score"))


@query(
    O.doc(
        FURNISHED, _CLEAN,
        rf"""fm AS (SELECT region_id, CASE WHEN raw = '' THEN nullif(regexp_extract(t, '(?i)^((?:(?:supplementary|supplemental|extended\s+data)\s+)?(?:table|tab\.?))(\s|$)', 1), '') END AS bare,
  CASE WHEN NOT regexp_matches(t, '(?i)\btables?\s+\w+\s+(?:and|to|[-–])\s+\w+') THEN nullif(regexp_replace(regexp_extract(t, '(?i){_MENTION}', 2), '\s+', '', 'g'), '') END AS mention,
  nullif(CASE WHEN raw = '' THEN regexp_extract(c, '{_OCR}', 3) ELSE '' END, '') AS misread, regexp_extract(t, '(?i)^(.*?)\btables?\b', 1) AS before, t FROM c5),
  rs AS (SELECT *, concat_ws(',', CASE WHEN trim(before, ' ') <> '' THEN 'identifier_embedded_in_prose' END,
  CASE WHEN regexp_matches(before, '(?i)\b(?:as\s+shown\s+in|shown\s+in|reported\s+in|according\s+to|results?\s+from|values?\s+in|compared\s+(?:with|in)|see)\s+$') THEN 'cross_reference_lead_in' END,
  CASE WHEN regexp_matches(t, '(?i)\btables?\s+\w+\s+(?:and|to|[-–])\s+\w+') THEN 'plural_table_reference' END, CASE WHEN regexp_matches(t, '(?i)\([^)]*\btable\b[^)]*\)') THEN 'parenthetical_reference' END) AS reasons FROM fm)""",
        select="SELECT region_id, bare, mention, misread, reasons FROM rs WHERE bare IS NOT NULL OR mention IS NOT NULL OR misread IS NOT NULL OR reasons <> ''",
    )
)
def table_reference_forms(spark, d):
    """Bare labels, mentions, misread labels and what rather is prose."""
    t = F.col("text")
    r = fixed(furnished(spark, d), mentioned=T.table_mention(t), reference=T.caption_reference(t, ocr=True))
    out = r.select(
        "region_id",
        T.bare_table_label(t).alias("bare"),
        F.col("mentioned.number").alias("mention"),
        F.when(F.col("reference.ocr_tolerant"), F.col("reference.number")).alias("misread"),
        F.array_join(T.prose_evidence(t), ",").alias("reasons"),
    )
    return out.where("bare IS NOT NULL OR mention IS NOT NULL OR misread IS NOT NULL OR reasons <> ''")


@query(
    O.doc(
        FURNISHED, _CLEAN,
        rf"""sq AS (SELECT f.doc_id, f.page_number, f.region_id, c5.t, lead(c5.t) OVER (PARTITION BY f.doc_id, f.page_number ORDER BY f.src_order) AS next FROM fu f JOIN c5 USING (region_id)),
  jn AS (SELECT *, trim(concat_ws(' ', t, COALESCE(next, ''))) AS both_texts FROM sq)""",
        select=rf"""SELECT region_id, regexp_replace(regexp_extract(both_texts, '{_REF}', 3), '\s+', '', 'g') AS number FROM jn WHERE lower(rtrim(regexp_extract(both_texts, '{_REF}', 2), '.')) IN ('table', 'tab')""",
    )
)
def fragmented_references(spark, d):
    """References to tables that a line and the next one of its page give together."""
    from pyspark.sql import Window

    r = furnished(spark, d)
    after = F.lead("text").over(Window.partitionBy("doc_id", "page_number").orderBy("src_order"))
    r = fixed(r.withColumn("next", after), reference=T.fragmented_table_reference(F.array("text", "next")))
    return r.where("reference IS NOT NULL").select("region_id", "reference.number")


_FIGURES = "lf AS (SELECT * REPLACE (CASE WHEN type = 'Caption' AND region_id % 4 <> 0 THEN 'Fig. ' || src_order || CASE WHEN region_id % 3 = 0 THEN ' (a) left (b) right' ELSE ' of it' END ELSE text END AS text) FROM li)"


@query(
    O.li(
        _FIGURES,
        select="""SELECT c.region_id AS caption_id, arg_min(f.region_id, (c.y0 - f.y1, f.src_order)) AS figure_id, min(c.y0 - f.y1) AS gap, any_value(c.region_id % 3 = 0) AS multipanel_hint, false AS completed,
  any_value(CASE WHEN c.region_id % 3 = 0 THEN 'geometry_preserved_without_image_evidence' ELSE 'insufficient_multipanel_caption_evidence' END) AS reason
  FROM lf c JOIN lf f USING (doc_id, page_number) WHERE c.type = 'Caption' AND c.region_id % 4 <> 0 AND f.type = 'Figure' AND f.y1 <= c.y0 GROUP BY c.region_id""",
    )
)
def figure_nearest_caption(spark, d):
    """Captions as captions of figures, some of several panels."""
    text = F.when((F.col("type") == "Caption") & (F.col("region_id") % 4 != 0), F.concat(F.lit("Fig. "), F.col("src_order").cast("string"), F.when(F.col("region_id") % 3 == 0, " (a) left (b) right").otherwise(" of it"))).otherwise(F.col("text"))
    r = A.lineitem_regions(spark, d).withColumn("text", text)
    return captions.caption_anchored_figures(r).select("caption_id", "figure_id", "gap", "multipanel_hint", "completed", "reason")


@query(
    r"""SELECT doc_id, COALESCE(nullif(regexp_replace(regexp_replace(regexp_replace(COALESCE(left(text, 60), ''), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'document') || '__' || left(sha256(COALESCE(text, '')), 12) AS document_id FROM documents"""
)
def document_ids(spark, d):
    """Ids of documents from their first letters, as from a file's name, and the start of their digest."""
    from quire.sources import runs

    t = A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", runs.document_id(F.substring("text", 1, 60), F.sha2(F.col("text").cast("binary"), 256)).alias("document_id"))


@query()
def metadata_fields(spark, d):
    """Every text counts as a first page; the scan has no SQL form and is compared in the tests."""
    from quire.operators import metadata

    return metadata.fields(furnished(spark, d)).select("page_number", "region_id", "field", "category", "inline", "value", "members")
