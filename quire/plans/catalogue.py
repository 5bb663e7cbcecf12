"""Registry of the layout queries and of the SQL that checks them.

Each query takes (spark, sf_dir) and runs over whole tables. Results are scalars per column, so that they compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.barrier import fixed
from quire.functions.geometry import Box
from quire.operators import captions, completion, filters, hierarchy, order, pairs, resolve, trace
from quire.plans import oracles as O
from quire.plans.registry import ORACLE_SQL, QUERIES, query
from quire.sources import adapters as A
from quire.sources import sinks
from quire.streaming import events as E

def _li(spark: SparkSession, d: str) -> DataFrame:
    return A.lineitem_regions(spark, d)


def _related(spark: SparkSession, d: str) -> DataFrame:
    return pairs.relationships(_li(spark, d))


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Document lines with headings put in at fixed places."""
    r = A.document_regions(spark, d)
    p, s = F.col("page_number"), F.col("src_order")
    text = (
        F.when((s == 3) & (p % 5 == 0), F.concat(F.lit("Table "), (s % 9 + 1).cast("string"), F.lit(". "), F.col("text")))
        .when((s == 2) & (p % 7 == 0), "Conclusion").when((s == 4) & (p % 7 == 0), "References").when((s == 5) & (p % 7 == 0), "Appendix A")
        .when((s == 1) & (p % 11 == 0), "Received 12 March 2020; accepted 3 May 2020").when((s == 2) & (p % 11 == 0), "Introduction")
        .when((s == 1) & (p % 13 == 0), "Copyright 2021 by the authors. All rights reserved").when((s == 3) & (p % 13 == 0), "Abstract")
        .otherwise(F.col("text"))
    )
    return r.withColumn("text", text)


# Pairs


@query(O.li(O.PAIRS, select="SELECT a_type, b_type, kind, count(*) AS n FROM rl GROUP BY ALL"))
def overlap_histogram(spark, d):
    return _related(spark, d).groupBy("a_type", "b_type", "kind").agg(F.count("*").alias("n"))


@query(O.li(O.PAIRS, select="SELECT page_number, a_region_id, b_region_id, kind, reason, action, status, parent_id, child_id FROM rl"))
def overlap_pairs(spark, d):
    return _related(spark, d).select("page_number", "a_region_id", "b_region_id", "kind", "reason", "action", "status", "parent_id", "child_id")


_FEATURES = ["intersection", "iou", "a_containment", "b_containment", "over_smaller", "over_larger", "horizontal_overlap", "vertical_overlap", "area_ratio", "a_page_area", "b_page_area", "a_center_inside", "b_center_inside", "a_token_coverage", "b_token_coverage", "token_jaccard", "edge_delta", "a_protrusion", "b_protrusion", "horizontal_gap", "vertical_gap", "text_relation", "same_class", "a_family", "b_family"]


@query(O.li(O.PAIRS, select=f"SELECT a_region_id, b_region_id, {', '.join(_FEATURES)} FROM ft"))
def pair_features(spark, d):
    return pairs.features(pairs.candidates(_li(spark, d), 0.012)).select("a_region_id", "b_region_id", *_FEATURES)


@query(O.li(O.PAIRS, select="SELECT kind, count(*) AS n FROM rl GROUP BY ALL"))
def overlap_banded(spark, d):
    """The histogram with pages cut into bands, as crowded pages need; same pairs."""
    return pairs.relationships(_li(spark, d), band=100.0).groupBy("kind").agg(F.count("*").alias("n"))


@query(O.doc(O.pairs("(SELECT *, NULL::DOUBLE AS score FROM dl)"), select="SELECT a_region_id, b_region_id, kind FROM rl WHERE kind = 'FRAGMENT_CANDIDATE'"))
def near_fragments(spark, d):
    return pairs.relationships(A.document_regions(spark, d)).where("kind = 'FRAGMENT_CANDIDATE'").select("a_region_id", "b_region_id", "kind")


# Duplicates and conflicts


def _duplicates(spark, d):
    r = A.snapped(_li(spark, d))
    related = pairs.relationships(r)
    return r, related, resolve.duplicate_components(related)


@query(O.li(O.SNAP_PAIRS, O.DUPES, select="SELECT page_number, array_to_string(members, ',') AS members, len(members) AS size FROM co"))
def duplicate_components(spark, d):
    found = resolve.duplicate_components(pairs.duplicates(A.snapped(_li(spark, d))))
    return found.select("page_number", F.array_join("members", ",").alias("members"), F.size("members").alias("size"))


@query(O.li(O.SNAP_PAIRS, O.DUPES, select="SELECT page_number, region_id, canonical_id, members FROM ca"))
def canonical_regions(spark, d):
    r, _, c = _duplicates(spark, d)
    return resolve.canonical(r, c).select("page_number", "region_id", "canonical_id", "members")


@query(O.li(O.SNAP_PAIRS, O.DUPES, select="SELECT sn.doc_id, count(*) AS regions, count(*) FILTER (canonical_id IS NOT NULL AND canonical_id <> sn.region_id) AS suppressed FROM sn LEFT JOIN ca USING (page_number, region_id) GROUP BY ALL"))
def suppressed_regions(spark, d):
    r, _, c = _duplicates(spark, d)
    j = r.join(resolve.canonical(r, c).select("page_number", "region_id", "canonical_id"), ["page_number", "region_id"], "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_if(F.col("canonical_id") != F.col("region_id")).alias("suppressed"))


@query(O.li(O.SNAP_PAIRS, O.DUPES, select="SELECT CASE WHEN rl.kind <> 'DUPLICATE' THEN status WHEN canonical_id IS NULL THEN 'retained_nontransitive_duplicate_chain' ELSE 'collapsed' END AS status, count(*) AS n FROM rl LEFT JOIN ca ON ca.page_number = rl.page_number AND ca.region_id = rl.a_region_id GROUP BY ALL"))
def duplicate_statuses(spark, d):
    r, related, c = _duplicates(spark, d)
    return resolve.duplicate_status(related, resolve.canonical(r, c)).groupBy("status").agg(F.count("*").alias("n"))


# Order


@query(O.li(O.ORDER, select="SELECT region_id, reading_column, reading_order FROM ro"))
def reading_order(spark, d):
    return order.reading_order(_li(spark, d)).select("region_id", "reading_column", "reading_order")


@query(O.li(O.SPLIT, select="SELECT page_number, gap, split FROM sp"))
def column_split(spark, d):
    return order.column_splits(_li(spark, d)).select("page_number", "gap", "split")


# Captions


@query(O.li(O.ALT, select="SELECT caption_id, parent_id, parent_type, score, options, status FROM az"))
def caption_best_parent(spark, d):
    return captions.associations(_li(spark, d)).select("caption_id", "parent_id", "parent_type", "score", "options", "status")


@query(O.li(O.ALT, select="SELECT caption_id, score, margin FROM az WHERE margin IS NOT NULL"))
def caption_margin(spark, d):
    return captions.associations(_li(spark, d)).where("margin IS NOT NULL").select("caption_id", "score", "margin")


@query(O.li(O.ALT, select="SELECT doc_id, status, count(*) AS n FROM az WHERE status <> 'associated' GROUP BY ALL"))
def caption_unattached(spark, d):
    return captions.associations(_li(spark, d)).where("status <> 'associated'").groupBy("doc_id", "status").agg(F.count("*").alias("n"))


@query(O.li(O.ALT, select="SELECT az.parent_id, string_agg(caption_id::VARCHAR, ',' ORDER BY y0, x0, src_order) AS caption_ids, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM az JOIN li ON li.region_id = az.caption_id AND li.page_number = az.page_number WHERE status = 'associated' GROUP BY az.page_number, az.parent_id"))
def caption_groups(spark, d):
    r = _li(spark, d)
    return captions.caption_groups(r, captions.associations(r)).select("parent_id", F.array_join("caption_ids", ",").alias("caption_ids"), "x0", "y0", "x1", "y1")


@query(O.li(select="""SELECT * FROM (SELECT f.region_id AS formula_id,
  (SELECT t.region_id FROM li t WHERE t.page_number = f.page_number AND t.type = 'Text' AND least(f.x1, t.x1) > greatest(f.x0, t.x0) AND t.y1 <= f.y0 ORDER BY t.y1 DESC, t.region_id LIMIT 1) AS above_id,
  (SELECT t.region_id FROM li t WHERE t.page_number = f.page_number AND t.type = 'Text' AND least(f.x1, t.x1) > greatest(f.x0, t.x0) AND t.y0 >= f.y1 ORDER BY t.y0, t.region_id LIMIT 1) AS below_id
  FROM li f WHERE f.type = 'Formula') WHERE above_id IS NOT NULL OR below_id IS NOT NULL"""))
def neighbor_above_below(spark, d):
    return captions.text_neighbours(_li(spark, d)).select("formula_id", "above_id", "below_id")


@query(O.li(f"""cr AS (SELECT f.page_number, f.region_id, f.x0, f.y0, f.x1, f.y1, max(CASE WHEN o.near AND o.y1 <= f.y0 THEN o.y1 END) AS ceiling, min(CASE WHEN o.near AND o.y0 >= f.y1 THEN o.y0 END) AS floor
  FROM li f LEFT JOIN (SELECT a.region_id AS fid, b.y0, b.y1, {O._NOV.format(a='a.', b='b.')} >= 0.2 AS near FROM li a JOIN li b USING (doc_id, page_number) WHERE a.type = 'Formula' AND b.type <> 'Formula') o ON o.fid = f.region_id WHERE f.type = 'Formula' GROUP BY ALL)""",
    select="""SELECT region_id, x0, greatest(0.0, y0 - m, least(y0, COALESCE(ceiling + 0.12 * (y1 - y0), 0.0))) AS crop_y0, x1, least(1000.0, y1 + m, greatest(y1, COALESCE(floor - 0.12 * (y1 - y0), 1000.0))) AS crop_y1
  FROM (SELECT *, least(greatest(0.3::DOUBLE * (y1 - y0), 0.006::DOUBLE * 1000.0::DOUBLE), 0.018::DOUBLE * 1000.0::DOUBLE) AS m FROM cr)"""))
def equation_crop_limits(spark, d):
    return captions.crop_limits(_li(spark, d)).select("region_id", "x0", "crop_y0", "x1", "crop_y1")


_COMP = """pf AS (SELECT *, (src_order * 2 + region_id % 7)::DOUBLE AS assignment, greatest(0.0, least(x0 - 60, 1000.0)) AS cx0, greatest(0.0, least(y0 - 30, 1000.0)) AS cy0, greatest(0.0, least(x1 + 200, 1000.0)) AS cx1, greatest(0.0, least(y1 + 120, 1000.0)) AS cy1 FROM li WHERE type = 'Figure'),
cp AS (SELECT f.region_id, o.type, greatest(0.0, least(o.x1, f.cx1) - greatest(o.x0, f.cx0)) * greatest(0.0, least(o.y1, f.cy1) - greatest(o.y0, f.cy0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) AS big, greatest(0.0, least(o.x1, f.x1) - greatest(o.x0, f.x0)) * greatest(0.0, least(o.y1, f.y1) - greatest(o.y0, f.y0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) AS small
  FROM pf f JOIN li o ON o.page_number = f.page_number AND o.region_id <> f.region_id),
cg AS (SELECT region_id, count(*) AS captured, count(*) FILTER (type IN ('Table', 'Formula', 'Caption')) AS barriers, count(*) FILTER (type IN ('Figure', 'Table')) AS competing FROM cp WHERE big >= 0.5 AND small < 0.5 GROUP BY region_id),
cd AS (SELECT pf.*, COALESCE(captured, 0) AS captured, CASE WHEN assignment < 7 THEN 'ambiguous_visual_evidence' WHEN COALESCE(competing, 0) > 0 THEN 'ambiguous_competing_asset' WHEN COALESCE(barriers, 0) > 0 THEN 'rejected_barrier_crossing'
  WHEN (cx1 - cx0) * (cy1 - cy0) / ((x1 - x0) * (y1 - y0)) > 4 OR (cx1 - cx0) * (cy1 - cy0) / 1000000.0 > 0.65 THEN 'rejected_excessive_growth' WHEN COALESCE(captured, 0) > 0 THEN 'accepted_with_nested_content' ELSE 'accepted' END AS decision FROM pf LEFT JOIN cg USING (region_id))"""


@query(O.li(_COMP, select="SELECT region_id, decision, captured, CASE WHEN decision LIKE 'acc%' THEN cx0 ELSE x0 END AS x0, CASE WHEN decision LIKE 'acc%' THEN cy0 ELSE y0 END AS y0, CASE WHEN decision LIKE 'acc%' THEN cx1 ELSE x1 END AS x1, CASE WHEN decision LIKE 'acc%' THEN cy1 ELSE y1 END AS y1 FROM cd"))
def figure_completion(spark, d):
    """Each Figure proposed to grow by fixed margins."""
    r = _li(spark, d)
    grown = r.where("type = 'Figure'").selectExpr("doc_id", "page_number", "region_id", "cast(src_order * 2 + region_id % 7 AS double) AS assignment", "x0 - 60 AS n_x0", "y0 - 30 AS n_y0", "x1 + 200 AS n_x1", "y1 + 120 AS n_y1")
    return completion.decisions(r, grown).select("region_id", "decision", "captured", "x0", "y0", "x1", "y1")


# Hierarchy


@query(O.li(O.PAIRS, O.PROPOSED, select="SELECT parent_id, child_id, role, kind, reason FROM hv"))
def containment_children(spark, d):
    r = _li(spark, d)
    return hierarchy.proposals(r, pairs.relationships(r)).select("parent_id", "child_id", "role", "kind", "reason")


def _outcome(spark, d):
    r = _li(spark, d)
    return r, hierarchy.resolved(hierarchy.proposals(r, pairs.relationships(r)))


@query(O.li(O.PAIRS, O.PROPOSED, select="SELECT child_id, parent_id, accepted_parent_id, kind, reason, action FROM hr"))
def hierarchy_outcomes(spark, d):
    return _outcome(spark, d)[1].select("child_id", "parent_id", "accepted_parent_id", "kind", "reason", "action")


@query(O.li(O.PAIRS, O.PROPOSED, select="SELECT li.doc_id, count(*) AS regions, count(accepted_parent_id) AS nested, count(*) - count(accepted_parent_id) AS top_level FROM li LEFT JOIN hr ON hr.page_number = li.page_number AND hr.child_id = li.region_id GROUP BY ALL"))
def hierarchy_partition(spark, d):
    r, o = _outcome(spark, d)
    n = hierarchy.numbered(r, o)
    return n.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count("parent_id").alias("nested"), F.count_if(F.col("parent_id").isNull()).alias("top_level"))


@query(O.li(O.PAIRS, O.PROPOSED, select="SELECT region_id, accepted_parent_id AS parent_id, CASE WHEN accepted_parent_id IS NOT NULL THEN row_number() OVER (PARTITION BY li.page_number, accepted_parent_id ORDER BY y0, x0, src_order, region_id) END AS local_order, CASE WHEN accepted_parent_id IS NULL THEN row_number() OVER (PARTITION BY li.page_number, accepted_parent_id IS NOT NULL ORDER BY y0, x0, region_id) END AS resolved_order FROM li LEFT JOIN hr ON hr.page_number = li.page_number AND hr.child_id = li.region_id"))
def parent_local_order(spark, d):
    r, o = _outcome(spark, d)
    return hierarchy.numbered(r, o).select("region_id", "parent_id", "local_order", "resolved_order")


@query(O.li(O.PAIRS, O.PROPOSED, select="SELECT parent_type, role, kind, count(*) AS n FROM hv GROUP BY ALL"))
def policy_matrix_counts(spark, d):
    r = _li(spark, d)
    return hierarchy.proposals(r, pairs.relationships(r)).groupBy("parent_type", "role", "kind").agg(F.count("*").alias("n"))


@query(O.li("""na AS (SELECT r.region_id, a.region_id AS asset_id, a.type, row_number() OVER (PARTITION BY r.page_number, r.region_id ORDER BY a.src_order) AS rn FROM li r JOIN li a USING (doc_id, page_number)
  WHERE r.type NOT IN ('Figure', 'Table') AND a.type IN ('Figure', 'Table') AND greatest(0.0, least(r.x1, a.x1) - greatest(r.x0, a.x0)) * greatest(0.0, least(r.y1, a.y1) - greatest(r.y0, a.y0)) / ((r.x1 - r.x0) * (r.y1 - r.y0)) >= 0.92)""",
    select="SELECT region_id, asset_id, 'nested_inside_' || lower(type) AS filter_reason FROM na WHERE rn = 1"))
def nested_assets_excluded(spark, d):
    return hierarchy.nested_assets(_li(spark, d)).select("region_id", "asset_id", "filter_reason")


def _edges(spark, d):
    """The relationships with ends put wrong at fixed places, so that each defect occurs."""
    r = _related(spark, d).select("doc_id", F.col("a_region_id").alias("left_id"), F.col("b_region_id").alias("right_id"), "kind", "status")
    # A document's pages are 100 apart.
    other_page = F.col("left_id") - F.col("left_id") % 1000 + 100_001
    wrong = F.when(F.col("left_id") % 97 == 0, F.col("left_id") + 500).when(F.col("left_id") % 89 == 0, F.col("left_id")).when(F.col("left_id") % 83 == 0, other_page).otherwise(F.col("right_id"))
    return r.withColumn("right_id", wrong)


_INTEGRITY = """ed AS (SELECT doc_id, a_region_id AS left_id, status, CASE WHEN a_region_id % 97 = 0 THEN a_region_id + 500 WHEN a_region_id % 89 = 0 THEN a_region_id
  WHEN a_region_id % 83 = 0 THEN a_region_id - a_region_id % 1000 + 100001 ELSE b_region_id END AS right_id FROM rl),
pa AS (SELECT *, least(left_id, right_id) || ':' || greatest(left_id, right_id) AS subject FROM ed),
iss AS (SELECT doc_id, 'missing_endpoint' AS issue, e::VARCHAR AS subject FROM (SELECT doc_id, unnest([left_id, right_id]) AS e FROM ed) x WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.doc_id = x.doc_id AND li.region_id = x.e)
 UNION ALL SELECT doc_id, 'self_loop', left_id::VARCHAR FROM ed WHERE left_id = right_id UNION ALL SELECT doc_id, 'duplicate_authoritative_outcome', subject FROM pa GROUP BY doc_id, subject HAVING count(*) > 1
 UNION ALL SELECT doc_id, 'unresolved_candidate', subject FROM pa WHERE status = 'observed_for_hierarchy_validation'
 UNION ALL SELECT pa.doc_id, 'cross_page', subject FROM pa JOIN li a ON a.doc_id = pa.doc_id AND a.region_id = left_id JOIN li b ON b.doc_id = pa.doc_id AND b.region_id = right_id WHERE a.page_number <> b.page_number)"""


@query(O.li(O.PAIRS, _INTEGRITY, select="SELECT doc_id, issue, subject, count(*) AS n FROM iss GROUP BY ALL"))
def graph_integrity(spark, d):
    return hierarchy.integrity(_li(spark, d), _edges(spark, d)).groupBy("doc_id", "issue", "subject").agg(F.count("*").alias("n"))


#: Each region's parent is the one of its page at place (place * place + 1) mod n; walked until the start comes again or has had its chance.
_CYCLES = """mp AS (SELECT region_id AS child_id, page_number * 1000 + (src_order * src_order + 1) % cnt + 1 AS parent_id, cnt FROM (SELECT *, count(*) OVER (PARTITION BY page_number) AS cnt FROM li)),
wk AS (SELECT child_id AS start_id, parent_id AS here, 1 AS steps, cnt FROM mp
  UNION ALL SELECT wk.start_id, mp.parent_id, wk.steps + 1, wk.cnt FROM wk JOIN mp ON mp.child_id = wk.here WHERE wk.here <> wk.start_id AND wk.steps < wk.cnt)"""


@query(O.li(_CYCLES, select="SELECT start_id AS region_id, steps AS cycle_length FROM wk WHERE here = start_id").replace("WITH ", "WITH RECURSIVE ", 1))
def hierarchy_cycles(spark, d):
    """Cycles of a parent map over all regions of all pages."""
    from pyspark.sql import Window

    r = _li(spark, d).withColumn("cnt", F.count("*").over(Window.partitionBy("page_number")))
    m = r.select(F.col("region_id").alias("child_id"), (F.col("page_number") * 1000 + (F.col("src_order") * F.col("src_order") + 1) % F.col("cnt") + 1).alias("parent_id"))
    return hierarchy.cycles(spark, m).select("region_id", "cycle_length")


# Filters


@query(O.doc(rf"""bd AS (SELECT *, {O.HEADER_SIG} AS sig FROM dl WHERE page_number > 1 AND y1 / 1000.0 <= 0.14), rc AS (SELECT doc_id, sig FROM bd WHERE sig <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 2)""", select="SELECT region_id, sig AS signature, 'later_page_upper_recurring_header' AS filter_reason FROM bd SEMI JOIN rc USING (doc_id, sig)"))
def header_recurring(spark, d):
    return filters.recurring_headers(A.document_regions(spark, d)).select("region_id", "signature", "filter_reason")


@query(O.doc(rf"""bd AS (SELECT *, {O.FOOTER_SIG} AS sig FROM dl WHERE y0 / 1000.0 >= 0.88 AND (x1 - x0) / 1000.0 < 0.25 AND (y1 - y0) / 1000.0 < 0.10), rc AS (SELECT doc_id, sig FROM bd WHERE sig <> '' GROUP BY ALL HAVING count(DISTINCT page_number) >= 2)""", select=r"SELECT region_id, sig AS signature, 'repeated_footer_visual_furniture' AS filter_reason FROM bd SEMI JOIN rc USING (doc_id, sig) WHERE NOT regexp_matches(text, '(?i)^(fig|figure|table)\s*\d')"))
def footer_recurring(spark, d):
    return filters.recurring_footers(A.document_regions(spark, d)).select("region_id", "signature", "filter_reason")


@query(O.li(select="""SELECT region_id, CASE WHEN (x0 + x1) / 2000.0 < 0.06 THEN 'left' ELSE 'right' END || '_side_margin_text_furniture' AS filter_reason FROM li
  WHERE ((x0 + x1) / 2000.0 < 0.06 OR (x0 + x1) / 2000.0 > 0.94) AND type IN ('Text', 'Footnote', 'Unknown') AND (x1 - x0) / 1000.0 < 0.10 AND ((y1 - y0) / 1000.0 > 0.12 OR (y1 - y0) / 1000.0 < 0.035)"""))
def side_margin_excluded(spark, d):
    return filters.side_margins(_li(spark, d)).select("region_id", "filter_reason")


@query(O.li(select="SELECT region_id, 'small_edge_figure_page2_plus' AS filter_reason FROM li WHERE page_number > 1 AND type = 'Figure' AND (y1 / 1000.0 <= 0.12 OR y0 / 1000.0 >= 0.90) AND (x1 - x0) / 1000.0 < 0.25 AND (y1 - y0) / 1000.0 < 0.12"))
def edge_figures_excluded(spark, d):
    return filters.edge_figures(_li(spark, d)).select("region_id", "filter_reason")


_CAT = r"CASE WHEN regexp_matches(n, '(?i)^(references|bibliography)$') THEN 'references' WHEN regexp_matches(n, '(?i)^(acknowledg(e)?ments?)$') THEN 'acknowledgements' WHEN regexp_matches(n, '(?i)^(declarations?|conflict(s)? of interest|competing interests?)$') THEN 'declarations' WHEN regexp_matches(n, '(?i)^(appendix|appendices)(\b|\s+[a-z0-9])') THEN 'appendices' WHEN regexp_matches(n, '(?i)^(supplementary|supporting)\s+(material|information|data)') THEN 'supplementary_sections' END"


@query(O.doc(O.HEADINGS, rf"nn AS (SELECT *, rtrim(trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')), ':.') AS n FROM hd), ct AS (SELECT *, {_CAT} AS cat FROM nn), sc AS (SELECT region_id, last_value(cat IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, y0, x0, src_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM ct)",
    select="SELECT section, CASE WHEN section = 'appendices' THEN 'retain' ELSE 'secondary_stream' END AS action, CASE WHEN section IS NULL THEN 'unclassified_tail' ELSE 'content_policy' END AS policy_reason, count(*) AS n, min(region_id) AS first_region FROM sc GROUP BY ALL"))
def policy_carry_forward(spark, d):
    p = filters.content_policy(_headed(spark, d), retain=("appendices",))
    return p.groupBy("section", "action", "policy_reason").agg(F.count("*").alias("n"), F.min("region_id").alias("first_region"))


_BLOCKS = r"""WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?i)<(h1|h2|h3|p|li|td|th|title)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g') AS h FROM pages),
b AS (SELECT page_id, unnest(list_filter(string_split(h, chr(1)), lambda x: contains(x, chr(2)))) AS part FROM m),
t AS (SELECT page_id, lower(split_part(part, chr(2), 1)) AS tag, trim(regexp_replace(regexp_replace(regexp_replace(split_part(part, chr(2), 2),
  '(?is)</(?:h1|h2|h3|p|li|td|th|title|ul|ol|tr|table|div|article|section|header|footer|nav|head|body|html)\s*>.*$', ''), '<[^>]*>', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS text FROM b)"""


@query(_BLOCKS + """ SELECT tag, CASE tag WHEN 'h1' THEN 'Title' WHEN 'h2' THEN 'Section-header' WHEN 'h3' THEN 'Section-header' WHEN 'p' THEN 'Text' WHEN 'li' THEN 'List' WHEN 'td' THEN 'Field-value' WHEN 'th' THEN 'Field-key' ELSE 'Page-header' END AS type,
  count(*) AS n, sum(length(text))::BIGINT AS chars FROM t WHERE text <> '' GROUP BY tag""")
def label_map_counts(spark, d):
    return A.html_blocks(spark, d).groupBy("tag", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


_ROLES = r"""f0 AS (SELECT *, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS body FROM hd),
f1 AS (SELECT *, len(regexp_extract_all(body, '[^\s\p{Z}]+')) AS words, y0 / 1000.0 AS top, y1 / 1000.0 AS bottom,
  len(regexp_extract_all(body, '(?i)\b(receiv\w*|revis\w*|accept\w*|submit\w*|publish\w*|available\s+(?:on|in)line|first\s+published|version\s+of\s+record)\b')) AS events,
  len(regexp_extract_all(body, '\b(?:\d{1,2}[\s./-]+(?:[A-Za-z]{3,12}|\d{1,2})[\s,./-]+\d{2,4}|(?:[A-Za-z]{3,12})\s+\d{1,2},?\s+\d{4}|\d{4}-\d{1,2}-\d{1,2})\b')) AS dates,
  len(regexp_extract_all(body, '(?i)(?:©|\bcopyright\b|\blicen[cs](?:e|ed|ing)\b|\ball\s+rights?\b|\bright\s+to\s+(?:copy|reuse|reproduce|distribute)\b|\bcreative\s+commons\b|\bopen\s+access\b|\bpermissions?\b|\bpublished\s+by\b|\breproduction\b|\bredistribution\b)')) AS legal,
  regexp_matches(body, '(?i)^\s*(article|manuscript|publication|submission)\s*(history|information|details?|record|timeline)\b') AS heading, regexp_matches(body, '(?i)^\s*(abstract|summary)\b') AS abstract,
  regexp_matches(body, '(?i)^\s*(?:(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)[\s.)\-:]*)?(introduction|background|materials?\s+and\s+methods?|methods?|results?)\b') AS starts,
  regexp_matches(body, '(?i)^\s*(key\s*words?|index\s+terms?)\b') AS keywords, regexp_matches(body, '[.!?](?:\s|$)') AS ends FROM f0),
f2 AS (SELECT *, words >= 18 AND (ends OR words >= 34) AS prose, type = 'Caption' OR abstract OR keywords OR starts AS protected, min(CASE WHEN starts THEN top END) OVER (PARTITION BY page_number) AS start, bool_or(abstract) OVER (PARTITION BY page_number) AS has_abstract FROM f1),
f3 AS (SELECT *, (start IS NOT NULL OR has_abstract) AND top < COALESCE(start, 1.0) AS before, words <= 45 AND (y1 - y0) / 1000.0 <= 0.09 AS compact, events >= 2 OR (events >= 1 AND dates >= 1) OR heading AS history FROM f2),
f4 AS (SELECT *, CASE WHEN history THEN 'article_history' WHEN legal >= 1 THEN 'publisher_legal' END AS role, least(1.0, 0.62::DOUBLE * CASE WHEN history THEN least(1.0, 0.48::DOUBLE + 0.16::DOUBLE * events + 0.14::DOUBLE * dates + CASE WHEN heading THEN 0.2::DOUBLE ELSE 0.0 END) ELSE least(1.0, 0.64::DOUBLE + 0.12::DOUBLE * least(legal, 3)) END
  + 0.38::DOUBLE * (CASE WHEN before THEN 0.45::DOUBLE ELSE 0.0 END + CASE WHEN compact THEN 0.25::DOUBLE ELSE 0.0 END + CASE WHEN NOT prose THEN 0.2::DOUBLE ELSE 0.0 END)) - CASE WHEN prose THEN 0.2::DOUBLE ELSE 0.0 END AS confidence FROM f3),
f5 AS (SELECT *, COALESCE(role IS NOT NULL AND NOT protected AND body <> '' AND words <= 120 AND before AND compact AND confidence >= 0.78, false) AS seed FROM f4),
f6 AS (SELECT r.page_number, r.region_id, arg_min(s.role, (s.src_order, s.region_id)) AS role, arg_min(s.confidence, (s.src_order, s.region_id)) AS confidence FROM f5 r JOIN f5 s ON s.page_number = r.page_number AND s.seed
  WHERE NOT r.seed AND NOT r.protected AND NOT r.prose AND r.words <= 120 AND r.top < COALESCE(r.start, 1.0) AND (r.words <= 45 OR r.heading) AND greatest(0.0, greatest(r.y0, s.y0) - least(r.y1, s.y1)) / 1000.0 <= 0.035
  AND greatest(0.0, least(r.x1, s.x1) - greatest(r.x0, s.x0)) / greatest(least(r.x1 - r.x0, s.x1 - s.x0), 0.000001) >= 0.45 GROUP BY r.page_number, r.region_id)"""


@query(
    O.doc(
        O.HEADINGS, _ROLES,
        select="SELECT page_number, region_id, role, 'semantic_structural_seed' AS decision, round(confidence, 6) AS confidence FROM f5 WHERE seed UNION ALL SELECT page_number, region_id, role, 'aligned_group_continuation', round(confidence, 6) FROM f6",
    )
)
def front_matter_roles(spark, d):
    return filters.front_matter_roles(_headed(spark, d)).select("page_number", "region_id", "role", "decision", F.round("confidence", 6).alias("confidence"))


@query(O.li("""ax AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, src_order, region_id) AS asset_order FROM li WHERE type IN ('Figure', 'Table'))""",
    select="""SELECT a.region_id, a.type, a.asset_order, COALESCE((SELECT string_agg(n.region_id::VARCHAR, ',' ORDER BY n.region_id) FROM li n WHERE n.page_number = a.page_number AND n.type IN ('Caption', 'Footnote', 'Text') AND abs(n.y0 - a.y1) < 120), '') AS linked FROM ax a"""))
def post_body_assets(spark, d):
    return filters.post_body_assets(_li(spark, d)).select("region_id", "type", "asset_order", F.array_join("linked", ",").alias("linked"))


# Snapshots and invariants


@query(O.li(select="SELECT doc_id, 'source' AS stage, count(*) AS regions, count(DISTINCT region_id) AS region_ids, count(*) = count(DISTINCT region_id) AS unique_ids, 0::BIGINT AS invalid_geometry, 0::BIGINT AS invalid_pages FROM li GROUP BY doc_id"))
def stage_snapshot(spark, d):
    return trace.snapshot("source", _li(spark, d)).select("doc_id", "stage", "regions", "region_ids", "unique_ids", "invalid_geometry", "invalid_pages")


@query(O.li(O.SNAP, select="SELECT doc_id, 0::BIGINT AS added, count(*) FILTER (region_id % 7 = 0) AS removed, count(*) FILTER (region_id % 7 <> 0 AND (a.x0, a.y0, a.x1, a.y1) <> (b.x0, b.y0, b.x1, b.y1)) AS moved, count(*) FILTER (region_id % 7 <> 0 AND region_id % 5 = 0 AND a.type <> 'Text') AS retyped FROM li a JOIN sn b USING (doc_id, page_number, region_id) GROUP BY doc_id"))
def trace_compare(spark, d):
    r = _li(spark, d)
    after = A.snapped(r).where("region_id % 7 <> 0").withColumn("type", F.when(F.col("region_id") % 5 == 0, "Text").otherwise(F.col("type")))
    return trace.compare(r, after)


@query(O.li(select="SELECT doc_id, count(*) AS inputs, count(*) FILTER (region_id % 11 = 0) AS lost, 0::BIGINT AS invented, 0::BIGINT AS repeated, count(*) FILTER (region_id % 11 = 0) = 0 AS holds FROM li GROUP BY doc_id"))
def partition_invariant(spark, d):
    r = _li(spark, d)
    out = r.where("region_id % 11 <> 0")
    return trace.partition(r, out.where("type <> 'Figure'"), out.where("type = 'Figure'"))


@query(O.li(select="SELECT region_id, array_to_string(list_filter([CASE WHEN x1 + 200 > 1000 OR y1 > 1000 THEN 'outside_page' END, CASE WHEN score + 0.25::DOUBLE > 1 THEN 'score_out_of_range' END], lambda x: x IS NOT NULL), ',') AS errors FROM li WHERE x1 + 200 > 1000 OR y1 > 1000 OR score + 0.25::DOUBLE > 1"))
def region_schema_errors(spark, d):
    """Boxes moved to the right, so that some leave the page."""
    r = _li(spark, d).withColumn("x1", F.col("x1") + 200).withColumn("score", F.col("score") + 0.25)
    return trace.schema_errors(r).select("region_id", F.array_join("errors", ",").alias("errors"))


@query(O.li(select="SELECT doc_id, count(*) AS regions, count(*) FILTER (x1 + 200 > 1000 OR y1 > 1000) AS changed, sum((least(x1 + 200, 1000) - x0) * (least(y1, 1000) - y0)) AS area FROM li GROUP BY doc_id"))
def geometry_history(spark, d):
    """Boxes clipped to the page by an accepted proposal each."""
    r = trace.initialized(_li(spark, d).withColumn("x1", F.col("x1") + 200))
    r = trace.change_geometry(r, Box.of().clipped(F.col("page_w"), F.col("page_h")), F.lit(True), "clip", "page bounds")
    return r.groupBy("doc_id").agg(F.count("*").alias("regions"), F.count_if(F.col("geometry_version") == 2).alias("changed"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query(O.li(select="SELECT doc_id, type, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM li GROUP BY ALL"))
def region_type_counts(spark, d):
    return _li(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum(Box.of().area).alias("area"))


@query(O.li(select="SELECT doc_id, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {t.lower()}" for t in ("Figure", "Table", "Formula", "Caption", "Footnote", "Text")) + " FROM li GROUP BY doc_id"))
def page_summary(spark, d):
    kinds = ["Figure", "Table", "Formula", "Caption", "Footnote", "Text"]
    p = _li(spark, d).groupBy("doc_id").pivot("type", kinds).agg(F.count(F.lit(1)))
    return p.select("doc_id", *[F.coalesce(F.col(k), F.lit(0)).alias(k.lower()) for k in kinds])


@query(O.li(select="SELECT region_id, least(greatest(x0, 0), 1000)::DOUBLE AS x0, least(greatest(y0, 0), 1000)::DOUBLE AS y0, least(greatest(x1, 0), 1000)::DOUBLE AS x1, least(greatest(y1, 0), 1000)::DOUBLE AS y1, CASE WHEN x1 - x0 >= 2 * (y1 - y0) THEN 0.0 WHEN y1 - y0 >= 2 * (x1 - x0) THEN 90.0 END::DOUBLE AS degrees FROM li"))
def geometry_scalars(spark, d):
    from quire.functions.geometry import direction

    b = Box.of().clipped(F.col("page_w"), F.col("page_h"))
    return _li(spark, d).select("region_id", b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"), direction(F.lit(None).cast("double"), F.lit(None).cast("double"), Box.of())["degrees"].alias("degrees"))


@query(rf"SELECT doc_id, md5({O._norm('text')}) AS normal_md5, len(list_filter(string_split({O._norm('text')}, ' '), lambda x: x <> '')) AS tokens FROM documents")
def text_normal_forms(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", "text")
    return t.select("doc_id", F.md5(T.normalized(F.col("text")).cast("binary")).alias("normal_md5"), F.size(T.tokens(F.col("text"))).alias("tokens"))


# Orders and customers as documents' strata


@query("SELECT o_orderkey AS page_number, o_orderstatus AS status, count(l_orderkey) AS regions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def page_left_issues(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_number"), F.col("o_orderstatus").alias("status"))
    n = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_number")).agg(F.count("*").alias("regions"))
    return o.join(n, "page_number", "left").select("page_number", "status", F.coalesce("regions", F.lit(0)).alias("regions"))


@query("SELECT o_orderkey AS page_number FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def pages_without_regions(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("page_number"))
    return o.join(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_number")), "page_number", "left_anti")


@query("SELECT r_name, n_name, count(*) AS pages, count(DISTINCT c_custkey) AS documents FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def strata_rollup(spark, d):
    t = lambda n: A.table(spark, d, n)
    j = t("orders").select("o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region").select("r_regionkey", "r_name"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("pages"), F.countDistinct("c_custkey").alias("documents"))


_FAILED = """fl AS (SELECT o_custkey AS run_id, o_orderkey AS page_number FROM orders WHERE o_orderstatus = 'F'),
iu AS (SELECT o_custkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'fatal' WHEN '2-HIGH' THEN 'error' ELSE 'warning' END AS severity FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'P')"""


def _failures(spark, d):
    """A customer's orders as a run's pages: those of status F failed, those of status P have issues, as severe as they are urgent."""
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("page_number"), "o_orderstatus", "o_orderpriority")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "fatal").when(F.col("o_orderpriority") == "2-HIGH", "error").otherwise("warning")
    return o.where("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").select("run_id", severity.alias("severity")), o.where("o_orderstatus = 'F'").select("run_id", "page_number")


_RUNS = """i AS (SELECT run_id, bool_or(severity = 'fatal') AS f, bool_or(severity = 'error') AS e, count(*) AS n FROM iu GROUP BY 1), p AS (SELECT run_id, count(DISTINCT page_number) AS fp FROM fl GROUP BY 1)
SELECT COALESCE(i.run_id, p.run_id) AS run_id, COALESCE(fp, 0) AS failed_pages, CASE WHEN f THEN 'failed' WHEN e OR fp > 0 THEN 'partial' WHEN n > 0 THEN 'complete_with_warnings' ELSE 'complete' END AS status FROM i FULL JOIN p ON p.run_id = i.run_id"""


@query(f"WITH {_FAILED}, {_RUNS}")
def run_statuses(spark, d):
    return trace.run_status(*_failures(spark, d))


@query(f"WITH {_FAILED} SELECT run_id, string_agg(DISTINCT page_number::VARCHAR, ',' ORDER BY page_number::VARCHAR) AS pages FROM fl GROUP BY run_id")
def retry_plan(spark, d):
    _, failed = _failures(spark, d)
    plan = trace.retry_plan(failed.withColumn("config_sha256", F.lit("0")))
    return plan.select("run_id", F.array_join(F.array_sort(F.transform("pages", lambda x: x.cast("string"))), ",").alias("pages"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS user_turns FROM conversations GROUP BY conv_id")
def turn_sequences(spark, d):
    return A.turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("user_turns"))


# Events


@query("SELECT event_type AS event, count(*) AS n, count(*) FILTER (value >= 50) AS slow, count(props) AS with_props, count(DISTINCT user_id) AS runs FROM events GROUP BY event_type")
def event_metrics(spark, d):
    return E.metrics(A.run_events(spark, d))


_WINDOWS = "SELECT date_trunc('day', ts) AS window_start, event_type AS event, count(*) AS n FROM events GROUP BY ALL"


@query(_WINDOWS)
def event_windows(spark, d):
    return E.windows(E.timed(A.run_events(spark, d)))


@query("SELECT run_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id AS run_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY run_id, s")
def event_sessions(spark, d):
    return E.sessions(E.timed(A.run_events(spark, d)))


@query("SELECT event_id, user_id AS run_id, event_type AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def event_dedup(spark, d):
    return E.first_of_each(A.run_events(spark, d)).select("event_id", "run_id", "event")


@query("SELECT event_id, (epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT) AS since FROM events")
def event_intervals(spark, d):
    return E.stages(E.timed(A.run_events(spark, d))).select("event_id", "since")


@query(_WINDOWS)
def event_stream_windows(spark, d):
    """The windows as a stream, run to the end of what is there, in complete mode."""
    import uuid

    name = f"quire_windows_{uuid.uuid4().hex}"
    return E.run_to_end(E.windows(E.stream(spark, f"{d}/events.parquet")), name, f"{sinks.shared_folder(spark)}/streams/{name}")


# The other modules of the catalogue enter theirs as they are imported.
from quire.plans import catalogue_conflicts, catalogue_tables, catalogue_text  # noqa: E402, F401
