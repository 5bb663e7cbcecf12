"""DuckDB SQL for the catalogue's queries, over the driver's tables."""

from __future__ import annotations

_KIND = "CASE l_partkey % 7 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Table' WHEN 2 THEN 'Formula' WHEN 3 THEN 'Caption' WHEN 4 THEN 'Footnote' ELSE 'Text' END"
LI = f"""li AS (
  SELECT l_orderkey % 100 AS doc_id, l_orderkey AS page_number, l_orderkey * 1000 + src_order AS region_id, src_order, type, x0::DOUBLE AS x0, y0::DOUBLE AS y0,
    (x0 + 40 + 6 * CAST(l_quantity AS BIGINT))::DOUBLE AS x1, (y0 + 20 + 15 * (l_partkey % 11))::DOUBLE AS y1,
    CASE WHEN l_partkey % 7 NOT IN (0, 1) THEN 'part ' || (l_partkey % 5) || CASE WHEN l_suppkey % 2 = 0 THEN ' of ' || (l_suppkey % 3) ELSE '' END END AS text,
    CASE WHEN l_tax <> 0 THEN l_discount * 10 END AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS src_order,
      {_KIND} AS type, (l_partkey * 37) % 600 AS x0, (l_suppkey * 53 + l_linenumber * 91) % 800 AS y0 FROM lineitem)
)"""
SNAP = "sn AS (SELECT * REPLACE (floor(x0 / 200.0) * 200.0 AS x0, floor(y0 / 200.0) * 200.0 AS y0, floor(x0 / 200.0) * 200.0 + 200.0 AS x1, floor(y0 / 200.0) * 200.0 + 200.0 AS y1) FROM li)"
DOC = """dl AS (
  SELECT source AS doc_id, doc_id AS page_number, doc_id * 10000000 + pos AS region_id, pos AS src_order,
    CASE WHEN pos = 0 THEN 'Title' WHEN pos % 9 = 4 THEN 'Section-header' WHEN pos % 9 = 7 THEN 'Caption' ELSE 'Text' END AS type, 50.0::DOUBLE AS x0,
    (CASE WHEN pos >= n - 2 THEN 930 + 25 * (pos - (n - 2)) ELSE 24 * (pos % 40) + 10 END)::DOUBLE AS y0,
    50.0::DOUBLE + least(CASE WHEN pos >= n - 2 THEN 200 ELSE 900 END, 6 * length(text))::DOUBLE AS x1,
    (CASE WHEN pos >= n - 2 THEN 930 + 25 * (pos - (n - 2)) ELSE 24 * (pos % 40) + 10 END)::DOUBLE + 18.0 AS y1, text
  FROM (SELECT source, doc_id, len(ls) AS n, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE trim(text, ' ') <> ''
)"""


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(trim(regexp_replace(COALESCE({x}, ''), '[\s\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


normal = _norm  # for other modules


def _family(x: str) -> str:
    return f"CASE WHEN {x} IN ('Table', 'Figure') THEN 'asset' WHEN {x} IN ('Formula', 'Equation') THEN 'formula' WHEN {x} IN ('Page-header', 'Page-footer', 'Page-number') THEN 'furniture' WHEN {x} IN ('Caption', 'Text', 'Footnote', 'Section-header', 'Title', 'List', 'Reference', 'Code') THEN 'text' ELSE 'unknown' END"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0::DOUBLE END"


def pairs(source: str, score: str = "score") -> str:
    """CTEs pr (pairs), ft (features) and rl (relationships) over a CTE of regions."""
    cols = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("region_id", "src_order", "type", "x0", "y0", "x1", "y1", "norm"))
    over = lambda x, y: f"greatest(greatest(0.0, {y}_x0 - {x}_x0) / 1000.0, greatest(0.0, {x}_x1 - {y}_x1) / 1000.0, greatest(0.0, {y}_y0 - {x}_y0) / 1000.0, greatest(0.0, {x}_y1 - {y}_y1) / 1000.0)"
    inside = lambda x, y: f"(({x}_x0 + {x}_x1) / 2 BETWEEN {y}_x0 AND {y}_x1 AND ({x}_y0 + {x}_y1) / 2 BETWEEN {y}_y0 AND {y}_y1)"
    return f"""rn AS (SELECT *, {_norm('text')} AS norm FROM {source}),
pr AS (
  SELECT a.doc_id, a.page_number, {cols}, a.{score} AS a_score, b.{score} AS b_score FROM rn a JOIN rn b ON a.doc_id = b.doc_id AND a.page_number = b.page_number
    AND (a.y0 < b.y0 OR (a.y0 = b.y0 AND (a.x0 < b.x0 OR (a.x0 = b.x0 AND a.src_order < b.src_order)))) AND a.y1 + 12.0 >= b.y0
), e1 AS (
  SELECT *, greatest(0.0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) AS iw, greatest(0.0, least(a_y1, b_y1) - greatest(a_y0, b_y0)) AS ih,
    (a_x1 - a_x0) * (a_y1 - a_y0) AS a_area, (b_x1 - b_x0) * (b_y1 - b_y0) AS b_area,
    list_distinct(list_filter(string_split(a_norm, ' '), lambda x: x <> '')) AS ta, list_distinct(list_filter(string_split(b_norm, ' '), lambda x: x <> '')) AS tb
  FROM pr
), e2 AS (SELECT *, iw * ih AS intersection, len(list_intersect(ta, tb)) AS met, len(list_distinct(list_concat(ta, tb))) AS either FROM e1),
ft AS (
  SELECT *, {_div('intersection', 'a_area + b_area - intersection')} AS iou, {_div('intersection', 'a_area')} AS a_containment, {_div('intersection', 'b_area')} AS b_containment,
    {_div('intersection', 'least(a_area, b_area)')} AS over_smaller, {_div('intersection', 'greatest(a_area, b_area)')} AS over_larger,
    {_div('iw', 'least(a_x1 - a_x0, b_x1 - b_x0)')} AS horizontal_overlap, {_div('ih', 'least(a_y1 - a_y0, b_y1 - b_y0)')} AS vertical_overlap,
    {_div('least(a_area, b_area)', 'greatest(a_area, b_area)')} AS area_ratio, a_area / 1000000.0 AS a_page_area, b_area / 1000000.0 AS b_page_area,
    {inside('a', 'b')} AS a_center_inside, {inside('b', 'a')} AS b_center_inside, {_div('met::DOUBLE', 'len(ta)')} AS a_token_coverage, {_div('met::DOUBLE', 'len(tb)')} AS b_token_coverage, {_div('met::DOUBLE', 'either')} AS token_jaccard,
    greatest(abs(a_x0 - b_x0) / 1000.0, abs(a_x1 - b_x1) / 1000.0, abs(a_y0 - b_y0) / 1000.0, abs(a_y1 - b_y1) / 1000.0) AS edge_delta,
    {over('a', 'b')} AS a_protrusion, {over('b', 'a')} AS b_protrusion,
    greatest(0.0, greatest(a_x0, b_x0) - least(a_x1, b_x1)) / 1000.0 AS horizontal_gap, greatest(0.0, greatest(a_y0, b_y0) - least(a_y1, b_y1)) / 1000.0 AS vertical_gap,
    CASE WHEN a_norm = '' OR b_norm = '' THEN 'unavailable' WHEN a_norm = b_norm THEN 'equal' WHEN contains(b_norm, a_norm) THEN 'a_in_b' WHEN contains(a_norm, b_norm) THEN 'b_in_a' ELSE 'different' END AS text_relation,
    a_type = b_type AS same_class, {_family('a_type')} AS a_family, {_family('b_type')} AS b_family
  FROM e2
), e3 AS (
  SELECT *, intersection > 0 AND ((b_type = 'Figure' AND a_type IN ('Text', 'Footnote', 'Unknown') AND a_center_inside) OR (a_type = 'Figure' AND b_type IN ('Text', 'Footnote', 'Unknown') AND b_center_inside)) AS owned,
    iou >= 0.9 AND area_ratio >= 0.85 AND edge_delta <= 0.003 AS same_place,
    over_smaller >= 0.92 OR (a_center_inside AND (a_containment >= 0.72 OR (a_containment >= 0.82 AND a_protrusion <= 0.004))) OR (b_center_inside AND (b_containment >= 0.72 OR (b_containment >= 0.82 AND b_protrusion <= 0.004))) AS inside,
    least(greatest(0.0, a_y1 - b_y0), greatest(0.0, b_y1 - a_y0)) / greatest(1.0, least(a_y1 - a_y0, b_y1 - b_y0)) AS depth
  FROM ft
), e4 AS (
  SELECT *, CASE WHEN owned THEN 'CONTAINMENT_CANDIDATE|figure_center_owned_text_observed|observe|observed_for_hierarchy_validation'
    WHEN same_place AND (same_class OR (a_family = 'text' AND b_family = 'text' AND text_relation = 'equal')) AND text_relation IN ('equal', 'unavailable') THEN 'DUPLICATE|near_identical_extent|canonicalize|observed'
    WHEN same_place AND NOT same_class THEN 'CLASS_CONFLICT|near_identical_extent_different_class|flag|unresolved_conflict'
    WHEN inside THEN 'CONTAINMENT_CANDIDATE|directional_containment_observed|observe|observed_for_hierarchy_validation'
    WHEN intersection > 0 AND (a_family = 'asset' OR b_family = 'asset') AND depth <= 0.2 THEN 'ACCIDENTAL_INTERSECTION|limited_boundary_penetration|retain|preserved'
    WHEN intersection > 0 AND NOT same_class THEN 'CLASS_CONFLICT|material_cross_role_overlap|flag|unresolved_conflict'
    WHEN intersection > 0 THEN 'AMBIGUOUS_OVERLAP|overlap_without_duplicate_evidence|flag|unresolved_conflict'
    WHEN a_family = 'text' AND b_family = 'text' AND horizontal_overlap >= 0.5 AND vertical_gap <= 0.012 AND text_relation = 'different' THEN 'FRAGMENT_CANDIDATE|aligned_nearby_unique_text|retain|preserved' END AS v
  FROM e3
), rl AS (
  SELECT *, split_part(v, '|', 1) AS kind, split_part(v, '|', 2) AS reason, split_part(v, '|', 3) AS action, split_part(v, '|', 4) AS status,
    CASE WHEN v LIKE 'CONT%' THEN CASE WHEN a_containment >= b_containment THEN b_region_id ELSE a_region_id END END AS parent_id,
    CASE WHEN v LIKE 'CONT%' THEN CASE WHEN a_containment >= b_containment THEN a_region_id ELSE b_region_id END END AS child_id
  FROM e4 WHERE v IS NOT NULL
)"""


def li(*ctes: str, select: str) -> str:
    return f"WITH {', '.join([LI, *ctes])} {select}"


def doc(*ctes: str, select: str) -> str:
    return f"WITH {', '.join([DOC, *ctes])} {select}"


PAIRS = pairs("li")
SNAP_PAIRS = f"{SNAP}, {pairs('sn')}"
DUPES = """en AS (SELECT doc_id, page_number, a_region_id AS v, b_region_id AS u FROM rl WHERE kind = 'DUPLICATE' UNION ALL SELECT doc_id, page_number, b_region_id, a_region_id FROM rl WHERE kind = 'DUPLICATE'),
cl AS (SELECT doc_id, page_number, list_sort(list_distinct(list_concat(us, [v]))) AS members FROM (SELECT doc_id, page_number, v, list(u) AS us FROM en GROUP BY doc_id, page_number, v)),
co AS (SELECT doc_id, page_number, members FROM (SELECT doc_id, page_number, members, count(*) AS c FROM cl GROUP BY doc_id, page_number, members) WHERE c = len(members)),
mb AS (SELECT doc_id, page_number, members, unnest(members) AS region_id FROM co),
ql AS (SELECT mb.*, row_number() OVER (PARTITION BY mb.doc_id, mb.page_number, mb.members ORDER BY (r.norm <> '') DESC, length(r.norm) DESC, (r.score IS NOT NULL) DESC, COALESCE(r.score, 0) DESC, r.src_order) AS rk
  FROM mb JOIN rn r USING (doc_id, page_number, region_id)),
ca AS (SELECT doc_id, page_number, region_id, first_value(region_id) OVER (PARTITION BY doc_id, page_number, members ORDER BY rk) AS canonical_id, len(members) AS members FROM ql)"""
SPLIT = """ce AS (SELECT doc_id, page_number, (x0 + x1) / (2 * 1000.0) AS c FROM li WHERE (x1 - x0) / 1000.0 < 0.75),
lg AS (SELECT *, lag(c) OVER (PARTITION BY doc_id, page_number ORDER BY c) AS l FROM ce),
bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY c - l DESC, l DESC, c DESC) AS rk FROM lg WHERE l IS NOT NULL),
sp AS (SELECT doc_id, page_number, c - l AS gap, (l + c) / 2 AS split FROM bs WHERE rk = 1 AND c - l >= 0.04)"""
ORDER = f"""{SPLIT}, ro0 AS (SELECT li.*, CASE WHEN split IS NULL THEN 'single' WHEN (x0 + x1) / (2 * 1000.0) < split THEN 'left' ELSE 'right' END AS reading_column FROM li LEFT JOIN sp USING (doc_id, page_number)),
ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN reading_column = 'right' THEN 1 ELSE 0 END, y0, x0, src_order) AS reading_order FROM ro0)"""
_NOV = "greatest(0.0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) / greatest(1.0, least({a}x1 - {a}x0, {b}x1 - {b}x0))"


def _turned(p: str) -> str:
    """Columns i0, i1, b0, b1 of a box in the frame turned by `deg`, its corners projected."""
    inline = [f"{p}{x} * cos(radians(deg)) + {p}{y} * sin(radians(deg))" for x in ("x0", "x1") for y in ("y0", "y1")]
    block = [f"{p}{y} * cos(radians(deg)) - {p}{x} * sin(radians(deg))" for x in ("x0", "x1") for y in ("y0", "y1")]
    n = p.rstrip("_")
    return f"least({', '.join(inline)}) AS {n}i0, greatest({', '.join(inline)}) AS {n}i1, least({', '.join(block)}) AS {n}b0, greatest({', '.join(block)}) AS {n}b1"


def _over(a: str, b: str, axis: str) -> str:
    return f"greatest(0.0, least({a}{axis}1, {b}{axis}1) - greatest({a}{axis}0, {b}{axis}0)) / greatest(1.0, least({a}{axis}1 - {a}{axis}0, {b}{axis}1 - {b}{axis}0))"


#: A caption twice as wide as high reads across, one twice as high as wide reads down the page; others follow the page's axes.
ALT = f"""al00 AS (
  SELECT c.doc_id, c.page_number, c.region_id AS c_id, p.region_id AS p_id, p.type AS p_type, c.x0, c.y0, c.x1, c.y1, p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1,
    CASE WHEN c.x1 - c.x0 >= 2 * (c.y1 - c.y0) THEN 0.0::DOUBLE WHEN c.y1 - c.y0 >= 2 * (c.x1 - c.x0) THEN 90.0::DOUBLE END AS deg
  FROM li c JOIN li p USING (doc_id, page_number) WHERE c.type = 'Caption' AND p.type IN ('Figure', 'Table', 'Formula', 'Code')
), al01 AS (SELECT *, {_turned('')}, {_turned('p')} FROM al00),
al02 AS (SELECT *, {_over('', 'p', 'i')} AS along, {_over('', 'p', 'b')} AS across, {_NOV.format(a='', b='p')} AS page_over FROM al01),
al03 AS (SELECT *, list_min(list_filter([CASE WHEN b1 <= pb0 THEN {{'gap': greatest(0.0, pb0 - b1), 'rank': 0, 'side': 'before', 'overlap': along}} END, CASE WHEN b0 >= pb1 THEN {{'gap': greatest(0.0, b0 - pb1), 'rank': 1, 'side': 'after', 'overlap': along}} END,
  CASE WHEN i1 <= pi0 THEN {{'gap': greatest(0.0, pi0 - i1), 'rank': 2, 'side': 'inline_before', 'overlap': across}} END, CASE WHEN i0 >= pi1 THEN {{'gap': greatest(0.0, i0 - pi1), 'rank': 3, 'side': 'inline_after', 'overlap': across}} END], lambda x: x IS NOT NULL)) AS pl FROM al02),
al0 AS (SELECT *, COALESCE(pl.side IN ('before', 'after'), false) AS local FROM al03),
al0b AS (SELECT *, CASE WHEN local THEN pl.overlap ELSE page_over END AS overlap, CASE WHEN local THEN pl.gap / sqrt(2000000.0::DOUBLE) ELSE greatest(0.0, greatest(y0, py0) - least(y1, py1)) / 1000.0 END AS gap,
  CASE WHEN local THEN pl.side = CASE WHEN p_type = 'Table' THEN 'before' ELSE 'after' END WHEN p_type = 'Table' THEN y1 <= py0 ELSE y0 >= py1 END AS directed FROM al0),
al1 AS (SELECT *, round(0.45 * overlap + 0.30 * greatest(0.0, 1 - gap / 0.1) + 0.0 + CASE WHEN directed THEN 0.10 ELSE 0.0 END, 6) AS score FROM al0b WHERE overlap >= 0.18 AND gap <= 0.1),
al AS (SELECT * FROM al1 c WHERE NOT EXISTS (SELECT 1 FROM li k WHERE k.doc_id = c.doc_id AND k.page_number = c.page_number AND k.type IN ('Title', 'Section-header', 'Figure', 'Table', 'Formula', 'Code') AND k.region_id NOT IN (c.c_id, c.p_id)
  AND k.y0 + k.y1 > least(c.y0 + c.y1, c.py0 + c.py1) AND k.y0 + k.y1 < greatest(c.y0 + c.y1, c.py0 + c.py1) AND {_NOV.format(a='c.', b='k.')} >= 0.25)),
rk AS (SELECT *, row_number() OVER w AS rn, round(score - lead(score) OVER w, 6) AS margin, count(*) OVER (PARTITION BY doc_id, page_number, c_id) AS options FROM al WHERE score >= 0.35 WINDOW w AS (PARTITION BY doc_id, page_number, c_id ORDER BY score DESC, p_id)),
az AS (SELECT c.doc_id, c.page_number, c.region_id AS caption_id, CASE WHEN COALESCE(margin < 0.15, false) THEN NULL ELSE p_id END AS parent_id, CASE WHEN COALESCE(margin < 0.15, false) THEN NULL ELSE p_type END AS parent_type, score, margin, COALESCE(options, 0) AS options,
  CASE WHEN p_id IS NULL THEN 'no_compatible_parent' WHEN COALESCE(margin < 0.15, false) THEN 'unresolved_conflict' ELSE 'associated' END AS status
  FROM (SELECT doc_id, page_number, region_id FROM li WHERE type = 'Caption') c LEFT JOIN (SELECT * FROM rk WHERE rn = 1) r ON r.doc_id = c.doc_id AND r.page_number = c.page_number AND r.c_id = c.region_id)"""
PROPOSED = """pp0 AS (
  SELECT r.doc_id, r.page_number, r.parent_id, r.child_id, CASE text_relation WHEN 'equal' THEN 'equal' WHEN 'unavailable' THEN 'unavailable' ELSE 'other' END AS text_relation,
    CASE WHEN child_id = a_region_id THEN a_type ELSE b_type END AS child_type, CASE WHEN child_id = a_region_id THEN b_type ELSE a_type END AS parent_type,
    CASE WHEN child_id = a_region_id THEN a_containment ELSE b_containment END AS child_coverage, CASE WHEN child_id = a_region_id THEN a_area ELSE b_area END AS child_area,
    CASE WHEN child_id = a_region_id THEN b_area ELSE a_area END AS parent_area, CASE WHEN child_id = a_region_id THEN b_page_area ELSE a_page_area END AS parent_page_area,
    CASE WHEN child_id = a_region_id THEN a_center_inside ELSE b_center_inside END AS center_inside, length(COALESCE(c.text, '')) AS chars, p.src_order AS parent_order
  FROM rl r JOIN li c ON c.doc_id = r.doc_id AND c.page_number = r.page_number AND c.region_id = r.child_id JOIN li p ON p.doc_id = r.doc_id AND p.page_number = r.page_number AND p.region_id = r.parent_id WHERE kind = 'CONTAINMENT_CANDIDATE'
), pp1 AS (
  SELECT *, CASE WHEN child_type = 'Formula' THEN 'formula' WHEN child_type = 'Figure' THEN 'figure' WHEN child_type = 'Table' THEN 'table'
    WHEN child_type = 'Caption' THEN CASE WHEN chars <= 24 THEN 'caption_identifier' ELSE 'full_caption' END
    WHEN parent_type = 'Figure' AND child_type IN ('Text', 'Footnote') THEN CASE WHEN chars <= 12 THEN 'panel_label' WHEN chars >= 80 THEN 'body_paragraph' ELSE 'figure_internal_text' END
    WHEN parent_type = 'Table' AND child_type = 'Footnote' THEN 'table_note' WHEN parent_type = 'Table' AND child_type = 'Text' THEN 'table_cell_text'
    WHEN chars >= 80 THEN 'body_paragraph' ELSE 'text_fragment' END AS role,
    parent_type IN ('Text', 'Caption', 'Footnote') AND child_type IN ('Text', 'Caption', 'Footnote') AS both_text, parent_type NOT IN ('Figure', 'Table') AS plain
  FROM pp0
), pp AS (
  SELECT *, CASE WHEN parent_type = 'Figure' AND parent_page_area > 0.65 THEN 'AMBIGUOUS_CONTAINMENT|figure_exceeds_trusted_page_area'
    WHEN parent_type = 'Figure' AND child_type IN ('Text', 'Footnote') AND center_inside AND child_coverage > 0 THEN 'NESTED_CHILD|figure_owns_centered_text'
    WHEN child_area / greatest(parent_area, 1.0) > 0.85 THEN 'AMBIGUOUS_CONTAINMENT|child_too_large_for_parent'
    WHEN plain AND both_text AND text_relation = 'equal' THEN 'DUPLICATE|equal_text_containment'
    WHEN plain AND both_text AND parent_type = 'Caption' AND role IN ('text_fragment', 'caption_identifier') THEN 'IDENTIFIER_FRAGMENT|caption_contains_identifier_fragment'
    WHEN plain AND both_text THEN 'AMBIGUOUS_TEXT_OCCLUSION|text_container_not_hierarchy_capable'
    WHEN plain THEN 'INVALID_OCCLUSION|parent_not_container_capable'
    WHEN parent_type = 'Table' AND role = 'table_note' AND child_coverage < 0.92 THEN 'AMBIGUOUS_CONTAINMENT|table_note_not_strongly_contained'
    WHEN (parent_type = 'Figure' AND role IN ('panel_label', 'figure_internal_text', 'formula', 'caption_identifier')) OR (parent_type = 'Table' AND role IN ('table_cell_text', 'formula', 'table_note')) THEN 'NESTED_CHILD|compatible_container_child_role'
    WHEN (parent_type = 'Figure' AND role IN ('body_paragraph', 'table', 'figure')) OR (parent_type = 'Table' AND role IN ('figure', 'table')) THEN 'INVALID_OCCLUSION|incompatible_container_child_role'
    ELSE 'AMBIGUOUS_CONTAINMENT|unrecognized_container_child_role' END AS v
  FROM pp1
), hv AS (SELECT *, split_part(v, '|', 1) AS kind, split_part(v, '|', 2) AS reason, count(*) FILTER (v LIKE 'NESTED%') OVER (PARTITION BY doc_id, page_number, child_id) AS fitting FROM pp),
ho AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, child_id ORDER BY CASE WHEN fitting = 1 AND kind = 'NESTED_CHILD' THEN 0 ELSE 1 END, parent_order, parent_id) AS rn FROM hv),
hr AS (SELECT doc_id, page_number, child_id, CASE WHEN fitting = 1 THEN parent_id END AS accepted_parent_id, parent_id, child_type, parent_type, role,
  CASE WHEN fitting > 1 THEN 'AMBIGUOUS_CONTAINMENT' ELSE kind END AS kind, CASE WHEN fitting > 1 THEN 'multiple_plausible_parents' ELSE reason END AS reason, CASE WHEN fitting = 1 THEN 'accept_hierarchy' ELSE 'retain_top_level' END AS action FROM ho WHERE rn = 1)"""
HEADER_SIG = r"trim(regexp_replace(regexp_replace(lower(COALESCE(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g'), '\d+', '#', 'g'))"
FOOTER_SIG = r"regexp_replace(lower(COALESCE(text, '')), '[^\p{L}\p{N}_]+', '', 'g')"
#: Lines of documents with headings put in at fixed places, so that tails, references and roles occur.
HEADINGS = """hd AS (SELECT * REPLACE (CASE
  WHEN src_order = 3 AND page_number % 5 = 0 THEN 'Table ' || (src_order % 9 + 1) || '. ' || text
  WHEN src_order = 2 AND page_number % 7 = 0 THEN 'Conclusion' WHEN src_order = 4 AND page_number % 7 = 0 THEN 'References' WHEN src_order = 5 AND page_number % 7 = 0 THEN 'Appendix A'
  WHEN src_order = 1 AND page_number % 11 = 0 THEN 'Received 12 March 2020; accepted 3 May 2020' WHEN src_order = 2 AND page_number % 11 = 0 THEN 'Introduction'
  WHEN src_order = 1 AND page_number % 13 = 0 THEN 'Copyright 2021 by the authors. All rights reserved' WHEN src_order = 3 AND page_number % 13 = 0 THEN 'Abstract'
  ELSE text END AS text) FROM dl)"""
