"""Operators on regions made by hand: semantics that the driver's tables don't reach."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import images
from quire.functions import text as T
from quire.functions.geometry import Box, angle_distance, direction, normal_angle, parallel, points_to_pixels, reliable_conflict
from quire.operators import caption_groups, captions, conflicts, filters, hierarchy, metadata, order, pairs, resolve, tables, trace
from quire.plans import pipeline, views
from quire.plans.config import DEFAULT
from quire.sources import adapters, runs, sinks
from quire.streaming import events

SCHEMA = "doc_id string, page_number long, region_id long, src_order long, type string, x0 double, y0 double, x1 double, y1 double, text string, score double, page_w double, page_h double"


def regions(spark, *rows, page=1):
    """Rows: type, box, text, optional score; ids and order count from 1."""
    data = [("d", page, i, i, r[0], *map(float, r[1]), r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, 1000.0, 1000.0) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, SCHEMA)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_duplicates_need_a_complete_component(spark):
    # 1 and 2 are alike, so are 2 and 3, but 1 and 3 drift apart: a chain, kept.
    r = regions(spark, ("Text", (0, 0, 400, 400), "same"), ("Text", (3, 0, 403, 400), "same"), ("Text", (6, 0, 406, 400), "same"))
    related = pairs.relationships(r)
    assert resolve.duplicate_components(related).count() == 0
    status = {x["status"] for x in resolve.duplicate_status(related, resolve.canonical(r, resolve.duplicate_components(related))).collect()}
    assert "retained_nontransitive_duplicate_chain" in status
    two = regions(spark, ("Text", (0, 0, 400, 400), "same"), ("Text", (2, 0, 402, 400), "same", 0.9))
    c = resolve.canonical(two, resolve.duplicate_components(pairs.relationships(two))).collect()
    assert {x["canonical_id"] for x in c} == {2}  # the scored one


def test_figure_owns_text_centred_in_it(spark):
    r = regions(spark, ("Figure", (100, 100, 400, 400)), ("Text", (350, 200, 430, 220), "axis"), ("Caption", (100, 410, 400, 430), "Figure 1. x"))
    kinds = {(x["a_region_id"], x["b_region_id"]): x["reason"] for x in pairs.relationships(r).collect()}
    assert kinds[1, 2] == "figure_center_owned_text_observed"
    p = hierarchy.resolved(hierarchy.proposals(r, pairs.relationships(r))).first()
    assert (p["child_id"], p["accepted_parent_id"], p["reason"]) == (2, 1, "figure_owns_centered_text")


def test_two_fitting_parents_are_ambiguous(spark):
    r = regions(spark, ("Table", (100, 100, 800, 800)), ("Table", (90, 90, 790, 790)), ("Formula", (200, 200, 300, 230)))
    o = {x["child_id"]: x for x in hierarchy.resolved(hierarchy.proposals(r, pairs.relationships(r))).collect()}
    assert o[3]["accepted_parent_id"] is None and o[3]["reason"] == "multiple_plausible_parents"


def test_bands_find_the_same_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [("Text", (x, y, x + w, y + h), "t") for x, y, w, h in zip(rng.integers(0, 900, 120), rng.integers(0, 900, 120), rng.integers(5, 300, 120), rng.integers(5, 300, 120))]
    r = regions(spark, *rows)
    ids = lambda df: sorted((x["a_region_id"], x["b_region_id"]) for x in df.collect())
    assert ids(pairs.candidates(r, 0.012)) == ids(pairs.candidates(r, 0.012, band=37.0))


def test_caption_is_blocked_and_can_be_ambiguous(spark):
    blocked = regions(spark, ("Figure", (100, 100, 400, 200)), ("Section-header", (100, 205, 400, 215), "x"), ("Caption", (100, 220, 400, 240), "a caption"))
    assert captions.associations(blocked).first()["status"] == "no_compatible_parent"
    between = regions(spark, ("Figure", (100, 100, 400, 200)), ("Caption", (100, 205, 400, 215), "a caption"), ("Figure", (100, 220, 400, 300)))
    a = captions.associations(between).first()
    assert a["status"] == "unresolved_conflict" or a["parent_id"] == 1
    named = regions(spark, ("Figure", (100, 100, 400, 200)), ("Caption", (100, 205, 400, 215), "Table 3. values"), ("Table", (100, 220, 400, 300)))
    assert captions.associations(named).first()["parent_id"] == 3


@pytest.mark.parametrize(("text", "kind", "number"), [("Fig. 12: x", "figure", "12"), ("Table S3. x", "table", "S3"), ("Supplementary Table IV", "table", "IV"), ("Eq. 4", "equation", "4"), ("• Figure 2", "figure", "2"), ("Figures are nice", "figure", "s"), ("Figurative", None, None), ("The Table 2", None, None), (None, None, None)])
def test_caption_references(spark, text, kind, number):
    ref = value(spark, T.caption_reference(F.lit(text).cast("string")))
    assert (ref["kind"], ref["number"]) == (kind, number) if kind else ref is None


def test_reference_quality(spark):
    good, note = (value(spark, T.authoritative(T.caption_reference(F.lit(t)))) for t in ("Table A. Results", "Table a See Table 2 for codes"))
    assert good and not note
    assert value(spark, T.prose_evidence(F.lit("as shown in Table 2"))) == ["identifier_embedded_in_prose", "cross_reference_lead_in"]
    assert value(spark, T.prose_evidence(F.lit("Table 2. values"))) == []


def test_columns_split_at_the_largest_gap(spark):
    r = regions(spark, ("Text", (520, 10, 900, 20)), ("Text", (50, 300, 450, 310)), ("Text", (50, 10, 450, 20)), ("Title", (50, 0, 950, 5)))
    got = {x["region_id"]: (x["reading_column"], x["reading_order"]) for x in order.reading_order(r).collect()}
    assert got[3][0] == "left" and got[1][0] == "right" and got[2][1] < got[1][1]


def test_tail_starts_behind_the_last_conclusion(spark):
    r = regions(spark, ("Text", (0, 0, 9, 9), "References"), ("Text", (0, 100, 9, 109), "5 Conclusions"), ("Text", (0, 200, 9, 209), "body"), ("Text", (0, 250, 9, 259), "Data availability"), ("Text", (0, 300, 9, 309), "Acknowledgments"), ("Text", (0, 400, 9, 409), "thanks"), ("Text", (0, 500, 9, 509), None))
    b = filters.tail_boundaries(r).collect()
    assert [(x["boundary_y"], x["method"]) for x in b] == [(250.0, "conclusion_anchor")]
    assert sorted(x["region_id"] for x in filters.document_tail(r).collect()) == [4, 5, 6, 7]
    p = {x["region_id"]: (x["section"], x["action"]) for x in filters.content_policy(r, retain=("acknowledgements",)).collect()}
    assert p[1] == p[4] == ("references", "secondary_stream") and p[6] == ("acknowledgements", "retain") and p[7][0] == "acknowledgements"


def test_headers_recur_over_pages(spark):
    a = regions(spark, ("Text", (0, 10, 300, 30), "Journal 12"), ("Text", (0, 500, 300, 530), "Journal 12"), page=2)
    b = regions(spark, ("Text", (0, 10, 300, 30), "Journal 13"), ("Page-header", (0, 50, 300, 60), "once"), page=3)
    got = filters.recurring_headers(a.unionByName(b)).select("page_number", "region_id").collect()
    assert sorted(map(tuple, got)) == [(2, 1), (3, 1), (3, 2)]


def test_front_matter_needs_semantics_and_structure(spark):
    r = regions(spark, ("Text", (50, 50, 450, 70), "Received 1 May 2020; accepted 3 June 2020"), ("Text", (50, 75, 450, 95), "Editor: A. Person"), ("Section-header", (50, 400, 450, 420), "1. Introduction"), ("Text", (50, 430, 450, 700), "We received the data. " * 10))
    got = {x["region_id"]: (x["role"], x["decision"]) for x in filters.front_matter_roles(r).collect()}
    assert got == {1: ("article_history", "semantic_structural_seed"), 2: ("article_history", "aligned_group_continuation")}
    confidence = filters.front_matter_roles(r).where("region_id = 1").first()["confidence"]
    assert confidence == pytest.approx(0.62 * min(1, 0.48 + 0.32 + 0.28) + 0.38 * 0.9)


def test_metadata_values_follow_their_labels(spark):
    r = regions(
        spark, ("Section-header", (50, 30, 200, 42), "A R T I C L E  I N F O"), ("Text", (50, 50, 200, 60), "Keywords:"), ("Text", (50, 63, 200, 73), "one, two"), ("Text", (50, 76, 200, 86), "three"), ("Text", (50, 300, 200, 310), "far away"),
        ("Text", (50, 320, 200, 330), "DOI: 10.1/x"), ("Text", (500, 55, 900, 65), "Introduction"), ("Text", (50, 400, 200, 430), "Article history\nReceived 1 May"), ("Text", (50, 433, 200, 443), "Accepted 2 May"), ("Text", (50, 446, 200, 456), "Abstract"), ("Text", (50, 900, 200, 910), "Contact: far down"),
    )
    got = [(x["region_id"], x["category"], x["value"], x["members"]) for x in metadata.fields(r).orderBy("region_id").collect()]
    assert got == [(2, "scientific_descriptors", "one, two\nthree", 2), (6, "identifiers", "DOI: 10.1/x", 1), (8, "administrative_history", "Article history\nReceived 1 May\nAccepted 2 May", 2)]
    role = {x["region_id"]: (x["role"], x["field"]) for x in metadata.roles(r).collect()}
    assert role == {
        1: ("metadata_container_heading", None), 2: ("metadata_field_label", 1), 3: ("metadata_field_value", 1), 4: ("metadata_field_value", 1), 6: ("metadata_field_label_and_value", 2),
        8: ("metadata_field_label_and_value", 3), 9: ("metadata_field_value", 3),
    }
    many = r
    for n in range(2, 40):
        many = many.unionByName(r.withColumn("page_number", F.lit(n).cast("long")))
    assert metadata.fields(many.repartition(7)).count() == 39 * 3 and metadata.roles(many.where("false")).count() == 0


def test_cycles_of_any_length(spark):
    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    sizes = {1000: 1, 2000: 2, 3000: 4, 4000: 16, 5000: 17, 6000: 48, 7000: 64}
    pairs_ = [x for a, n in sizes.items() for x in ring(a, n)]
    pairs_ += [(5100 + i, 5101 + i) for i in range(40)] + [(5140, 5003)] + [(i, i + 1) for i in range(70)] + [(900, None)]  # into a cycle, and to a root
    df = lambda rows: spark.createDataFrame(rows, "child_id long, parent_id long")
    got = {x["region_id"]: x["cycle_length"] for x in hierarchy.cycles(spark, df(pairs_ + pairs_[:3])).collect()}
    assert got == {a + i: n for a, n in sizes.items() for i in range(n)}
    assert hierarchy.cycles(spark, df([(1, 2), (2, 3)])).collect() == [] == hierarchy.cycles(spark, df([])).collect()
    with pytest.raises(ValueError):
        hierarchy.cycles(spark, df([(1, 2), (1, 3)]))


def test_cycles_over_all_pages(spark):
    r = adapters.lineitem_regions(spark, "/root/testdata/sf0.001").groupBy("page_number").agg(F.count("*").alias("n")).collect()
    rows = [(x["page_number"] * 1000 + i + 1, x["page_number"] * 1000 + (i + 1) % x["n"] + 1) for x in r for i in range(x["n"])]
    got = {x["region_id"]: x["cycle_length"] for x in hierarchy.cycles(spark, spark.createDataFrame(rows, "child_id long, parent_id long")).collect()}
    assert got == {x["page_number"] * 1000 + i + 1: x["n"] for x in r for i in range(x["n"])}


def owned_by_seeds(r, config=DEFAULT):
    return tables.owners(r, tables.seed_edges(r, config), config)


def test_tables_grow_by_rounds(spark):
    r = regions(spark, ("Table", (100, 300, 500, 500)), ("Caption", (100, 280, 500, 290), "Table 1. a caption"), ("Text", (100, 262, 500, 272), "that goes on"), ("Text", (100, 244, 500, 254), "and on"), ("Text", (100, 10, 500, 20), "far"), ("Footnote", (100, 505, 500, 515), "Note: a"))
    owned = owned_by_seeds(r)
    got = sorted((x["region_id"], x["table_id"], x["round"]) for x in tables.grown(r, owned, keep=sinks.written).collect())
    assert got == [(2, 1, 0), (3, 1, 1), (4, 1, 2), (6, 1, 0)]
    t = tables.logical_tables(r, owned).first()
    assert (t["notes"], t["captions"], t["identifiers"], t["y0"], t["y1"], t["printed_label"]) == ([6], [2], [2], 280.0, 515.0, "Table 1")


def test_tables_grow_over_long_chains(spark):
    texts = [("Text", (100, 686 - 12 * i, 500, 696 - 12 * i), "x") for i in range(50)]
    r = regions(spark, ("Table", (100, 710, 500, 900)), ("Caption", (100, 698, 500, 708), "Table 1. a caption"), *texts)
    narrow = DEFAULT.__class__(table=DEFAULT.table.__class__(fragment_gap_ratio=0.005))
    got = sorted((x["region_id"], x["table_id"], x["round"]) for x in tables.grown(r, owned_by_seeds(r, narrow), narrow).collect())
    assert got == [(2, 1, 0), *((3 + i, 1, 1 + i) for i in range(50))]


def test_corridors_and_references_continue_a_caption(spark):
    r = regions(
        spark, ("Table", (300, 300, 700, 600)), ("Caption", (300, 200, 700, 215), "What this is about"), ("Text", (300, 240, 700, 290), "Anything here. It may be prose. And more of it."),
        ("Text", (180, 200, 295, 215), "Table 4"), ("Caption", (300, 610, 700, 625), "Fig. 2. other"), ("Text", (300, 291, 420, 299), "Fig. 3 in between"),
    )
    got = {x["region_id"]: (x["role"], x["identifier"], x["score"] == 10) for x in tables.context(r).collect()}
    assert got == {2: ("caption", False, False), 4: ("caption_fragment", True, False), 3: ("caption_fragment", False, True)}


def test_directions_that_are_stated_and_cross_keep_captions_apart(spark):
    r = regions(spark, ("Table", (300, 300, 700, 600)), ("Caption", (300, 270, 700, 285), "Table 1. a"), ("Caption", (300, 290, 500, 298), "of it"))
    way = F.when(F.col("region_id") == 3, 90.0).when(F.col("region_id") == 2, 0.0)
    assert {x["region_id"] for x in owned_by_seeds(r.withColumn("angle", way)).collect()} == {2}
    assert {x["region_id"] for x in owned_by_seeds(r).collect()} == {2, 3}


def stitch(*parts):
    """The tokens, those that the text so far ends with and the next part begins with once."""
    plain = lambda ts: [re.sub(r"\W+", "", t.casefold()) for t in ts]
    out = []
    for p in parts:
        k = next((k for k in range(min(len(out), len(p)), 0, -1) if plain(out)[-k:] == plain(p)[:k]), 0)
        out += p[k:]
    return out


@pytest.mark.parametrize("parts", [(["Table", "3"], ["table", "3.", "Stalk", "yield"]), (["a", "b"], ["b", "a", "b"], ["A,", "b", "c"]), ([], ["x"]), (["x"], []), (["a"], ["a"], ["a", "a"])])
def test_shared_tokens_stand_once(spark, parts):
    column = F.array(*[F.array(*[F.lit(t) for t in p]).cast("array<string>") for p in parts])
    assert value(spark, caption_groups.stitched(column)) == stitch(*parts)


def test_a_caption_is_put_together(spark):
    r = regions(
        spark, ("Table", (300, 300, 700, 600)), ("Caption", (300, 270, 700, 280), "Table 2. Yields of plots"), ("Text", (300, 282, 700, 292), "of plots, by year"), ("Text", (300, 294, 400, 299), "by year"),
    )
    t = tables.logical_tables(r, tables.context(r))
    g = caption_groups.groups(r, t).first()
    assert (g["ordered"], g["semantic"], g["text"], g["spans"], g["y0"], g["y1"]) == ([2, 3, 4], [2, 3], "Table 2 Yields of plots by year", False, 270.0, 299.0)
    got = {x["region_id"]: (x["resolved_type"], x["semantic_role"]) for x in caption_groups.annotated(r, caption_groups.groups(r, t)).collect()}
    assert got[2] == ("Caption", "table_caption_identifier") and got[3] == ("Caption", "table_caption_fragment") and got[1] == ("Table", None)


def decided(r):
    related = pairs.relationships(r)
    found = conflicts.conflict_pairs(related)
    trims = conflicts.boundary_trims(found)
    return related, trims, conflicts.text_policy(found, trims, r)


def test_a_surer_detection_of_one_place_stays(spark):
    r = regions(spark, ("Formula", (100, 200, 300, 260), "", 0.95), ("Text", (100, 200, 300, 261), "x", 0.5))
    related, trims, policy = decided(r)
    assert (policy.first()["action"], policy.first()["suppressed_id"]) == ("suppress_lower_confidence_detection", 2)
    assert [x["region_id"] for x in conflicts.applied(r, trims, policy).collect()] == ["1"]
    assert conflicts.settled(related, trims, policy).first()["kind"] == "CROSS_CLASS_DETECTION_SUPPRESSED"


def test_a_text_is_split_around_a_formula_between_its_lines(spark):
    r = regions(spark, ("Formula", (100, 200, 350, 230), ""), ("Text", (90, 150, 400, 300), "one\n\ntwo \nthree"))
    related, trims, policy = decided(r)
    assert policy.first()["action"] == "split_text_around_semantic_region"
    got = {x["region_id"]: (x["y0"], x["y1"], x["text"], x["page_order"]) for x in conflicts.applied(r, trims, policy).collect()}
    assert got == {"1": (200.0, 230.0, "", 2), "2": (150.0, 199.0, "one", 1), "2__formula_split_02": (231.0, 300.0, "two\nthree", 3)}
    one = regions(spark, ("Formula", (100, 200, 350, 230), ""), ("Text", (90, 150, 400, 300), "one line"))
    assert decided(one)[2].first()["reason"] == "text_payload_not_line_addressable"
    assert conflicts.conflict_states(conflicts.settled(related, trims, policy)).where("resolution_status = 'ambiguous'").count() == 0


def test_all_texts_move_a_formula_together(spark):
    r = regions(spark, ("Formula", (100, 200, 500, 300), ""), ("Text", (100, 150, 500, 220), "above"), ("Text", (100, 285, 500, 360), "below"))
    _, trims, _ = decided(r)
    assert {(x["edge"], x["new_y0"], x["new_y1"], x["action"]) for x in trims.collect()} == {("top", 221.0, 284.0, "trim_formula_boundary"), ("bottom", 221.0, 284.0, "trim_formula_boundary")}


def test_geometry_history_and_versions(spark):
    r = trace.initialized(regions(spark, ("Text", (0, 0, 10, 10), "x"), ("Text", (5, 5, 20, 20), "y")))
    moved = trace.change_geometry(r, Box(F.col("x0") + 1, F.col("y0"), F.col("x1"), F.col("y1")), F.col("region_id") == 1, "s", "r")
    got = {x["region_id"]: (x["x0"], x["geometry_version"], [h["accepted"] for h in x["geometry_history"]], x["source_box"]["x0"]) for x in moved.collect()}
    assert got == {1: (1.0, 2, [True, True], 0.0), 2: (5.0, 1, [True, False], 5.0)}
    with pytest.raises(ValueError, match="version"):
        trace.migrated(r, 2)
    with pytest.raises(Exception, match="unsupported"):
        trace.migrated(r.withColumn("schema_version", F.lit(9))).collect()


def test_snapshot_digest_ignores_order_and_sees_changes(spark):
    r = regions(spark, ("Text", (0, 0, 10, 10), "x"), ("Text", (5, 5, 20, 20), "y"))
    digest = lambda df: trace.snapshot("s", df).first()["digest"]
    assert digest(r) == digest(r.orderBy(F.desc("region_id"))) != digest(r.withColumn("x1", F.col("x1") + 1))


def test_angles(spark):
    assert value(spark, normal_angle(F.lit("-90"))) == 270.0 and value(spark, normal_angle(F.lit("x"))) is None
    assert value(spark, angle_distance(F.lit(350.0), F.lit(10.0))) == 20.0
    assert value(spark, parallel(F.lit(0.0), F.lit(175.0))) and value(spark, parallel(F.lit(0.0), F.lit(None).cast("double"))) is None
    assert value(spark, reliable_conflict(F.lit(0.0), F.lit(0.9), F.lit(90.0), F.lit(0.9)))
    box = Box(*map(F.lit, (0.0, 0.0, 10.0, 100.0)))
    assert value(spark, direction(F.lit(None).cast("double"), F.lit(None).cast("double"), box))["degrees"] == 90.0
    rot = box.rotated(F.lit(90.0))
    assert value(spark, F.round(rot.x1 - rot.x0, 6)) == 100.0


def test_points_to_pixels_flip_and_clip(spark):
    b = points_to_pixels(*map(F.lit, (10.0, 90.0, 50.0, 70.0, "BOTTOMLEFT", 100.0, 100.0, 1000.0, 1000.0)))
    assert value(spark, F.array(b.x0, b.y0, b.x1, b.y1)) == [100.0, 100.0, 500.0, 300.0]


def test_export_converts(spark, tmp_path):
    place = {"page_no": 1, "bbox": {"l": 10, "t": 10, "r": 50, "b": 30, "coord_origin": "TOPLEFT"}}
    doc = {"document_id": "d", "texts": [{"label": "section_header", "text": "", "orig": "H", "prov": [place]}, {"label": "odd_label", "text": "x", "prov": [{**place, "page_no": 9}, {**place, "bbox": {**place["bbox"], "r": 10}}]}], "pictures": [{"label": "chart", "prov": [place]}], "pages": [{"page_number": 1, "page_width_pt": 100, "page_height_pt": 100, "image_width_px": 1000, "image_height_px": 1000}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    r, counts = adapters.convert_export(adapters.read_export(spark, str(tmp_path / "x.json")))
    assert [(x["region_id"], x["type"], x["text"], x["x1"]) for x in r.orderBy("src_order").collect()] == [("p0001_d000000_01", "Section-header", "H", 500.0), ("p0001_d000002_01", "Figure", None, 500.0)]
    c = counts.first()
    assert (c["items"], c["places"], c["skipped_page"], c["skipped_geometry"]) == (3, 4, 1, 1)


def test_artifacts_are_listed_and_checked(spark, tmp_path):
    path = str(tmp_path / "run")
    sinks.write_artifacts({"regions": regions(spark, ("Text", (0, 0, 9, 9), "x"))}, path)
    assert (tmp_path / "run" / "_SUCCESS_RUN").exists()
    assert sinks.validate_artifacts(spark, path).count() == 0
    part = next((tmp_path / "run" / "regions").glob("*.parquet"))
    part.rename(part.with_name("part-x.parquet"))
    assert sorted(x["issue"] for x in sinks.validate_artifacts(spark, path).collect()) == ["missing", "unlisted"]


def test_redaction(spark):
    df = spark.createDataFrame([("secret text", "/a/b", ("t", "k"), "see ftp://me:pw@host/x")], "text string, source_path string, n struct<orig:string,api_key:string>, note string")
    r = sinks.redact(df).first()
    assert r.asDict(True) == {"text": "<redacted>", "n": {"orig": "<redacted>", "api_key": "<redacted>"}, "note": "see ftp://<redacted>@host/x"}


def test_bounded_json(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sinks.bounded_json(spark, str(p), "a int").count() == 2
    with pytest.raises(ValueError, match="rows"):
        sinks.bounded_json(spark, str(p), "a int", max_rows=1)
    with pytest.raises(Exception, match="too long"):
        sinks.bounded_json(spark, str(p), "a int", max_line_bytes=3).collect()


def test_configuration():
    c = DEFAULT.with_options(caption={"accept": 0.5})
    assert c.caption.accept == 0.5 and DEFAULT.caption.accept == 0.35
    assert sinks.config_digest(c) != sinks.config_digest(DEFAULT)
    for bad in ({"captions": {}}, {"caption": {"nope": 1}}, {"caption": {"max_gap_ratio": 2}}):
        with pytest.raises(ValueError):
            DEFAULT.with_options(**bad)


def test_pipeline_keeps_its_invariants(spark):
    r = regions(spark, ("Title", (50, 200, 950, 230), "A title of words"), ("Text", (50, 100, 300, 110), "before title"), ("Figure", (100, 400, 400, 600)), ("Caption", (100, 605, 400, 620), "Figure 1. x"), ("Text", (150, 450, 200, 460), "axis"), ("Table", (500, 400, 900, 600)), ("Footnote", (500, 605, 900, 615), "Note: y"))
    seen = []
    out = pipeline.run(r, control=pipeline.Run(on_event=seen.append), keep=sinks.written)
    assert {x["region_id"] for x in out.excluded.collect()} == {2}
    assert trace.partition(r, out.regions, out.excluded).first()["holds"]
    assert {x["caption_id"]: x["parent_id"] for x in out.captions.collect()} == {4: 3}
    assert {x["child_id"]: x["accepted_parent_id"] for x in out.hierarchy.collect()}[5] == 3
    assert out.tables.first()["notes"] == [7]
    assert out.trace.count() == 5 and out.status == "complete"
    names = [e["stage"] for e in seen]
    assert views.invariants(out, r).first()["holds"] and views.nested(out).count() == 1 and views.formula_candidates(out).isEmpty()
    assert views.page_records(out).first()["counts"]["Table"] == 1 and views.exclusions(out, "page1_upper_before_title").count() == 1
    assert [(x["region_id"], x["ordinal"]) for x in views.table_associations(out).collect()] == [(7, 1)] and views.semantic_captions(out).isEmpty()
    assert names.index("filters") < names.index("overlaps") < names.index("hierarchy") < names.index("tables") < names.index("caption_groups")


def test_documents_with_equal_ids_stay_apart(spark):
    """A caption associated in one document protects nothing in another; graph checks and neighbours take string ids."""
    rows = [("Figure", (100, 100, 500, 500)), ("Caption", (110, 490, 490, 510), "Figure 1. x"), ("Formula", (600, 300, 800, 330)), ("Text", (600, 200, 800, 250), "above"), ("Text", (600, 400, 800, 450), "below")]
    one = regions(spark, *rows).withColumn("region_id", F.concat(F.lit("r"), F.col("region_id").cast("string")))
    inside = F.col("region_id") == "r2"
    two = one.withColumn("doc_id", F.lit("e")).withColumn("y0", F.when(inside, 300.0).otherwise(F.col("y0"))).withColumn("y1", F.when(inside, 320.0).otherwise(F.col("y1")))
    both = one.unionByName(two)
    out = pipeline.run(both, keep=sinks.written)
    assert {(x["doc_id"], x["child_id"]) for x in out.hierarchy.where("accepted_parent_id IS NOT NULL").collect()} == {("e", "r2")}
    assert {(x["doc_id"], x["above_id"], x["below_id"]) for x in captions.text_neighbours(both).collect()} == {("d", "r4", "r5"), ("e", "r4", "r5")}
    edges = spark.createDataFrame([("d", "r1", "r2", "k", "s"), ("e", "r1", "r9", "k", "s"), ("e", "r2", "r1", "k", "s")], "doc_id string, left_id string, right_id string, kind string, status string")
    assert [(x["doc_id"], x["issue"], x["subject"]) for x in hierarchy.integrity(both, edges).collect()] == [("e", "missing_endpoint", "r9")]


def test_a_stage_that_fails_in_execution_falls_back(spark):
    r = regions(spark, ("Text", (0, 0, 10, 10), "x"))
    run = pipeline.Run(strict=False, keep=sinks.written)
    bad = r.withColumn("text", F.raise_error(F.lit("broken row")))
    assert run.stage("s", lambda: bad, lambda: r).count() == 1
    assert run.issues[0]["stage"] == "s" and pipeline.status_of(run.issues) == "partial"
    pages = spark.range(100).selectExpr("'d' AS doc_id", "id AS page_number")
    assert run.check_pages(pages.where("page_number < 3"), pages) == 3 and len(run.issues) == 1
    run.check_pages(pages.where("page_number < 4"), pages)
    assert pipeline.status_of(run.issues) == "failed"
    with pytest.raises(pipeline.BudgetExceeded):
        pipeline.Run().check_pages(pages, pages)


def test_stage_failures_fall_back_or_raise():
    def broken():
        raise KeyError("x")

    class Frame:
        schema = None

    with pytest.raises(KeyError):
        pipeline.Run().stage("s", broken, Frame)
    run = pipeline.Run(strict=False, on_event=lambda e: 1 / 0)
    assert isinstance(run.stage("s", broken, Frame), Frame)
    assert [i["severity"] for i in run.issues] == ["error", "warning"]
    with pytest.raises(pipeline.Cancelled):
        pipeline.Run(cancelled=lambda: True).stage("s", Frame)


def test_batches_isolate_a_broken_sink(spark, tmp_path):
    s = events.stream(spark, "/root/testdata/sf0.001/events.parquet")
    failures = events.into_batches(s, lambda df, n: 1 / 0, str(tmp_path / "c"), mode="append")
    assert failures and "ZeroDivisionError" in failures[0][1]
    kept = spark.read.parquet(str(tmp_path / "c-dead-letters"))
    assert kept.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_image_kernels(spark):
    im = np.full((40, 60), 255, np.uint8)
    im[5:15, 5:20] = 0
    im[5:15, 40:50] = 0
    im[30:35, 5:50] = 0
    assert images.components(im, (0, 0, 60, 40)) == [(5, 5, 20, 15), (40, 5, 50, 15), (5, 30, 50, 35)]
    assert images.ink(im, (5, 5, 20, 15)) == 1.0 and images.ink(im, (9, 9, 9, 9)) == 0.0
    assert images.valley(im, (0, 0, 60, 20), 1) == (20, 40)
    assert [b[:4] for b in images.connected(im < 246)] == [(5, 5, 20, 15), (5, 30, 50, 35), (40, 5, 50, 15)]
    assert images.bridge(im < 246, (5, 5, 20, 15), (40, 5, 50, 15)) == 0.0
    df = spark.createDataFrame([(im.tobytes(), 60, 40, 5.0, 5.0, 20.0, 15.0)], "p binary, w int, h int, x0 double, y0 double, x1 double, y1 double")
    r = df.select(images.ink_ratio("p", "w", "h", "x0", "y0", "x1", "y1").alias("r"), images.ink_components("p", "w", "h", F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(40.0)).alias("c")).first()
    assert r["r"] == 1.0 and len(r["c"]) == 3


def test_command_line_runs_validates_and_compares(spark, tmp_path):
    from quire.__main__ import main

    place = lambda l, t, r, b: {"page_no": 1, "bbox": {"l": l, "t": t, "r": r, "b": b, "coord_origin": "TOPLEFT"}}
    doc = {"document_id": "d", "texts": [{"label": "title", "text": "A title here", "prov": [place(5, 20, 95, 23)]}, {"label": "caption", "text": "Figure 1. x", "prov": [place(10, 62, 40, 64)]}], "pictures": [{"label": "chart", "prov": [place(10, 40, 40, 61)]}], "pages": [{"page_number": 1, "page_width_pt": 100, "page_height_pt": 100, "image_width_px": 1000, "image_height_px": 1000}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    a = str(tmp_path / "a")
    assert main(["run", str(tmp_path / "x.json"), a], spark) == 0
    assert main(["validate", a], spark) == 0 and main(["validate", str(tmp_path / "none")], spark) == 7
    assert main(["compare", a, a], spark) == 0
    assert main(["run", str(tmp_path / "x.json"), a, "--set", "caption.nope=1"], spark) == 2
    assert main(["run", str(tmp_path / "missing.json"), a], spark) == 3
    assert main(["config"]) == 0


def test_completion_respects_columns(spark):
    from quire.operators import completion

    body = "long text " * 10
    r = regions(spark, ("Figure", (50, 100, 450, 300)), ("Text", (50, 400, 450, 500), body), ("Text", (520, 400, 950, 500), body))
    p = r.where("type = 'Figure'").selectExpr("doc_id", "page_number", "region_id", "9.0 AS assignment", "50.0 AS n_x0", "100.0 AS n_y0", "800.0 AS n_x1", "300.0 AS n_y1")
    d = completion.decisions(r, p).first()
    assert (d["decision"], d["reason"], d["x1"]) == ("rejected_barrier_crossing", "proposal_crosses_column_gutter", 450.0)


def test_paths_of_manifests_stay_under_their_root():
    assert runs.confined("s3://b/run/", "regions/part-0.parquet") == "s3://b/run/regions/part-0.parquet"
    for bad in ("", "/etc/passwd", "a/../b", "./a", "a//b", "c:\\x", "hdfs://x/y", "a\x00b", "..\\x", None):
        with pytest.raises(runs.PathError):
            runs.confined("/r", bad)


def test_runs_leave_records(spark, tmp_path):
    at = str(tmp_path)
    context = runs.RunContext("r1", "d", "s", "c")
    recorder = runs.Recorder(context, sink=lambda e: 1 / 0)
    tokens = runs.bind(recorder, lambda: (_ for _ in ()).throw(pipeline.Cancelled("now")))
    assert runs.current() is recorder
    with pytest.raises(pipeline.Cancelled):
        runs.check_cancelled()
    runs.reset(tokens)
    assert runs.current() is None and runs.check_cancelled() is None
    assert recorder.emit("stage", api_key="x")["sink_error"] == "ZeroDivisionError" and recorder.events[0]["api_key"] == sinks.REDACTED
    recorder.persist(spark, f"{at}/events.jsonl")
    assert sinks.bounded_json(spark, f"{at}/events.jsonl", "run_id string, event string").first()["event"] == "stage"
    runs.write_failure(spark, at, context, ValueError("quotes a document"))
    assert "quotes" not in runs.read_text(spark, f"{at}/run_failure.json") and runs.read_text(spark, f"{at}/none") is None
    r = regions(spark, ("Text", (0, 0, 10, 10), "x"))
    sinks.write_artifacts({"regions": r}, f"{at}/run")
    runs.record_run(spark, f"{at}/run", "abc", DEFAULT, "complete")
    assert runs.mark_validated(spark, f"{at}/run") and runs.resumable(spark, f"{at}/run", "abc", DEFAULT)["run_status"] == "complete"
    for sha, config in (("other", DEFAULT), ("abc", DEFAULT.with_options(caption={"accept": 0.5}))):
        with pytest.raises(ValueError):
            runs.resumable(spark, f"{at}/run", sha, config)
    shots = trace.snapshot("source", r)
    assert runs.update_golden(spark, f"{at}/golden.json", shots, "f", "first", True)["previous"] is None
    assert runs.update_golden(spark, f"{at}/golden.json", shots, "f", "again", True)["previous"]["reason"] == "first"
    with pytest.raises(ValueError):
        runs.update_golden(spark, f"{at}/golden.json", shots, "f", "bad", False)
    found = runs.doctor(spark, DEFAULT, at, least_free_mb=1, needed=("pyspark", "no-such-package"))
    assert [c["name"] for c in found["checks"] if c["status"] == "fail"] == ["no-such-package"]
    assert runs.environment(spark, DEFAULT)["environment_sha256"] == runs.environment(spark, DEFAULT)["environment_sha256"]
    assert runs.inputs(spark, f"{at}/golden.json").first()["document_id"].startswith("golden__") and runs.folder_mb(spark, at) > 0
    assert [runs.sensitivity(n) for n in ("raw_text", "trace", "config", "regions")] == ["raw_sensitive", "operational_metadata", "secret_redacted", "derived_sensitive"]


def test_pages_without_a_seed_stay_out_of_a_tables_context(spark):
    """Only regions around tables are carried on and compared; what tables own is the same, whichever way relationships come."""
    around = [("Table", (300, 300, 700, 600)), ("Caption", (300, 270, 700, 280), "Table 2. Yields of plots"), ("Text", (300, 282, 700, 292), "of plots, by year"), ("Text", (300, 294, 400, 299), "by year")]
    every = regions(spark, *around).unionByName(regions(spark, *around[1:], page=2)).unionByName(regions(spark, around[0], ("Text", (0, 0, 90, 10), "far"), page=3))
    asked = []

    def found(near):
        asked.append({x["page_number"] for x in near.collect()})
        return pairs.relationships(near)

    near, owned = tables.surrounded(every, related=found)
    rows = lambda df: sorted(map(str, df.collect()))
    assert asked == [{1}] and near.count() == 4 and owned.count() == 3
    assert rows(owned) == rows(tables.context(every, related=pairs.relationships(every)))


def test_frames_by_page_join_without_a_shuffle(spark):
    r = regions(spark, ("Text", (0, 0, 10, 10), "x"), ("Text", (0, 20, 10, 30), "y"))
    with sinks.in_place(spark):
        kept = sinks.paged(r)
        plan = order.reading_order(kept.join(sinks.paged(r.select("doc_id", "page_number", "region_id")).hint("merge"), ["doc_id", "page_number", "region_id"]))
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 2
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_columns_of_regions_without_a_page_are_single(spark):
    r = regions(spark, ("Text", (0, 0, 200, 10), "x"), ("Text", (700, 0, 900, 10), "y"))
    lost = r.withColumn("doc_id", F.lit(None).cast("string"))
    assert {x["reading_column"] for x in order.reading_order(lost).collect()} == {"single"}
    assert {x["reading_column"] for x in order.reading_order(r).collect()} == {"left", "right"}


def test_stages_use_what_earlier_ones_found(spark, monkeypatch):
    """Rules of exclusion are gone through once, and captions are associated once; by page too, each region comes out once."""
    r = regions(spark, ("Title", (50, 200, 950, 230), "A title of words"), ("Text", (50, 100, 300, 110), "before title"), ("Figure", (100, 400, 400, 600)), ("Caption", (100, 605, 400, 620), "Figure 1. x"))
    calls, associations, frames = [], captions.associations, []
    monkeypatch.setattr(pipeline.captions, "associations", lambda *a: calls.append(a) or associations(*a))

    def keep(df):
        frames.append((set(df.columns), df._jdf.queryExecution().analyzed().toString()))
        return sinks.paged(df)

    with sinks.in_place(spark):
        out = pipeline.run(sinks.paged(r), keep=keep)
    assert len(calls) == 1 and {x["caption_id"]: x["parent_id"] for x in out.captions.collect()} == {4: 3}
    assert sum("page1_upper_before_title" in plan for _, plan in frames) == 1
    assert views.invariants(out, r).first().asDict() == {"doc_id": "d", "inputs": 4, "lost": 0, "invented": 0, "repeated": 0, "holds": True}


def test_members_of_captions_are_told_from_the_regions_around_tables(spark):
    from quire.plans import catalogue_tables

    data = "/root/testdata/sf0.001"
    near, grouped = catalogue_tables._groups(spark, data)
    tabled = adapters.lineitem_regions(spark, data).where("type = 'Table'").select("page_number").distinct().count()
    assert 0 < near.select("page_number").distinct().count() < tabled
    told = {x["region_id"] for x in caption_groups.annotated(near, grouped).where("parent_table_id IS NOT NULL").collect()}
    assert told == {i for x in grouped.collect() for i in x["ordered"]}


def test_texts_are_gone_into_only_near_a_table_and_near_each_other(spark):
    """Pages without a text near a table go by their boxes; relationships are found among near texts alone; members need no caption put together."""
    around = [("Table", (300, 300, 700, 600)), ("Caption", (300, 270, 700, 280), "Table 2. Yields of plots"), ("Text", (300, 282, 700, 292), "of plots, by year"), ("Text", (0, 900, 90, 910), "far"), ("Footnote", (300, 605, 700, 615), "Note: a")]
    far = regions(spark, around[0], around[3], page=2).unionByName(regions(spark, *around[1:], page=3))
    noted = regions(spark, around[0], around[4], page=4)
    r = regions(spark, *around).unionByName(far).unionByName(noted)
    assert {x["page_number"] for x in tables.beside(r).collect()} == {1, 4}
    asked = []

    def found(ends):
        asked.extend((x["page_number"], x["region_id"]) for x in ends.collect())
        return pairs.relationships(ends)

    near, owned = tables.surrounded(r, related=found, role="caption")
    assert sorted(asked) == [(1, 2), (1, 3)] and {x["page_number"] for x in near.collect()} == {1}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(owned) == rows(tables.context(r, related=pairs.relationships(r)).where("page_number = 1"))
    marked = caption_groups.annotated(near, caption_groups.groups(near, tables.logical_tables(near, owned))).where("parent_table_id IS NOT NULL")
    got = caption_groups.members(owned)
    assert got.count() == 2 and rows(got) == rows(marked.select(*got.columns))


def test_members_of_captions_equal_those_put_together(spark):
    from quire.plans import catalogue_tables

    data = "/root/testdata/sf0.001"
    near, grouped = catalogue_tables._groups(spark, data)
    marked = caption_groups.annotated(near, grouped).where("parent_table_id IS NOT NULL").select("region_id", "parent_table_id", "semantic_role")
    rows = lambda df: sorted(map(str, df.collect()))
    assert 0 < marked.count() and rows(marked) == rows(catalogue_tables.caption_members(spark, data))
