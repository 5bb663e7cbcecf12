"""Text scalars as Column builders: normal forms, signatures, caption references, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"


def collapsed(text: Column, orig: Column | None = None) -> Column:
    """The text, or where it is empty the original, with single spaces."""
    t = F.nullif(text, F.lit("")) if orig is None else F.coalesce(F.nullif(text, F.lit("")), orig)
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\s\p{Z}]+", " "))


def folded(text: Column) -> Column:
    """Lower case, with the one folding that lower case lacks in these languages."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized(text: Column, orig: Column | None = None) -> Column:
    return F.trim(F.regexp_replace(folded(collapsed(text, orig)), NOT_WORD, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalized(text), " "), lambda x: x != "")


def relation(a: Column, b: Column) -> Column:
    """How two normal texts relate; substrings count, words need not be whole."""
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "unavailable")
        .when(a == b, "equal")
        .when(F.contains(b, a), "a_in_b")
        .when(F.contains(a, b), "b_in_a")
        .otherwise("different")
    )


def header_signature(text: Column) -> Column:
    """Lower case, digits as #, what is no word as a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "), r"\d+", "#"))


def footer_signature(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\p{Z}]+")), F.lit(0))


# References to assets, alone or in prose. A look-ahead for a space or the end is a last group here.
LEADING_NOISE = r"^[\s•▪●|_]+"
REFERENCE = r"(?i)^((?:(?:supplementary|supplemental|extended\s+data)\s+)?(fig(?:ure)?\.?|table|tab\.?|equation|eq\.?|algorithm|listing)\s*((?:[A-Z]\s*[.\-]?\s*)?\d+(?:\s*[.\-]\s*\d+)?|[IVXLCDM]+|[A-Z]))(?:\s*[:.\-])?(\s|$)"
OCR_TABLE = r"(?i)^((?:supplementary\s+|supplemental\s+)?(ta\s*b\s*[1il]\s*e)\s*((?:[A-Z]\s*)?\d+|[IVXLCDM]+))(?:\s*[:.\-])?(\s|$)"
PROSE_LEAD = r"(?i)\b(?:as\s+shown\s+in|shown\s+in|reported\s+in|according\s+to|results?\s+from|values?\s+in|compared\s+(?:with|in)|see)\s+$"
PLURAL_TABLES = r"(?i)\btables?\s+\w+\s+(?:and|to|[-–])\s+\w+"
IN_PARENTHESES = r"(?i)\([^)]*\btable\b[^)]*\)"
TABLE_MENTION = r"\b((?:(?:supplementary|supplemental)\s+)?(?:table|tab\.?)\s*((?:[A-Z]\s*[.\-]?\s*)?\d+(?:\s*[.\-]\s*\d+)?|[IVXLCDM]+|[A-Z]))\b"
NOTE_CONTINUATION = r"(?i)^(?:see\s+table\b|means?\s+(?:within|followed)\b|values?\s+in\s+parentheses\b|notes?\s*:|sources?\s*:)"
BARE_TABLE = r"(?i)^((?:(?:supplementary|supplemental|extended\s+data)\s+)?(?:table|tab\.?))(\s|$)"
KINDS = {"fig": "figure", "figure": "figure", "tab": "table", "table": "table", "eq": "equation", "equation": "equation", "algorithm": "algorithm", "listing": "listing"}


def caption_text(text: Column) -> Column:
    """Spaces and dashes in one form. Compatibility forms are taken by quire.functions.unicode.compatible first."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " –—", " --"), r"[\s\p{Z}]+", " "))


def caption_reference(text: Column, ocr: bool = False) -> Column:
    """Struct of what a reference that leads the text says; null if none does. ocr: takes misread forms of "Table" too.

    start and end are characters of the text in caption form; suffix is what follows.
    """
    full = caption_text(text)
    clean = F.regexp_replace(full, LEADING_NOISE, "")
    offset = F.length(full) - F.length(clean)

    def found(pattern: str, misread: bool) -> Column:
        raw = F.rtrim(F.lower(F.regexp_extract(clean, pattern, 2)), F.lit("."))
        kind = F.lit("table") if misread else F.coalesce(*[F.when(raw == k, v) for k, v in KINDS.items()])
        end = F.length(F.regexp_extract(clean, pattern, 0)) - F.length(F.regexp_extract(clean, pattern, 4))
        return F.when(
            raw != "",
            F.struct(
                kind.alias("kind"),
                F.trim(F.regexp_extract(clean, pattern, 1)).alias("label"),
                F.regexp_replace(F.regexp_extract(clean, pattern, 3), r"\s+", "").alias("number"),
                offset.alias("start"),
                (offset + end).alias("end"),
                F.when(offset == 0, "leading").otherwise("near_leading").alias("position"),
                F.lit(0.86).alias("confidence") if misread else F.when(offset == 0, F.lit(1.0)).otherwise(F.lit(0.94)).alias("confidence"),
                F.lit(misread).alias("ocr_tolerant"),
                F.regexp_replace(F.substr(clean, end + 1), r"^[ .:\-]+", "").alias("suffix"),
            ),
        )

    return F.coalesce(found(REFERENCE, False), found(OCR_TABLE, True)) if ocr else found(REFERENCE, False)


OF_TABLE = REFERENCE.replace(r"fig(?:ure)?\.?|table|tab\.?|equation|eq\.?|algorithm|listing", r"table|tab\.?")


def leads_with_reference(text: Column) -> Column:
    """Whether a reference to any asset leads the text: caption_reference() without its parts."""
    return F.regexp_replace(caption_text(text), LEADING_NOISE, "").rlike(REFERENCE)


def names_table(text: Column, ocr: bool = False) -> Column:
    """Whether a reference to a table leads the text."""
    clean = F.regexp_replace(caption_text(text), LEADING_NOISE, "")
    return clean.rlike(OF_TABLE) | clean.rlike(OCR_TABLE) if ocr else clean.rlike(OF_TABLE)


def names_other(text: Column) -> Column:
    """Whether a reference to another asset than a table leads the text."""
    return leads_with_reference(text) & ~names_table(text)


def mentions_table(text: Column) -> Column:
    """Whether one table is mentioned anywhere: table_mention() without its parts."""
    t = caption_text(text)
    return t.rlike(f"(?i){TABLE_MENTION}") & ~t.rlike(PLURAL_TABLES)


def reference_reasons(reference: Column) -> Column:
    """What speaks against a reference as a caption's: a lower-case letter as number, a note, another mention at once."""
    number, suffix = reference["number"], reference["suffix"]
    again = F.length(F.regexp_extract(suffix, rf"(?i)^(?:.{{0,8}}?)(?:{TABLE_MENTION})", 0)) > 0
    return F.array_compact(
        F.array(
            F.when((F.length(number) == 1) & number.rlike(r"^\p{Ll}$"), "lowercase_single_letter_identifier"),
            F.when(suffix.rlike(NOTE_CONTINUATION), "table_note_continuation"),
            F.when(again, "immediate_trailing_table_reference"),
        )
    )


_COSTS = {"lowercase_single_letter_identifier": 0.35, "table_note_continuation": 0.75, "immediate_trailing_table_reference": 0.55}


def reference_score(reference: Column) -> Column:
    """Confidence less what the reasons cost."""
    reasons = reference_reasons(reference)
    out = reference["confidence"]
    for reason, cost in _COSTS.items():
        out = out - F.when(F.array_contains(reasons, reason), cost).otherwise(0.0)
    return out


def authoritative(reference: Column) -> Column:
    return F.coalesce(reference_score(reference) >= 0.55, F.lit(False))


def bare_table_label(text: Column) -> Column:
    """The label of a text that leads with a bare "Table"; null if a whole reference leads it."""
    return F.when(caption_reference(text).isNull(), F.nullif(F.regexp_extract(caption_text(text), BARE_TABLE, 1), F.lit("")))


def table_mention(text: Column) -> Column:
    """Struct of the first mention of one table anywhere in the text; null without any, or where tables are told in the plural."""
    t = caption_text(text)
    label = F.regexp_extract(t, f"(?i){TABLE_MENTION}", 1)
    start = F.length(F.regexp_extract(t, f"(?i)^(.*?){TABLE_MENTION}", 1))
    return F.when(
        (label != "") & ~t.rlike(PLURAL_TABLES),
        F.struct(
            F.trim(label).alias("label"),
            F.regexp_replace(F.regexp_extract(t, f"(?i){TABLE_MENTION}", 2), r"\s+", "").alias("number"),
            start.alias("start"),
            (start + F.length(label)).alias("end"),
            F.when(start == 0, "leading").otherwise("embedded").alias("position"),
            F.when(start == 0, F.lit(1.0)).otherwise(F.lit(0.72)).alias("confidence"),
        ),
    )


def fragmented_table_reference(texts: Column, ocr: bool = False) -> Column:
    """The reference to a table that a list of neighbouring texts gives when joined; null if none."""
    reference = caption_reference(F.array_join(F.transform(texts, lambda x: F.coalesce(x, F.lit(""))), " "), ocr)
    return F.when(reference["kind"] == "table", reference)


def prose_evidence(text: Column) -> Column:
    """Reasons why a text rather discusses a table than captions one."""
    t = caption_text(text)
    before = F.regexp_extract(t, r"(?i)^(.*?)\btables?\b", 1)
    embedded = F.trim(before) != ""
    return F.array_compact(
        F.array(
            F.when(embedded, "identifier_embedded_in_prose"),
            F.when(embedded & before.rlike(PROSE_LEAD), "cross_reference_lead_in"),
            F.when(t.rlike(PLURAL_TABLES), "plural_table_reference"),
            F.when(t.rlike(IN_PARENTHESES), "parenthetical_reference"),
        )
    )


# Headings of sections behind the conclusion, by category, in order of precedence.
SECTIONS = (
    ("references", r"(?i)^(references|bibliography)$"),
    ("acknowledgements", r"(?i)^(acknowledg(e)?ments?)$"),
    ("declarations", r"(?i)^(declarations?|conflict(s)? of interest|competing interests?)$"),
    ("appendices", r"(?i)^(appendix|appendices)(\b|\s+[a-z0-9])"),
    ("supplementary_sections", r"(?i)^(supplementary|supporting)\s+(material|information|data)"),
)


def section_category(text: Column) -> Column:
    t = F.rtrim(collapsed(text), F.lit(":."))
    return F.coalesce(*[F.when(t.rlike(p), name) for name, p in SECTIONS])


def upper_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def safe_name(text: Column) -> Column:
    """For file names: runs of anything but letters, digits, dot, underscore and dash become one underscore."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("document"))
