"""Metadata of a first page: field labels, the values that follow them, and the heading over them.

A label's values depend on what labels above it have claimed, so a page is one ordered scan. Pages are independent and bounded
by what stands on one; partitions hand their pages to the scan as Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.pairs import KEY
from quire.plans.config import DEFAULT, Config

# Families of field labels in order of precedence, headings of the body, types of values and headings.
FAMILIES = (
    ("administrative_history", r"^\s*(?:(?:article|manuscript|publication|submission)\s+)?(?:history|information|details?|record|timeline)\s*:?.*$"),
    ("scientific_descriptors", r"^\s*(?:key\s*words?|index\s+terms?|subject\s+(?:terms?|areas?)|topic\s+(?:terms?|areas?)|classification\s+(?:codes?|terms?))\s*:?.*$"),
    ("classification", r"^\s*(?:classification|categories|subject\s+classification|jel|msc|pacs)\s*(?:codes?)?\s*:?.*$"),
    ("abbreviations", r"^\s*(?:abbreviations?|acronyms?|nomenclature)\s*:?.*$"),
    ("highlights", r"^\s*(?:highlights?|key\s+points?|key\s+messages?)\s*:?.*$"),
    ("correspondence", r"^\s*(?:correspond(?:ing|ence)|contact|author\s+information|address\s+for\s+correspondence)\s*:?.*$"),
    ("identifiers", r"^\s*(?:doi|article\s+(?:number|id)|identifier)\s*:?.*$"),
)
BOUNDARY = r"^\s*(?:(?:section\s+)?(?:\d+(?:\.\d+)*|[ivxlcdm]+)[\s.)\-:]*)?(abstract|summary|introduction|background|methods?|results?|discussion|conclusions?|references?)\b"
VALUES = {"Text", "List", "Field-item", "Field-value", "Key-value"}
HEADINGS = {"Caption", "Section-header", "Title", "Text", "Field-heading"}
STYLED = {"Caption", "Section-header", "Field-heading"}

_FAMILIES = [(name, re.compile(p, re.IGNORECASE)) for name, p in FAMILIES]
_BOUNDARY = re.compile(BOUNDARY, re.IGNORECASE)


def family(text: str) -> str | None:
    """The family of a compact label; None for more than eight words or a hundred characters, or no match."""
    if not text or len(text) > 100 or len(text.split()) > 8:
        return None
    return next((name for name, p in _FAMILIES if p.fullmatch(text)), None)


def parts(text: str | None) -> tuple[str, str, str] | None:
    """family, label and value of a region: by its first line, by a colon, or as a whole."""
    raw = (text or "").strip()
    lines = [x.strip() for x in raw.splitlines() if x.strip()]
    flat = " ".join(raw.split())
    forms = [(lines[0], "\n".join(lines[1:]))] if len(lines) > 1 else []
    if ":" in flat:
        label, _, value = flat.partition(":")
        forms.append((f"{label.strip()}:", value.strip()))
    for label, value in [*forms, (flat, "")]:
        if f := family(label):
            return f, label, value
    return None


def prose(text: str) -> bool:
    n = len(text.split())
    return n >= 34 or n >= 18 and re.search(r"[.!?](?:\s|$)", text) is not None


def heading_words(text: str) -> int:
    """Words of a heading; one for letters set apart."""
    words = text.split()
    spelt = [w for w in words if w.isalpha()]
    return 1 if spelt and sum(len(w) == 1 for w in spelt) >= 0.7 * len(spelt) else len(words)


def heading_style(kind: str, text: str) -> bool:
    """A type of heading, or four fifths of the letters in upper case."""
    letters = [c for c in text if c.isalpha()]
    return kind in STYLED or bool(letters) and sum(map(str.isupper, letters)) >= 0.8 * len(letters)


@dataclass
class Row:
    """A region of a page as the scan sees it."""

    id: object
    kind: str
    x0: float
    y0: float
    x1: float
    y1: float
    raw: str
    text: str = ""
    parts: tuple[str, str, str] | None = None
    stop: bool = False

    def __post_init__(self):
        self.text = " ".join(self.raw.split())
        self.parts = parts(self.raw)
        self.stop = self.parts is not None or _BOUNDARY.match(self.text) is not None


@dataclass
class Field:
    label: Row
    category: str
    inline: bool
    members: list[Row] = field(default_factory=list)


def aligned(a: Row, b: Row, width: float, c) -> bool:
    """Over each other by enough of the narrower one, or beginning at one left edge."""
    narrow = max(min(a.x1 - a.x0, b.x1 - b.x0), 1.0)
    return max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) / narrow >= c.metadata_overlap or abs(a.x0 - b.x0) / max(width, 1.0) <= c.metadata_left_ratio


def scan(rows: list[Row], width: float, height: float, config: Config = DEFAULT) -> tuple[list[Field], Row | None]:
    """The populated fields of a page, rows in the order of (y0, x0), and the heading over them if there is one.

    A label's values follow below it while they are close (by the line height so far), aligned with it or the value before,
    no prose and unclaimed; another label or a heading of the body in its column ends it, one elsewhere is passed over.
    """
    c = config.filters
    fields, claimed = [], set()
    for i, r in enumerate(rows):
        if not r.parts or r.kind not in HEADINGS or r.y0 / height > c.body_anchor_y or prose(r.text):
            continue
        fields.append((i, Field(r, r.parts[0], bool(r.parts[2]))))
    for i, f in fields:
        last, line = f.label, max(f.label.y1 - f.label.y0, 1.0)
        if f.inline:
            f.members.append(f.label)
            claimed.add(f.label.id)
        for r in rows[i + 1 :]:
            if r.stop:
                if aligned(f.label, r, width, c):
                    break
                continue
            if r.kind not in VALUES or r.id in claimed:
                continue
            reach = min(c.metadata_max_gap_ratio * height, max(c.metadata_min_gap_ratio * height, 2.5 * line))
            if max(0.0, r.y0 - last.y1) > reach or not (aligned(f.label, r, width, c) or aligned(last, r, width, c)) or prose(r.text):
                break
            f.members.append(r)
            claimed.add(r.id)
            last, line = r, (line + max(r.y1 - r.y0, 1.0)) / 2
    full = [f for _, f in fields if f.members]
    if len(full) < c.metadata_fields:
        return full, None
    first = full[0].label
    for r in reversed(rows[: next(i for i, f in fields if f.members)]):
        if max(0.0, first.y0 - r.y1) / height > c.metadata_heading_gap_ratio:
            break
        if r.kind in HEADINGS and 0 < heading_words(r.text) <= c.metadata_heading_words and not prose(r.text) and not r.parts and heading_style(r.kind, r.text) and aligned(r, first, width, c):
            return full, r
    return full, None


def _rows(page: pd.DataFrame) -> list[Row]:
    page = page.sort_values(["y0", "x0", "src_order"], kind="stable")
    return [Row(*x) for x in zip(page["region_id"].tolist(), page["type"].tolist(), *(page[k].tolist() for k in ("x0", "y0", "x1", "y1")), (t or "" for t in page["text"]))]


def _pages(batches: Iterator[pd.DataFrame], found) -> Iterator[pd.DataFrame]:
    """Rows come by page; a page may go on in the next batch."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        number = b.groupby(KEY, sort=False, dropna=False).ngroup()
        last = number == number.iloc[-1]
        held = b[last]
        for _, page in b[~last].groupby(number[~last], sort=False):
            yield found(page)
    if held is not None and len(held):
        yield found(held)


def _scanned(regions: DataFrame, found, columns: str) -> DataFrame:
    kinds = dict(regions.dtypes)
    more = ["region_id", "src_order", "type", "x0", "y0", "x1", "y1", "text", "page_w", "page_h"]
    key = f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, region_id {kinds['region_id']}, "
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("orig")) if "orig" in regions.columns else F.col("text")
    rows = regions.withColumn("text", text).select(*KEY, *more).repartition(*KEY).sortWithinPartitions(*KEY)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _pages(batches, found)

    return rows.mapInPandas(pages, key + columns)


def fields(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per populated field: its label region, number on the page, category, whether the label holds a value, text and box.

    The text is its members' texts by line, the label's own included where it holds a value; the box is the one around them.
    """

    def found(page: pd.DataFrame) -> pd.DataFrame:
        key = tuple(page[k].iloc[0] for k in KEY)
        out = []
        for n, f in enumerate(scan(_rows(page), page["page_w"].iloc[0], page["page_h"].iloc[0], config)[0], 1):
            m = sorted(f.members, key=lambda r: (r.y0, r.x0))
            box = min(r.x0 for r in m), min(r.y0 for r in m), max(r.x1 for r in m), max(r.y1 for r in m)
            out.append((*key, f.label.id, n, f.category, f.inline, "\n".join(t for r in m if (t := r.raw.strip())), len(m), *box))
        return pd.DataFrame(out, columns=[*KEY, "region_id", "field", "category", "inline", "value", "members", "x0", "y0", "x1", "y1"])

    return _scanned(regions, found, "field int, category string, inline boolean, value string, members int, x0 double, y0 double, x1 double, y1 double")


def roles(regions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The regions that are part of a page's metadata: role, field, category, and how many members the field's value has.

    Values of two members or more make one logical region of their field; see fields() for its text and box.
    """

    def found(page: pd.DataFrame) -> pd.DataFrame:
        key = tuple(page[k].iloc[0] for k in KEY)
        full, heading = scan(_rows(page), page["page_w"].iloc[0], page["page_h"].iloc[0], config)
        out = [] if heading is None else [(*key, heading.id, "metadata_container_heading", None, None, len(full))]
        for n, f in enumerate(full, 1):
            out.append((*key, f.label.id, "metadata_field_label_and_value" if f.inline else "metadata_field_label", n, f.category, len(f.members)))
            out += [(*key, r.id, "metadata_field_value", n, f.category, len(f.members)) for r in f.members if r is not f.label]
        frame = pd.DataFrame(out, columns=[*KEY, "region_id", "role", "field", "category", "members"])
        return frame.astype({"field": "Int32", "members": "Int32"})

    return _scanned(regions, found, "role string, field int, category string, members int")
