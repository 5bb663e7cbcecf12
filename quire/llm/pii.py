"""Information-theoretic sanitisation of personal data.

Fixed patterns find protected entities. The corpus then tells which other words give them away: a term's
disclosure of an entity is P(entity | term), the share of the documents with the term in which the entity stands
too, and its pointwise mutual information with the entity. Terms that disclose more than a threshold
are generalised, those beyond a second one removed, wherever they stand.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import spans as S
from quire.llm.common import DOCUMENT_COLUMNS, SPACES, BitmapTest, bitmap, by_bitmap, narrowed, tidy, written

KINDS = ("email", "ip", "card", "phone", "remove", "general")
#: What stands for a span in a sanitised text; a term that is generalised gets its class instead (broader).
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": "[REMOVED]"}


def broader(word: str) -> str:
    """The class that a generalised term is replaced by: what it shares with many others, by its signs alone."""
    letters, digits = any(map(str.isalpha, word)), any(map(str.isdigit, word))
    if digits:
        return "[CODE]" if letters else f"[NUMBER OF {sum(map(str.isdigit, word))} DIGITS]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


@dataclass(frozen=True)
class Disclosure:
    """min_texts: distinct texts that must show a pair. general, remove: P(entity | term) from which a term is generalised or removed.
    min_bits: mutual information that either needs in one text; a frequent entity can't give that, so its texts
    together must give as much beyond chance (see disclosing_terms)."""

    min_texts: int = 3
    general: float = 0.6
    remove: float = 0.9
    min_bits: float = 6.0


def term(word: str) -> str:
    """A word's term: lower case, without what isn't letter or digit at its ends; '' if it is none."""
    a, b = 0, len(word)
    if word[:1].isalnum() and word[-1:].isalnum():
        return word.lower()
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def words(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the words of a text."""
    for line_start, line in _pieces(text):
        at = 0
        for w in line.split(" "):
            if w:
                yield line_start + at, line_start + at + len(w)
            at += len(w) + 1


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.translate(_NEWLINES).split("\n"):
        yield at, line
        at += len(line) + 1


_NEWLINES = {ord(c): "\n" for c in SPACES if c != " "}


def terms_of(text: str, found: list[S.Span]) -> set[str]:
    """The terms of a text, of any length and kind of sign; words that overlap an entity don't count."""
    spans = list(words(text))
    starts = np.array([a for a, _ in spans], np.int64)
    blocked = np.zeros(len(spans), bool)
    for _, a, b in found:
        i = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        while i < len(spans) and spans[i][0] < b:
            blocked[i] |= spans[i][1] > a
            i += 1
    return set(map(term, {text[a:b] for (a, b), no in zip(spans, blocked.tolist()) if not no})) - {""}


def entities_of(text: str, found: list[S.Span]) -> set[str]:
    return {f"{kind}:{text[a:b].lower()}" for kind, a, b in found}


def near(text: str, found: list[S.Span], rules: Disclosure) -> set[tuple[str, str]]:
    """(entity, term) for every entity and every term of a text, wherever they stand."""
    terms = terms_of(text, found)
    return {(e, t) for e in entities_of(text, found) for t in terms}


@tidy
def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, text and hashes of the entities, only of texts that have any."""
    for b in batches:
        rows = []
        for x, digest in zip(b["text"], b["digest"], strict=True):
            text = x.as_py() or ""
            if found := S.personal(text):
                rows.append((digest.as_py(), text, [_hash(e) for e in entities_of(text, found)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.list_(pa.int64())))], names=["digest", "text", "entities"])


#: Pairs that a task sums before it hands them on.
_HELD = 200_000


@tidy
def _pairs(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """Documents and distinct texts by pair, for entities in the bit map, summed over up to _HELD pairs of a task."""
    test, docs, texts = BitmapTest(wanted), Counter(), Counter()

    def out():
        keys = list(docs)
        columns = [[e for e, _ in keys], [t for _, t in keys], [docs[k] for k in keys], [texts[k] for k in keys]]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entity", "term", "n_both", "texts"])
        docs.clear()
        texts.clear()
        return batch

    for b in batches:
        for x, hashes, copies in zip(b["text"], b["entities"], b["copies"].to_pylist(), strict=True):
            hashes = np.array(hashes.as_py(), np.int64)
            if not (hashes := hashes[test(hashes)].tolist()):
                continue
            text = x.as_py()
            terms = list(map(_hash, terms_of(text, S.personal(text))))
            for e in hashes:
                for t in terms:
                    docs[e, t] += copies
                    texts[e, t] += 1
                if len(docs) > _HELD:
                    yield out()
    if docs:
        yield out()


class _Hits:
    """The terms of texts that a bit map lets through, by word; forgets words when they get many."""

    WORDS = 150_000

    def __init__(self, wanted: bytes):
        self.test = BitmapTest(wanted)
        self.seen: set[bytes] = set()
        self.hash_of: dict[bytes, int] = {}

    def words(self, text: str) -> set[bytes]:
        """The words of a text whose terms the map lets through; hash_of has their hashes."""
        words = set(text.encode("utf-8", "surrogatepass").split())
        if fresh := list(words - self.seen):
            if len(self.seen) > self.WORDS:
                self.seen.clear()
                self.hash_of.clear()
                fresh = list(words)
            self.seen.update(fresh)
            terms = [term(w.decode("utf-8", "surrogatepass")) for w in fresh]
            hashes = np.fromiter(map(_hash, terms), np.int64, len(terms))
            for i in np.flatnonzero(self.test(hashes)).tolist():
                if terms[i]:
                    self.hash_of[fresh[i]] = int(hashes[i])
        return words & self.hash_of.keys()


@tidy
def _counts(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """Documents by term, for terms in the bit map, summed over the task; the key null counts documents."""
    hits, docs, counts = _Hits(wanted), 0, Counter()

    def out():
        keys = [*counts, None]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*counts.values(), docs], pa.int64())], names=["term", "n"])

    for b in batches:
        for x in b["text"]:
            docs += 1
            found = hits.words(x.as_py() or "")
            counts.update(set(map(hits.hash_of.__getitem__, found)))
        if len(counts) > 200_000:
            yield out()
            docs = 0
            counts.clear()
    yield out()


def _digest():
    """Equal texts have equal digests, and what is found in one holds for its copies."""
    return F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")


def disclosing_terms(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """term (a hash), kind ('general' or 'remove'), disclosure: the terms of docs (text) that give an entity away.

    Every term of a document co-occurs with every entity of it. Documents are counted with their repeats; the support of a pair counts distinct texts, so that copies of one
    text don't make a pattern. Terms are counted over the whole corpus in a second pass, which lets through what a
    bit map of fixed size holds of the candidates; the join is exact.

    P(entity | term) decides. That it isn't chance, a pair shows by min_bits of mutual information, or by the evidence of
    all its texts: their number times the divergence of P(entity | term) from P(entity) in bits, which bounds the
    chance of such a share, must be min_bits more than telling the candidates apart takes. So an entity of any frequency
    below 1, in a table of any size, can have terms; the less it tells per text, the more texts it takes.
    """
    texts = docs.select("text")
    having = texts.select("text", _digest()).mapInArrow(_entities, "digest string, text string, entities array<long>")
    having = written(having.groupBy("digest").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies")))
    # A pair is in no more texts than its entity.
    entities = having.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts"))
    entities = written(entities.where(F.col("texts") >= rules.min_texts).drop("texts"))
    pairs = having.select("text", "entities", "copies").mapInArrow(functools.partial(_pairs, wanted=bitmap(entities, "entity")), "entity long, term long, n_both long, texts long")
    candidates = written(pairs.groupBy("entity", "term").agg(F.sum("n_both").alias("n_both"), F.sum("texts").alias("texts")).where(F.col("texts") >= rules.min_texts))
    wanted = bitmap(candidates.select("term").distinct(), "term")
    if not any(wanted):
        return candidates.select("term", F.lit("general").alias("kind"), F.lit(0.0).alias("disclosure")).where(F.lit(False))
    counts = texts.mapInArrow(functools.partial(_counts, wanted=wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = written(counts)
    total = counts.where("term IS NULL").agg(F.sum("n_term")).first()[0] or 0
    p = F.col("n_both") / F.col("n_term")
    everywhere = F.col("n_entity") / F.lit(float(total))
    bits = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    without = F.when(p < 1, (F.col("n_term") - F.col("n_both")) * F.log2((1 - p) / (1 - everywhere))).otherwise(0.0)
    # Copies of a text are no more evidence than the text.
    evidence = F.col("texts") / F.col("n_both") * (F.col("n_both") * bits + without)
    enough = rules.min_bits + math.log2(max(1, candidates.count()))
    return (
        candidates.join(counts.where("term IS NOT NULL"), "term")
        .join(entities, "entity")
        .where((p >= rules.general) & ((bits >= rules.min_bits) | ((bits > 0) & (evidence >= enough))))
        .groupBy("term")
        .agg(F.max(p).alias("disclosure"))
        .select("term", F.when(F.col("disclosure") >= rules.remove, "remove").otherwise("general").alias("kind"), "disclosure")
    )


def _places(text: str, base: list[S.Span], hits: _Hits) -> list[dict]:
    """Where terms that the bit map lets through stand, outside base spans."""
    if not (found := {w.decode("utf-8", "surrogatepass"): hits.hash_of[w] for w in hits.words(text)}):
        return []
    out = []
    for p, q in words(text):
        h = found.get(text[p:q])
        if h is not None:
            while not text[p].isalnum():
                p += 1
            while not text[q - 1].isalnum():
                q -= 1
            if not any(p < e and a < q for _, a, e in base):
                out.append({"term": h, "start": p, "end": q})
    return out


_AT = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("base", pa.string()), ("at", _AT)])


@tidy
def _find(batches: Iterator[pa.RecordBatch], wanted: bytes | None) -> Iterator[pa.RecordBatch]:
    """Base spans of every text, and the places of terms that the bit map lets through."""
    hits = wanted and _Hits(wanted)
    for b in batches:
        rows = []
        for doc, x in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            text = x.as_py() or ""
            base = S.personal(text)
            joined = S.joined(base, KINDS)
            n = [sum(s[0] == k for s in base) for k in KINDS[:4]]
            rows.append((doc, *n, S.digest(joined), joined, _places(text, base, hits) if hits else []))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)


@tidy
def _flagged(batches: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """digest and places, only of texts that have any."""
    hits = _Hits(wanted)
    for b in batches:
        rows = [(d, at) for x, d in zip(b["text"], b["digest"].to_pylist(), strict=True) if (at := _places(text := x.as_py() or "", S.personal(text), hits))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], _AT)], names=["digest", "at"])


def find(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """Base counts, digest and all spans for each row of docs (doc_id, text; others are left out).

    Null and empty texts have no spans; repeated rows each get a row; a null doc_id stays null; with no entities, or
    no term beyond the thresholds, there are base spans only. A row's terms are looked up by a number of the written
    row, so a doc_id need not be unique, and copies of a text don't meet in one task.
    """
    docs = docs.selectExpr("cast(doc_id as long) AS doc_id", "text")
    terms = written(disclosing_terms(docs, rules))
    wanted = bitmap(terms, "term")
    found = docs.mapInArrow(
        functools.partial(_find, wanted=wanted if any(wanted) else None),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, at array<struct<term:long,start:long,end:long>>",
    )
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    columns = ["doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256"]
    # Rows without a place, nearly all, need no join.
    clear = found.where(F.size("at") == 0).select(*columns, F.col("base").alias("spans"))
    met = found.where(F.size("at") > 0)
    extra = _term_spans(met.select("row", F.explode("at").alias("x")).select("row", "x.*"), terms, "row")
    return clear.unionByName(met.join(extra, "row", "left").select(*columns, _merged(F.col("base"), F.col("extra")).alias("spans")))


def _term_spans(places: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, extra: the flagged term spans of each row or text, as kind:start:end strings."""
    return (
        places.join(terms.select("term", "kind"), "term")
        .groupBy(key)
        .agg(F.collect_list(F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))).alias("extra"))
    )


def _merged(base, extra):
    """Both lists of spans by start, then kind as listed, comma-joined."""
    every = F.concat(F.filter(F.split(base, ","), lambda x: x != ""), F.coalesce(extra, F.array().cast("array<string>")))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(every, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.array_position(order, F.split_part(x, F.lit(":"), F.lit(1))).alias("kind"), x.alias("span")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["span"]), ",")


@tidy
def _mask(batches: Iterator[pa.RecordBatch], but: bytes | None = None) -> Iterator[pa.RecordBatch]:
    """Masked documents. but: leaves out rows whose __key this bit map lets through; without, rows bring an __extra."""
    for b in by_bitmap(batches, "__key", but, False) if but else batches:
        out, n = [], []
        more = b["__extra"].to_pylist() if "__extra" in b.schema.names else [None] * b.num_rows
        for x, extra in zip(b["text"], more, strict=True):
            text = x.as_py()
            if text is not None:
                text = sanitise(text, S.personal(text) + [(k, int(p), int(q)) for k, p, q in (s.split(":") for s in extra or [])])
            out.append(text)
            n.append(None if text is None else len(text))
        columns = {name: b[name] for name in DOCUMENT_COLUMNS} | {"text": pa.array(out, pa.string()), "n_chars": pa.array(n, pa.int64())}
        yield pa.RecordBatch.from_arrays([columns[c].cast(t) for c, t in _DOCUMENT], names=DOCUMENT_COLUMNS)


_DOCUMENT = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]


def sanitise(text: str, found: list[S.Span]) -> str:
    """The text with each span replaced by its kind's mask, or its class; of overlapping spans the first, then the longest, gives the mask of all."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], broader(text[a:b]) if kind == "general" else MASKS[kind]]
        at = max(at, b)
    return "".join([*out, text[at:]])


#: Parts that the copies of one text are dealt to where their spans are joined.
PARTS = 32


def sanitise_documents(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """The documents with personal data and disclosing terms masked; n_chars counts the new text. Null texts stay null.

    Repeated rows each get a row, empty texts stay empty, no rows give no rows, other columns are left out. Only texts
    with a flagged term are shuffled, to their spans; copies of one text are dealt to PARTS parts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    terms = written(disclosing_terms(docs, rules))
    wanted = bitmap(terms, "term")
    if not any(wanted):
        return docs.mapInArrow(_mask, schema)
    places = docs.select("text", _digest()).mapInArrow(functools.partial(_flagged, wanted=wanted), "digest string, at array<struct<term:long,start:long,end:long>>")
    places = places.groupBy("digest").agg(F.first("at").alias("at")).select("digest", F.explode("at").alias("x")).select("digest", "x.*")
    extra = written(_term_spans(places, terms, "digest").withColumn("__key", F.xxhash64("digest")))
    wanted = bitmap(extra, "__key")
    keyed = docs.withColumns({"__digest": _digest(), "__part": (F.monotonically_increasing_id() % PARTS).cast("int")}).withColumn("__key", F.xxhash64("__digest"))
    clear = keyed.drop("__digest", "__part").mapInArrow(functools.partial(_mask, but=wanted), schema)
    parts = extra.select(F.col("digest").alias("__digest"), F.col("extra").alias("__extra"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    # Written, so that no task runs two Python steps, and with them two workers more that stay.
    joined = written(narrowed(keyed, "__key", wanted).join(parts, ["__digest", "__part"], "left").select(*docs.columns, "__extra"))
    return clear.unionByName(joined.mapInArrow(_mask, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return find(table(spark, sf_dir, "documents").select("doc_id", "text"))
