"""Quality rules from a suffix array: repeated passages of a text, their covered share and the longest one.

A suffix array over the words of a text, built by prefix doubling, brings equal passages next to each other;
the longest common prefix (LCP) of neighbours bounds the intervals of suffixes that share a passage. The maximal
repeated substrings are those intervals; the union of their spans is what repetition covers.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import SPACES, chunks, tidy

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """min_words: fewer fail. window: words of the shortest repeat that counts. The rest are upper limits."""

    min_words: int = 10
    window: int = 5
    max_repeat_words_pct: int = 20
    max_covered_pct: int = 30
    max_longest_words: int = 40


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of ids, and levels: levels[l][i] ranks the 2**l words from i on, -1 past the end.

    Prefix doubling; after each level only suffixes whose prefix is still shared are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int64)
    rank = np.full(n + 1, -1, np.int64)

    def regroup(at: np.ndarray, keys_differ: np.ndarray, base: np.ndarray) -> None:
        """at: positions in order. A group's rank is where it starts."""
        starts = np.where(keys_differ, base, 0)
        rank[order[at]] = np.maximum.accumulate(starts)

    first = np.empty(n, bool)
    if n:
        first[0] = True
        first[1:] = ids[order[1:]] != ids[order[:-1]]
        regroup(np.arange(n), first, np.arange(n))
    levels = [rank.astype(np.int32)]
    h = 1
    while True:
        shared = ~first
        shared[:-1] |= ~first[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            return order, levels
        suffix = order[at]
        group, second = rank[suffix], rank[np.minimum(suffix + h, n)]
        by = np.lexsort((second, group))
        suffix, group, second = suffix[by], group[by], second[by]
        order[at] = suffix
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first[at] = new
        regroup(at, new, at)
        levels.append(rank.astype(np.int32))
        h *= 2


def lcp_array(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """lcp[k]: common prefix of suffixes order[k-1] and order[k]; 0 where it is under `least`."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    gate = levels[min(len(levels) - 1, max(0, int(np.log2(least))))]
    k = np.flatnonzero(gate[order[1:]] == gate[order[:-1]]) + 1
    a, b, got = order[k - 1], order[k], np.zeros(len(k), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        i, j = np.minimum(a + got, n), np.minimum(b + got, n)
        same = (r[i] == r[j]) & (i < n) & (j < n)
        got[same] += 1 << level
    got[got < least] = 0
    lcp[k] = got
    return lcp


def maximal_repeats(words: list, least: int = 5) -> list[tuple[int, tuple[int, ...]]]:
    """The maximal repeated substrings of a word list: (length, start positions), by the intervals of the LCP array.

    An interval is kept if its passage can't be extended to the left: its occurrences follow different words.
    """
    ids = _ids(words, {})
    order, levels = suffix_array(ids)
    lcp = lcp_array(order, levels, least)
    left = np.where(order > 0, ids[np.maximum(order - 1, 0)], -1 - np.arange(len(order)))
    out, stack = [], []  # stack of (length, first place in order)
    for k in range(1, len(order) + 1):
        length = int(lcp[k]) if k < len(order) else 0
        start = k - 1
        while stack and stack[-1][0] > length:
            full, start = stack.pop()
            if len(set(left[start:k].tolist())) > 1:
                out.append((full, tuple(sorted(order[start:k].tolist()))))
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, start))
    return sorted(out)


def _ids(words: list, known: dict) -> np.ndarray:
    d = defaultdict(count().__next__, known)
    return np.fromiter(map(d.__getitem__, words), np.int64, len(words))


def _covered(ids: np.ndarray, doc: np.ndarray, docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of many texts, whose ids don't meet between texts: what repeats cover, and each text's longest repeat.

    Each suffix is covered by its deepest interval, max(lcp[k], lcp[k+1]) words; a passage that the interval's
    left extension covers is inside that one's span, so the union is that of the maximal repeats.
    """
    order, levels = suffix_array(ids)
    lcp = lcp_array(order, levels, least)
    deepest = np.maximum(lcp, np.append(lcp[1:], 0))
    k = np.flatnonzero(deepest)
    start, length = order[k], deepest[k]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc[start], length)
    return np.cumsum(edge[:-1]) > 0, longest


def _dup_lines(text: str) -> int:
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    return dup


def measure(texts: list[str | None], rules: Rules) -> dict[str, np.ndarray]:
    """Columns for a chunk of texts."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(words)), n)
    ids, base = [], 0
    for w in words:
        one = _ids(w, {})
        ids.append(one + base)
        base += len(w)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    covered, longest = _covered(ids, doc, len(words), rules.window)
    at = np.flatnonzero(covered)
    # Code points of a word: its bytes but for UTF-8's continuation bytes.
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for one in words for w in one), np.int64, int(n.sum()))
    repeat_words = np.bincount(doc[at], minlength=len(words))
    covered_chars = np.bincount(doc[at], weights=chars[at], minlength=len(words)).astype(np.int64)
    word_chars = np.bincount(doc, weights=chars, minlength=len(words)).astype(np.int64)
    base_failed = (n < rules.min_words) | (100 * repeat_words > rules.max_repeat_words_pct * n)
    verdict = (100 * covered_chars <= rules.max_covered_pct * word_chars) & (longest <= rules.max_longest_words)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) if t else 0 for t in texts], np.int64),
        "n_repeat_words": repeat_words.astype(np.int64),
        "covered_chars": covered_chars,
        "longest_repeat": longest,
        "base_failed": base_failed,
        "kept": ~base_failed & verdict,
    }


MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "covered_chars": "long", "longest_repeat": "long", "base_failed": "boolean", "kept": "boolean"}


@tidy
def _map(batches: Iterator[pa.RecordBatch], rules: Rules, only_kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            m = measure(part.column("text").to_pylist(), rules)
            if only_kept:
                yield part.filter(pa.array(m["kept"]))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(m[k]) for k in MEASURES]], names=["doc_id", *MEASURES])


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row of measures and verdict for each row of docs (doc_id, text; others are left out).

    Null and empty texts have no words and so fail. Repeated rows each get a row, a null doc_id stays null, no
    rows give no rows. Texts go whole through one suffix array, at 4 bytes a word for each doubling they need.
    """
    schema = "doc_id long, " + ", ".join(f"{k} {t}" for k, t in MEASURES.items())
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(functools.partial(_map, rules=rules, only_kept=False), schema)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; docs needs a column text."""
    return docs.mapInArrow(functools.partial(_map, rules=rules, only_kept=True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("longest_repeat")


#: The covered words are those of repeated 5-word windows; a longest repeat over 40 words is a repeated window of 41.
SQL = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), hs AS (
  SELECT doc_id, list_transform(words, lambda x: hash(x)) AS words FROM d
), win AS (
  SELECT doc_id, i, hash(words[i : i + 4]) AS g FROM hs, unnest(range(1, len(words) - 3)) AS t(i)
), rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT DISTINCT doc_id, j FROM rep, unnest(range(i, i + 5)) AS t(j)
), tok AS (
  SELECT doc_id, generate_subscripts(words, 1) AS j, length(unnest(words)) AS chars FROM d
), covered AS (
  SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM cov JOIN tok USING (doc_id, j) GROUP BY doc_id
), far AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, count(*) OVER (PARTITION BY doc_id, hash(words[i : i + 40])) AS c FROM hs, unnest(range(1, len(words) - 39)) AS t(i)
  ) WHERE c > 1
), lines AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, COALESCE(lines.n, 0) AS n_dup_lines,
    COALESCE(covered.n, 0)::BIGINT AS n_repeat_words, COALESCE(covered.chars, 0)::BIGINT AS covered_chars, far.doc_id IS NOT NULL AS far
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN far USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars, base_failed,
  NOT base_failed AND 100 * covered_chars <= 30 * word_chars AND NOT far AS kept
FROM b
"""
