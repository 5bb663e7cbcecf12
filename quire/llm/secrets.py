"""Secret scans: fixed patterns, and the guess cost of values that stand where credentials stand.

The guess cost is the least number of bits over all segmentations of a value into dictionary words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming over its prefixes.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm import spans as S
from quire.llm.common import tidy

KINDS = ("assign", "access", "hex", "guess")
# Words that passwords and placeholders are made of, common ones first.
COMMON = tuple(
    "password pass word admin user login welcome secret token test example sample demo changeme change me your here default guest root "
    "letmein monkey dragon master qwerty hello love sunshine princess football baseball shadow superman batman trustno hunter "
    "summer winter spring autumn monday friday january december none null true false redacted hidden placeholder insert value key api "
    "xxxx todo foo bar baz my the and for with this that not is a".split()
)
# Keyboard rows and runs that a walk follows, either way.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "0987654321")
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!", "oleastasi")
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "pin")
#: A quoted value goes to its closing quote on the line, any other to white space.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|(?:api|access|auth|private|secret)[_ -]?(?:key|token)|token|credentials?|login|pin)(?:["']|\b)[ \t]*+(?::|=>?|->|\bis\b)[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`|["'`]?(\S{6,}))""",
    re.IGNORECASE | re.ASCII,
)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}")


def word_ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Words and their ranks: the common ones, then the vocabulary file's pieces of 4 letters or more in its order."""
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            pieces = json.load(f)["model"]["vocab"]
        for piece, i in sorted(pieces.items(), key=lambda x: x[1]):
            w = piece.removeprefix("Ġ").lower()
            if len(w) >= 4 and w.isascii() and w.isalpha():
                ranks.setdefault(w, len(COMMON) + i)
    return ranks


def _char_bits(c: str) -> float:
    return 3.33 if c in "0123456789" else 4.71 if c.isascii() and c.isalpha() else 5.05 if c.isascii() else 8.0


def _walk_end(value: str, i: int) -> int:
    """Where a walk over neighbouring keys that starts at i ends, if it takes 3 keys or more."""
    best = i
    for row in WALKS:
        for line in (row, row[::-1]):
            at = line.find(value[i])
            n = 0
            while at >= 0 and i + n < len(value) and at + n < len(line) and value[i + n] == line[at + n]:
                n += 1
            if n >= 3:
                best = max(best, i + n)
    return best


class Words:
    """Words and their ranks, and the lengths that words with a given start of two letters have."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        lengths: dict[str, set[int]] = {}
        for w in ranks:
            lengths.setdefault(w[:2], set()).add(len(w))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}

    def at(self, text: str, i: int) -> Iterator[tuple[int, int]]:
        """End and rank of each word of two letters or more that starts at i."""
        for size in self.lengths.get(text[i : i + 2], ()):
            if size > 1 and i + size <= len(text) and (rank := self.ranks.get(text[i : i + size])):
                yield i + size, rank


def guess_bits(value: str, words: Words | dict[str, int], enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """Least bits to guess the value and the segments that give it: (kind, start, end), kinds word, date, repeat, walk, brute.

    A segment's bits are never negative, so a prefix that costs `enough` is followed no further; if the whole value
    costs that, the result is (enough, []). Words have any length of the list's, and repeats any period: a unit
    is lengthened until its characters alone cost what is left to spend.
    """
    words = words if isinstance(words, Words) else Words(words)
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    bits_of = [_char_bits(c) for c in low]
    brute = [0.0, *itertools.accumulate(bits_of)]
    cost, back, reached = {0: 0.0}, {}, 0

    def step(i: int, j: int, kind: str, bits: float) -> None:
        nonlocal reached
        if (now := cost[i] + bits) < min(enough, cost.get(j, math.inf)):
            cost[j], back[j] = now, (i, kind)
            reached = max(reached, j)

    # A segment of another kind costs a bit and a half to name; brute force goes on character by character.
    for i in range(n):
        if i > reached:
            break
        if i not in cost:
            continue
        step(i, i + 1, "brute", _char_bits(value[i]))
        for j, rank in words.at(low, i):
            upper = sum(map(str.isupper, value[i:j]))
            step(i, j, "word", 1.5 + math.log2(rank + 1) + (1 if upper else 0) + (2 if 1 < upper < j - i else 0))
        for j, rank in words.at(plain, i):
            if j - i > 2:
                step(i, j, "word", 3.5 + math.log2(rank + 1) + (1 if value[i:j] != low[i:j] else 0))
        if m := _DATE.match(value, i):
            step(i, m.end(), "date", 1.5 + (6.0 if m.end() - i == 4 else 15.0))
        if (end := _walk_end(low, i)) > i:
            step(i, end, "walk", 1.5 + math.log2(len(WALKS) * 2 * 20) + math.log2(end - i))
        for u in range(1, (n - i) // 3 + 1):
            unit = brute[i + u] - brute[i]
            if cost[i] + 1.5 + unit >= enough:
                break
            times = 1
            while low.startswith(low[i : i + u], i + u * times):
                times += 1
            if times >= 3:
                step(i, i + u * times, "repeat", 1.5 + unit + math.log2(times))
    if n not in cost:
        return enough, []
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind == "brute" and out and out[-1][0] == "brute":
            out[-1] = ("brute", i, out[-1][2])
        else:
            out.append((kind, i, j))
        j = i
    return cost[n], out[::-1]


#: Bits from which a value in a credential's place counts as a secret; placeholders and plain words stay under it.
MIN_BITS = 30.0


def guessed(text: str, words: Words | dict[str, int], min_bits: float = MIN_BITS) -> list[S.Span]:
    """Values in a credential's place that are dear to guess."""
    low = text.lower()
    if not any(s in low for s in _STEMS):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        k = m.lastindex
        value = m[k] if k < 4 else m[k].rstrip(".)]}!?,;\"'`<>")
        if len(value) >= 6 and guess_bits(value, words, min_bits)[0] >= min_bits:
            out.append(("guess", m.start(k), m.start(k) + len(value)))
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


@tidy
def _scan(batches: Iterator[pa.RecordBatch], ranks: dict[str, int], min_bits: float) -> Iterator[pa.RecordBatch]:
    words = Words(ranks)
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            text = text.as_py() or ""
            base, more = S.secrets(text), guessed(text, words, min_bits)
            n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((doc, *n, len(more), S.digest(S.joined(base, KINDS)), S.joined(base + more, KINDS)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def scan(docs: DataFrame, vocabulary: str | None = None, min_bits: float = MIN_BITS) -> DataFrame:
    """Counts and spans of secrets for each row of docs (doc_id, text; others are left out).

    Null and empty texts have none; repeated rows each get a row; a null doc_id stays null. The word list is read
    once on the driver and its size is that of the vocabulary file.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(functools.partial(_scan, ranks=word_ranks(vocabulary), min_bits=min_bits), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
