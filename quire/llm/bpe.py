"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs. So
the last token of the encoding of each prefix follows from the last tokens of shorter prefixes, at most as many
bytes back as the longest token is long: that length is the lookahead which the merge list asks for. Prefixes
form a tree by "drop the last token"; tokens above the common ancestor of all prefixes within the lookahead can't
change any more and are emitted. What is kept is the window, not the text.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import chunks, tidy
from quire.llm.lockstep import Lockstep

# Fixed value: the pieces within which byte-level BPE merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_PIECES = regex.compile(PIECES)
_RUNS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\p{White_Space}\p{L}\p{N}]+")]
_SPACES = regex.compile(r"\p{White_Space}+")


@functools.cache
def _near_pieces() -> re.Pattern:
    """PIECES for texts of characters up to U+FFFF, with each class spelled out: what `re` looks up in a table."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x10000))))
    pattern = PIECES.replace(r"\P{White_Space}", r"[^\p{White_Space}]")
    for name in (r"\p{White_Space}", r"\p{L}", r"\p{N}"):
        found = [m[0] for part in (every[:0xD800], every[0xD800:]) for m in regex.finditer(f"{name}+", part)]
        ranges = "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in found)
        pattern = re.sub(rf"\[\^[^]]*\]|{re.escape(name)}", lambda m: m[0].replace(name, ranges) if m[0][0] == "[" else f"[{ranges}]", pattern)
    return re.compile(pattern)


def pieces_of(text: str) -> list[str]:
    near = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return (_near_pieces() if near else _PIECES).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Tokens, merge ranks and the lookahead of one vocabulary file's merge list."""

    def __init__(self, data: str):
        spec = json.loads(data)
        alphabet = byte_alphabet()
        raw = {piece: bytes(alphabet[c] for c in piece) for piece in spec["model"]["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw[p]: i for p, i in spec["model"]["vocab"].items() if p not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw[a], raw[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = {a + b: (r, a, b) for (a, b), r in reversed(self.rank.items())}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        #: Bytes that decide a boundary: no merge makes a longer token.
        self.lookahead = max(map(len, self.id_of))
        # The tokens that are ever emitted: their own bytes merge to them.
        self.whole = {b: i for b, i in self.id_of.items() if len(self.merge(b)) == 1}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.whole.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        #: By both tokens in one number, the second in the low bits.
        self._fits: dict[int, bool] = {}
        #: By token: rank of the merge that makes it, or -1, and its left and right parts. By both tokens of a pair in one number: its rank.
        parts = {self.id_of[x]: (r, self.id_of[a], self.id_of[b]) for x, (r, a, b) in self.made.items()}
        self.rank_of, self.left_of, self.right_of = zip(*(parts.get(i, (-1, -1, -1)) for i in range(max(self.bytes_of) + 1)))
        self.pair = {self.id_of[a] << 32 | self.id_of[b]: r for (a, b), r in self.rank.items()}

    @functools.cached_property
    def lockstep(self) -> Lockstep:
        return Lockstep(self.whole, self.pair, self.rank_of, self.left_of, self.right_of)

    def merge(self, data: bytes) -> list[bytes]:
        """The merges applied by rank, leftmost first: what defines an encoding. For short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            r, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if r == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their bytes."""
        got = self._fits.get(a << 32 | b)
        if got is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            got = self._fits[a << 32 | b] = self._apart(a, b)
        return got

    def _apart(self, x: int, y: int) -> bool:
        """Whether no merge joins x and y while both are built up, from the last merge at their boundary back to bytes.

        before: merges of a lower rank came before x or y was merged into something larger. Equal ranks go left to
        right: a merge across the boundary comes before that of y's right side, and after that of x's left side.
        """
        pair, rank_of, before = self.pair.get, self.rank_of, float("inf")
        while True:
            if pair(x << 32 | y, before) < before:
                return False
            r, q = rank_of[x], rank_of[y]
            if r > q:
                before, x = r, self.right_of[x]
            elif q >= 0:
                before, y = q + 0.5, self.left_of[y]
            else:
                return True


class Transducer:
    """Bytes of one piece in, stable tokens out. One automaton finds the tokens that end at each place."""

    #: Bytes that are gone through between two looks at what is stable.
    STEP = 4096

    def __init__(self, merges: Merges):
        self.m = merges
        self.search, self.base = None, 0
        # By prefix length within the window, which begins at `base`: the last token of the prefix's encoding. The first is the last token emitted.
        self.last = [-1]

    @property
    def data(self) -> list[int]:
        """The window: for each of its bytes, the last token of the encoding up to there."""
        return self.last[1:]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.STEP):
            self._follow(data[at : at + self.STEP])
            if len(self.last) > 4 * self.m.lookahead:
                out += self._emit()
        return out

    def _follow(self, data: bytes) -> None:
        m, last, base = self.m, self.last, self.base
        known, text = m._fits.get, data.decode("latin-1")
        if self.search is None:
            self.search = m.automaton.iter(text)
        else:
            self.search.set(text)
        done = base + len(last) - 1
        end = done + len(data)
        for at, (t, length) in self.search:  # by end, the longest first
            if at < done:
                continue
            start = at + 1 - length
            if start < base:
                continue
            before = last[start - base]
            ok = before == -1 or known(before << 32 | t)
            if ok or ok is None and m.fits(before, t):  # of the tokens that end here, one fits
                last.append(t)
                done = at + 1
        if done != end:
            raise ValueError("the merge list has no encoding for this input")

    def _path(self, end: int) -> list[int]:
        out, last, size_of = [], self.last, self.m.size_of
        while end:
            t = last[end]
            out.append(t)
            end -= size_of[t]
        return out[::-1]

    def _emit(self) -> list[int]:
        """Tokens above the common ancestor of the prefixes that a later token can follow."""
        n = len(self.last) - 1
        live = set(range(max(0, n + 1 - self.m.lookahead), n + 1))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - self.m.size_of[self.last[top]] if top else 0)
        (at,) = live
        if not at:
            return []
        out = self._path(at)
        self.base += at
        self.last = [out[-1], *self.last[at + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.last) - 1)
        self.search, self.base, self.last = None, 0, [-1]
        return out


class Recent(dict):
    """Tokens of pieces. Two generations: what the older one gives is recent again."""

    #: Pieces of a generation that are remembered, of up to LONGEST characters.
    SIZE, LONGEST = 100_000, 64

    def __init__(self, through: Transducer):
        self.older: dict[str, tuple[int, ...]] = {}
        self.through = through

    def meet(self, pieces: set[str]) -> None:
        """Works out in lockstep those that aren't remembered."""
        self._turn()
        new, older = [], self.older.get
        for piece in pieces:
            if piece not in self:
                ids = older(piece)
                if ids is not None:
                    self[piece] = ids
                elif len(piece) <= self.LONGEST:
                    new.append(piece)
        self.update(zip(new, self.through.m.lockstep([p.encode() for p in new])))

    def _turn(self) -> None:
        if len(self) >= self.SIZE:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> Iterable[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = (*self.through.feed(piece.encode()), *self.through.finish())
        if len(piece) <= self.LONGEST:
            self._turn()
            self[piece] = ids
        return ids


class Encoder:
    """Text in, in chunks of any size; token ids out as soon as they are stable."""

    #: Characters of a piece that is kept before it goes through a transducer as it comes.
    HELD = 1024

    def __init__(self, merges: Merges, special: bool = True):
        self.m, self.carry, self.open, self.run = merges, "", None, None
        self.recent = Recent(Transducer(merges))
        #: Pieces of what prepare() was given, until it comes.
        self.split: dict[str, list[str]] = {}
        self.special = dict(merges.special) if special else {}
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._keep = max(map(len, self.special), default=1) - 1

    def feed(self, text: str, last: bool = False) -> list[int]:
        """Tokens that nothing to come can change; all that are left when last."""
        buf, out, at = self.carry + text, [], 0
        if self._split is not None and any(s[0] in buf for s in self.special):
            for m in self._split.finditer(buf):
                out += self._feed(buf[at : m.start()], True)
                out.append(self.special[m[0]])
                at = m.end()
        keep = 0 if last else self._partial(buf[at:])
        self.carry = ""
        out += self._feed(buf[at : len(buf) - keep] if keep else buf[at:], last)
        self.carry += buf[len(buf) - keep :] if keep else ""
        return out

    def _partial(self, buf: str) -> int:
        """Characters at the end that may begin a special token."""
        for k in range(min(self._keep, len(buf)), 0, -1):
            if any(s.startswith(buf[-k:]) for s in self.special):
                return k
        return 0

    def _feed(self, buf: str, last: bool) -> list[int]:
        out: list[int] = []
        if self.open is not None:
            buf = self._go_on(buf, last, out)
        pieces, end = self.split.pop(buf, None) or pieces_of(buf), len(buf)
        if not last:  # a contraction may take two more letters, and the last piece any
            while pieces and end > len(buf) - 3:
                end -= len(pieces.pop())
        out += itertools.chain.from_iterable(map(self.recent.__getitem__, pieces))
        rest = buf[end:]
        if not last and len(rest) > self.HELD:
            # One piece, but for the last few characters: it goes through a transducer from here on.
            lead = rest[0] if rest[0] == " " and not _SPACES.match(rest[1]) else ""
            self.run = next((r for r in _RUNS if r.match(rest, len(lead))), _SPACES)
            if self.run is _SPACES or self.run.match(rest, len(lead)).end() == len(rest):
                self.open = Transducer(self.m)
                out += self.open.feed(lead.encode())
                rest = self._go_on(rest[len(lead) :], False, out)
        self.carry = rest
        return out

    def _go_on(self, buf: str, last: bool, out: list[int]) -> str:
        """Feeds the open piece; what is left of buf is no part of it, or may not be."""
        x = self.run.match(buf)
        end = x.end() if x else 0
        if self.run is _SPACES:  # the last space of a run before a word is the word's, or a piece of its own
            if not (last and end == len(buf)):
                end = max(0, end - 1)
            over = last or end + 1 < len(buf)
        else:
            over = last or end < len(buf)
        out += self.open.feed(buf[:end].encode())
        if over:
            out += self.open.finish()
            self.open = None
        return buf[end:]

    def prepare(self, texts: Iterable[str]) -> None:
        """Meets the pieces of texts that are about to come; of long ones, of their first STEP characters."""
        self.split = {text[:STEP]: pieces_of(text[:STEP]) for text in texts}
        self.recent.meet(set(itertools.chain.from_iterable(self.split.values())))

    def finish(self) -> list[int]:
        return self.feed("", True)

    def encode(self, text: str) -> list[int]:
        return self.feed(text, True)


class Decoder:
    """Token ids in, text out: the bytes go through an incremental UTF-8 state machine, bad bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


@functools.lru_cache(maxsize=2)
def _encoder(data: str) -> Encoder:
    return Encoder(Merges(data))


#: Characters of a text that are encoded at a time, and bytes of texts whose pieces are worked out together.
STEP, TOGETHER = 1 << 16, 1 << 19


def round_trip(encoder: Encoder, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text decoded from them; holds one step's ids at a time."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    decoder, text_of = Decoder(encoder.m), encoder.m.text_of
    for at in range(0, max(1, len(text)), STEP):
        last = at + STEP >= len(text)
        ids = encoder.feed(text[at : at + STEP], last)
        if ids:
            ids_hash.update((("," if n else "") + ",".join(map(text_of.__getitem__, ids))).encode())
            n += len(ids)
        text_hash.update(decoder.feed(ids, last).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@tidy
def _map(batches: Iterator[pa.RecordBatch], data: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(data)
    for b in batches:
        rows = []
        for start, stop in chunks(b["text"], TOGETHER):
            part = b.slice(start, stop - start)
            encoder.prepare(text.as_py() or "" for text in part["text"])
            rows += [(doc, *round_trip(encoder, text.as_py() or "")) for doc, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token count and digests for each row of docs (doc_id, text; others are left out).

    vocabulary: path of a byte-level BPE file, read on the driver; its size bounds what is sent to the tasks. Null
    texts count as empty; an empty text has 0 tokens and the digests of the empty string; repeated rows each get a row.
    """
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(functools.partial(_map, data=data), schema)


@tidy
def _ids(batches: Iterator[pa.RecordBatch], data: str) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(data)
    for b in batches:
        ids = []
        for start, stop in chunks(b["text"], TOGETHER):
            part = b["text"].slice(start, stop - start).to_pylist()
            encoder.prepare(text or "" for text in part)
            ids += [encoder.encode(text or "") for text in part]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the token ids themselves."""
    with open(vocabulary, encoding="utf-8") as f:
        data = f.read()
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(functools.partial(_ids, data=data), "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.common import table

    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
