"""Chat formatting with a grammar round trip.

Grammar of the output, one deterministic parse for every string:

    conversation = turn*
    turn         = "### " role ": " body "\\n</turn>\\n"
    role         = "User" | "Assistant" | "System" | "Tool" | "=" escaped-name
    body         = text in which every control string ("###" or "</turn>") stands behind one or more backslashes

Control strings are read from left to right and do not overlap: a backslash and the control string behind it are one
token, so "\\####" is an escaped "###" and a "#". The parser takes that backslash away, so a text that holds neither
control string is its own body. Each turn is rendered plainly, parsed again and compared with its source; where they
differ, the conflicting content is escaped, and again, until the turn reads back identical. A conversation's turns are then
read back from one reader that is fed their joined text, so what one turn says can't pass as the end of another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import tidy

CONTROL = re.compile(r"###|</turn>")
_ESCAPED = re.compile(r"\\(###|</turn>)")
_HEADER = regex.compile(r"### (User|Assistant|System|Tool|=(?:[^\\:\n]|\\.)*): ")
#: A control string in a body, with its backslash; the first without one ends the body, if it is an end of turn.
_TOKEN = re.compile(r"\\?(?:###|</turn>)")
END = "\n</turn>\n"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", ":": "\\:"}
_ROLE_IN = {"\\": "\\", "n": "\n", ":": ":"}


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(body: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], body)


def role_name(role: str) -> str:
    return NAMES.get(role) or "=" + "".join(_ROLE_OUT.get(c, c) for c in role)


def _role(name: str) -> str:
    return ROLES[name] if name in ROLES else re.sub(r"\\(.)", lambda m: _ROLE_IN[m[1]], name[1:])


class Reader:
    """The parser, fed in pieces of any size; it holds the turn that has not ended."""

    #: Characters of the longest token.
    LONGEST = 8

    def __init__(self):
        # buf holds the output from `base` on; the turns before `pos` in it are read, and no token starts before `at`.
        self.buf, self.base, self.pos, self.head, self.at = "", 0, 0, None, 0

    def feed(self, out: str, last: bool = False) -> list[tuple[str, str, int, int]]:
        """role, text, and the span of the body in all that was fed, for each turn that ends; ParseError if there is none."""
        done, self.buf = self.pos, self.buf[self.pos :] + out
        self.base, self.pos, self.at = self.base + done, 0, self.at - done
        turns = []
        while self.pos < len(self.buf) and (turn := self._turn(last)):
            turns.append(turn)
        if last and self.pos < len(self.buf):
            raise ParseError(f"no turn at {self.base + self.pos}")
        return turns

    def _turn(self, last: bool) -> tuple[str, str, int, int] | None:
        if self.head is None:
            head = _HEADER.match(self.buf, self.pos, partial=not last)
            if not head:
                raise ParseError(f"no turn header at {self.base + self.pos}")
            if head.partial:
                return None
            self.head, self.at = (head[1], head.end() - self.pos), head.end()
        role, start = self.head[0], self.pos + self.head[1]
        for m in _TOKEN.finditer(self.buf, self.at):
            if m[0][0] == "\\":
                self.at = m.end()
                continue
            self.at = m.start()
            if not last and m.end() == len(self.buf):
                return None
            if m[0] != "</turn>" or self.buf[m.start() - 1] != "\n" or m.start() - 1 < start or not self.buf.startswith("\n", m.end()):
                raise ParseError(f"no end of turn after {self.base + start}")
            end = m.start() - 1
            self.pos, self.head = m.end() + 1, None
            return _role(role), unescape(self.buf[start:end]), self.base + start, self.base + end
        # A token that starts in the last few characters may not be whole yet.
        self.at = max(self.at, len(self.buf) - self.LONGEST + 1)
        return None


def parse(out: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the span of the body in out, for each turn; ParseError if out is not of the grammar."""
    return Reader().feed(out, True)


def render_turn(role: str, text: str) -> str:
    """The turn as the grammar writes it; escaped as often as it takes to read back the same."""
    body = text
    for _ in range(3):
        out = f"### {role_name(role)}: {body}{END}"
        try:
            back = [x[:2] for x in parse(out)]
        except ParseError:
            back = None
        if back == [(role, text)]:
            return out
        body = escape(body) if body is text else escape(text)
    raise ParseError("a turn does not read back")


def format_conversation(turns: Iterable[tuple[str, str]]) -> str:
    return "".join(render_turn(r, t) for r, t in turns)


def loss_spans(out: str) -> list[tuple[int, int]]:
    """Spans of out that are trained on: the bodies of assistant turns."""
    return [(a, b) for role, _, a, b in parse(out) if role == "assistant"]


class _Digest:
    """What is read back of one conversation's joined text; it holds one turn."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.reader = Reader()

    def add(self, role: str, text: str) -> None:
        out = render_turn(role, text)
        self.chars += len(out)
        self._read(out)

    def _read(self, out: str, last: bool = False) -> None:
        for role, text, _, _ in self.reader.feed(out, last):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self, conv) -> tuple:
        self._read("", True)
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


@tidy
def _digest_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn; one open conversation at a time, across batches."""
    conv, open_, rows = None, None, []
    for batch in batches:
        for c, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if open_ is None or c != conv:
                if open_ is not None:
                    rows.append(open_.row(conv))
                conv, open_ = c, _Digest()
            open_.add(role, text)
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
            rows = []
    if open_ is not None:
        rows.append(open_.row(conv))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def round_trip(conversations: DataFrame) -> DataFrame:
    """One row per conversation with what reads back from its formatted text.

    conversations: conv_id, turn, role, text (others are left out). Rows are taken by turn, null turns first, ties
    by role and text, so repeated rows are repeated turns. Null role and null text count as empty; a null conv_id
    is a conversation of its own. The digests need a conversation's turns in order, so they are sorted by Spark
    (which spills) and streamed: a task holds one turn, however long the conversation is.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_digest_sorted, _SCHEMA)


@tidy
def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [render_turn(r, t) for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], pa.array(out, pa.string())], names=["conv_id", "turn", "role", "rendered"])


def render(conversations: DataFrame) -> DataFrame:
    """The formatted text itself, a row per turn; a conversation is its rows' text in the order of turn, joined.

    Null conv_id and turn stay null; null role and text count as empty; repeated rows each get a row; no rows give none.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_rendered, "conv_id long, turn long, role string, rendered string")


#: The conversation that the query adds.
PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return round_trip(given.unionByName(probe))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(regexp_replace(text, '(###|</turn>)', '\\\1', 'g')) + 15
    + CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role)
      ELSE 1 + length(role) + length(regexp_replace(role, '[^\\:\n]', '', 'g')) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
