"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of its character n-grams, hashed to rows of an embedding table; so a misspelling that was never
seen shares most of its vectors with the word it distorts. A window of words is the mean of its words' vectors, a
linear softmax scores it, and a text scores as its most toxic window: a few words decide, however long the text.
Training runs the gradient through that window into the softmax and the table together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, chunks, tidy


@dataclass(frozen=True)
class Params:
    """rows: of the embedding table. size: of a vector. grams: lengths of character n-grams. window: words of a window,
    which start every half window. sample: labelled documents of either label that training takes at most, by the
    least digest of their id. rate, epochs, batch: of the descent; steps: of it at least, so that a small sample is gone
    through more often."""

    rows: int = 1 << 15
    size: int = 12
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 16
    sample: int = 2500
    rate: float = 0.5
    epochs: int = 12
    batch: int = 64
    steps: int = 900
    seed: int = 7
    threshold: float = 0.3


_EDGE = b".,;:!?\"'()[]{}"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case, without punctuation at their ends; one that is nothing else is empty."""
    return [w.strip(_EDGE) for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()]


def _mixed(h: np.ndarray, rows: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(rows)).astype(np.int64)


def gram_rows(words: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(word, table row) for each n-gram of each word within < and >, and for the whole word; none for an empty word."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" if w else "" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    of, rows = [], []
    with np.errstate(over="ignore"):
        for k in p.grams:
            start = at[at + k <= end]
            h = np.full(len(start), k, np.uint64)
            for j in range(k):
                h = h * _PRIME + codes[start + j]
            of.append(word[start])
            rows.append(_mixed(h, p.rows))
        if len(codes):  # a polynomial in the place of the letter, whatever the length
            first = np.cumsum(size)[size > 0] - size[size > 0]
            place = (at - np.repeat(first, size[size > 0])).astype(np.uint64)
            whole = np.add.reduceat((codes + place * _PRIME) * (place * np.uint64(2) + np.uint64(1)) * _PRIME, first)
            of.append(np.flatnonzero(size))
            rows.append(_mixed(whole, p.rows))
    return np.concatenate(of), np.concatenate(rows)


def window_grid(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each window, and which of them count: each distinct word once, none past the end.

    Windows start every half size; a shorter text has one. A bag is divided by the full size, so what isn't there
    counts as zero, and a word that fills a window by repetition doesn't stand for it.
    """
    n = len(ids)
    before = np.full(n, -1, np.int64)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    start = np.arange(0, max(1, n - size // 2), size // 2)[:, None]
    at = start + np.arange(size)
    inside = np.minimum(at, n - 1)
    return inside, (at < n) & (before[inside] < start)


@dataclass
class Model:
    table: np.ndarray  # rows x size
    weight: np.ndarray  # size x 2
    bias: np.ndarray  # 2
    params: Params


class Scorer:
    """Scores texts. A word's margin (toxic less clean logit) is computed once; a window's is the mean of its words'."""

    WORDS = 400_000

    def __init__(self, model: Model):
        self.p = model.params
        # The softmax of two classes depends on the difference of their logits only.
        self.row = (model.table @ (model.weight[:, 1] - model.weight[:, 0])).astype(np.float64)
        self.bias = float(model.bias[1] - model.bias[0])
        self.index: dict[bytes, int] = {}
        self.margins = np.zeros(1 << 14)

    def _learn(self, words: list[bytes]) -> None:
        of, rows = gram_rows(words, self.p)
        margin = np.bincount(of, weights=self.row[rows], minlength=len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)
        known = len(self.index)
        self.index.update(zip(words, range(known, known + len(words))))
        if known + len(words) > len(self.margins):
            self.margins = np.concatenate([self.margins, np.zeros(known + len(words))])
        self.margins[known : known + len(words)] = margin

    def scores(self, texts: list[str | None]) -> list[float]:
        """For a chunk of texts, whose new words are looked up together."""
        if len(self.index) > self.WORDS:
            self.index.clear()
        words = [tokens(t) for t in texts]
        if new := [w for w in {w for one in words for w in one} if w not in self.index]:
            self._learn(new)
        return [self._score(one) for one in words]

    def _score(self, words: list[bytes]) -> float:
        best = 0.0
        if words:
            ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            at, counts = window_grid(ids, self.p.window)
            # Rounded, so that a margin's place in the cache can't show in the last bits.
            best = float((self.margins[ids][at] * counts).sum(1).max() / self.p.window)
        return round(float(1 / (1 + np.exp(-np.clip(best + self.bias, -60, 60)))), 12)


def train(texts: list[str], labels: list[int], p: Params = Params()) -> Model:
    """Joint descent over table, weights and bias; the gradient of a text goes through its most toxic window."""
    rng = np.random.default_rng(p.seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)], np.int64) for t in texts]
    word_of, flat = gram_rows(list(vocabulary), p)
    order = np.argsort(word_of, kind="stable")
    word_of, flat = word_of[order].astype(np.int32), flat[order].astype(np.int32)
    del order
    model = Model((rng.standard_normal((p.rows, p.size)) / p.size).astype(np.float32), (rng.standard_normal((p.size, 2)) / p.size).astype(np.float32), np.zeros(2, np.float32), p)
    counts = np.bincount(word_of, minlength=len(vocabulary))
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    y = np.array(labels)
    usable = [i for i in range(len(docs)) if len(docs[i])]
    grids = {i: window_grid(docs[i], p.window) for i in usable}
    epochs = max(p.epochs, -(-p.steps // max(1, -(-len(usable) // p.batch)))) if usable else 0
    for epoch in range(epochs):
        rate = p.rate * (1 - epoch / epochs)
        rng.shuffle(usable)
        for at in range(0, len(usable), p.batch):
            if at % (p.batch * 16) == 0:  # margins of all words, to choose windows by
                row = model.table @ (model.weight[:, 1] - model.weight[:, 0])
                margins = np.bincount(word_of, weights=row[flat], minlength=len(vocabulary)) / np.maximum(counts, 1)
            part = usable[at : at + p.batch]
            chosen = []
            for i in part:
                grid, real = grids[i]
                # Early on no window stands out, so any may be taken.
                s = rng.integers(len(grid)) if not epoch and rng.random() < 0.5 else int((margins[docs[i]][grid] * real).sum(1).argmax())
                chosen.append(docs[i][grid[s][real[s]]])
            ids = np.concatenate(chosen)
            n_grams = counts[ids]
            doc_row = np.repeat(np.repeat(np.arange(len(part)), [len(c) for c in chosen]), n_grams)
            rows_hit = flat[np.repeat(begin[ids] - np.concatenate([[0], np.cumsum(n_grams)[:-1]]), n_grams) + np.arange(int(n_grams.sum()))]
            share = np.repeat(1.0 / (np.maximum(n_grams, 1) * p.window), n_grams).astype(np.float32)
            mean = np.zeros((len(part), p.size), np.float32)
            np.add.at(mean, doc_row, model.table[rows_hit] * share[:, None])
            logits = mean @ model.weight + model.bias
            logits -= logits.max(1, keepdims=True)
            grad = np.exp(logits)
            grad /= grad.sum(1, keepdims=True)
            grad[np.arange(len(part)), y[part]] -= 1
            back = grad @ model.weight.T
            model.weight -= rate * 4 * (mean.T @ grad) / len(part)
            model.bias -= rate * grad.mean(0)
            np.add.at(model.table, rows_hit, -rate * p.window * back[doc_row] * share[:, None])
    return model


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2: such a row's label is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Trains on a bounded sample of the labelled documents that aren't held out: p.sample of either label at most.

    The sample is that with the least digests of the id, chosen before texts are read; the driver holds
    2 * p.sample whole texts. Rows without id, text or label are left out; without both labels every score is alike.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out(F.col("doc_id"))).withColumn("d", F.md5(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")).cast("binary")))
    chosen = [x for label in (0, 1) for x in rows.where(F.col("toxic") == label).orderBy("d", "doc_id").limit(p.sample).collect()]
    label_of = {r["doc_id"]: r["toxic"] for r in chosen}
    ids = [int(i) for i in label_of]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()) if ids else None
    got = sorted({(r["doc_id"], r["text"]) for r in texts.toLocalIterator()}) if ids else []
    return train([t for _, t in got], [label_of[i] for i, _ in got], p)


@tidy
def _map(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model)
    for batch in batches:
        for a, z in chunks(batch.column("text")):
            part = batch.slice(a, z - a)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scorer.scores(part["text"].to_pylist()), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; others are left out).

    Null and empty texts get the score of the bias alone; repeated rows each get a row; a null doc_id isn't held out.
    """
    scored = docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(functools.partial(_map, model=model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= model.params.threshold).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
