"""Quality classification from weak labels: an expectation-maximisation label model teaches a hashed linear scorer.

Overlapping heuristic labellers each vote good, bad or not at all. All documents' vote patterns are counted (at most
3^labellers patterns), and expectation-maximisation on the counts finds each labeller's accuracy and the share of good
documents, with the labellers independent given the class. The posterior of its pattern labels a document. On a bounded
sample, a logistic scorer of hashed words, word shapes and shape pairs learns these labels; it then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, carried, give_back_memory, mix64, staged, text_blocks, word_hashes

#: Buckets of word shapes and their pairs, and of words.
SHAPES, WORDS = 1 << 14, 1 << 17
BUCKETS = SHAPES + WORDS
LABELLERS = ("words with symbols", "capitals", "repeats", "variety", "word length", "sentence ends", "symbol characters", "symbol endings")
_UPPER, _LOWER, _DIGIT, _OTHER, _SYMBOL, _STOP, _WIDE = 1, 2, 3, 4, 5, 6, 7
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
_KIND[[ord(c) for c in "!$%&*#@^~|<>=+_{}[]\\/"]] = _SYMBOL
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_MIX = np.random.default_rng(3).integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words:
    """The words of some texts: hash, text, length in bytes, counts of kinds of bytes, kinds of the first and last byte."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.hash, self.doc, begin, end = word_hashes(texts)
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[data]

        def within(which: int) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind == which)])
            return total[end] - total[begin]

        self.size = end - begin
        self.upper, self.lower, self.symbol = within(_UPPER), within(_LOWER), within(_SYMBOL)
        self.first, self.last, self.stop = kind[begin], kind[end - 1], data[end - 1] == 46
        same = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.again = np.concatenate([[False], same]) if len(self.hash) else same

    def per_text(self, x: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, x, self.n).astype(float)


def voted(texts: list[bytes]) -> np.ndarray:
    """Votes (texts x labellers: 1 good, -1 bad, 0 none)."""
    votes = np.zeros((len(texts), len(LABELLERS)), np.int8)
    for a, b in byte_blocks(texts):
        w = _Words(texts[a:b])
        words = w.per_text()
        distinct = np.bincount((np.unique((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=w.n)
        some = np.maximum(words, 1)
        letters, size = np.maximum(w.per_text(w.upper + w.lower), 1), np.maximum(w.per_text(w.size), 1)
        capital, ends, mean, long_enough = w.per_text(w.upper) / letters, w.per_text(w.stop) / some, size / some, words >= 20
        v = votes[a:b]
        # Six labellers know a defect and say nothing otherwise; two know ordinary prose.
        v[:, 0] = np.where(w.per_text(w.symbol > 0) / some > 0.2, -1, 0)
        v[:, 1] = np.where((capital > 0.5) & (letters > 20), -1, 0)
        v[:, 2] = np.where(w.per_text(w.again) / some > 0.2, -1, 0)
        v[:, 3] = np.where(long_enough & (distinct / some < 0.2), -1, 0)
        v[:, 4] = np.where((mean > 15) | (mean < 2), -1, np.where((mean > 3) & (mean < 10), 1, 0))
        v[:, 5] = np.where(long_enough & (ends < 0.005), -1, np.where((ends > 0.02) & (ends < 0.6), 1, 0))
        v[:, 6] = np.where(w.per_text(w.symbol) / size > 0.04, -1, 0)
        v[:, 7] = np.where(w.per_text(w.last == _SYMBOL) / some > 0.15, -1, 0)
        v[words == 0] = 0
    return votes


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of each bucket that a text has: the root of the bucket's share of the text's words."""
    texts_, buckets, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for a, b in byte_blocks(texts):
        w = _Words(texts[a:b])
        if not len(w.hash):
            continue
        # A word's shape: kinds of its first and last byte, its case, its length, symbols, and whether it repeats the word before.
        case = np.where((w.upper > 0) & (w.lower == 0) & (w.upper + w.lower > 1), 2, np.where(w.upper > 0, 1, 0))
        shape = w.first.astype(np.int64)
        for part, k in ((w.last, 8), (case, 3), (np.digitize(w.size, [2, 4, 7, 12]), 5), (np.minimum(w.symbol, 2), 3), (w.again, 2)):
            shape = shape * k + part.astype(np.int64)
        shape = shape.astype(np.uint64) + np.uint64(1)
        one = mix64(shape * _MIX[0]) % np.uint64(SHAPES)
        two = mix64(shape[:-1] * _MIX[0] + shape[1:] * _MIX[1]) % np.uint64(SHAPES)
        inside = w.doc[1:] == w.doc[:-1]
        word = np.uint64(SHAPES) + (w.hash >> np.uint64(40)) % np.uint64(WORDS)
        cell, count = np.unique(np.concatenate([w.doc, w.doc[:-1][inside], w.doc]) * BUCKETS + np.concatenate([one, two[inside], word]).astype(np.int64), return_counts=True)
        texts_.append(cell // BUCKETS + a)
        buckets.append(cell % BUCKETS)
        values.append(np.sqrt(count / w.per_text()[cell // BUCKETS]))
    return np.concatenate(texts_), np.concatenate(buckets), np.concatenate(values)


#: P(vote | class) that the label model starts from, for votes -1, 0, 1: what a labeller says is likelier right than wrong.
PRIOR = np.array([[0.3, 0.4, 0.3], [0.01, 0.39, 0.6]])


def label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, strength: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern (patterns x labellers), and P(vote | class) as (labellers, class, vote + 1).

    Starts from PRIOR, which names the classes and counts like `strength` documents.
    """
    n = patterns.shape[1]
    table, share = np.tile(PRIOR, (n, 1, 1)), np.array([0.2, 0.8])
    for _ in range(steps):
        log = np.log(share) + np.stack([np.log(table[np.arange(n), c, patterns + 1]).sum(1) for c in (0, 1)], 1)
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        by_class = np.stack([counts * (1 - good), counts * good])
        table = PRIOR * strength * share[:, None] + np.stack([(patterns == vote).T @ by_class.T for vote in (-1, 0, 1)], 2)
        table /= table.sum(2, keepdims=True)
        share = (by_class.sum(1) + 1) / (counts.sum() + 2)
    return good, table


def train_scorer(texts: list[bytes], target: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the buckets (and the bias, last) of a logistic scorer of hashed().

    Buckets are held for some texts at a time, in 32-bit numbers, and each step goes over them in order.
    """
    parts = []
    for a, b in byte_blocks(texts, 1 << 19):
        row, column, value = hashed(texts[a:b])
        parts.append((a, b, row.astype(np.int32), column.astype(np.int32), value))
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        g, bias = np.zeros(BUCKETS), np.zeros(len(texts))
        for a, b, row, column, value in parts:
            column = column.astype(np.intp)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], b - a) + w[-1], -30, 30)))
            bias[a:b] = (p - target[a:b]) / len(texts)
            np.add.at(g, column, value * bias[a:b][row])
        g = np.append(g, bias.sum()) + decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def scored(w: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Scores of texts; 0 for a text without words."""
    row, column, value = hashed(texts)
    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], len(texts)) + w[-1], -30, 30)))
    return np.where(np.bincount(row, minlength=len(texts)) > 0, p, 0.0)


def _code(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ 3 ** np.arange(votes.shape[1])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's pattern of votes, and a hash of id and text."""
    for batch in batches:
        for a, b, texts in text_blocks(batch, 1 << 21):
            yield pa.RecordBatch.from_arrays([pa.array(_code(voted(texts))), batch.column(batch.schema.get_field_index("turn")).slice(a, b - a)], ["pattern", "turn"])
    give_back_memory()


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in text_blocks(batch, 1 << 21):
            yield pa.RecordBatch.from_arrays([pa.array(_code(voted(texts))), batch.column(0).slice(a, b - a)], ["pattern", "text"])


def _scored(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, posterior = shared.value
        for batch in batches:
            for a, b, texts in text_blocks(batch, 1 << 21):
                score = scored(w, texts)
                weak = np.array([posterior.get(int(c), 0.5) for c in _code(voted(texts))])
                of = lambda name: batch.column(batch.schema.get_field_index(name)).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([of("doc_id"), pa.array(weak), pa.array(score), pa.array(score >= 0.5), *map(of, carry)], ["doc_id", "weak_label", "score", "keep", *carry])
        give_back_memory()

    return run


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, carry: Sequence[str] = ()) -> DataFrame:
    """Scores each whole text: doc_id, weak_label (posterior of good), score (0 to 1), keep (score >= 0.5), then the columns named in carry.

    The label model uses the votes on all documents. The scorer learns from `sample` different texts at most, those whose
    hash is lowest, and sees them whole. A text without words scores 0 and is not kept. Equal texts score alike. Null ids and repeated
    rows stay; other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    more, fields = carried(docs, carry, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *more)
    base = docs.select(text.alias("text")).withColumn("turn", F.xxhash64("text"))
    patterns_ = staged(base.mapInArrow(_patterns, "pattern long, turn long"), "votes")
    found = patterns_.groupBy("pattern").count().orderBy("pattern").toPandas()
    if found.empty:
        return rows.select("doc_id", F.lit(0.5).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("keep"), *carry)
    codes, counts = found["pattern"].to_numpy(), found["count"].to_numpy(float)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    good, _ = label_model(patterns, counts)
    posterior = dict(zip(codes.tolist(), good.tolist()))
    # The sample-th lowest hash; equal texts count once.
    lowest = patterns_.select("turn").distinct().orderBy("turn").limit(sample).agg(F.max("turn")).first()[0]
    picked = base.filter((F.col("turn") <= lowest) & (F.length("text") > 0)).dropDuplicates(["turn"]).select("text").mapInArrow(_examples, "pattern long, text string").toPandas().sort_values(["text", "pattern"])
    target = np.array([posterior.get(int(c), 0.5) for c in picked["pattern"]])
    texts = [t.encode() for t in picked["text"]]
    del picked
    w = train_scorer(texts, target) if texts else np.zeros(BUCKETS + 1)
    # The driver lives on, and what training took may be needed elsewhere.
    del texts
    give_back_memory()
    shared = docs.sparkSession.sparkContext.broadcast((w, posterior))
    return rows.mapInArrow(_scored(shared, list(carry)), ", ".join(["doc_id long, weak_label double, score double, keep boolean", *fields]))
