"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters with a learned embedding of itself (word input) and the summed learned embeddings of its character 4- and
5-grams (character input); words and n-grams are known by 64-bit hashes. Two gated recurrent layers read a window of words in
both directions, attention pools the states, and a linear layer gives the window's score. Windows overlap by half and
cover the whole text; a document scores as its highest window. Labels are the documents', so training takes the highest
window of a toxic document as its example, and the highest and some random windows of a clean one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, carried, crc_mod, give_back_memory, mix64, staged, text_blocks, word_hashes

WINDOW, STRIDE = 32, 16
HIDDEN = 8
#: Numbers in an embedding.
SIZE = 4
INPUTS = 2 * SIZE
_C = np.random.default_rng(11).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = 22
#: Words whose n-grams are hashed at once.
_WORDS = 20_000
#: Passes over the n-grams of the training words, by their leading bits.
_PASSES = 8


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased texts, its text, and the joined bytes with each word's place in them."""
    raw = [(t or "").lower().encode() for t in texts]
    h, doc, begin, end = word_hashes(raw, punctuation=True)
    return h, doc, np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), begin, end


def words_in_parts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of many texts, hashed a megabyte at a time: of each block only its different words are kept.

    Returns the sorted hashes, the number of each word of the texts among them, the words of each text, the texts that have
    each hash, and some joined bytes with each hash's place in them.
    """
    counts, parts, at = np.zeros(len(texts), np.int64), [], 0
    for a, b in byte_blocks([range(len(t or "")) for t in texts], 1 << 20):
        h, doc, data, begin, end = words_of(texts[a:b])
        if not len(h):
            continue
        counts[a:b] = np.bincount(doc, minlength=b - a)
        first, local = distinct(h)
        met = np.bincount(np.unique(local * (b - a) + doc) // (b - a), minlength=len(first))
        size = end[first] - begin[first]
        to = np.cumsum(size)
        own = data[np.repeat(begin[first] - (to - size), size) + np.arange(int(size.sum()))]
        parts.append((h[first], local.astype(np.int32), met, own, to - size + at, to + at))
        at += len(own)
    if not parts:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e.astype(np.int32), counts, e, e.astype(np.uint8), e, e
    hashes = np.unique(np.concatenate([x[0] for x in parts]))
    documents, begin, end, ids = np.zeros(len(hashes), np.int64), np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64), []
    for h, local, met, _, first, last in parts:
        number = np.searchsorted(hashes, h).astype(np.int32)
        documents[number] += met
        begin[number], end[number] = first, last
        ids.append(number[local])
    return hashes, np.concatenate(ids), counts, documents, np.concatenate([x[3] for x in parts]), begin, end


def grams_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 4- and 5-grams of bytes of `^word$` and the index of the word of each."""
    size = end - begin + 2
    at = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - at[owner]
    marked = data[np.minimum(begin[owner] + np.maximum(place - 1, 0), len(data) - 1)].astype(np.uint64)
    marked[at] = 94
    marked[at + size - 1] = 36
    hashes, owners = [], []
    for n in (4, 5):
        if len(marked) < n:
            continue
        h = np.zeros(len(marked) - n + 1, np.uint64)
        for j in range(n):
            h += (marked[j : len(marked) - n + 1 + j] + np.uint64(1)) * _C[j]
        inside = owner[: len(h)] == owner[n - 1 :]
        hashes.append(mix64(h[inside] * np.uint64(2 * n + 1)))
        owners.append(owner[: len(h)][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _lookup(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted array, or its length."""
    if not len(sorted_):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, len(sorted_))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of texts with so many words: text, first word (over all texts) and words of each."""
    many = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    first = (np.cumsum(counts) - counts)[doc] + nth * STRIDE
    return doc, first, np.minimum(WINDOW, counts[doc] - nth * STRIDE)


class Inputs:
    """The words and n-grams with an embedding, and the embeddings: word_table (last row: any other word) and gram_table."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, rng: np.random.Generator):
        self.words, self.grams = words, grams  # sorted hashes
        draw = lambda n: (rng.standard_normal((n, SIZE)) * 0.02).astype(np.float32)
        self.word_table, self.gram_table = draw(len(words) + 1), draw(len(grams))
        self.word_table[-1] = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "filter"}

    def known(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words, given by hash and place in the bytes: row of each in word_table, and pairs (word, row in gram_table)."""
        if "filter" not in self.__dict__:
            self.filter = np.zeros(1 << _BITS, bool)
            self.filter[self.grams >> np.uint64(64 - _BITS)] = True
        owners, rows = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for i in range(0, len(h), _WORDS):
            g, owner = grams_of(data, begin[i : i + _WORDS], end[i : i + _WORDS])
            maybe = self.filter[g >> np.uint64(64 - _BITS)]
            g, owner = g[maybe], owner[maybe]
            at = _lookup(self.grams, g)
            hit = at < len(self.grams)
            owners.append((owner[hit] + i).astype(np.int32))
            rows.append(at[hit].astype(np.int32))
        return _lookup(self.words, h), np.concatenate(owners), np.concatenate(rows)

    def vectors(self, word: np.ndarray, owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """A row of inputs for each word: its own embedding, then the sum of its n-grams'."""
        x = np.empty((len(word), 2 * SIZE), np.float32)
        x[:, :SIZE] = self.word_table[word]
        for k in range(SIZE):
            x[:, SIZE + k] = np.bincount(owner, self.gram_table[gram, k], len(word))
        return x


class Network:
    """The parameters, the forward pass and, for training, the backward pass."""

    def __init__(self, inputs: Inputs, rng: np.random.Generator):
        self.inputs = inputs
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        p = {"va": draw(2 * HIDDEN), "wo": draw(2 * HIDDEN), "bo": np.full(1, -1.0, np.float32)}
        for side in "fb":
            p["W" + side], p["U" + side], p["b" + side] = draw(INPUTS, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        self.p = p

    def _layer(self, side: str, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        U, H = self.p["U" + side], HIDDEN
        h = np.zeros((len(ids), H), np.float32)
        out = np.zeros((WINDOW, len(ids), H), np.float32)
        whole = mask.all(0)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g, hu = gates[ids[:, t]], h @ U
            zr = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(g[:, 2 * H :] + r * hu[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * H :]))
            new = n + z * (h - n)
            h = new if whole[t] else np.where(mask[:, t, None], new, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None, gates: dict | None = None) -> np.ndarray:
        """Scores (before the sigmoid) of windows of word indices into x, rows of inputs."""
        states = []
        for side in "fb":
            trail = [] if keep is not None else None
            states.append(self._layer(side, gates[side] if gates else self.gates(x, side), ids, mask, trail))
            if keep is not None:
                keep[side] = trail
        h = np.concatenate(states, 2)
        a = np.where(mask.T, h @ self.p["va"], np.float32(-1e9))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(h=h, a=a, pooled=pooled)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gates(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p["W" + side] + self.p["b" + side]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss by the parameters, and by the inputs (key "x")."""
        keep: dict = {}
        d = ((_sigmoid(self.forward(x, ids, mask, keep)) - target) / len(target)).astype(np.float32)
        h, a, pooled, H = keep["h"], keep["a"], keep["pooled"], HIDDEN
        g = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True)}
        dx = np.zeros((WINDOW, len(ids), INPUTS), np.float32)
        dp = d[:, None] * self.p["wo"]
        da = (h * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tb,tbh->h", ds, h)
        dh_all = a[:, :, None] * dp + ds[:, :, None] * self.p["va"]
        for k, side in enumerate("fb"):
            U = self.p["U" + side]
            dU, dh = np.zeros_like(U), np.zeros((len(ids), H), np.float32)
            dW, db = np.zeros_like(self.p["W" + side]), np.zeros(3 * H, np.float32)
            for t, before, z, r, n, un in reversed(keep[side]):
                m = mask[:, t, None]
                full = dh + dh_all[t, :, k * H : (k + 1) * H]
                # A step without a word hands its state on.
                go = np.where(m, full, 0)
                dn = go * (1 - z) * (1 - n * n)
                dz = go * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], 1)
                dg = np.concatenate([dz, dr, dn], 1)
                dW += x[ids[:, t]].T @ dg
                dx[t] += dg @ self.p["W" + side].T
                db += dg.sum(0)
                dU += before.T @ du
                dh = np.where(m, go * z + du @ U.T, full)
            g["U" + side], g["b" + side], g["W" + side] = dU, db, dW
        flat, token = dx.reshape(-1, INPUTS), ids.T.ravel()
        g["x"] = np.stack([np.bincount(token, flat[:, k], len(x)) for k in range(INPUTS)], 1)
        return g

    def windows(self, x: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 4096) -> np.ndarray:
        """Scores of the windows that begin at words `start`."""
        gates, out, step = {side: self.gates(x, side) for side in "fb"}, np.empty(len(start), np.float32), np.arange(WINDOW)
        for i in range(0, len(start), most):
            at = np.minimum(start[i : i + most, None] + step, len(ids) - 1)
            out[i : i + most] = self.forward(x, ids[at], step < size[i : i + most, None], gates=gates)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's score of each text (before the sigmoid); -inf for a text without words."""
        out = np.full(len(texts), -np.inf)
        h, doc, data, begin, end = words_of(texts)
        if not len(h):
            return out
        first, ids = distinct(h)
        x = self.inputs.vectors(*self.inputs.known(h[first], data, begin[first], end[first]))
        of, start, size = windows_of(np.bincount(doc, minlength=len(texts)))
        logits = self.windows(x, ids, start, size)
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[heads]] = np.maximum.reduceat(logits, heads)
        return out


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one occurrence of each distinct hash, and for each hash its number among them."""
    order = np.argsort(h)
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    return order[new], ids


def _vocabulary(hashes: np.ndarray, documents: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words, and of the n-grams, that occur in at least so many documents (n-grams: words times documents)."""
    kept = []
    for part in range(_PASSES):  # an eighth of all n-grams at a time
        units, often = np.empty(0, np.uint64), np.empty(0, np.int64)
        for i in range(0, len(hashes), _WORDS):
            grams, owner = grams_of(data, begin[i : i + _WORDS], end[i : i + _WORDS])
            own = grams >> np.uint64(61) == part
            units, inverse = np.unique(np.concatenate([units, grams[own]]), return_inverse=True)
            often = np.bincount(inverse, np.concatenate([often, documents[owner[own] + i]]), len(units)).astype(np.int64)
        kept.append(units[often >= least])
    return hashes[documents >= least], np.concatenate(kept)


def train(texts: list[str | None], toxic: np.ndarray, steps: int = 2000, batch: int = 32, rate: float = 0.01, table_rate: float = 3.0, decay: float = 1e-3, least: int = 3, seed: int = 5) -> Network:
    """Trains on documents and their labels (1: toxic).

    Words and n-grams in fewer than `least` documents get no embedding of their own. The layers are trained by Adam; the
    embeddings by plain steps, so that what few documents have moves little. Steps get smaller towards the end; there are
    about `steps` of them, but at most 20 rounds over the documents. A fifth of the documents (of 100 or more) only
    settles where the score is 0.5.
    """
    rng = np.random.default_rng(seed)
    every = np.asarray(toxic, np.float64)
    aside = np.zeros(len(texts), bool)
    for label in (0, 1):
        of_label = np.flatnonzero(every == label)
        aside[rng.permutation(of_label)[: len(of_label) // 5 if len(texts) >= 100 else 0]] = True
    others = [t for t, a in zip(texts, aside) if a]
    texts, toxic = [t for t, a in zip(texts, aside) if not a], every[~aside]
    hashes, ids, counts, documents, data, begin, end = words_in_parts(texts)
    net = Network(Inputs(*_vocabulary(hashes, documents, data, begin, end, least), rng), rng)
    word, gram, many = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(hashes), _WORDS):
        rows, owner, which = net.inputs.known(hashes[i : i + _WORDS], data, begin[i : i + _WORDS], end[i : i + _WORDS])
        word.append(rows)
        gram.append(which[np.argsort(owner, kind="stable")])
        many.append(np.bincount(owner, minlength=len(rows)))
    word, gram, grams_from = np.concatenate(word), np.concatenate(gram), np.cumsum(np.concatenate(many))
    of, start, length = windows_of(counts)
    del hashes, counts, documents, data, begin, end, many
    give_back_memory()
    if not len(of):
        return net
    step = np.arange(WINDOW)
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    clean = np.flatnonzero(toxic[of] == 0)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    ticks = 0

    def inputs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words at some places, the word of each place, and pairs (word, row in gram_table)."""
        own, local = np.unique(ids[at], return_inverse=True)
        many = grams_from[own + 1] - grams_from[own]
        which = gram[np.repeat(grams_from[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        return own, local.reshape(at.shape), np.repeat(np.arange(len(own)), many), which

    def scores() -> np.ndarray:
        out = np.empty(len(start), np.float32)
        for i in range(0, len(start), 4096):
            own, local, to, which = inputs_of(np.minimum(start[i : i + 4096, None] + step, len(ids) - 1))
            out[i : i + 4096] = net.forward(scale * net.inputs.vectors(word[own], to, which), local, step < length[i : i + 4096, None])
        return out

    # The tables stand for scale times their numbers, so that a step touches the rows of its words only.
    scale = np.float32(1)

    def settle() -> None:
        nonlocal scale
        net.inputs.word_table *= scale
        net.inputs.gram_table *= scale
        scale = np.float32(1)

    epochs = min(20, -(-steps * batch // (2 * len(heads))))
    for epoch in range(epochs):
        # Before anything is learned, one window of a document is as good as another.
        score = scores() if epoch else rng.random(len(of))
        best = np.array([a + int(score[a:b].argmax()) for a, b in zip(heads, [*heads[1:], len(of)])])
        other = rng.choice(clean, min(len(clean), len(best)), replace=False)
        chosen = rng.permutation(np.unique(np.concatenate([best, other])))
        for i in range(0, len(chosen), batch):
            part = chosen[i : i + batch]
            own, local, to, which = inputs_of(np.minimum(start[part, None] + step, len(ids) - 1))
            g = net.gradients(scale * net.inputs.vectors(word[own], to, which), local, step < length[part, None], toxic[of[part]])
            ticks += 1
            left = 1 - (epoch + i / len(chosen)) / epochs
            dx = g.pop("x")
            scale *= 1 - decay
            for table, rows, of_row, columns in ((net.inputs.word_table, word[own], slice(None), 0), (net.inputs.gram_table, which, to, SIZE)):
                met, number = np.unique(rows, return_inverse=True)
                for k in range(SIZE):
                    table[met, k] -= left * table_rate / scale * np.bincount(number, dx[of_row, columns + k], len(met))
            if scale < 1e-3:
                settle()
            for k, grad in g.items():
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.p[k] -= (left * rate * (m / (1 - 0.9**ticks)) / (np.sqrt(v / (1 - 0.99**ticks)) + 1e-8)).astype(np.float32)
    settle()
    # Move the bias so that 0.5 parts the documents kept aside best, and is as far from them as it can be.
    top, y = (np.concatenate([net.scores(others[i : i + 100]) for i in range(0, len(others), 100)]), every[aside]) if others else (np.maximum.reduceat(scores(), heads), toxic[of[heads]])
    top, y = top[np.isfinite(top)], y[np.isfinite(top)]
    if not len(top):
        return net
    order = np.argsort(top)
    s, y = top[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    cut = np.flatnonzero(wrong == wrong.min())
    middle = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    width = np.concatenate([[0], s[1:] - s[:-1], [0]])
    net.p["bo"] -= np.float32(middle[cut[width[cut].argmax()]])
    return net


def _scored(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for a, b, texts in text_blocks(batch, 1 << 21):
                logits = net.scores([t.decode() for t in texts]) if net else np.full(len(texts), -np.inf)
                p = np.where(np.isfinite(logits), _sigmoid(logits), 0.0)
                of = lambda name: batch.column(batch.schema.get_field_index(name)).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([of("doc_id"), of("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *map(of, carry)], ["doc_id", "held_out", "score", "predicted", *carry])
        give_back_memory()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, max_per_label: tuple[int, int] = (3200, 1600), carry: Sequence[str] = ()) -> DataFrame:
    """Scores each whole text: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), then the columns named in carry.

    Trains on labelled rows outside the held-out fold: of label 0 and 1 at most max_per_label rows, those whose hash of id
    and text is lowest, equal rows once. It sees their whole texts, and scores are of whole texts. A text without words, null or empty, scores 0, as do all if there are no rows
    of both labels to learn from. Null labels are left out; null ids are not held out; repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """
    held = lambda c: F.coalesce(crc_mod(c, folds) == held_fold, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held("doc_id"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    net = None
    if len(counts) == 2:
        # About a fifth more than wanted by a hash of the id, then exactly so many of distinct rows.
        share = F.when(F.col("label") == 1, F.lit(min(1.0, 1.2 * max_per_label[1] / counts[1]))).otherwise(F.lit(min(1.0, 1.2 * max_per_label[0] / counts[0])))
        likely = staged(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share * (1 << 30)).distinct(), "likely")
        met = base.filter("text is not null").join(likely, "doc_id").select("label", "text").distinct().withColumn("turn", F.xxhash64("text", "label"))
        sample = None
        for label, most in enumerate(max_per_label):
            part = met.filter(F.col("label") == label).orderBy("turn", "text").limit(most)
            sample = part if sample is None else sample.unionByName(part)
        few = sample.select("label", "text").toPandas().sort_values(["label", "text"])
        texts, marks = few["text"].tolist(), few["label"].to_numpy()
        del few
        if len(set(marks.tolist())) == 2:
            net = train(texts, marks)
        del texts
        give_back_memory()
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = "doc_id long, held_out boolean, score double, predicted int"
    more, fields = carried(docs, carry, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more).withColumn("held_out", held("doc_id"))
    return rows.mapInArrow(_scored(shared, list(carry)), ", ".join([schema, *fields]))
