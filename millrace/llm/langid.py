"""Language identification: words first, then back off to shorter and shorter character n-grams.

Words are runs of letters, in lower case. A known word adds its log frequency in each language. An unseen word adds the
mean log frequency of its known n-grams of the longest length (5 down to 1, with marks for the word's ends) of which any is
known; a word without any known n-gram adds nothing. Of languages with equal sums the first by name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_blocks, crc_mod, give_back_memory, mix64, rows_of, text_blocks

ORDERS = (5, 4, 3, 2, 1)
_K = np.random.default_rng(19).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text whose words are handled at once; a longer text goes in parts.
_BLOCK = 1 << 22
_GAP = re.compile(r"[\W\d_]")


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, and of each occurrence the number of its word and its text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), r"[^\p{L}]+")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[some.to_numpy(zero_copy_only=False)]
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), text


def grams_of(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of `^word$`, and the number of the word of each."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    point = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    many = np.maximum(size - n + 1, 0)
    owner = np.repeat(np.arange(len(words)), many)
    first = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    h = np.full(len(first), n, np.uint64)
    for j in range(n):
        h += (point[first + j] + np.uint64(1)) * _K[j]
    return mix64(h), owner


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams per language, of a block of whole texts at a time."""
    for batch in batches:
        langs = np.array(rows_of(batch, "lang"), object)
        for a, b, texts in text_blocks(batch):
            for lang in sorted(set(langs[a:b])):
                words, number, _ = words_of([texts[i].decode() for i in np.flatnonzero(langs[a:b] == lang)])
                count = np.bincount(number, minlength=len(words))
                yield _units(lang, 0, words, [0] * len(words), count)
                for n in ORDERS:
                    h, owner = grams_of(words, n)
                    unit, inverse = np.unique(h, return_inverse=True)
                    yield _units(lang, n, [""] * len(unit), unit.view(np.int64), np.bincount(inverse, count[owner], len(unit)).astype(np.int64))


def _units(lang: str, order: int, words, grams, n) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(words), pa.string()), pa.array([order] * len(words), pa.int32()), pa.array(words, pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "order", "word", "gram", "n"])


class Model:
    """Languages, and log frequencies in each: of words (a dictionary into word_score) and of n-grams (sorted hashes by length)."""

    def __init__(self, languages: list[str], words: dict[str, int], word_score: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.words, self.word_score, self.grams = languages, words, word_score, grams

    def backed_off(self, words: list[str]) -> np.ndarray:
        """A row of scores for each unseen word."""
        out, open_ = np.zeros((len(words), len(self.languages))), np.arange(len(words))
        for n in ORDERS:
            hashes, score = self.grams.get(n, (np.empty(0, np.uint64), None))
            if not len(open_) or not len(hashes):
                continue
            h, owner = grams_of([words[i] for i in open_] if len(open_) < len(words) else words, n)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[at] == h
            owner, at = owner[known], at[known]
            found = np.bincount(owner, minlength=len(open_))
            met = found > 0
            for k in range(out.shape[1]):
                out[open_[met], k] = np.bincount(owner, score[at, k], len(open_))[met] / found[met]
            open_ = open_[~met]
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of word scores, and its number of words."""
        words, number, text = words_of(texts)
        row = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        score = np.zeros((len(words), len(self.languages)))
        score[row >= 0] = self.word_score[row[row >= 0]]
        unseen = np.flatnonzero(row < 0)
        score[unseen] = self.backed_off([words[i] for i in unseen])
        return np.stack([np.bincount(text, score[number, k], len(texts)) for k in range(score.shape[1])], 1), np.bincount(text, minlength=len(texts))

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """sums() of whole texts; a very long text goes in parts that are cut between words."""
        parts, of = [], []
        for i, t in enumerate(texts):
            at = 0
            while len(t) - at > _BLOCK and (gap := _GAP.search(t, at + _BLOCK)):
                parts.append(t[at : gap.start()])
                of.append(i)
                at = gap.start()
            parts.append(t[at:])
            of.append(i)
        total, many = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for a, b in byte_blocks([b"\0" * len(p) for p in parts], _BLOCK):
            s, n = self.sums(parts[a:b])
            np.add.at(total, of[a:b], s)
            np.add.at(many, of[a:b], n)
        return total, many


def fit_language_model(rows: DataFrame, max_docs: int = 2000, least: int = 2) -> Model | None:
    """Fits on rows (text, lang); None if there are none with text and language.

    Of each language at most max_docs different texts are used whole, those whose hash is lowest. Words and n-grams that this sample holds at least `least` times are known.
    """
    rows = rows.filter("lang is not null and text is not null").select("text", "lang")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return None
    # About a fifth more than wanted by hash, then exactly so many: the window sees these few rows only.
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, 1.2 * max_docs / n))])[F.col("lang")]
    likely = rows.withColumn("turn", F.xxhash64("text", "lang")).filter(F.pmod("turn", F.lit(1 << 30)) <= share * (1 << 30)).distinct()
    used = likely.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("turn"))).filter(F.col("at") <= max_docs)
    counts = used.select("lang", "text").mapInArrow(_counted, "lang string, order int, word string, gram long, n long").groupBy("order", "word", "gram", "lang").agg(F.sum("n").alias("n"))
    units = counts.groupBy("order", "word", "gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by_lang")).filter(F.col("all") >= least)
    found = units.select("order", "word", "gram", F.inline("by_lang")).toArrow()
    languages = sorted(totals)
    column = pc.index_in(found.column("lang"), pa.array(languages)).to_numpy()
    order, n = found.column("order").to_numpy(), found.column("n").to_numpy()

    def logs(row: np.ndarray, at: np.ndarray, units: int) -> np.ndarray:
        table = np.zeros((units, len(languages)))
        np.add.at(table, (row, column[at]), n[at])
        return np.log((table + 0.5) / (table.sum(0) + 0.5 * units))

    at = np.flatnonzero(order == 0)
    coded = found.column("word").combine_chunks().take(pa.array(at)).dictionary_encode()
    words = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    grams = {}
    for k in ORDERS:
        of_order = np.flatnonzero(order == k)
        hashes, row = np.unique(found.column("gram").to_numpy()[of_order].view(np.uint64), return_inverse=True)
        grams[k] = (hashes, logs(row, of_order, len(hashes)))
    return Model(languages, words, logs(coded.indices.to_numpy(), at, len(words)), grams)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in rows_of(batch, "text")]
            preds, probs = ["und"] * len(texts), np.zeros(len(texts))
            if model:
                total, many = model.totals(texts)
                p = np.exp(total - total.max(1, keepdims=True))
                best = p.argmax(1)
                probs = np.where(many > 0, p[np.arange(len(p)), best] / p.sum(1), 0.0)
                preds = [model.languages[k] if m else "und" for k, m in zip(best.tolist(), many.tolist())]
            of = lambda name: batch.column(batch.schema.get_field_index(name))
            yield pa.RecordBatch.from_arrays([of("doc_id"), of("held_out"), pa.array(preds, pa.string()), pa.array(probs, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        give_back_memory()

    return run


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, max_docs: int = 2000) -> DataFrame:
    """Predicts each text's language: doc_id, held_out, lang_pred, score.

    Learns from rows outside the held-out fold with text and language, at most max_docs texts of each language. Null text,
    or one without a letter: `und` with score 0, as for all if there is nothing to learn from. score is the posterior
    probability of lang_pred. Null ids count as learnable and not held out; repeated rows stay; other columns are ignored;
    an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(crc_mod(id_col, folds) == held_fold, F.lit(False)).alias("held_out"))
    model = fit_language_model(base.filter("not held_out"), max_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.select("doc_id", "text", "held_out").mapInArrow(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")
