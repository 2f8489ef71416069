"""A phrase automaton over words: all phrases of a text in one sweep, and the leftmost-longest ones replaced."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dictionaries up to this size are broadcast; larger ones meet the texts by their first word.
BROADCAST_BYTES = 32 << 20
#: What a word is, and what may stand between the words of a phrase.
WORD, GLUE = r"[A-Za-z0-9]+", r"[  -]| [&/] "


class PhraseAutomaton:
    """A trie of word sequences with failure links, in flat arrays.

    Edges are sorted keys (state, word) with their targets. fail[s] is the state of the longest proper end of s that is in
    the trie, ends[s] the phrase that ends at s (or -1), and more[s] the nearest state along the failure links that ends one.
    """

    def __init__(self, phrases: Sequence[str], word: str = WORD, glue: str = GLUE, fold: bool = True):
        self.word, self.glue, self.fold = word, glue, fold
        self.phrases = list(phrases)
        self.words: dict[str, int] = {}
        edges: list[dict[int, int]] = [{}]
        ends, depth = [-1], [0]
        for p, phrase in enumerate(self.phrases):
            state = 0
            for w in re.findall(word, phrase.lower() if fold else phrase):
                w = self.words.setdefault(w, len(self.words))
                nxt = edges[state].get(w)
                if nxt is None:
                    nxt = edges[state][w] = len(edges)
                    edges.append({})
                    ends.append(-1)
                    depth.append(depth[state] + 1)
                state = nxt
            if state and ends[state] < 0:  # of equal phrases the first counts
                ends[state] = p
        fail, more, queue = [0] * len(edges), [0] * len(edges), [0]
        for s in queue:
            for w, t in edges[s].items():
                queue.append(t)
                if s:
                    f = fail[s]
                    while f and w not in edges[f]:
                        f = fail[f]
                    fail[t] = edges[f].get(w, 0)
                more[t] = fail[t] if ends[fail[t]] >= 0 else more[fail[t]]
        key = np.array([(s << 32) | w for s, e in enumerate(edges) for w in e], np.int64)
        order = np.argsort(key)
        self.key, self.target = key[order], np.array([t for e in edges for t in e.values()], np.int32)[order]
        self.fail, self.more, self.ends, self.depth = (np.array(x, np.int32) for x in (fail, more, ends, depth))
        self._lists: tuple | None = None

    def __getstate__(self):
        return {**self.__dict__, "_lists": None}

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """(first word, end word, first character, end character, phrase) of all matches, by their end."""
        if self._lists is None:
            self._lists = (dict(zip(self.key.tolist(), self.target.tolist())), *(x.tolist() for x in (self.fail, self.more, self.ends, self.depth)), re.compile(self.word), re.compile(f"(?:{self.glue})"))
        go, fail, more, ends, depth, word, glue = self._lists
        state, begins, last = 0, [], 0
        text = text or ""
        for i, m in enumerate(word.finditer(text)):
            if i and not glue.fullmatch(text, last, m.start()):
                state = 0  # no phrase goes over this gap
            begins.append(m.start())
            last = m.end()
            w = self.words.get(m[0].lower() if self.fold else m[0], -1)
            while state and (state << 32 | w) not in go:
                state = fail[state]
            state = go.get(state << 32 | w, 0) if w >= 0 else 0
            at = state if ends[state] >= 0 else more[state]
            while at:
                first = i + 1 - depth[at]
                yield first, i + 1, begins[first], last, ends[at]
                at = more[at]

    def longest(self, text: str | None) -> list[tuple[int, int, int]]:
        """(first character, end character, phrase) from left to right: the longest at each place that no earlier one covers."""
        return leftmost_longest(self.matches(text))


def leftmost_longest(found) -> list[tuple[int, int, int]]:
    out, free = [], 0
    for first, end, a, b, p in sorted(found, key=lambda m: (m[0], -m[1])):
        if first >= free:
            out.append((a, b, p))
            free = end
    return out


def _spliced(text: str, parts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in parts:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _distinct_terms(terms: DataFrame, phrase: str, replacement: str) -> DataFrame:
    """One row per sequence of words: the smallest spelling and its smallest replacement."""
    words = F.regexp_extract_all(F.lower(phrase), F.lit(f"({WORD})"), 1)
    return terms.filter(F.col(replacement).isNotNull()).select(words.alias("ws"), F.col(phrase).alias("p"), F.col(replacement).alias("r")).filter("size(ws) > 0").groupBy("ws").agg(F.min(F.struct("p", "r")).alias("m")).select("ws", "m.p", "m.r")


def replaced(texts: DataFrame, text: str, terms: DataFrame, phrase: str, replacement: str, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """texts with `out`: its longest phrases replaced, from left to right, whole words in any case; null stays null.

    Words of a phrase may be parted by a blank, a hyphen, ` & ` or ` / `. terms has the phrases and what replaces them; of
    phrases with the same words the alphabetically first counts. A dictionary of more than broadcast_bytes is not
    broadcast: its phrases are joined with the texts' places by their first word.
    """
    known = _distinct_terms(terms, phrase, replacement)
    size = known.agg(F.coalesce(F.sum(F.length("p") + F.length("r") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _replaced_by_join(texts, text, known, out)
    rows = known.orderBy("p").collect()
    new = [r["r"] for r in rows]
    shared = texts.sparkSession.sparkContext.broadcast(PhraseAutomaton([r["p"] for r in rows]))

    @F.pandas_udf("string")
    def swap(column: pd.Series) -> pd.Series:
        automaton = shared.value
        return column.map(lambda t: None if t is None else _spliced(t, [(a, b, new[p]) for a, b, p in automaton.longest(t)]))

    return texts.withColumn(out, swap(text))


def _replaced_by_join(texts: DataFrame, text: str, known: DataFrame, out: str) -> DataFrame:
    """replaced() for any number of phrases: a place of a text meets the phrases that begin with its word."""
    most = known.agg(F.max(F.size("ws"))).first()[0] or 1
    places = "array<struct<first:int,a:int,b:int,glued:boolean,w:string>>"

    @F.pandas_udf(places)
    def words_of(column: pd.Series) -> pd.Series:
        word, glue = re.compile(WORD), re.compile(f"(?:{GLUE})")

        def one(t: str | None) -> list[dict]:
            ms = list(word.finditer(t or ""))
            return [{"first": i, "a": m.start(), "b": m.end(), "glued": bool(i and glue.fullmatch(t, ms[i - 1].end(), m.start())), "w": m[0].lower()} for i, m in enumerate(ms)]

        return column.map(one)

    distinct = texts.select(F.col(text).alias("t")).filter("t is not null").distinct().withColumn("h", F.xxhash64("t"))
    spots = distinct.select("h", "t", words_of("t").alias("s")).select("h", "t", "s", F.explode(F.transform("s", lambda x, i: F.struct(x["first"].alias("first"), x["w"].alias("w")))).alias("x"))
    # A window of the longest phrase's length goes along with each place.
    ahead = spots.select("h", "t", "x.first", F.col("x.w").alias("w"), F.slice("s", F.col("x.first") + 1, most).alias("win"))
    met = ahead.join(known.withColumn("w", F.col("ws")[0]), "w").filter(F.size("win") >= F.size("ws"))
    same = F.transform(F.slice("win", 1, F.size("ws")), lambda x: x["w"]) == F.col("ws")
    joined = F.forall(F.slice("win", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda x: x["glued"])
    hits = met.filter(same & joined).select("h", "t", "first", (F.col("first") + F.size("ws")).alias("end"), F.col("win")[0]["a"].alias("a"), F.get("win", F.size("ws") - 1)["b"].alias("b"), "r")
    longest = hits.withColumn("k", F.row_number().over(Window.partitionBy("h", "t", "first").orderBy(F.desc("end")))).filter("k = 1")
    of_text = longest.groupBy("h", "t").agg(F.collect_list(F.struct("first", "end", "a", "b", "r")).alias("ms"))

    @F.pandas_udf("string")
    def swap(column: pd.Series, found: pd.Series) -> pd.Series:
        done = [_spliced(t, leftmost_longest((m["first"], m["end"], m["a"], m["b"], m["r"]) for m in ms)) for t, ms in zip(column, found)]
        return pd.Series(done, dtype=object)

    changed = of_text.select(F.col("t").alias("_t"), swap("t", "ms").alias("_new"))
    return texts.join(changed, texts[text] == changed["_t"], "left").withColumn(out, F.coalesce("_new", F.col(text))).drop("_t", "_new")


def found_phrases(texts: DataFrame, doc: str, text: str, phrases: list[str], word: str = "[^ ]+", glue: str = " ") -> DataFrame:
    """doc and each phrase that its text holds as whole words, once, by one sweep of an automaton over each text."""
    shared = texts.sparkSession.sparkContext.broadcast(PhraseAutomaton(phrases, word, glue, fold=False))

    @F.pandas_udf("array<string>")
    def find(column: pd.Series) -> pd.Series:
        automaton = shared.value
        return column.map(lambda t: sorted({automaton.phrases[p] for *_, p in automaton.matches(t)}))

    return texts.select(doc, F.explode(find(text)).alias("phrase")).distinct()
