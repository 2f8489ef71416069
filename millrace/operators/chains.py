"""Rows that depend on the last one kept, and folds over a key's log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


class _Section:
    """Times of one key in one sorted range, and what a chain does in it."""

    def __init__(self, times: np.ndarray, gap: int, inclusive: bool):
        self.times, self.gap, self.side = times, gap, "left" if inclusive else "right"
        self.next = np.searchsorted(times, times + gap, self.side)

    def start(self, last: int | None) -> int:
        """The first row kept after one kept at `last`."""
        return 0 if last is None else int(np.searchsorted(self.times, last + self.gap, self.side))

    def kept(self, last: int | None) -> list[int]:
        out, i = [], self.start(last)
        while i < len(self.times):
            out.append(i)
            i = int(self.next[i])
        return out

    def exits(self) -> tuple[list[int], list[int]]:
        """The last time kept, by the first row kept: ascending first times, and the exit of all up to each."""
        n = len(self.times)
        end = np.where(self.next < n, np.minimum(self.next, n - 1), np.arange(n))
        while True:
            further = end[end]
            if (further == end).all():
                break
            end = further
        # A chain that comes from before has kept nothing later than the first row.
        first = np.arange(min(int(self.next[0]), n - 1) + 1)
        out = self.times[end[first]]
        last_of = np.append(out[1:] != out[:-1], True)
        return self.times[first][last_of].tolist(), out[last_of].tolist()


def _after(last: int | None, upto: list[int], exits: list[int], fresh: int, gap: int, inclusive: bool) -> int:
    if last is None:
        return fresh
    i = int(np.searchsorted(np.array(upto, np.int64), last + gap, "left" if inclusive else "right"))
    return exits[i] if i < len(exits) else last


def spaced(df: DataFrame, keys: list[str], ts: Column, item: str, gap: int, inclusive: bool = False, rows_per_range: int = 250_000) -> DataFrame:
    """The items kept when a row is kept only if it lies more than gap after the last kept row of its key.

    ts is a whole number (null rows are left out), ties go by item; inclusive keeps rows at exactly the gap as well. Rows
    are sorted into ranges, and a key's rows may fill many: each range gives, for every state that a chain may enter it
    with, the state that it leaves with; these steps are composed along the key, and then each range marks its own rows. So
    a key of any size is split over tasks. A task holds one range of about rows_per_range rows at a time, so there are
    more ranges the more rows there are.
    """
    rows = df.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("k"), ts.cast("long").alias("t"), F.col(item).alias("item")).filter("t is not null")
    order = ["k", "t", "item"]
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_range))
    ranged = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "spaced")

    def sections(table: pa.Table) -> Iterator[tuple[str, int, int, np.ndarray]]:
        keys = table.column("k").combine_chunks().dictionary_encode()
        code = keys.indices.to_numpy()
        cut = np.flatnonzero(code[1:] != code[:-1]) + 1
        times = table.column("t").to_numpy()
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(code)]):
            yield keys.dictionary[int(code[a])].as_py(), a, b, times[a:b]

    def steps(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        out = []
        for k, a, b, times in sections(table):
            if a == 0 or b == len(table):  # only these can go on in other ranges
                s = _Section(times, gap, inclusive)
                out.append((k, table.column("part")[0].as_py(), *s.exits(), int(times[s.kept(None)[-1]])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))], ["k", "part", "upto", "exits", "fresh"])

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for r in pdf.sort_values("part").itertuples():
            out.append(last)
            last = _after(last, list(r.upto), list(r.exits), r.fresh, gap, inclusive)
        return pd.DataFrame({"part": pdf.sort_values("part")["part"], "first_key": pdf["k"].iloc[0], "entry": pd.array(out, "Int64")})

    entries = ranged.groupBy("part").applyInArrow(steps, "k string, part int, upto array<long>, exits array<long>, fresh long").groupBy("k").applyInPandas(entered, "part int, first_key string, entry long").filter("entry is not null")
    kinds = f"part int, item {ranged.schema['item'].dataType.simpleString()}"

    def marked(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        entry = {k: e for k, e in zip(table.column("first_key").to_pylist()[:1], table.column("entry").to_pylist()[:1])}
        at = [a + i for k, a, _, times in sections(table) for i in _Section(times, gap, inclusive).kept(entry.get(k))]
        return table.select(["part", "item"]).take(pa.array(at, pa.int64()))

    # A range's first key alone can come from before, so there is one entry a range at most.
    return ranged.join(entries, "part", "left").groupBy("part").applyInArrow(marked, kinds).select(F.col("item").alias(item))


def folded(df: DataFrame, key: str, order: list[str], columns: list[str], first: Callable[[], dict], step: Callable[[dict, dict], None], schema: str) -> DataFrame:
    """A row a key: the state after all its rows in order, by step(state, row), from first().

    Rows pass by sorted, in batches; a task holds one state at a time, whatever the length of a key's log. Null keys are
    one key. schema lists the state's fields, without the key.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema]
    rows = df.select(key, *[c for c in dict.fromkeys([*order, *columns]) if c != key]).repartition(key).sortWithinPartitions(key, *order)
    out_schema = df.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []  # key as text, key, state
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                own = json.dumps(row[key], default=str)
                if not held or held[0] != own:
                    if held:
                        done.append((held[1], *(held[2][n] for n in names)))
                    held = [own, row[key], first()]
                step(held[2], row)
            yield pd.DataFrame(done, columns=[key, *names], dtype=object)
        if held:
            yield pd.DataFrame([(held[1], *(held[2][n] for n in names))], columns=[key, *names], dtype=object)

    return rows.mapInPandas(run, out_schema)
