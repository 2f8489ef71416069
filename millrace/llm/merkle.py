"""Merkle manifest of a dataset: a postorder append log per group of rows, written by aligned builders, and proofs from it.

Leaves of a group are numbered in order. A builder takes an aligned block of 1024 consecutive leaves and appends nodes as
they complete: a leaf, then every node whose last leaf that was. The roots of the blocks are the leaves of the next
builders, until one node of the group remains; the groups' roots make a last tree in the same way. Two consecutive nodes
become the hash of their digests; the last one of an odd level becomes the hash of its own.

A log is in completion order, so a node's place follows from its level and index alone: before the subtree that starts at
leaf x, the log holds 2x - popcount(x) nodes, and the subtree itself has ceil(m/2^j) nodes on each level j for its m
leaves. Proofs address siblings by these places and search nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import numbered

from .common import staged

#: Levels that one builder adds above its leaves.
LEVELS = 10
_HEX = 64


def digest_of(columns: Sequence[str | Column]) -> Column:
    """SHA-256 (hex) of the columns, each `-` if null, else its length in UTF-8 bytes, a colon, and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(*digests: bytes) -> bytes:
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def tree_height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def postorder_place(level: np.ndarray, index: np.ndarray, leaves: int) -> np.ndarray:
    """Places of nodes (level, index) in the postorder log of a tree over so many leaves."""
    level, index = np.asarray(level, np.int64), np.asarray(index, np.int64)
    first = index << level
    under = np.minimum(np.int64(1) << level, leaves - first)
    size = np.zeros(np.broadcast(level, index).shape, np.int64)
    for j in range(int(level.max(initial=0)) + 1):
        size += np.where(j <= level, (under + (1 << j) - 1) >> j, 0)
    return 2 * first - np.bitwise_count(first).astype(np.int64) + size - 1


def append_nodes(leaves: list[bytes], height: int) -> list[bytes]:
    """The log of a block: its nodes up to level `height` in the order in which they complete."""
    log, open_ = [], [b""] * (height + 1)
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        while level < height and ((i >> level) & 1 or i == len(leaves) - 1):
            node = _joined(open_[level], node) if (i >> level) & 1 else _joined(node)
            log.append(node)
            level += 1
        open_[level] = node
    return log


def _height(n: int, levels: int) -> int:
    return min(levels, tree_height(n))


def _built(extra: list[str], levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))
            logs, roots = [], []
            for digests, n in zip(of("digests"), of("n").to_pylist()):
                log = append_nodes([d.encode() for d in digests.as_py()], _height(n, levels))
                logs.append(b"".join(log))
                roots.append(log[-1].decode())
            names = ["grp", "block", "n", *extra]
            yield pa.RecordBatch.from_arrays([*(of(c) for c in names), pa.array(logs, pa.binary()), pa.array(roots, pa.string())], [*names, "log", "root"])

    return run


def append_log(leaves: DataFrame, extra: Sequence[str] = (), levels: int = LEVELS) -> list[DataFrame]:
    """Log segments of all groups, a table for each round of builders; a group's last round is one segment.

    leaves: grp (not null), idx (from 0 in the group), n (leaves of the group), digest, and extra columns that the first
    round keeps as arrays. A row of a round: grp, block, n (nodes that the round starts from), log (64 hex digits a node),
    root. An empty table gives one empty round.
    """
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    most = leaves.agg(F.max("n")).first()[0] or 0
    rounds, rows, keep = [], leaves, list(extra)
    while True:
        row = F.sort_array(F.collect_list(F.struct("idx", "digest", *keep)))
        blocks = rows.groupBy("grp", F.shiftright("idx", levels).alias("block"), "n").agg(row.alias("r"))
        blocks = blocks.select("grp", "block", "n", F.col("r.digest").alias("digests"), *[F.col(f"r.{c}").alias(c) for c in keep])
        schema = ", ".join(["grp string, block long, n long", *(f"{c} array<{kinds[c]}>" for c in keep), "log binary, root string"])
        rounds.append(staged(blocks.mapInArrow(_built(keep, levels), schema), "log"))
        most = (most + (1 << levels) - 1) >> levels
        if most <= 1:
            return rounds
        above = F.shiftright(F.col("n") + ((1 << levels) - 1), levels)
        # A group that is complete takes no part in further rounds.
        rows = rounds[-1].filter(F.col("n") > 1 << levels).select("grp", F.col("block").alias("idx"), above.alias("n"), F.col("root").alias("digest"))
        keep = []


def _siblings(log: bytes, leaves: int, height: int) -> list[list[bytes]]:
    """For each leaf, level by level: `L` or `R` and the sibling's digest, or nothing for a node that has none."""
    own = np.arange(leaves, dtype=np.int64)
    out: list[list[bytes]] = [[] for _ in range(leaves)]
    for level in range(height):
        beside = (own >> level) ^ 1
        there = (beside << level) < leaves
        place = postorder_place(np.full(leaves, level), np.where(there, beside, 0), leaves) * _HEX
        side = [b"L" if left else b"R" for left in (beside < own >> level).tolist()]
        for path, p, s, t in zip(out, place.tolist(), side, there.tolist()):
            path.append(s + log[p : p + _HEX] if t else b"")
    return out


def _segment_leaves(n: int, block: int, levels: int) -> int:
    return min(1 << levels, n - (block << levels))


def _descended(extra: str | None, levels: int):
    """Rows (grp, block, n, log, path, subroot, root[, extra array]) to a row a leaf: its path to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))
            for i in range(batch.num_rows):
                grp, block, n, log, above, subroot, root = (of(c)[i].as_py() for c in ("grp", "block", "n", "log", "path", "subroot", "root"))
                many = _segment_leaves(n, block, levels)
                steps = [[*own, *([] if above is None else [above])] for own in _siblings(log, many, _height(n, levels))]
                paths = [b",".join(s) if s else None for s in steps]  # a path of one empty step is not an empty path
                leaf = postorder_place(np.zeros(many, np.int64), np.arange(many), many) * _HEX
                keys = of(extra)[i].as_py() if extra else [grp] * many
                under = [subroot] * many if subroot else [log[p : p + _HEX].decode() for p in leaf.tolist()]
                at = list(range(block << levels, (block << levels) + many))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int64()), pa.array(paths, pa.binary()), pa.array(under, pa.string()), pa.array([root] * many, pa.string())], ["grp", "block", "path", "subroot", "root"])

    return run


_PATHS = "grp string, block long, path binary, subroot string, root string"


def _paths_above(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Paths from the segments of the first round to the root, given those of each group's last segment (block 0)."""
    paths = tops
    for table in rounds[:0:-1]:
        here = table.select("grp", "block", "n", "log").join(paths, ["grp", "block"])
        # Paths of groups that were complete before this round stay as they are.
        rest = paths.join(table.select("grp").distinct(), "grp", "left_anti")
        paths = here.mapInArrow(_descended(None, levels), _PATHS).unionByName(rest)
    return paths


def _verified(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: batch.column(batch.schema.get_field_index(name))
            for i in range(batch.num_rows):
                block, n, log, above, subroot, root, ids, claimed = (of(c)[i].as_py() for c in ("block", "n", "log", "path", "subroot", "root", "id", "claimed"))
                many, upper = _segment_leaves(n, block, levels), above.split(b",") if above is not None else []
                upper_digests = b"".join(s[1:] for s in upper)
                leaf = [log[p : p + _HEX].decode() for p in (postorder_place(np.zeros(many, np.int64), np.arange(many), many) * _HEX).tolist()]
                proofs, folded, seen = [], [], {}
                for own, start in zip(_siblings(log, many, _height(n, levels)), claimed):
                    proofs.append(hashlib.sha256(b"".join(s[1:] for s in own) + upper_digests).hexdigest())
                    node = fold(start.encode(), own)
                    if node not in seen:  # most leaves of a block meet in its root
                        seen[node] = fold(node, upper).decode()
                    folded.append(seen[node])
                columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (leaf, [subroot] * many, [root] * many, proofs, folded)), pa.array([f == root for f in folded], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for step in path:
        leaf = _joined(leaf) if not step else _joined(step[1:], leaf) if step[:1] == b"L" else _joined(leaf, step[1:])
    return leaf


def log_nodes(rounds: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """All nodes of the groups' logs: grp, position (in the group's postorder over all rounds), level, idx, digest."""
    schema = "grp string, position long, level int, idx long, digest string"

    def flat(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for grp, block, n, leaves, log in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    many = _segment_leaves(n, block, levels)
                    # A round's first level is the last one of the round before.
                    for level in range(1 if base else 0, _height(n, levels) + 1):
                        idx = np.arange((many + (1 << level) - 1) >> level, dtype=np.int64)
                        place = postorder_place(np.full(len(idx), level), idx, many) * _HEX
                        whole = idx + (block << (levels - level))
                        at = postorder_place(np.full(len(idx), base + level), whole, leaves)
                        columns = [pa.array([grp] * len(idx)), pa.array(at), pa.array(np.full(len(idx), base + level, np.int32)), pa.array(whole), pa.array([log[p : p + _HEX].decode() for p in place.tolist()])]
                        yield pa.RecordBatch.from_arrays(columns, ["grp", "position", "level", "idx", "digest"])

        return run

    leaves = rounds[0].groupBy("grp").agg(F.max("n").alias("leaves"))
    parts = [t.join(leaves, "grp").select("grp", "block", "n", "leaves", "log").mapInArrow(flat(i * levels), schema) for i, t in enumerate(rounds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_leaves(docs: DataFrame, columns: Sequence[str], group_col: str, id_col: str, claimed: Column | None = None) -> DataFrame:
    """Leaves of a table: grp (`` for a null group, else `=` and its text), idx, n, digest, id, claimed digest.

    Rows of a group ascend by id, null ids first; rows that repeat an id, by digest.
    """
    own = digest_of(columns)
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"), F.col(id_col).cast("long").alias("id"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed"))
    # Equal rows need a difference, or a much repeated one would be one range.
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(rows, ["grp", "id", "digest", "row"], "place")
    # Written, so that the join knows its size and rows of a large group need not meet by key.
    spans = staged(placed.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n")), "spans")
    return placed.join(spans, "grp").select("grp", (F.col("place") - F.col("first")).alias("idx"), "n", "digest", "id", "claimed")


def merkle_manifest(docs: DataFrame, columns: Sequence[str], group_col: str = "lang", id_col: str = "doc_id", claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Builds the logs and verifies each row's claimed leaf digest (its own if none is given) against the root.

    Returns doc_id, leaf, subroot (the group's root), root, proof_sha256 (SHA-256 of the siblings' digests from the leaf up
    to the root), folded_root (from the claimed leaf and the siblings), verified (whether that is the root). Groups are
    ordered by their text, null first. Null values are leaves' values like others; a null id stays null; repeated rows are
    leaves of their own; a group of one leaf is that leaf; texts of any length count whole; other columns are ignored; an
    empty table gives an empty result.
    """
    rounds = append_log(group_leaves(docs, columns, group_col, id_col, claimed), ["id", "claimed"], levels)
    # The last segment of a group: the only one of a round.
    roots = rounds[0].filter(F.col("n") <= 1 << levels).select("grp", "root")
    for table in rounds[1:]:
        roots = roots.unionByName(table.filter(F.col("n") <= 1 << levels).select("grp", "root"))
    roots = staged(roots, "roots")
    ordered = numbered(roots, ["grp"], "place").select(F.lit("").alias("grp"), (F.col("place") - 1).alias("idx"), F.lit(roots.count()).cast("long").alias("n"), F.col("root").alias("digest"), F.col("grp").alias("key"))
    upper = append_log(ordered, ["key"], levels)
    top = upper[-1].select("grp", F.lit(0).cast("long").alias("block"), F.lit(None).cast("binary").alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    firsts = upper[0].drop("root").join(_paths_above(upper, top, levels).select("grp", "block", "path", "root"), ["grp", "block"]).withColumn("subroot", F.lit(None).cast("string"))
    tops = firsts.mapInArrow(_descended("key", levels), _PATHS).withColumn("block", F.lit(0).cast("long"))
    paths = _paths_above(rounds, staged(tops, "tops"), levels)
    return rounds[0].drop("root").join(paths, ["grp", "block"]).mapInArrow(_verified(levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
