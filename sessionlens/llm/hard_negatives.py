"""Hard negatives by maximum inner product search over an STR-packed R-tree.

Rows are dealt out by label and first coordinate; every task packs its rows by sort-tile-recursive: cut into slabs of one coordinate, each
slab by the next, until leaves of ``LEAF`` rows are left. ``FANOUT`` neighbours share a parent, up to the root of a shard. A node keeps the
box around its rows; each coordinate of a box bounds that coordinate's part of an inner product from both sides, and the sums bound the
score. A query keeps its open nodes with their upper bounds and opens the best ones first; a node goes if its bounds miss the query's score
window, if its labels do not fit, or if its upper bound is strictly below the worst of the k rows found so far.

Anchors are packed into blocks. A task holds one shard and reads the blocks one at a time (blocks of equal anchors, without a cross join: a
block is sent once to every shard it must search). It returns k rows per anchor and window; those of all shards are merged block by block.
The first search finds the nearest rows of the anchor's own label; each of them opens a score window for the second, among other labels.

Scores are exact 64-bit integers. Rows take no part if their id, label or vector or a component is null, or if a component is so large
that a score might leave 64 bits (above the root of 2**62 by the vector's length). Only vectors of one length meet; empty ones score 0.
Ties go to the smaller id. Repeated ids are rows of their own, but no row is compared with one of its own id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.session import stage

#: Rows of a shard (one R-tree), of a leaf, children of a node, anchors of a block.
SHARD, LEAF, FANOUT, ANCHORS = 4096, 64, 8, 512
#: Nodes a query opens at a time.
WAVE = 8
NONE = np.iinfo(np.int64).min


def packed(values: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 or 8 bytes, which the first byte names."""
    most = int(np.abs(values).max()) if values.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind[-1].encode() + values.astype(kind).tobytes()


def unpacked(data: bytes, rows: int) -> np.ndarray:
    values = np.frombuffer(data, f"<i{data[:1].decode()}", offset=1)
    return values.reshape(rows, len(values) // rows if rows else 0)


def str_order(vectors: np.ndarray, leaf: int, first: int = 0) -> np.ndarray:
    """Sort-tile-recursive order of the rows: every ``leaf`` rows in it are a leaf."""
    n, d = vectors.shape
    pages = -(-n // leaf)
    if pages <= 1 or first >= d:
        return np.arange(n)
    slabs = int(np.ceil(round(pages ** (1 / (d - first)), 9)))
    order = np.argsort(vectors[:, first], kind="stable")
    size = -(-pages // slabs) * leaf
    return np.concatenate([part[str_order(vectors[part], leaf, first + 1)] for part in (order[i : i + size] for i in range(0, n, size))])


class Tree:
    """An R-tree over rows in packed order; nodes are numbered from the leaves up, the root is the last."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.most = int(np.abs(vectors).max()) if vectors.size else 0
        starts = np.arange(0, len(ids), LEAF)
        low, high = np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts)
        first, last = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        self.leaves = len(starts)
        children: list[tuple[int, int]] = []
        levels, begin = [(low, high, first, last)], 0
        while len(levels[-1][0]) > 1:
            low, high, first, last = levels[-1]
            n = len(low)
            starts = np.arange(0, n, FANOUT)
            children += [(begin + s, begin + min(s + FANOUT, n)) for s in starts.tolist()]
            begin += n
            levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts)))
        self.low, self.high, self.first, self.last = (np.concatenate(x) for x in zip(*levels, strict=True))
        self.children = [(0, 0)] * self.leaves + children

    def search(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the first k rows of each window (queries x windows x k; ``NONE`` where there are none)."""
        q, windows = low.shape
        # Doubles are exact for sums below 2**53, and their products fast.
        size = max(1, queries.shape[1]) * self.most * (int(np.abs(queries).max()) if queries.size else 0)
        kind = np.float64 if size < 1 << 53 else np.int64
        queries, vectors = queries.astype(kind), self.vectors.astype(kind)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        box_low, box_high = self.low.astype(kind), self.high.astype(kind)
        best = np.full((q, windows, k), NONE)
        best_id = np.full((q, windows, k), np.iinfo(np.int64).max)
        alive = low <= high
        # Open nodes of every query: the bounds of their scores, NONE for nodes that are not open.
        upper = np.full((q, len(self.low)), NONE)
        lower = np.zeros_like(upper)

        def opened(rows: np.ndarray, a: int, b: int) -> None:
            fits = np.ones((len(rows), b - a), bool)
            if same_label:
                fits = (self.first[a:b] <= labels[rows, None]) & (labels[rows, None] <= self.last[a:b])
            else:
                fits = (self.first[a:b] != self.last[a:b]) | (self.first[a:b] != labels[rows, None])
            up = (plus[rows] @ box_high[a:b].T + minus[rows] @ box_low[a:b].T).astype(np.int64)
            upper[rows, a:b] = np.where(fits, up, NONE)
            lower[rows, a:b] = (plus[rows] @ box_low[a:b].T + minus[rows] @ box_high[a:b].T).astype(np.int64)

        root = len(self.low) - 1
        opened(np.arange(q), root, root + 1)
        active = np.flatnonzero(alive.any(axis=1))
        while len(active):
            bounds = upper[active]
            wave = min(WAVE, bounds.shape[1])
            nodes = np.argpartition(-bounds.astype(np.float64), wave - 1, axis=1)[:, :wave] if wave < bounds.shape[1] else np.tile(np.arange(wave), (len(active), 1))
            rows = np.repeat(active, wave)
            nodes = nodes.ravel()
            up, down = upper[rows, nodes], lower[rows, nodes]
            is_open = up != NONE
            upper[rows, nodes] = NONE
            useful = (alive[rows] & (up[:, None] >= np.maximum(low[rows], best[rows, :, -1])) & (down[:, None] <= high[rows])).any(axis=1) & is_open
            rows, nodes = rows[useful], nodes[useful]
            order = np.argsort(nodes, kind="stable")
            rows, nodes = rows[order], nodes[order]
            cuts = np.flatnonzero(np.diff(nodes)) + 1
            for group, node in zip(np.split(rows, cuts), nodes[np.concatenate([[0], cuts]).astype(int)] if len(nodes) else (), strict=False):
                if node >= self.leaves:
                    opened(group, *self.children[node])
                    continue
                at = slice(node * LEAF, (node + 1) * LEAF)
                scores = (queries[group] @ vectors[at].T).astype(np.int64)
                fits = (labels[group, None] == self.labels[at]) == same_label
                fits &= ids[group, None] != self.ids[at]
                for w in range(windows):
                    kth, kth_id = best[group, w, -1, None], best_id[group, w, -1, None]
                    better = fits & (scores >= low[group, w, None]) & (scores <= high[group, w, None]) & ((scores > kth) | ((scores == kth) & (self.ids[at] < kth_id)))
                    some = np.flatnonzero(better.any(axis=1))
                    if len(some):
                        of = group[some]
                        merge(best, best_id, of, w, np.where(better[some], scores[some], NONE), np.broadcast_to(self.ids[at], (len(some), scores.shape[1])))
            active = active[(upper[active] != NONE).any(axis=1)]
        return best, best_id


def merge(best: np.ndarray, best_id: np.ndarray, of: np.ndarray, w: int, scores: np.ndarray, ids: np.ndarray) -> None:
    """Take further scores into the first k of the queries ``of``; ``NONE`` stands for no row."""
    k = best.shape[2]
    scores = np.concatenate([best[of, w], scores], axis=1)
    ids = np.where(scores == NONE, np.iinfo(np.int64).max, np.concatenate([best_id[of, w], ids], axis=1))
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    best[of, w] = np.take_along_axis(scores, order, axis=1)
    best_id[of, w] = np.take_along_axis(ids, order, axis=1)


def cut_rows(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows in the order they come, ``most`` at a time; vectors of one length only."""
    held: list[pd.DataFrame] = []
    total, size = 0, None
    for frame in frames:
        for s, run in frame.groupby("size", sort=False):
            while len(run):
                if held and (s != size or total >= most):
                    yield pd.concat(held, ignore_index=True)
                    held, total = [], 0
                size = s
                held.append(run.iloc[: most - total])
                run = run.iloc[most - total :]
                total += len(held[-1])
    if held:
        yield pd.concat(held, ignore_index=True)


def matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), int(rows["size"].iloc[0]))


PACKS = "pack long, size int, n int, ids binary, labels binary, vectors binary, kinds array<long>"


def _pack(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"pack": [TaskContext.get().partitionId() << 32 | number], "size": [vectors.shape[1]], "n": [len(ids)], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [packed(vectors)], "kinds": [np.unique(labels)]})


def make_shards(rows: DataFrame) -> DataFrame:
    """One R-tree's rows, in packed order, per row; ``kinds`` are its labels."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, shard in enumerate(cut_rows(frames, SHARD)):
            vectors, labels = matrix(shard), shard["label"].to_numpy(np.int64)
            # Labels with a leaf's rows and more have leaves of their own; smaller ones share them.
            starts = [0]
            for s in np.flatnonzero(np.diff(labels)) + 1:
                if s - starts[-1] >= LEAF:
                    starts.append(int(s))
            parts = [s + str_order(vectors[s:e], LEAF) for s, e in zip(starts, [*starts[1:], len(labels)], strict=True)]
            order = np.concatenate(parts)
            yield _pack(number, shard["id"].to_numpy(np.int64)[order], labels[order], vectors[order])

    first = F.get("vector", F.lit(0))
    ordered = rows.withColumn("first", first).repartitionByRange("size", "label", "first", F.xxhash64("id", "vector")).sortWithinPartitions("size", "label", "first", "id")
    return ordered.select("id", "label", "size", "vector").mapInPandas(build, PACKS)


def make_blocks(anchors: DataFrame) -> DataFrame:
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, block in enumerate(cut_rows(frames, ANCHORS)):
            yield _pack(number, block["id"].to_numpy(np.int64), block["label"].to_numpy(np.int64), matrix(block))

    ordered = anchors.repartitionByRange("size", "label", "id", F.xxhash64("vector")).sortWithinPartitions("size", "label", "id")
    return ordered.select("id", "label", "size", "vector").mapInPandas(build, PACKS)


FOUND = "block long, scores binary, found binary"


def searched(shards: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """For every pair (shard, block): the first k rows of each of the block's windows (``low``, ``high``, binary, anchors x windows)."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, labels, vectors = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64), unpacked(row.vectors, row.n)
                if row.turn == 0:
                    tree = Tree(ids, labels, vectors)
                    continue
                low, high = (np.frombuffer(x, np.int64).reshape(row.n, -1) for x in (row.low, row.high))
                scores, found = tree.search(ids, labels, vectors, low, high, k, same_label)
                if (scores != NONE).any():
                    yield pd.DataFrame({"block": [row.block], "scores": [scores.tobytes()], "found": [found.tobytes()]})

    body = ["n", "ids", "labels", "vectors"]
    held = shards.join(pairs.select(F.col("shard").alias("pack")).distinct(), "pack", "left_semi")
    none = F.lit(None).cast("binary")
    held = held.select(F.col("pack").alias("shard"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("block"), *body, none.alias("low"), none.alias("high"))
    sent = pairs.join(blocks.withColumnRenamed("pack", "block"), "block").select("shard", F.lit(1).alias("turn"), "block", *body, "low", "high")
    return held.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "turn", "block").mapInPandas(search, FOUND)


def merged(blocks: DataFrame, found: DataFrame, windows: int, k: int, done, schema: str) -> DataFrame:
    """Per block the first k of all shards' rows, given to ``done(block row, scores, ids)``, which makes a frame."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.turn == 0:
                    if held:
                        yield done(*held)
                    held = (row, np.full((row.n, windows, k), NONE), np.full((row.n, windows, k), np.iinfo(np.int64).max))
                    continue
                shape = held[1].shape
                scores, ids = np.frombuffer(row.scores, np.int64).reshape(shape), np.frombuffer(row.found, np.int64).reshape(shape)
                for w in range(windows):
                    merge(held[1], held[2], np.arange(shape[0]), w, scores[:, w], ids[:, w])
        if held:
            yield done(*held)

    own = blocks.withColumnsRenamed({"pack": "block"}).withColumn("turn", F.lit(0))
    both = own.unionByName(found.select("*", F.lit(1).alias("turn"), F.lit(0).alias("size"), F.lit(0).alias("n")), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "turn").mapInPandas(fold, schema)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the anchors of ``rows`` (id, label, vector of integers, is_anchor).

    An anchor's positives are its first ``positives`` other rows of its label. For each of them the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` per cent of the positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    size = F.size("vector")
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(size, F.lit(1))))
    fits = F.coalesce((F.array_max("vector") <= most) & (F.array_min("vector") >= -most), F.lit(True))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & fits
    kept = rows.where(usable).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), size.alias("size"), F.col("vector").cast("array<long>").alias("vector"), "is_anchor")
    kept = stage(kept, "vectors")
    shards = stage(make_shards(kept.drop("is_anchor")), "shards")
    blocks = stage(make_blocks(kept.where("is_anchor")), "anchor-blocks")

    def ends(packs: DataFrame, name: str) -> DataFrame:
        return packs.select(F.col("pack").alias(name), "size", "kinds")

    def everything(part: pd.DataFrame) -> list[bytes]:
        return [np.full((n, 1), v).tobytes() for n, v in zip(part["n"], part["fill"], strict=True)]

    def open_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(low=everything(frame.assign(fill=NONE + 1)), high=everything(frame.assign(fill=np.iinfo(np.int64).max)))

    windowed = f"{PACKS}, low binary, high binary"
    alike = ends(shards, "shard").select("shard", "size", F.explode("kinds").alias("label")).join(ends(blocks, "block").select("block", "size", F.explode("kinds").alias("label")), ["size", "label"])
    pairs = stage(alike.select("shard", "block").distinct(), "pairs-of-a-label")
    found = stage(searched(shards, blocks.mapInPandas(open_windows, windowed), pairs, positives, True), "positives")

    def windows_of(row, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        # Without a positive the window is empty.
        scores, ids = scores[:, 0], ids[:, 0]
        least = np.array([[1 if s == NONE else -(-int(s) * low // 100) for s in line] for line in scores], np.int64)
        most = np.array([[0 if s == NONE else int(s) * high // 100 for s in line] for line in scores], np.int64)
        return pd.DataFrame({"pack": [row.block], "size": [row.size], "n": [row.n], "ids": [row.ids], "labels": [row.labels], "vectors": [row.vectors], "kinds": [row.kinds],
                             "low": [least.tobytes()], "high": [most.tobytes()], "positive_ids": [ids.tobytes()], "positive_scores": [scores.tobytes()]})

    blocks = stage(merged(blocks, found, 1, positives, windows_of, f"{windowed}, positive_ids binary, positive_scores binary"), "windows")
    others = (F.size("kinds") > 1) | (F.size("block_kinds") > 1) | (F.col("kinds") != F.col("block_kinds"))
    unlike = ends(shards, "shard").join(ends(blocks, "block").withColumnRenamed("kinds", "block_kinds"), "size").where(others)
    pairs = stage(unlike.select("shard", "block"), "pairs-of-other-labels")
    found = stage(searched(shards, blocks.drop("positive_ids", "positive_scores"), pairs, negatives, False), "negatives")

    def rows_of(row, scores: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        anchor, positive, rank = np.nonzero(scores != NONE)
        of = lambda data: np.frombuffer(data, np.int64).reshape(row.n, positives)[anchor, positive]
        return pd.DataFrame({"anchor_id": np.frombuffer(row.ids, np.int64)[anchor], "positive_id": of(row.positive_ids), "rank": rank + 1, "negative_id": ids[anchor, positive, rank],
                             "positive_score": of(row.positive_scores), "negative_score": scores[anchor, positive, rank]})

    return merged(blocks, found, positives, negatives, rows_of, MINED)
