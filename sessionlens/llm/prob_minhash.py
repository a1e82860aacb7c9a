"""Near copies by ProbMinHash.

Every distinct word shingle of a text is a Poisson process whose rate is the shingle's weight. Its points fall on the
signature's registers at random; a register keeps the shingle that comes first, so two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. All weights are 1 here, however often a shingle occurs: then this is
the Jaccard similarity of the distinct shingles, by which links are defined. A shingle stops as soon as its next point lies
behind the last register of its text. Bands of registers give candidates, a byte sketch of the signature drops the clear misses, and
a pair is linked when the exact Jaccard similarity of its distinct shingles reaches the threshold.

Exact copies are one node. In each bucket of a band every member is compared with the bucket's hub (each band draws other
hubs), first by sketch, which gives clusters of texts that look alike, then exactly, which gives the links of most groups. What
is apart after that is compared tile by tile: members of a bucket in different clusters by sketch, parts of a cluster by their
shingles. A part of any size is not compared within itself, tasks hold two tiles, and they return links that join parts, never all pairs.
No link is lost to a cap: two texts that share a bucket and whose sketches agree are in one cluster, and there in one part or compared.

Null and repeated ids, null and empty texts: a null text is a class of its own; equal texts (empty ones too) are copies; the
row kept of a class is the one with the smallest id (null last), of equal rows one. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import components
from sessionlens.llm.ragged import batches, mix, offsets
from sessionlens.llm.shingles import shingles
from sessionlens.session import stage

BANDS, ROWS = 24, 4
#: Registers of 96 that agree at least. A pair of similarity 0.8 falls short of it about once in three million.
LEAST_AGREEING = 56
#: Members of a bucket or cluster that meet in a task at a time.
TILE, SET_TILE = 512, 256


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mix(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Winning shingle of every register, one row per text; rows of texts without shingles are zero."""
    winner = np.zeros(n_texts * registers, np.uint64)
    first = np.full(n_texts * registers, np.inf)
    x, turn = np.zeros(len(text)), 0
    while len(text):
        turn = (turn + 0xD1B54A32D192ED03) % (1 << 64)
        seed = hashes + np.uint64(turn)
        x = x - np.log(_uniform(seed)) / weights
        slot = text * registers + (mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        closer = np.flatnonzero(x < first[slot])
        order = closer[np.lexsort((hashes[closer], x[closer], slot[closer]))]
        keep = order[np.concatenate([[True], slot[order][1:] != slot[order][:-1]])] if len(order) else order
        first[slot[keep]], winner[slot[keep]] = x[keep], hashes[keep]
        last = first.reshape(n_texts, registers).max(axis=1)
        going = np.flatnonzero(x < last[text])
        text, hashes, weights, x = text[going], hashes[going], weights[going], x[going]
    return winner.reshape(n_texts, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: equal where a band's registers are equal."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            k = mix(k ^ sig[:, b * ROWS + r])
        keys[:, b] = k
    return keys


def signed(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """``(row, doc_id, digest, bands, sketch)``: one row per document; bands and sketch are null without shingles."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            for part in batches([len(t) for t in texts], 1_000_000):
                group = frame.iloc[part]
                text, hashes, _ = shingles(texts[part], words)
                sig = signatures(text, hashes, np.ones(len(text)), len(group))
                some = np.zeros(len(group), bool)
                some[text] = True
                keys, sketch = band_keys(sig).view(np.int64), (sig >> np.uint64(40)).astype(np.uint8)
                yield pd.DataFrame({"row": group["row"], "doc_id": group["doc_id"], "digest": group["digest"],
                                    "bands": [k if s else None for k, s in zip(keys, some, strict=True)],
                                    "sketch": [k.tobytes() if s else None for k, s in zip(sketch, some, strict=True)]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(text_column, 256)).alias("digest"), F.col(text_column).alias("text"))
    return rows.mapInPandas(sign, "row long, doc_id long, digest binary, bands array<long>, sketch binary")


def shingle_sets(wanted: DataFrame, docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """``(node, hashes)`` of the nodes wanted (node, doc_id, digest): the distinct shingles' 64-bit hashes, ascending."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame["text"].str.len().tolist(), 1_000_000):
                group = frame.iloc[part]
                text, hashes, _ = shingles(group["text"].tolist(), words)
                at = np.searchsorted(text, np.arange(len(group) + 1))
                yield pd.DataFrame({"node": group["node"], "hashes": [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(text_column, 256)).alias("digest"), F.col(text_column).alias("text"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["digest"] == wanted["digest"])).select("node", "text")
    # Repeated equal rows give a node several times; one set is enough.
    return found.mapInPandas(sets, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the node pairs ``(a, b)``, those whose shingles reach the threshold. A hub's many pairs may be split among tasks."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= threshold - 1e-12 for x, y in zip(frame["x"], frame["y"], strict=True)]
            yield frame.loc[np.array(keep, bool), ["a", "b"]]

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return with_both.select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


class Merges:
    """Components met so far in a block; ``join`` says whether two of them were apart."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def by_sketch(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple[int, int]]:
    """Pairs of rows in different components whose sketches agree enough, as far as they join components of this block."""
    sa, sb = (np.frombuffer(b"".join(x["data"]), np.uint8).reshape(len(x), BANDS * ROWS) for x in (a, b))
    ca, cb, na, nb = a["component"].tolist(), b["component"].to_numpy(), a["node"].tolist(), b["node"].tolist()
    merges, out = Merges(), []
    for i in range(len(a)):
        for j in np.flatnonzero((cb != ca[i]) & ((sb == sa[i]).sum(axis=1) >= LEAST_AGREEING)).tolist():
            if merges.join(ca[i], int(cb[j])):
                out.append((na[i], nb[j]))
    return out


def by_set(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """The same for the exact similarity of the rows' shingles."""
    sets_b = [np.frombuffer(x, np.uint64) for x in b["data"]]
    size_b, at = np.array([len(x) for x in sets_b]), offsets(np.array([len(x) for x in sets_b]))
    names, codes = np.unique(np.concatenate(sets_b), return_inverse=True) if len(sets_b) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    mark = np.zeros(len(names) + 1, np.int64)
    cb, nb = b["component"].tolist(), b["node"].tolist()
    merges, out = Merges(), []
    for data, component, node in zip(a["data"], a["component"].tolist(), a["node"].tolist(), strict=True):
        own = np.frombuffer(data, np.uint64)
        known = np.searchsorted(names, own)
        known = known[names[np.minimum(known, len(names) - 1)] == own] if len(names) else known
        mark[known] = 1
        both = np.diff(np.concatenate([[0], np.cumsum(mark[codes])])[at])
        mark[known] = 0
        near = np.flatnonzero(both >= (threshold - 1e-12) * (len(own) + size_b - both))
        for j in near.tolist():
            if both[j] and cb[j] != component and merges.join(component, cb[j]):
                out.append((node, nb[j]))
    return out


def compared(rows: DataFrame, solve: Callable[[pd.DataFrame, pd.DataFrame], list[tuple[int, int]]], tile: int) -> DataFrame:
    """Links ``(a, b)`` between rows (key, node, component, data) of one key in different components.

    A component of ``tile`` members or more has tiles of its own, which are not compared with each other; the members of smaller ones
    share tiles. A task compares two tiles at a time and returns links that join components, no more than there are rows.
    """
    rows = stage(rows, "blocks")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("own", F.when(F.col("n") >= tile, F.col("component")))
    tiles_of = stage(sizes.groupBy("key", "own").agg((F.floor((F.sum("n") - 1) / tile) + 1).cast("int").alias("tiles")), "tile-counts")
    sizes = stage(sizes.select("key", "component", "own"), "component-sizes")
    spot = rows.join(sizes, ["key", "component"]).join(tiles_of.withColumnsRenamed({"key": "k", "own": "o"}), (F.col("key") == F.col("k")) & F.col("own").eqNullSafe(F.col("o")))
    # The members of a small component go to one tile.
    turn = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node")), "tiles")
    placed = stage(spot.select("key", "node", "component", "data", F.xxhash64("key", "own", turn).alias("tile"), "own"), "tiles")
    tiles = placed.groupBy("key", "tile").agg(F.first("own").alias("own"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    tiles = stage(tiles, "tile-list")
    left, right = (tiles.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("tile", "own", "lo", "hi")]) for k in (1, 2))
    apart = F.when(F.col("tile1") == F.col("tile2"), F.col("lo1") != F.col("hi1")).otherwise(~F.coalesce(F.col("own1") == F.col("own2"), F.lit(False)))
    pairs = stage(left.join(right, "key").where((F.col("tile1") <= F.col("tile2")) & apart).select("key", "tile1", "tile2"), "tile-pairs")
    body = placed.select(F.col("key").alias("k"), "node", "component", "data", "tile")
    first = pairs.join(body, (pairs["key"] == body["k"]) & (pairs["tile1"] == body["tile"])).withColumn("side", F.lit(1))
    second = pairs.where("tile1 != tile2").join(body, (pairs["key"] == body["k"]) & (pairs["tile2"] == body["tile"])).withColumn("side", F.lit(2))
    work = first.unionByName(second).select("key", "tile1", "tile2", "side", "node", "component", "data")

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None

        def links() -> pd.DataFrame:
            group = pd.concat(held) if len(held) > 1 else held[0]
            one, two = group[group["side"] == 1], group[group["side"] == 2]
            return pd.DataFrame(solve(one, two if len(two) else one), columns=["a", "b"], dtype="int64")

        for frame in frames:
            names = list(zip(frame["key"], frame["tile1"], frame["tile2"], strict=True))
            start = 0
            for i, name in enumerate(names):
                if name != last:
                    if i > start:
                        held.append(frame.iloc[start:i])
                    if held:
                        yield links()
                    held, start, last = [], i, name
            if len(frame) > start:
                held.append(frame.iloc[start:])
        if held:
            yield links()

    order = ("key", "tile1", "tile2", "side")
    return work.repartition("key", "tile1", "tile2").sortWithinPartitions(*order).mapInPandas(runs, "a long, b long").where("a != b")


def joined_components(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components ``(node, component)`` of nodes that are in some already, after further links between these."""
    ends = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    more = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), name).select(F.col("node").alias("component"), F.col("component").alias("further"))
    return known.join(more, "component", "left").select("node", F.coalesce("further", "component").alias("component"))


def open_keys(placed: DataFrame, key: str) -> DataFrame:
    """Keys whose members are in several components."""
    ends = placed.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select(key)
    return stage(ends, "open")


def near_copies(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its class), ``kept`` (one row per class), ``digest`` of the text."""
    rows = stage(signed(docs, words, id_column, text_column), "signed")
    # Exact copies are one node; it is named after its first row.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = F.when(F.col("digest").isNull(), F.col("row"))
    keyed = rows.withColumn("own", own)
    nodes = keyed.groupBy("digest", "own").agg(F.min(order).alias("o"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.select(F.col("o.row").alias("node"), F.col("o.doc_id").alias("doc_id"), "digest", "own", "bands", "sketch"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    draw = F.min(F.struct(F.xxhash64("key", "node").alias("draw"), "node"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), draw.alias("hub")).where("n > 1").select("key", F.col("hub.node").alias("hub"))
    # Staged sides leave both ends of a join to be dealt out anew, so that a large bucket's rows may be split among tasks.
    buckets = stage(buckets, "hubs")
    shared = stage(members.join(buckets, "key").select("key", "node", "hub"), "buckets")
    sketches = nodes.select(F.col("node"), "sketch")
    stars = shared.where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    stars = stars.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    stars = stage(agreeing(stars), "stars")
    # Clusters: members of a bucket that look alike. Hubs join most; what a bucket still has apart is compared by sketch.
    near = components(stars, "near")
    known = shared.select("node").distinct().join(near, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    known = stage(known, "near")
    placed = stage(shared.join(known, "node").select("key", "node", "component"), "placed")
    rest = placed.join(open_keys(placed, "key"), "key").join(sketches, "node").select("key", "node", "component", F.col("sketch").alias("data"))
    extra = stage(compared(rest, by_sketch, TILE), "extra")
    clusters = stage(joined_components(known, extra, "clusters"), "clusters")
    # Links: hubs' pairs first, then, in clusters that are still apart, all pairs between their parts, tile by tile.
    pairs = stars.unionByName(extra.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "digest"), "node")
    sets = stage(shingle_sets(wanted, docs, words, id_column, text_column), "sets")
    first = components(verified(pairs, sets, threshold), "first")
    parts = stage(clusters.join(first.withColumnRenamed("component", "part"), "node", "left").select(F.col("component").alias("key"), "node", F.coalesce("part", "node").alias("component")), "parts")
    rest = parts.join(open_keys(parts, "key"), "key").join(sets.withColumnRenamed("hashes", "data"), "node").select("key", "node", "component", "data")
    second = compared(rest, lambda a, b: by_set(a, b, threshold), SET_TILE)
    final = joined_components(parts.select("node", "component"), second, "final")
    of_node = nodes.select("node", "digest", "own").join(final, "node", "left").select("digest", "own", F.coalesce("component", "node").alias("component"))
    same = keyed["digest"].eqNullSafe(of_node["digest"]) & keyed["own"].eqNullSafe(of_node["own"])
    classed = stage(keyed.join(of_node, same).select("row", keyed["doc_id"], keyed["digest"], "component"), "classed")
    heads = stage(classed.groupBy("component").agg(F.min(order).alias("head")), "heads")
    return classed.join(heads, "component").select("doc_id", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"), "digest")


def without_near_copies(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns as they were. Of repeated equal rows that are kept, one stays."""
    kept = near_copies(docs, threshold, words, id_column, text_column).where("kept").select("doc_id", "digest")
    kept = stage(kept.groupBy("doc_id", "digest").agg(F.count("*").alias("times")), "kept")
    digest = F.unhex(F.sha2(docs[text_column], 256))
    stays = docs.join(kept, docs[id_column].cast("long").eqNullSafe(kept["doc_id"]) & digest.eqNullSafe(kept["digest"]), "left_semi")
    # Null texts are classes of their own, however often their id occurs; other rows of one id and text are copies.
    nulls, texts = stays.where(F.col(text_column).isNull()), stays.where(F.col(text_column).isNotNull())
    again = docs.select(F.col(id_column).cast("long").alias("_id"), F.unhex(F.sha2(text_column, 256)).alias("_digest")).groupBy("_id", "_digest").agg(F.count("*").alias("_n")).where("_n > 1 and _digest is not null")
    again = stage(again.select("_id", "_digest"), "repeated-rows")
    if not again.limit(1).count():
        return stays
    repeated = texts[id_column].cast("long").eqNullSafe(again["_id"]) & F.unhex(F.sha2(texts[text_column], 256)).eqNullSafe(again["_digest"])
    once = texts.join(again, repeated, "left_anti")
    first = texts.join(again, repeated, "left_semi").dropDuplicates([id_column, text_column])
    return nulls.unionByName(once).unionByName(first)


def agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sketches ``sa`` and ``sb`` agree enough."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a, b = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(len(frame), -1) for c in ("sa", "sb"))
                yield frame.loc[(a == b).sum(axis=1) >= LEAST_AGREEING, ["a", "b"]]

    return pairs.select("a", "b", "sa", "sb").mapInPandas(keep, "a long, b long")
