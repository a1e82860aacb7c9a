"""Near-copies of embeddings by tiled comparison in principal-component order.

Vectors are made of length 1 and turned onto the principal components of their second moments (a sum over all rows, one small
matrix at the driver), so the first coordinates hold most of every product. Within a label, rows are cut into tiles in the
order of the first coordinate; since cosine c means a distance of sqrt(2 - 2c), only tiles whose ranges come that close are
compared. A pair of tiles adds up leading coordinates block by block; what the rest can add is bounded by the product of the rests' norms,
and rows, columns and finally the whole pair are dropped as soon as no cosine can reach the threshold.

Equal vectors of a label are one row with a count, so a vector that a third of all rows share costs no pairs. A task reads two
tiles at a time and returns link counts per row and a spanning forest of its links, never the links themselves.

Null labels, null, empty or zero vectors, and vectors with null or non-finite components link with nothing; vectors of
different lengths do not link. Rows of null id have no component (null) and are kept. Rows that share an id and a vector are
copies like any others; rows that share an id with different vectors share its component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import components
from sessionlens.session import stage

TILE = 1024
#: Coordinates added at a time.
STEPS = (8, 16, 32)
#: Cosines this close to the threshold are computed again from the vectors as they came.
CLOSE = 1e-9


def matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64).reshape(len(values), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square leaves the range of doubles.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Axes of the most frequent vector length, strongest first. Others keep their own: the turn is for speed only."""
    size = rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not size:
        return {}
    d = size[0]["size"]

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for frame in frames:
            if len(frame):
                u = unit(matrix(frame["vector"]))
                total += u.T @ u
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": total.ravel()})

    cells = rows.where(F.col("size") == d).select("vector").mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((d, d))
    total[cells["i"], cells["j"]] = cells["s"]
    return {d: np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])}


def close_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` with a product of ``least`` or more, and the products. Rows have length 1."""
    d = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    rows, cols = np.arange(len(a)), np.arange(len(b))
    sums, done = np.zeros((len(a), len(b))), 0
    for step in [s for s in STEPS if s < d] + [d]:
        sums += a[rows, done:step] @ b[cols, done:step].T
        done = step
        if done == d:
            break
        possible = sums + np.outer(rest_a[rows, done], rest_b[cols, done]) >= least - 1e-12
        keep_rows, keep_cols = possible.any(axis=1), possible.any(axis=0)
        if not keep_rows.any():
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        rows, cols, sums = rows[keep_rows], cols[keep_cols], sums[np.ix_(keep_rows, keep_cols)]
    i, j = np.nonzero(sums >= least)
    return rows[i], cols[j], sums[i, j]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and their links: the smallest node each one reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def compare_tiles(left, right, same: bool, threshold: float) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Link counts ``(node, n)`` and forest links ``(a, b)`` of two tiles (or of one with itself)."""
    i, j, c = close_pairs(left["turned"], right["turned"], threshold - CLOSE)
    if same:
        upper = i < j
        i, j, c = i[upper], j[upper], c[upper]
    unsure = np.flatnonzero(np.abs(c - threshold) <= CLOSE)
    if len(unsure):
        x, y = left["vector"][i[unsure]], right["vector"][j[unsure]]
        exact = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        drop = unsure[~(exact >= threshold)]
        i, j = np.delete(i, drop), np.delete(j, drop)
    n = len(left["node"])
    nodes = left["node"] if same else np.concatenate([left["node"], right["node"]])
    copies = left["copies"] if same else np.concatenate([left["copies"], right["copies"]])
    k = j if same else j + n
    links = np.bincount(i, weights=copies[k], minlength=len(nodes)) + np.bincount(k, weights=copies[i], minlength=len(nodes))
    label = forest(i, k, len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    some = np.flatnonzero(links > 0)
    return pd.DataFrame({"node": nodes[some], "n": links[some].astype(np.int64)}), pd.DataFrame({"a": nodes[label[moved]], "b": nodes[moved]})


def make_tiles(groups: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """One row per tile: its label, vector length, range of the first coordinate, and its rows as packed doubles."""

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, group in frame.groupby("size"):
                u = unit(matrix(group["vector"]))
                turned = u @ axes[size] if size in axes else u
                yield pd.DataFrame({"node": group["node"], "label": group["label"], "size": group["size"], "copies": group["copies"], "first": turned[:, 0],
                                    "turned": [t.tobytes() for t in turned], "vector": [v.tobytes() for v in matrix(group["vector"])]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            return pd.DataFrame({"tile": [task << 32 | made], "label": rows["label"].iloc[:1].to_numpy(), "size": rows["size"].iloc[:1].to_numpy(), "low": [rows["first"].min()], "high": [rows["first"].max()],
                                 "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "copies": [rows["copies"].to_numpy(np.int64).tobytes()], "turned": [b"".join(rows["turned"])], "vectors": [b"".join(rows["vector"])]})

        held: list[pd.DataFrame] = []
        for frame in frames:
            for _, run in frame.groupby((frame[["label", "size"]] != frame[["label", "size"]].shift()).any(axis=1).cumsum()):
                if held and tuple(held[-1].iloc[0][["label", "size"]]) != tuple(run.iloc[0][["label", "size"]]):
                    yield pack(pd.concat(held))
                    held = []
                held.append(run)
                rows = pd.concat(held) if len(held) > 1 else run
                while len(rows) >= tile:
                    yield pack(rows.iloc[:tile])
                    rows = rows.iloc[tile:]
                held = [rows] if len(rows) else []
        if held:
            yield pack(pd.concat(held))

    ordered = groups.mapInPandas(turn, "node long, label long, size int, copies long, first double, turned binary, vector binary")
    ordered = stage(ordered, "turned").repartitionByRange("label", "size", "first").sortWithinPartitions("label", "size", "first", "node")
    return ordered.mapInPandas(cut, "tile long, label long, size int, low double, high double, nodes binary, copies binary, turned binary, vectors binary")


def linked(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    v = F.col(vector_column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(~F.exists(v, bad) & F.exists(v, lambda x: x != 0) & F.col(id_column).isNotNull() & F.col(label_column).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.when(usable, v).alias("vector"))
    some = rows.where(F.col("vector").isNotNull())
    groups = some.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    groups = stage(groups.select(F.monotonically_increasing_id().alias("node"), "label", "vector", "first_id", "copies", F.size("vector").alias("size")), "vector-groups")
    tiles = stage(make_tiles(groups.select("node", "label", "vector", "copies", "size"), principal_axes(groups), tile), "tiles")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    # Tiles meet in cells of the first coordinate: one side in every cell it can reach, the other in that of its low end only.
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    spans = tiles.select("label", "size", F.col("tile").alias("t1"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") + reach))).alias("cell"))
    ends = tiles.select("label", "size", F.col("tile").alias("t2"), F.col("low").alias("l2"), cell(F.col("low")).alias("cell"))
    later = (F.col("l2") > F.col("l1")) | ((F.col("l2") == F.col("l1")) & (F.col("t2") >= F.col("t1")))
    pairs = spans.join(ends, ["label", "size", "cell"]).where(later & (F.col("l2") - F.col("h1") <= reach)).select("t1", "t2", "size")
    body = lambda k: tiles.select(F.col("tile").alias(f"t{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("nodes", "copies", "turned", "vectors")])
    work = pairs.join(body(1), "t1").join(body(2), "t2")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                side = [{"node": np.frombuffer(n, np.int64), "copies": np.frombuffer(c, np.int64), "turned": np.frombuffer(t).reshape(-1, row.size), "vector": np.frombuffer(x).reshape(-1, row.size)}
                        for n, c, t, x in ((row.nodes1, row.copies1, row.turned1, row.vectors1), (row.nodes2, row.copies2, row.turned2, row.vectors2))]
                counts, links = compare_tiles(*side, row.t1 == row.t2, threshold)
                yield pd.concat([counts.assign(other=None), links.rename(columns={"a": "node", "b": "other"}).assign(n=None)])[["node", "n", "other"]].astype("Int64")

    found = stage(work.mapInPandas(compare, "node long, n long, other long"), "tile-links")
    links = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    # Links between groups, by the smallest id of each; a group's own copies lead to the same id.
    name = groups.select("node", "first_id")
    edges = found.where("other is not null").select("node", "other").join(name.withColumnRenamed("first_id", "a"), "node").join(name.select(F.col("node").alias("other"), F.col("first_id").alias("b")), "other").select("a", "b")
    shared = some.select("vec_id", "label", "vector").join(groups.select("label", "vector", "first_id"), ["label", "vector"]).where("vec_id != first_id")
    repeated = some.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    edges = edges.unionByName(shared.join(repeated, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("first_id").alias("b")))
    reached = components(edges, "vector-components")
    counted = groups.join(links, "node", "left").join(reached.select(F.col("node").alias("first_id"), "component"), "first_id", "left")
    counted = stage(counted.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component")), "counted")
    joined = some.join(counted, ["label", "vector"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
