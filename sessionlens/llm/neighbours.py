"""Text quality by nearest-neighbour voting on latent-semantic vectors.

The terms of a text are what its writing looks like, not what it says: shapes of words and of pairs of words (runs of lower
case, upper case, digits, single signs), and bins of the shares of repeated words, words equal to the one before, capitals, signs,
repeated lines, and of the mean word length. Term counts are damped, weighted by inverse document frequency over **all**
documents, and projected on the leading singular vectors of a bounded sample of labelled rows (latent-semantic analysis). That
sample's vectors and labels are broadcast: ``sample`` x ``dimensions`` floats, whatever the corpus. Every document is then
compared with all of them in blocks of exact cosine products, and the labels of its nearest ``neighbours`` vote with weights that grow
with similarity.

The score depends on the text alone. Null and empty texts have one term of their own and are scored like any other. Labels
of null count as missing; several labels of one id are averaged; null ids have no label. Without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import whole_text
from sessionlens.llm.encode import LETTER, NUMBER, SPACE, character_classes
from sessionlens.llm.ragged import batches, mix, prefix_hash, span_hash
from sessionlens.llm.shingles import word_spans

SHAPES, PAIRS, BINS, KINDS = 256, 256, 24, 7
TERMS = SHAPES + PAIRS + BINS * KINDS
SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 8192, 48, 16, 12.0
_UPPER: list[np.ndarray] = []


def _upper() -> np.ndarray:
    if not _UPPER:
        _UPPER.append(np.array([0xD800 > c and chr(c).isupper() for c in range(0x10000)] + [False] * 0x100000))
    return _UPPER[0]


def _share(bins: np.ndarray, part: np.ndarray, whole: np.ndarray, kind: int) -> None:
    """Mark the bin of ``part / whole``, and more lightly its neighbours, as terms of a kind."""
    at = np.where(whole > 0, np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)) * (BINS - 2) + 1, 0).astype(np.int64)
    rows = np.arange(len(bins))
    for step, weight in ((0, 3.0), (-1, 1.5), (1, 1.5)):
        bins[rows, SHAPES + PAIRS + kind * BINS + np.clip(at + step, 0, BINS - 1)] += weight


def terms(texts: list[str]) -> np.ndarray:
    """Damped term counts, one row per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    codes, start, end, at = word_spans(texts)
    n_words = np.diff(at)
    text = np.repeat(np.arange(len(texts)), n_words)
    if len(text):
        kind = character_classes()[codes].astype(np.uint32)
        upper = _upper()[codes]
        # Shape letters: capitals, other letters, digits, every sign for itself.
        shape = np.where(kind == LETTER, np.where(upper, 2, 1), np.where(kind == NUMBER, 3, np.where(kind == SPACE, 0, codes + np.uint32(8))))
        first_of_word = np.zeros(len(codes), bool)
        first_of_word[start] = True
        keep = np.flatnonzero((kind != SPACE) & (first_of_word | np.concatenate([[True], shape[1:] != shape[:-1]])))
        runs = np.searchsorted(keep, np.append(start, len(codes)))
        shapes = span_hash(prefix_hash(shape[keep]), runs[:-1], runs[1:])
        counts = np.bincount(text * SHAPES + (mix(shapes) % np.uint64(SHAPES)).astype(np.int64), minlength=len(texts) * SHAPES)
        out[:, :SHAPES] = counts.reshape(len(texts), SHAPES)
        same_text = text[1:] == text[:-1]
        pairs = (mix(shapes[:-1] * np.uint64(3) + mix(shapes[1:]))[same_text] % np.uint64(PAIRS)).astype(np.int64)
        out[:, SHAPES : SHAPES + PAIRS] = np.bincount(text[1:][same_text] * PAIRS + pairs, minlength=len(texts) * PAIRS).reshape(len(texts), PAIRS)
        np.log1p(out, out=out)
        words = mix(span_hash(prefix_hash(codes), start, end))
        keys = words ^ mix(text.astype(np.uint64) + np.uint64(77))
        distinct = np.bincount(text[np.unique(keys, return_index=True)[1]], minlength=len(texts))
        again = np.bincount(text[1:][same_text & (words[1:] == words[:-1])], minlength=len(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        of_code = np.repeat(np.arange(len(texts)), lengths)
        solid = np.bincount(of_code[kind != SPACE], minlength=len(texts))
        _share(out, n_words - distinct, n_words, 0)
        _share(out, again, n_words, 1)
        _share(out, np.bincount(of_code[upper], minlength=len(texts)), solid, 2)
        _share(out, np.bincount(of_code[(kind != SPACE) & (kind != LETTER) & (kind != NUMBER)], minlength=len(texts)), solid, 3)
        _share(out, solid, n_words * 40, 4)
        lines = [t.split("\n") for t in texts]
        n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
        _share(out, n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(lines)), n_lines, 5)
        _share(out, np.bincount(of_code[kind == NUMBER], minlength=len(texts)), solid, 6)
    out[n_words == 0] = 0
    out[n_words == 0, SHAPES + PAIRS] = 10
    return out


def held_out(id_column: str = "doc_id") -> Column:
    """Every third id (crc32 of its decimal text, modulo 3, is 1) never teaches; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # per term
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows, of length 1
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.weights) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for part in batches([len(t) + 2000 for t in texts], 1_000_000):
            cosine = self.project(terms(texts[part])) @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
            out[part] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)

    def score_column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(model.score(texts.fillna("").tolist()), dtype="float64")

        return score(text)


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term. One partial sum per Arrow batch reaches the aggregation."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(TERMS, np.int64), 0
        for frame in frames:
            texts = frame["text"].tolist()
            n += len(texts)
            for part in batches([len(t) + 2000 for t in texts], 1_000_000):
                total += (terms(texts[part]) > 0).sum(axis=0)
        yield pd.DataFrame({"term": np.arange(-1, TERMS), "n": np.concatenate([[n], total])})

    rows = docs.select(whole_text(text_column).alias("text")).mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = dict(map(tuple, rows))
    return found.get(-1, 0), np.array([found.get(t, 0) for t in range(TERMS)], np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """Frequencies from all documents; vectors from at most ``sample`` labelled rows that are not held out, drawn by a hash of the id."""
    n, frequency = document_frequencies(docs, text_column)
    weights = (np.log((n + 1) / (frequency + 1)) + 0.5).astype(np.float32)
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
    known = known.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("double").alias("_label")).groupBy("_id").agg(F.avg("_label").alias("_label"))
    ids = docs.select(F.col(id_column).cast("long").alias("_id")).distinct()
    drawn = known.join(ids, "_id", "left_semi").orderBy(F.xxhash64(F.lit(4), "_id"), "_id").limit(sample).toPandas()
    if not len(drawn):
        return Model(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    few = docs.sparkSession.createDataFrame(drawn)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches([len(t) + 2000 for t in frame["text"]], 1_000_000):
                group = frame.iloc[part]
                yield pd.DataFrame({"_id": group["_id"], "_label": group["_label"], "counts": [c.astype(np.float16).tobytes() for c in terms(group["text"].tolist())]})

    # At most ``sample`` rows are broadcast; of repeated ids one row is taken.
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), whole_text(text_column).alias("text")).join(F.broadcast(few), "_id").mapInPandas(encode, "_id long, _label double, counts binary")
    rows = texts.groupBy("_id").agg(F.first("_label").alias("_label"), F.min("counts").alias("counts")).toPandas().sort_values("_id")
    counts = np.frombuffer(b"".join(rows["counts"]), np.float16).reshape(len(rows), TERMS).astype(np.float32)
    weighted = counts * weights
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions], np.float32)
    model = Model(weights, axes, np.zeros((0, axes.shape[1]), np.float32), rows["_label"].to_numpy(np.float64))
    model.vectors = np.ascontiguousarray(model.project(counts), np.float32)
    return model


def scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; other columns are ignored."""
    model = fit(docs, labels, id_column=id_column, text_column=text_column, **options)
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), model.score_column(F.col(text_column)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
