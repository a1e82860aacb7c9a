"""Token ids in compressed files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit planes from the highest bit down; below each plane the ids with bit 0
come first, those with bit 1 after them, each part in the order before. With counts of ones per block, a plane answers
*rank* (ones before a place) at once and *select* (place of the n-th one) by a binary search, and so one file gives any token by place, counts
a token in any range, and finds all its occurrences, without decoding the rest.

Documents are dealt out by ranges of ``doc_id``; each task writes the shards of its range, one Parquet file per shard
(zstd), so that a lost task is written again as a whole and the driver sees no ids. Null text counts as empty, null
``doc_id`` comes first, repeated rows are documents of their own next to each other, and an empty table gives no shard.
A document is never cut: one longer than a shard makes a larger one. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import whole_text
from sessionlens.llm.encode import encoder
from sessionlens.llm.ragged import batches, offsets

SHARD = "part int, shard int, first_doc long, n_tokens long, zeros array<long>, planes array<binary>, ones array<binary>, doc_ids array<long>, doc_starts array<long>"
#: Bits whose ones are counted together.
BLOCK = 512
SHARD_TOKENS = 4_000_000


class WaveletMatrix:
    """Bit planes of a sequence of ids, highest bit first."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ones: list[bytes]):
        self.n, self.zeros = n, [int(z) for z in zeros]
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ones = [np.frombuffer(o, np.uint32) for o in ones]
        self._ranks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n, bits = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ones = [], [], []
        for bit in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << bit)) != 0
            low, high = now[~one], now[one]
            zeros.append(len(low))
            plane = np.packbits(one, bitorder="little")
            per_block = np.add.reduceat(np.bitwise_count(plane).astype(np.uint32), np.arange(0, len(plane), BLOCK // 8)) if n else np.zeros(0, np.uint32)
            planes.append(plane.tobytes())
            ones.append((np.cumsum(per_block) - per_block).astype(np.uint32).tobytes())
            now = np.concatenate([low, high])
        return cls(n, zeros, planes, ones)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each of the places ``at`` (0 to n)."""
        at = np.asarray(at, np.int64)
        plane, block = self.planes[level], at // BLOCK
        if not self.n:
            return np.zeros(at.shape, np.int64)
        if level not in self._ranks:
            # A block behind the end and the count up to it, added once: a rank then looks at one block.
            total = int(self.ones[level][-1]) + int(np.bitwise_count(plane[(len(self.ones[level]) - 1) * (BLOCK // 8) :]).sum())
            self._ranks[level] = (np.concatenate([plane, np.zeros(BLOCK // 8, np.uint8)]), np.append(self.ones[level].astype(np.int64), total))
        padded, counted = self._ranks[level]
        start = np.minimum(block, len(counted) - 1)
        byte = start[..., None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        left = np.clip(at[..., None] - byte * 8, 0, 8)
        inside = np.bitwise_count(padded[np.minimum(byte, len(padded) - 1)] & ((1 << left) - 1).astype(np.uint8)).sum(-1, dtype=np.int64)
        return counted[start] + np.where(block < len(counted) - 1, inside, 0)

    def bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def select(self, level: int, which: int, value: int) -> int:
        """Place of the ``which``-th (from 0) bit of that value: a binary search over rank."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = int(self.rank(level, np.array([mid + 1]))[0])
            if (ones if value else mid + 1 - ones) > which:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at any places."""
        at = np.array(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit, ones = self.bit(level, at), self.rank(level, at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            ones = self.rank(level, np.array([start, end]))
            one = token >> (len(self.zeros) - 1 - level) & 1
            start, end = (zeros + int(ones[0]), zeros + int(ones[1])) if one else (start - int(ones[0]), end - int(ones[1]))
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token stands in [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def find(self, token: int) -> np.ndarray:
        """All places of a token, ascending: its range below the last plane, taken back up by select."""
        a, b = self._range(token, 0, self.n)
        out = []
        for at in range(a, b):
            for level in range(len(self.zeros) - 1, -1, -1):
                one = at >= self.zeros[level]
                at = self.select(level, at - self.zeros[level] if one else at, int(one))
            out.append(at)
        return np.array(out, np.int64)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        bits = len(self.zeros)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~one] = now[: self.zeros[level]]
            up[one] = now[self.zeros[level] :] | now.dtype.type(1 << (bits - 1 - level))
            now = up
        return now.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode ``docs`` and write their shards below ``path``, in ascending order of the id."""

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, shard, held = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, []

        def flush() -> pd.DataFrame:
            nonlocal shard, held
            names, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            w = WaveletMatrix.build(ids)
            row = (part, shard, None if pd.isna(names[0]) else int(names[0]), w.n, w.zeros, [p.tobytes() for p in w.planes], [o.tobytes() for o in w.ones],
                   [None if pd.isna(x) else int(x) for x in names], offsets(sizes)[:-1].tolist())
            shard, held = shard + 1, []
            return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD.split(", ")])

        for frame in frames:
            texts = frame["text"].tolist()
            for group in batches([len(t) + 1 for t in texts], min(shard_tokens, 2_000_000)):
                ids, at = encode(texts[group])
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                held.append((frame["id"].to_numpy(object)[group], np.diff(at), ids))
                if sum(len(h[2]) for h in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("text"))
    # Rows of one id (or of none) may be many, and are dealt out by how their texts begin.
    rows = rows.repartitionByRange("id", F.left("text", F.lit(64))).sortWithinPartitions("id", "text")
    rows.mapInPandas(shards, SHARD).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``(part, shard, before)``: tokens of all shards before. The one window without a key sees a row per task of the writer."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return shards.select("part", "shard", "n_tokens", in_part.alias("in_part")).join(before_part, "part").select("part", "shard", (F.col("before_part") + F.col("in_part")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``ids`` are little-endian unsigned 32-bit integers."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = WaveletMatrix(row.n_tokens, row.zeros, row.planes, row.ones).decode()
                starts = np.append(np.asarray(row.doc_starts, np.int64), row.n_tokens)
                names = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64")
                for i in range(0, len(names), 1000):
                    cut = starts[i : i + 1001]
                    yield pd.DataFrame({"part": row.part, "shard": row.shard, "doc_id": names[i : i + 1000], "at": cut[:-1], "n_tokens": np.diff(cut),
                                        "ids": [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    shards = read_shards(spark, path)
    docs = shards.mapInPandas(decode, "part int, shard int, doc_id long, at long, n_tokens long, ids binary")
    before = shard_starts(shards.select("part", "shard", "n_tokens"))
    return docs.withColumn("crc", F.crc32("ids")).join(before, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids", "crc")
