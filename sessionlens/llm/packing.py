"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits into one sequence. The program asks for the fewest sequences whose
configurations together hold every length of the histogram as often as it occurs. It is solved by multiplicative weights:
each round prices the lengths, a knapsack dynamic program finds the configuration of most value, it is used for a share of
what is left of its scarcest length, and the prices of the lengths it covers fall. The solution is rounded down, and the few
pieces the rounding leaves are packed by the same dynamic program, one best-filled sequence after another.

The driver sees the histogram only (one count per length, at most ``capacity`` of them). Pieces get their rank among those
of their length by a two-level count, and rank and configuration table give sequence and offset, so a length that a third of
all rows share is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import stage, whole_text
from sessionlens.llm.encode import encoder
from sessionlens.llm.ragged import offsets

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts (null: empty) and cut those longer than ``capacity`` into full pieces; the first may be shorter.

    One row per piece, ``ids`` as little-endian unsigned 32-bit integers. An empty text is the end id alone, or without one
    no piece at all. Null ids and repeated rows are documents of their own; other columns are ignored.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode
        for frame in frames:
            for i in range(0, len(frame), 500):
                group = frame.iloc[i : i + 500]
                ids, at = encode(group["text"].tolist())
                if end_id is not None:
                    ids, at = np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(offsets(pieces)[:-1], pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                places = at[doc] + start
                yield pd.DataFrame({"doc_id": group["doc_id"].array[doc], "piece": piece.astype(np.int32), "start": start, "length": length,
                                    "ids": [ids[a : a + m].tobytes() for a, m in zip(places, length, strict=True)]})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")).mapInPandas(cut, PIECES)


def best_configuration(values: np.ndarray, most: np.ndarray, capacity: int) -> list[int]:
    """Lengths (each at most ``most`` times) of greatest total value that fit. ``values[l]`` is the price of length l, 0 for none.

    Dynamic program over the room that is used; a length's limit is checked on the way back, where the next best fitting
    length stands in for one that is used up.
    """
    lengths = np.flatnonzero((values > 0) & (most > 0))
    if not len(lengths):
        return []
    worth = values[lengths]
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        k = fitting[room]
        total = best[room - lengths[:k]]
        total += worth[:k]
        i = total.argmax()
        if total[i] > best[room - 1]:
            best[room], choice[room] = total[i], lengths[i]
        else:
            best[room] = best[room - 1]
    left, room, out = most.copy(), capacity, []
    while room > 0:
        if not choice[room]:
            room -= 1
            continue
        length = int(choice[room])
        if left[length] <= 0:
            usable = lengths[(lengths <= room) & (left[lengths] > 0)]
            if not len(usable):
                break
            length = int(usable[np.argmax(best[room - usable] + values[usable])])
        out.append(length)
        left[length] -= 1
        room -= length
    return out


def best_fit(left: np.ndarray, bins: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put ``left[l]`` pieces of every length, the longest first, each into the fullest sequence it fits into, ``bins`` being open.

    Sequences of one content are taken together, so the work depends on the number of lengths, not of pieces."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for config, times in bins:
        rooms.setdefault(capacity - sum(config), []).append((config, times))
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                room, group = capacity, ((), count)
            else:
                group = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            config, times = group
            # A sequence that took a piece is the fullest one, and takes the next as well.
            each = room // length
            full, rest = min(times, count // each), 0
            if full < times:
                rest = min(each, count - full * each)
            for pieces, n in ((each, full), (rest, 1 if rest else 0)):
                if n:
                    rooms.setdefault(room - pieces * length, []).append((config + (length,) * pieces, n))
            unused = times - full - (1 if rest else 0)
            if unused and config:
                rooms.setdefault(room, []).append((config, unused))
            count -= full * each + rest
    return [g for groups in rooms.values() for g in groups]


def configurations(histogram: dict[int, int], capacity: int, rounds: int = 400, step: float = 0.1) -> list[tuple[tuple[int, ...], int]]:
    """``[(lengths, times)]`` that hold exactly the histogram.

    Multiplicative weights on the covering program: a row's share is the part of its count that the chosen configurations hold,
    its weight starts at count x length and falls by ``exp(-share / step)``, and its price is the weight over the count. A round uses
    the configuration of most value for ``step`` of its scarcest row. The mean of the prices, each round's scaled so that the best
    configuration is worth 1, is the dual solution: its value is a lower bound, and rounds end when the primal one is a sequence away.
    The primal one is scaled to cover every row it reached, rounded down, and cut to what is left. The rest takes the configurations of
    most dual value, or goes by best fit into what rounding has left open; the better of the two is taken, and never more sequences than
    best fit alone needs.
    """
    need = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        need[length] = count
    rows = np.flatnonzero(need)
    if not len(rows):
        return []
    used: dict[tuple[int, ...], float] = {}
    share, price = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for turn in range(1, rounds + 1):
        values = np.zeros(capacity + 1)
        values[rows] = rows * np.exp(np.clip((share[rows].min() - share[rows]) / step, -30, 0))
        config = best_configuration(values, need, capacity)
        price += values / values[config].sum()
        lengths, times = np.unique(config, return_counts=True)
        amount = step * float((need[lengths] / times).min())
        key = tuple(sorted(config, reverse=True))
        used[key] = used.get(key, 0.0) + amount
        share[lengths] += amount * times / need[lengths]
        if turn % 20 == 0 and (least := share[rows].min()) > 0 and sum(used.values()) / least <= price @ need / turn * (1 + 1e-4) + 1:
            break
    scale = 1 / max(share[share > 0].min(), step)
    left, out = need.copy(), []
    for config, amount in sorted(used.items(), key=lambda x: -x[1]):
        lengths, times = np.unique(config, return_counts=True)
        whole = min(int(amount * scale), int((left[lengths] // times).min()))
        if whole:
            out.append((config, whole))
            left[lengths] -= whole * times
    fitted, plain = best_fit(left, out, capacity), best_fit(need, [], capacity)
    while left.any():
        # A little more for long pieces: among configurations of equal value the one that leaves short pieces for later.
        values = np.where(left > 0, price * (1 + 1e-3 * np.arange(capacity + 1) / capacity), 0)
        config = best_configuration(values, left, capacity)
        lengths, times = np.unique(config, return_counts=True)
        whole = int((left[lengths] // times).min())
        out.append((tuple(sorted(config, reverse=True)), whole))
        left[lengths] -= whole * times
    return min(out, fitted, plain, key=lambda configs: sum(n for _, n in configs))


def slots(configs: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per length and configuration: the ranks [first, last) it takes, its first sequence, and where the length stands in it."""
    rows, taken, sequence = [], {}, 0
    for config, times in configs:
        at = 0
        for length in sorted(set(config), reverse=True):
            each = config.count(length)
            first = taken.get(length, 0)
            rows.append((length, first, first + each * times, each, sequence, at))
            taken[length] = first + each * times
            at += each * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "sequence", "at"])


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece"), rounds: int = 400) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; their other columns stay.

    Lengths of null or below 1 take no room: they get null for both. Longer ones raise an error. Equal rows get places of
    their own; an empty table stays empty.
    """
    spark = pieces.sparkSession
    # A rank among equal lengths: count per (length, bucket of keys), then the place in the bucket. Buckets grow with the rows.
    rows = pieces.withColumn("_chunk", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    held = stage(rows, "pieces")
    fits = F.col("length") > 0
    per_chunk = stage(held.where(fits).groupBy("length", "_chunk").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).where(F.col("length") <= capacity + 1).collect()}
    if any(x > capacity for x in histogram) or per_chunk.where(F.col("length") > capacity).limit(1).count():
        raise ValueError(f"a piece is longer than {capacity}")
    table = slots(configurations(histogram, capacity, rounds))
    before = per_chunk.select("length", "_chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("_row")) - 1
    narrow = held.where(fits).select("length", "_chunk", "_row", rank.alias("k")).join(before, ["length", "_chunk"]).select("length", "_row", (F.col("k") + F.col("before")).alias("k"))
    by_length = {int(n): g.sort_values("first") for n, g in table.groupby("length")}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, at = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length, index in frame.groupby("length").indices.items():
                t, k = by_length[int(length)], frame["k"].to_numpy()[index]
                row = np.searchsorted(t["first"].to_numpy(), k, "right") - 1
                turn, nth = np.divmod(k - t["first"].to_numpy()[row], t["each"].to_numpy()[row])
                sequence[index] = t["sequence"].to_numpy()[row] + turn
                at[index] = t["at"].to_numpy()[row] + nth * int(length)
            yield pd.DataFrame({"_row": frame["_row"], "sequence_id": sequence, "offset": at})

    placed = narrow.mapInPandas(place, "_row long, sequence_id long, offset long")
    return held.join(placed, "_row", "left").select(*pieces.columns, "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, n_tokens, n_pieces, ids)`` from rows of ``pack`` that carry ``ids``."""
    of = packed.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id")
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return of.agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.aggregate(F.transform(joined, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
