"""Spelling variants of a corpus's words by blocked Gram matrices.

Words are maximal runs of Latin letters, with only A-Z lower-cased. Two are near if one inserted, deleted or replaced code point tells
them apart; then their lengths differ by one at most and the squared distance of their letter counts is at most two. Words of one length
are packed into blocks, in the order of a few letters' counts. Blocks of equal or adjacent length meet unless the boxes around their
counts are too far apart. In a task a block is cut into tiles, always by the letter that halves it best; one matrix product per tile and
all tiles of the other block that its box can reach gives the squared distances, and pairs that are close enough are compared letter by letter.

A task holds one block and reads the blocks it meets one at a time; what leaves it is one row per word with near words, never the pairs.
Counting words is combined within a task and before the shuffle, so a word that is everywhere costs one small row per task.

Null text counts as empty and a null id as no characters before the colon. Rows are counted as they come, repeated ones too. Other
columns are ignored. Ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import whole_text
from sessionlens.llm.ragged import mix, offsets, prefix_hash, ragged_index, span_hash
from sessionlens.session import stage

#: Characters of text a task takes at a time; longer texts are cut behind a character that is no letter.
PIECE = 4_000_000
#: Words of a task that are counted before they are handed on.
FLUSH = 300_000
#: Words of a block, its letters at most, and words of a tile.
BLOCK, BLOCK_LETTERS, TILE = 16_384, 1_000_000, 256
#: Letters whose counts order the blocks. Any choice gives the same result.
LEADING = "eainrst"
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: Runs up to this many bytes are hashed together.
SHORT = 64


def crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = crc_table()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
ASCII = np.array([97 <= b <= 122 for b in range(256)])


def crc32_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run ``data[start : start + size]`` behind a text whose crc32 is ``before``."""
    out = np.empty(len(start), np.uint32)
    long = size > SHORT
    for i in np.flatnonzero(long):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(before[i]))
    order = np.argsort(np.where(long, 1, -size), kind="stable")[: len(size) - int(long.sum())]
    start, size, state = start[order], size[order], before[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        state[:n] = CRC[(state[:n] ^ data[start[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(ids: list[str], texts: list[str], least: int, every: int) -> Counter[str]:
    """Words of ``least`` code points and more and how often they occur; in one of ``every`` (id, run) a code point is left out."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = offsets(np.array([len(r) + 1 for r in raw]))
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    # U+00C0 to U+00FF are the two-byte characters whose first byte is C3.
    lead = data == 0xC3
    letter = ASCII[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(at, start, "right") - 1
    # Runs of less than ``least`` bytes have too few code points in any case.
    some = np.flatnonzero(end - start >= least)
    start, end, text = start[some], end[some], text[some]
    hashes = span_hash(prefix_hash(data), start, end)
    _, first, times = np.unique(mix(hashes + mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    start, end, hashes = start[first], end[first], hashes[first]
    crc = crc32_of(data, start, end - start, np.array([zlib.crc32(f"{i}:".encode("utf-8", "surrogatepass")) for i in ids], np.uint32)[text[first]])
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = (end - start) - (leads[end] - leads[start])
    cut = crc.astype(np.int64) % every == 0
    words: Counter[str] = Counter()
    for i in np.flatnonzero(cut & (points > least)):
        run = data[start[i] : end[i]].tobytes().decode("utf-8")
        k = int(crc[i]) % len(run)
        words[run[:k] + run[k + 1 :]] += int(times[i])
    whole = np.flatnonzero(~cut & (points >= least))
    of, distinct = pd.factorize(hashes[whole])
    if len(distinct):
        total = np.bincount(of, weights=times[whole]).astype(np.int64)
        place = np.empty(len(distinct), np.int64)
        place[of[::-1]] = whole[::-1]
        flat, size = data.tobytes(), end[place]
        for s, e, n in zip(start[place].tolist(), size.tolist(), total.tolist(), strict=True):
            words[flat[s:e].decode("utf-8")] += n
    return words


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters; no word is cut."""
    at = 0
    while len(text) - at > PIECE:
        stop = NO_LETTER.search(text, at + PIECE)
        end = stop.end() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n`` of all distinct words of ``least`` code points and more."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        ids: list[str] = []
        texts: list[str] = []
        size = 0

        def take() -> None:
            nonlocal size
            words.update(count_words(ids, texts, least, every))
            ids.clear()
            texts.clear()
            size = 0

        for frame in frames:
            for doc_id, text in zip(frame["id"], frame["text"], strict=True):
                for piece in pieces(text):
                    ids.append(doc_id)
                    texts.append(piece)
                    size += len(piece)
                    if size >= PIECE:
                        take()
                        if len(words) >= FLUSH:
                            yield pd.DataFrame({"word": list(words), "n": list(words.values())})
                            words.clear()
        if texts:
            take()
        if words:
            yield pd.DataFrame({"word": list(words), "n": list(words.values())})

    rows = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), whole_text(text_column).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How often each of ``letters`` stands in each row of a matrix of letters."""
    place = np.full(256, -1)
    place[letters] = np.arange(len(letters))
    cell = place[words] + np.arange(len(words))[:, None] * len(letters)
    return np.bincount(cell.ravel(), minlength=len(words) * len(letters)).reshape(len(words), len(letters))


class Block:
    """Words of one length as a matrix of letters, in tiles of similar letter counts."""

    def __init__(self, words: bytes, n: bytes, size: int):
        words_, n_ = np.frombuffer(words, np.uint8).reshape(-1, size), np.frombuffer(n, np.int64)
        letters = np.unique(words_)
        counts = letter_counts(words_, letters)
        order, self.starts = self.tiles(counts)
        self.words, self.n, self.letters, self.size = words_[order], n_[order], letters, size
        self.counts = counts[order]
        # The order in which a near word is preferred as a form.
        best = np.lexsort((np.unique(self.words, axis=0, return_inverse=True)[1].ravel(), -self.n))
        self.rank = np.empty(len(best), np.int64)
        self.rank[best] = np.arange(len(best))
        self.of_rank = best

    @staticmethod
    def tiles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done, waiting = [], [np.arange(len(counts))]
        while waiting:
            rows = waiting.pop()
            if len(rows) > TILE:
                own = counts[rows]
                share = np.stack([(own <= k).mean(axis=0) for k in range(3)])
                k, letter = np.unravel_index(np.abs(share - 0.5).argmin(), share.shape)
                low = own[:, letter] <= k
                if 0 < low.sum() < len(rows):
                    waiting += [rows[~low], rows[low]]
                    continue
            # What no letter parts is cut as it stands.
            done += [rows[i : i + TILE] for i in range(0, len(rows), TILE)]
        return np.concatenate(done), offsets(np.array([len(d) for d in done]))

    def matrix(self, letters: np.ndarray, wide: bool) -> np.ndarray:
        out = np.zeros((len(self.words), len(letters)), np.float64 if wide else np.float32)
        out[:, np.searchsorted(letters, self.letters)] = self.counts
        return out

    def boxes(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.reduceat(matrix, self.starts[:-1]), np.maximum.reduceat(matrix, self.starts[:-1])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of letters are one edit apart; ``b`` is as wide as ``a`` or one letter wider."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.concatenate([a == b[:, :-1], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    tail = np.concatenate([(a == b[:, 1:])[:, ::-1], np.zeros((len(a), 1), bool)], axis=1).argmin(axis=1)
    return head + tail >= a.shape[1]


def near_pairs(a: Block, b: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` that are one edit apart; ``b``'s words are as long as ``a``'s or longer by one."""
    letters = np.union1d(a.letters, b.letters)
    wide = b.size > 2000
    left, right = a.matrix(letters, wide), b.matrix(letters, wide)
    (low_a, high_a), (low_b, high_b) = a.boxes(left), b.boxes(right)
    # Half of each squared norm as one more letter: the product is minus half the squared distance.
    one, half = np.ones((len(left), 1), left.dtype), lambda m: -(m * m).sum(axis=1, keepdims=True) / 2
    left = np.concatenate([left, one, half(left)], axis=1)
    right = np.concatenate([right, half(right), np.ones((len(right), 1), right.dtype)], axis=1)
    least = -1.0 if a.size == b.size else -0.5
    for t in range(len(low_a)):
        gap = np.maximum(np.maximum(low_a[t] - high_b, low_b - high_a[t]), 0)
        reach = np.flatnonzero((gap * gap).sum(axis=1) <= 2)
        if same:
            reach = reach[reach >= t]
        if not len(reach):
            continue
        cols = ragged_index(b.starts[reach], np.diff(b.starts)[reach])
        rows = np.arange(a.starts[t], a.starts[t + 1])
        for k in range(0, len(cols), 4096):
            part = cols[k : k + 4096]
            hit = np.flatnonzero(left[rows] @ right[part].T >= least)
            i, j = rows[hit // len(part)], part[hit % len(part)]
            if same:
                i, j = i[i < j], j[i < j]
            step = max(1, 4_000_000 // b.size)
            for s in range(0, len(i), step):
                x, y = i[s : s + step], j[s : s + step]
                good = one_edit(a.words[x], b.words[y])
                yield x[good], y[good]


def compare(a: Block, b: Block, same: bool) -> Iterator[pd.DataFrame]:
    """``word, n_near, form_n, form`` of the words of two blocks that are near to one of the other."""
    short, long = (a, b) if a.size <= b.size else (b, a)
    near = {0: np.zeros(len(short.n), np.int64), 1: np.zeros(len(long.n), np.int64)}
    best = {0: np.full(len(short.n), len(long.n)), 1: np.full(len(long.n), len(short.n))}
    if same:
        near[1], best[1] = near[0], best[0]
    for i, j in near_pairs(short, long, same):
        near[0] += np.bincount(i, minlength=len(near[0]))
        near[1] += np.bincount(j, minlength=len(near[1]))
        np.minimum.at(best[0], i, long.rank[j])
        np.minimum.at(best[1], j, short.rank[i])
    for side, own, other in ((0, short, long), (1, long, short))[: 1 if same else 2]:
        some = np.flatnonzero(near[side])
        if len(some):
            form = other.of_rank[best[side][some]]
            yield pd.DataFrame({"word": [w.tobytes().decode("latin-1") for w in own.words[some]], "n_near": near[side][some], "form_n": other.n[form], "form": [w.tobytes().decode("latin-1") for w in other.words[form]]})


def make_blocks(words: DataFrame) -> DataFrame:
    """One row per block: ``block, size`` (length of its words), ``words`` and ``n`` packed, and the box of its letter counts."""
    symbols = np.array([*range(97, 123), *range(0xC0, 0x100)])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            made += 1
            size = int(rows["size"].iloc[0])
            flat = "".join(rows["word"]).encode("latin-1")
            counts = letter_counts(np.frombuffer(flat, np.uint8).reshape(-1, size), symbols)
            return pd.DataFrame({"block": [task << 32 | made], "size": [size], "words": [flat], "n": [rows["n"].to_numpy(np.int64).tobytes()], "low": [counts.min(axis=0)], "high": [counts.max(axis=0)]})

        held: list[pd.DataFrame] = []
        total, size = 0, None
        for frame in frames:
            for s, run in frame.groupby("size", sort=False):
                while len(run):
                    most = max(1, min(BLOCK, BLOCK_LETTERS // s))
                    if held and (s != size or total >= most):
                        yield pack(pd.concat(held))
                        held, total = [], 0
                    size = s
                    held.append(run.iloc[: most - total])
                    run = run.iloc[most - total :]
                    total += len(held[-1])
        if held:
            yield pack(pd.concat(held))

    count = [F.char_length("word") - F.char_length(F.translate("word", letter, "")) for letter in LEADING]
    ordered = words.select("word", "n", F.char_length("word").alias("size"), F.array(*count).alias("key"))
    ordered = ordered.repartitionByRange("size", "key", "word").sortWithinPartitions("size", "key", "word")
    return ordered.select("word", "n", "size").mapInPandas(cut, "block long, size int, words binary, n binary, low array<int>, high array<int>")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form`` of every word of ``words`` (word, n) that has near words: how many, and the most frequent one."""
    blocks = stage(make_blocks(words), "word-blocks")
    ends = lambda k: blocks.select(F.col("block").alias(f"b{k}"), F.col("size").alias(f"s{k}"), F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}"))
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0)))
    apart = F.aggregate(F.concat(gap("low1", "high2"), gap("low2", "high1")), F.lit(0), lambda s, x: s + x * x)
    level = ends(1).withColumn("s", F.explode(F.array("s1", F.col("s1") + 1))).join(ends(2), F.col("s") == F.col("s2"))
    pairs = level.where(((F.col("s1") < F.col("s2")) | (F.col("b1") <= F.col("b2"))) & (apart <= 2)).select("b1", "b2")
    # Either block may hold the pair; which one is left to chance, so that all hold about as many.
    swap = F.xxhash64("b1", "b2") % 2 == 0
    pairs = pairs.select(F.when(swap, F.col("b2")).otherwise(F.col("b1")).alias("holder"), F.when(swap, F.col("b1")).otherwise(F.col("b2")).alias("block"))
    body = blocks.select("block", "size", "words", "n")
    own = body.join(pairs.select(F.col("holder").alias("block")).distinct(), "block", "left_semi").select(F.col("block").alias("holder"), F.lit(0).alias("turn"), "block", "size", "words", "n")
    met = pairs.join(body, "block").select("holder", F.lit(1).alias("turn"), "block", "size", "words", "n")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holder = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.turn == 0:
                    holder, own_block = row.holder, Block(row.words, row.n, row.size)
                elif row.block == holder:
                    yield from compare(own_block, own_block, True)
                else:
                    yield from compare(own_block, Block(row.words, row.n, row.size), False)

    met = own.unionByName(met).repartition("holder").sortWithinPartitions("holder", "turn", "block")
    found = met.mapInPandas(meet, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every row of ``forms`` (word, form): the end of the chain. Chains must not come back to themselves."""
    paths = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(paths.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        paths = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return paths


def variants(docs: DataFrame, least: int = 7, every: int = 31, times: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``least`` code points that occurs twice or more.

    ``form`` is the most frequent near word if it is ``times`` as frequent, and ``root`` what following forms ends at."""
    words = stage(word_counts(docs, least, every, id_column, text_column).where("n >= 2"), "words")
    near = stage(near_words(words), "near-words")
    rows = words.join(near, "word", "left")
    is_form = F.col("form_n") >= F.col("n") * times
    rows = stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
