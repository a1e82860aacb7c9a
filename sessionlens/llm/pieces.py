"""SentencePiece encoding and decoding as a max-plus scan.

The encoding of a text is the path of most weight through the lattice of its pieces. Unigram model files give every piece a score, and
equal sums go to the longer last piece; characters no piece covers score 10 below the least piece. Files of the merging kind decide by
neighbours: two pieces may follow each other if merging the text of both leaves the boundary between them in place (see
:mod:`sessionlens.llm.transducer`). A step that may be taken weighs 0 there and any other minus infinity, and one path is left, the
library's. Characters no piece covers become byte pieces where the file has them. Decoding joins pieces, turns the blank mark into
blanks and drops the one put before the text.

Between two characters that stand side by side in no piece every path has a boundary, so what lies between such places is solved on
its own, all new ones of a batch in step, and remembered. A text longer than ``chunk`` is dealt out in chunks to different tasks.
The state at a chunk's boundary is how far the piece over it reaches into the next chunk, and in merging files which piece it is; each
chunk yields the matrix of best weights from state to state, the matrices of a text are multiplied (max, +) in order, and with the states found each chunk is traced back
independently. A chunk's matrix is small whatever its length; the scan sees one per chunk.

Null text counts as empty and has no id. Null and repeated ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import spread, whole_text
from sessionlens.llm.encode import WordStore
from sessionlens.llm.ragged import batches, offsets, prefix_hash, ragged_index, span_hash
from sessionlens.session import stage

CHUNK = 32_768
#: Longer stretches without a certain boundary are solved one by one.
STEP_LENGTH = 64
MARK = "▁"
_PIECES: dict[str, "Pieces"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def is_unigram(path: str) -> bool:
    """Whether the file's trainer settings (field 2) name the unigram kind (field 3: 1, also if it is missing)."""
    with open(path, "rb") as f:
        trainer = b"".join(v for k, v in _fields(f.read()) if k == 2)
    return dict(_fields(trainer)).get(3, 1) == 1


class Pieces(WordStore):
    # Stretches come with their ids and with the state of the scan.
    most_words = 300_000

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.scores = np.array([m.get_score(i) for i in range(n)])
        self.path, self.merging = path, not is_unigram(path)
        self.unknown_score = float(self.scores[usable].min()) - 10.0
        self.longest = max(len(text[i]) for i in usable)
        self.bytes_from = next((i for i in range(n) if m.is_byte(i)), None)
        self.unknown = m.unk_id()
        codes = np.frombuffer("".join(text[i] for i in usable).encode("utf-32-le"), np.uint32)
        at = offsets(np.array([len(text[i]) for i in usable]))
        self.index = pd.Index(span_hash(prefix_hash(codes), at[:-1], at[1:]))
        self.usable = np.array(usable)
        inside = np.ones(len(codes), bool)
        inside[at[1:] - 1] = False
        pair = np.flatnonzero(inside)
        self.pairs = np.unique(codes[pair].astype(np.uint64) << np.uint64(32) | codes[pair + 1])
        # Bytes of every id, for decoding.
        raw = [bytes([i - self.bytes_from]) if m.is_byte(i) else b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), offsets(np.array([len(r) for r in raw]))

    @cached_property
    def merges(self):
        """The file's merges and what may follow what; workers that only decode never load them."""
        from sessionlens.llm.transducer import transducer

        return transducer(self.path)

    def normalize(self, texts: list[str]) -> list[str]:
        return [self.model.normalize(t) for t in texts]

    def safe(self, codes: np.ndarray) -> np.ndarray:
        """Whether there is a boundary on every path before each place but the first."""
        pairs = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return self.pairs[at] != pairs

    def cut(self, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        start = text_start.copy()
        start[1:] |= self.safe(codes)
        return np.flatnonzero(start)

    def lattice(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Id of the piece of each length (row, from 1) at each place, -1 for none; ``left`` is how many characters may follow."""
        h, n = prefix_hash(codes), len(codes)
        out = np.full((self.longest + 1, n), -1, np.int32)
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            found = self.index.get_indexer(span_hash(h, at, at + size))
            out[size, at] = np.where(found < 0, -1, self.usable[found])
        return out

    def weight(self, ids: np.ndarray, size: int) -> np.ndarray:
        return np.where(ids >= 0, self.scores[ids], self.unknown_score if size == 1 else -np.inf)

    def paths(self, codes: np.ndarray, starts: list[int]) -> np.ndarray:
        """Best score from each of the first places ``starts`` (columns) to every place (rows, the end too)."""
        n = len(codes)
        pieces = self.lattice(codes, n - np.arange(n))
        best = np.full((n + 1, len(starts)), -np.inf)
        best[starts, np.arange(len(starts))] = 0.0
        weights = np.stack([self.weight(pieces[s], s) for s in range(1, self.longest + 1)])
        for end in range(1, n + 1):
            most = min(self.longest, end)
            at = end - np.arange(1, most + 1)
            best[end] = np.maximum(best[end], (best[at] + weights[np.arange(most), at][:, None]).max(axis=0))
        return best

    def _long(self, codes: np.ndarray) -> tuple[list[int], float]:
        n = len(codes)
        pieces = self.lattice(codes, n - np.arange(n))
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        weights = [None, *(self.weight(pieces[s], s).tolist() for s in range(1, self.longest + 1))]
        for end in range(1, n + 1):
            for size in range(min(self.longest, end), 0, -1):
                got = best[end - size] + weights[size][end - size]
                if got > best[end]:
                    best[end], back[end] = got, size
        out, at = [], n
        while at:
            at -= back[at]
            out.append(at)
        cuts = [*out[::-1], n]
        return [int(pieces[b - a, a]) if pieces[b - a, a] >= 0 else -1 - int(codes[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], best[n]

    def _in_step(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, piece (or -1 - character) of every piece in order, and the words' scores. Words are ordered by falling length."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = offsets(sizes)[:-1]
        left = np.repeat(start + sizes, sizes) - np.arange(len(codes))
        pieces = self.lattice(codes, left)
        widest = int(sizes[0])
        best = np.full((widest + 1, len(words)), -np.inf)
        back = np.zeros((widest + 1, len(words)), np.int8)
        best[0] = 0.0
        for end in range(1, widest + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))
            for size in range(min(self.longest, end), 0, -1):
                got = best[end - size, :n] + self.weight(pieces[size, start[:n] + end - size], size)
                better = got > best[end, :n]
                best[end, :n][better] = got[better]
                back[end, :n][better] = size
        word, piece, turn = [], [], []
        at, going, k = sizes.copy(), np.arange(len(words)), 0
        while len(going):
            size = back[at[going], going].astype(np.int64)
            place = start[going] + at[going] - size
            found = pieces[size, place]
            word.append(going)
            piece.append(np.where(found >= 0, found, -1 - codes[place].astype(np.int64)))
            turn.append(np.full(len(going), -k))
            at[going] -= size
            going, k = going[at[going] > 0], k + 1
        word, piece, turn = np.concatenate(word), np.concatenate(piece), np.concatenate(turn)
        order = np.lexsort((turn, word))
        return word[order], piece[order], best[sizes, np.arange(len(words))]

    def merged(self, text: str) -> list[str]:
        """The pieces of a stretch by the file's merges. A long one keeps its possible merges in a heap."""
        if len(text) <= STEP_LENGTH:
            return self.merges.merged(text)
        rank, parts, after, before = self.merges.rank, list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # What a merge has changed meanwhile has another length, or is gone.
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def merged_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.merged(text):
            known = self.merges.id.get(part)
            if known is not None:
                out.append(known)
            elif self.bytes_from is not None:
                out.extend(self.bytes_from + b for b in part.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.merging:
            flat, sizes = array("I"), np.zeros(len(words), np.int64)
            for k, word in enumerate(words):
                ids = self.merged_ids(word)
                flat.extend(ids)
                sizes[k] = len(ids)
            return np.array(flat, np.uint32), sizes, np.zeros(len(words))
        by_length = sorted(range(len(words)), key=lambda i: -len(words[i]))
        values, found = np.zeros(len(words)), []
        short = [i for i in by_length if len(words[i]) <= STEP_LENGTH]
        for i in by_length[: len(words) - len(short)]:
            ids, values[i] = self._long(np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), np.uint32))
            found.append((np.full(len(ids), i), np.array(ids)))
        for part in batches([len(words[i]) for i in short], 300_000):
            of = np.array(short[part])
            word, piece, score = self._in_step([words[i] for i in of])
            values[of] = score
            found.append((of[word], piece))
        word, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        word, piece = word[order], piece[order]
        for at in np.flatnonzero(piece < 0)[::-1] if self.bytes_from is not None else ():
            raw = chr(-1 - piece[at]).encode("utf-8", "surrogatepass")
            piece = np.concatenate([piece[:at], self.bytes_from + np.frombuffer(raw, np.uint8).astype(np.int64), piece[at + 1 :]])
            word = np.insert(word, at, [word[at]] * (len(raw) - 1))
        return np.where(piece < 0, self.unknown, piece).astype(np.uint32), np.bincount(word, minlength=len(words)), values

    def encode(self, texts: list[str], most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of normalized texts and the texts' offsets."""
        flat, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for part in batches([len(t) for t in texts], most):
            ids, at = self.words(texts[part])
            flat.append(ids)
            sizes[part] = np.diff(at)
        return np.concatenate(flat), offsets(sizes)

    def score(self, text: str) -> float:
        row = self.places([text])[0]
        return float(self.values[row].sum())

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """Best scores from a start 0, 1, ... characters into the chunk to an end 0, 1, ... characters behind it."""
        n, wide = len(chunk), self.longest
        codes = np.frombuffer((chunk + ahead).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.full((wide, wide), -np.inf)
        cuts = 1 + np.flatnonzero(self.safe(codes))
        cuts = cuts[cuts <= n]
        ends = min(wide - 1, len(ahead)) + 1
        if not len(cuts):
            starts = list(range(min(wide, n)))
            out[: len(starts), :ends] = self.paths(codes, starts)[n : n + ends].T
            return out
        first, last = int(cuts[0]), int(cuts[-1])
        starts = list(range(min(wide, first + 1)))
        head = self.paths(codes[:first], starts)[first]
        tail = self.paths(codes[last:], [0])[n - last : n - last + ends, 0] if last < len(codes) else np.zeros(1)
        out[: len(starts), : len(tail)] = (head + self.score((chunk + ahead)[first:last]))[:, None] + tail
        return out

    def transfer(self, behind: str, chunk: str, ahead: str) -> bytes:
        """A chunk's transfer matrix as it is sent: all scores, or for merging files the pairs of pieces that go together."""
        if not self.merging:
            return b"m" + self.matrix(chunk, ahead).tobytes()
        found = self.merges.state_map(behind, chunk, ahead, counted=False)
        counts = np.array(found["counts"]).reshape(len(found["entries"]), -1)
        return json.dumps({"entries": found["entries"], "exits": found["exits"], "steps": [x.tolist() for x in np.nonzero(counts >= 0)]}).encode()

    def decode(self, ids: np.ndarray) -> str:
        sizes = np.diff(self.raw_at)[ids]
        text = self.raw[ragged_index(self.raw_at[:-1][ids], sizes)].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    """The worker's pieces of a file; made once."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def scan_pieces(maps: list[dict]) -> list[int]:
    """How far the pieces over the chunks' boundaries reach (one more than chunks), by maps from piece to piece."""
    reached, steps = [{e: None for e in maps[0]["entries"]}], []
    for m in maps:
        came: dict[int, int] = {}
        for i, j in zip(*m["steps"], strict=True):
            if m["entries"][i] in reached[-1]:
                came.setdefault(m["exits"][j], m["entries"][i])
        reached.append(came)
        steps.append(came)
    # One piece ends with the text; from there the way back is given.
    state = next(iter(reached[-1]))
    states = [state]
    for came in reversed(steps):
        state = came[state]
        states.append(state)
    return [s >> 32 for s in states[::-1]]


def scan(matrices: list[np.ndarray]) -> list[int]:
    """States at the chunks' boundaries (one more than chunks) of the best path from 0 to 0; the lowest state of equals."""
    reach = [np.where(np.arange(len(matrices[0])) == 0, 0.0, -np.inf)]
    for m in matrices:
        reach.append((reach[-1][:, None] + m).max(axis=0))
    states = [0]
    for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        states.append(int(np.argmax(before + m[:, states[-1]])))
    return states[::-1]


ENCODED = "doc_id long, ids binary"


def encoded(docs: DataFrame, model: str, chunk: int = CHUNK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    # Normalizing lengthens a text by a bounded factor; what counts is where it is solved, not what comes out.
    giant = F.char_length("text") > chunk

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            for part in batches([len(t) for t in frame["text"]], 1_000_000):
                group = frame.iloc[part]
                ids, at = p.encode(p.normalize(group["text"].tolist()))
                yield pd.DataFrame({"doc_id": group["doc_id"], "ids": [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            for row, doc_id, text in zip(frame["row"], frame["doc_id"].array, frame["text"], strict=True):
                whole = p.normalize([text])[0]
                at = list(range(0, len(whole), chunk))
                # A last chunk shorter than a piece would let a piece reach over it.
                if len(at) > 1 and len(whole) - at[-1] < p.longest:
                    at.pop()
                ends = [*at[1:], len(whole)]
                yield pd.DataFrame({"row": row, "doc_id": pd.array([doc_id] * len(at), dtype="Int64"), "chunk": range(len(at)), "behind": [whole[max(0, a - p.longest) : a] for a in at], "text": [whole[a:b] for a, b in zip(at, ends, strict=True)], "ahead": [whole[b : b + p.longest - 1] for b in ends]})

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            yield pd.DataFrame({"row": frame["row"], "chunk": frame["chunk"], "m": [p.transfer(b, t, a) for b, t, a in zip(frame["behind"], frame["text"], frame["ahead"], strict=True)]})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        if group["m"].iloc[0][:1] == b"{":
            found = scan_pieces([json.loads(m) for m in group["m"]])
        else:
            wide = int(np.sqrt(len(group["m"].iloc[0]) // 8))
            found = scan([np.frombuffer(m[1:]).reshape(wide, wide) for m in group["m"]])
        return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "start": found[:-1], "over": found[1:]})

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            ids, at = p.encode([(t + a)[s : len(t) + o] for t, a, s, o in zip(frame["text"], frame["ahead"], frame["start"], frame["over"], strict=True)])
            yield pd.DataFrame({"row": frame["row"], "doc_id": frame["doc_id"], "chunk": frame["chunk"], "ids": [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})

    whole = rows.where(~giant).select("doc_id", "text").mapInPandas(small, ENCODED)
    chunks = stage(rows.where(giant).mapInPandas(cut, "row long, doc_id long, chunk int, behind string, text string, ahead string"), "giant-chunks")
    dealt = spread(chunks, "row", "chunk")
    known = dealt.mapInPandas(matrices, "row long, chunk int, m binary").groupBy("row").applyInPandas(states, "row long, chunk int, start int, over int")
    parts = chunks.join(known, ["row", "chunk"]).select("row", "doc_id", "chunk", "text", "ahead", "start", "over").mapInPandas(trace, "row long, doc_id long, chunk int, ids binary")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    long = parts.groupBy("row", "doc_id").agg(ordered.alias("p")).select("doc_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return whole.unionByName(long)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """Add ``text`` to rows of ``doc_id, ids``."""

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for frame in frames:
            for i in range(0, len(frame), 1000):
                group = frame.iloc[i : i + 1000]
                yield pd.DataFrame({"doc_id": group["doc_id"], "ids": group["ids"], "text": [p.decode(np.frombuffer(x, np.uint32)) for x in group["ids"]]})

    return rows.select("doc_id", "ids").mapInPandas(back, "doc_id long, ids binary, text string")
