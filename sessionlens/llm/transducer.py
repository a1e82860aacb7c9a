"""Token counts of whole texts by a tokenizer compiled to a deterministic transducer.

A file of the merging kind decides a text's pieces pair by pair: no merge ever crosses a boundary that the merges of the two pieces beside it
alone leave in place. So a sequence of pieces is the encoding of a text if and only if each piece encodes as itself and each two neighbours
keep their boundary, and there is one such sequence for every prefix of the text. The transducer reads characters. A state holds what the rest
of the text can still depend on: for each place from which a piece of the file may go on, the piece before it and how many tokens further the
prefix read by now has come. A transition is annotated with the tokens it emits (a number, which may be negative: a longer piece takes the
place of several). States are compiled when they are first reached, kept by each worker, and given up beyond a bound.

Characters that stand side by side in no piece are always parted, so texts fall into stretches that start in the first state; a batch's
distinct stretches are run once. A text longer than ``chunk`` is dealt out in chunks. What the chunks before leave open is the piece over the cut: where it ends and
which it is. A chunk's state map gives, for every piece that can stand over its start and every piece that can stand over its
end, the tokens between them. Maps are composed associatively, in groups of ``FAN`` per round, as a parallel scan does, until one per text is left.

Null text counts as empty and has no tokens; null and repeated ids are documents of their own; other columns are ignored. Files of the
unigram kind, and files with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import spread, whole_text
from sessionlens.llm.encode import WordStore
from sessionlens.llm.pieces import is_unigram
from sessionlens.llm.ragged import batches
from sessionlens.session import stage

CHUNK = 32_768
#: Maps composed at a time.
FAN = 16
#: Transitions a worker keeps.
MOST = 250_000
#: What a place may follow besides a piece: the start of a text, a character no piece covers.
START, UNKNOWN = -1, -2
_TRANSDUCERS: dict[str, "Transducer"] = {}


class Transducer(WordStore):
    # Stretches stand beside the states in a worker's memory.
    most_words = 600_000

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        if is_unigram(path):
            raise ValueError(f"{path} does not hold merges")
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        if any(m.is_unused(i) for i in ids):
            raise ValueError(f"{path} has unused pieces")
        special = [i for i in ids if m.is_byte(i) or m.is_control(i) or m.is_unknown(i)]
        usable = sorted({*ids} - {*special})
        self.text = {i: m.id_to_piece(i) for i in usable}
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {t: -m.get_score(i) for t, i in self.id.items()}
        if any(m.get_score(i) == 0 and len(self.text[i]) > 1 and i > usable[0] for i in usable):
            raise ValueError(f"{path} has user-defined pieces")
        self.with_bytes = any(m.is_byte(i) for i in special)
        self.longest = max(map(len, self.id))
        self.prefixes = {t[:k] for t in self.id for k in range(1, len(t))}
        pairs = {(a, b) for t in self.id for a, b in zip(t[:-1], t[1:], strict=True)}
        self.pairs = np.array(sorted(ord(a) << 32 | ord(b) for a, b in pairs), np.uint64)
        self.whole_pieces: dict[int, bool] = {}
        self.kept_boundaries: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.transitions: dict[int, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[str, tuple]] = []

    def normalize(self, texts: list[str]) -> list[str]:
        return [self.model.normalize(t) if t else "" for t in texts]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges, the best first, the leftmost of equals."""
        rank, parts = self.rank, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_whole(self, piece: int) -> bool:
        known = self.whole_pieces.get(piece)
        if known is None:
            known = self.whole_pieces[piece] = len(self.merged(self.text[piece])) == 1
        return known

    def keeps(self, left: int, right: int) -> bool:
        """Whether two pieces that each encode as themselves do so side by side."""
        if left < 0:
            return True
        known = self.kept_boundaries.get((left, right))
        if known is None:
            if len(self.kept_boundaries) > MOST:
                self.kept_boundaries.clear()
            a, b = self.text[left], self.text[right]
            known = self.kept_boundaries[left, right] = self.merged(a + b) == [a, b]
        return known

    def number(self, open_text: str, places: tuple) -> int:
        key = (open_text, places)
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.states)
            self.states.append(key)
        return found

    def after(self, piece: int) -> int:
        """The state behind a boundary that follows ``piece``."""
        return self.number("", ((0, piece, 0),))

    def compile(self, state: int, c: str) -> int:
        """The transition of a state by a character: the next state, times 256, and 128 more than the tokens it emits."""
        open_text, places = self.states[state]
        emitted, piece = None, UNKNOWN
        # A place: characters read since, the piece before it, and tokens emitted since.
        for size, before, tokens in places:
            found = self.id.get(open_text[len(open_text) - size :] + c)
            if found is not None and self.is_whole(found) and self.keeps(before, found):
                emitted, piece = 1 - tokens, found
                break
        if emitted is None and c not in self.id and places and places[-1][0] == 0:
            emitted = len(c.encode("utf-8", "surrogatepass")) if self.with_bytes else int(places[-1][1] != UNKNOWN)
        # Behind a given piece, unlike behind a start, some prefixes cannot end: no place is added, and the count stays where it was.
        ended = emitted is not None
        emitted = emitted or 0
        going = [(size + 1, before, tokens + emitted) for size, before, tokens in places if open_text[len(open_text) - size :] + c in self.prefixes]
        text = (open_text + c)[-going[0][0] :] if going else ""
        value = self.number(text, (*going, *[(0, piece, 0)] * ended)) << 8 | emitted + 128
        self.transitions[state << 21 | ord(c)] = value
        return value

    def last(self, state: int) -> int | None:
        """The piece that ends where the state is; None if none can."""
        places = self.states[state][1]
        return places[-1][1] if places and places[-1][0] == 0 else None

    def run(self, text: str, piece: int = START) -> tuple[int, int]:
        """Tokens of a text behind a boundary that follows ``piece``, and the last state."""
        if len(self.transitions) > MOST:
            self.clear()
        known, state, total = self.transitions, self.after(piece), 0
        for c in text:
            value = known.get(state << 21 | ord(c))
            if value is None:
                value = self.compile(state, c)
            state = value >> 8
            total += (value & 255) - 128
        return total, state

    def safe(self, codes: np.ndarray) -> np.ndarray:
        """Places, from 1 on, before which there is a boundary in any case."""
        pairs = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return 1 + np.flatnonzero(self.pairs[at] != pairs)

    def cut(self, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        start = text_start.copy()
        start[self.safe(codes)] = True
        return np.flatnonzero(start)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Only counts are kept, as the words' values."""
        return np.zeros(0, np.uint32), np.zeros(len(words), np.int64), np.array([self.run(w)[0] for w in words], np.float64)

    def counts(self, texts: list[str], most: int = 1_000_000) -> np.ndarray:
        """Tokens of normalized texts."""
        out = np.zeros(len(texts), np.int64)
        for part in batches([len(t) for t in texts], most):
            row, at = self.places(texts[part])
            out[part] = np.diff(np.concatenate([[0], np.cumsum(self.values[row])])[at]).astype(np.int64)
        return out

    def over(self, behind: str, ahead: str) -> list[tuple[int, int]]:
        """What can stand over a place between two texts: characters it reaches on, and the piece (or UNKNOWN, or START)."""
        if not behind:
            return [(0, START)]
        out = [(0, UNKNOWN)] if behind[-1] not in self.id else []
        for reach in range(min(self.longest - 1, len(ahead)) + 1):
            for size in range(reach + 1, min(self.longest, reach + len(behind)) + 1):
                piece = self.id.get(behind[len(behind) - size + reach :] + ahead[:reach])
                if piece is not None and self.is_whole(piece):
                    out.append((reach, piece))
        return out

    def state_map(self, behind: str, chunk: str, ahead: str, counted: bool = True) -> dict:
        """Tokens between each piece over the chunk's start and each piece over its end (-1 where they do not go together).

        Without ``counted``, those between certain boundaries are left out: it still says which pieces go together."""
        codes = np.frombuffer((chunk + ahead).encode("utf-32-le", "surrogatepass"), np.uint32)
        safe = self.safe(codes)
        safe = safe[safe < len(chunk)]
        entries = self.over(behind, (chunk + ahead)[: self.longest])
        exits: dict[tuple[int, int], int] = {}
        rows = []
        # Between the first and the last certain boundary all entries go the same way.
        first, last = (int(safe[0]), int(safe[-1])) if len(safe) else (None, 0)
        if first is not None:
            middle = int(self.counts([(chunk + ahead)[first:last]])[0]) if counted else 0
            tail = self.ends(chunk[last:], ahead, START)
        for reach, piece in entries:
            if first is None:
                rows.append(self.ends(chunk[reach:], ahead[max(0, reach - len(chunk)) :], piece))
            elif reach <= first:
                head, state = self.run(chunk[reach:first], piece)
                rows.append({k: head + middle + n for k, n in tail.items()} if self.last(state) is not None else {})
            else:
                rows.append({})
            for k in rows[-1]:
                exits.setdefault(k, len(exits))
        counts = np.full((len(entries), len(exits)), -1, np.int64)
        for i, row in enumerate(rows):
            for k, n in row.items():
                counts[i, exits[k]] = n
        return {"entries": [r << 32 | (p & 0xFFFFFFFF) for r, p in entries], "exits": [r << 32 | (p & 0xFFFFFFFF) for r, p in exits], "counts": counts.ravel().tolist()}

    def ends(self, text: str, ahead: str, piece: int) -> dict[tuple[int, int], int]:
        """From a boundary behind ``piece``: every piece that may stand over the end of ``text``, and the tokens up to its end."""
        total, state = self.run(text, piece)
        out = {}
        for reach in range(len(ahead) + 1):
            last = self.last(state)
            # It must start before the end of the text, or end there.
            if last is not None and (reach == 0 or reach < (len(self.text[last]) if last >= 0 else 1)):
                out[reach, last] = total
            if reach == min(len(ahead), self.longest - 1):
                break
            value = self.transitions.get(state << 21 | ord(ahead[reach])) or self.compile(state, ahead[reach])
            state, total = value >> 8, total + (value & 255) - 128
        return out


def transducer(path: str) -> Transducer:
    """The worker's transducer of a file; made once."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def composed(maps: pd.DataFrame) -> dict:
    """The map of several chunks in a row."""
    first = maps.iloc[0]
    entries, exits, counts = first["entries"], list(first["exits"]), np.array(first["counts"], np.int64).reshape(len(first["entries"]), -1)
    for _, row in maps.iloc[1:].iterrows():
        step = np.array(row["counts"], np.int64).reshape(len(row["entries"]), -1)
        place = {k: i for i, k in enumerate(row["entries"])}
        joined = np.full((len(entries), step.shape[1]), -1, np.int64)
        for i, k in enumerate(exits):
            if k in place:
                both = np.where((counts[:, i, None] >= 0) & (step[place[k]] >= 0), counts[:, i, None] + step[place[k]], -1)
                joined = np.maximum(joined, both)
        exits, counts = list(row["exits"]), joined
    return {"entries": entries, "exits": exits, "counts": counts.ravel().tolist()}


MAPS = "row long, doc_id long, n_bytes long, chunk int, entries array<long>, exits array<long>, counts array<long>"


def token_counts(docs: DataFrame, model: str, chunk: int = CHUNK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    giant = F.char_length("text") > chunk

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for frame in frames:
            for part in batches([len(x) for x in frame["text"]], 1_000_000):
                group = frame.iloc[part]
                yield pd.DataFrame({"doc_id": group["doc_id"], "n_bytes": group["n_bytes"], "n_tokens": t.counts(t.normalize(group["text"].tolist()))})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for frame in frames:
            for row, doc_id, n_bytes, text in zip(frame["row"], frame["doc_id"].array, frame["n_bytes"], frame["text"], strict=True):
                whole = t.normalize([text])[0]
                side = t.longest
                step = max(chunk, side)
                at = np.arange(0, max(1, len(whole)), step)
                yield pd.DataFrame({"row": row, "doc_id": pd.array([doc_id] * len(at), dtype="Int64"), "n_bytes": n_bytes, "chunk": range(len(at)), "behind": [whole[max(0, a - side) : a] for a in at], "text": [whole[a : a + step] for a in at], "ahead": [whole[a + step : a + step + side] for a in at]})

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for frame in frames:
            found = [t.state_map(b, x, a) for b, x, a in zip(frame["behind"], frame["text"], frame["ahead"], strict=True)]
            columns = {k: pd.Series([f[k] for f in found], dtype=object) for k in ("entries", "exits", "counts")}
            yield frame[["row", "doc_id", "n_bytes", "chunk"]].assign(**columns)

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        head = group[["row", "doc_id", "n_bytes"]].iloc[:1].reset_index(drop=True)
        return head.assign(chunk=int(group["chunk"].iloc[0]) // FAN, **{k: pd.Series([v], dtype=object) for k, v in composed(group).items()})

    pieces = rows.where(giant).mapInPandas(cut, "row long, doc_id long, n_bytes long, chunk int, behind string, text string, ahead string")
    level = stage(spread(pieces, "row", "chunk").mapInPandas(maps, MAPS), "state-maps")
    while level.where("chunk > 0").limit(1).count():
        level = stage(level.groupBy("row", F.floor(F.col("chunk") / FAN).alias("part")).applyInPandas(compose, MAPS), "state-maps")
    # A text starts at its start, and its last piece ends with it: of the map that is left one cell has a count.
    long = level.select("doc_id", "n_bytes", F.array_max("counts").alias("n_tokens"))
    return rows.where(~giant).select("doc_id", "n_bytes", "text").mapInPandas(small, "doc_id long, n_bytes long, n_tokens long").unionByName(long)
