"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, for use inside tasks.

The library spends most of its time on words it has met before. Here numpy cuts a batch of texts into the words the file's
own pattern cuts, and only words that are new to this worker are handed to the library; ids of known words are copied. Texts
that hold one of the file's added tokens, and files with another pre-tokenizer, go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd

from sessionlens.llm.ragged import batches, offsets, prefix_hash, ragged_index, span_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What the pattern takes after an apostrophe.
AFTER_APOSTROPHE = ("s", "t", "re", "ve", "m", "ll", "d")
#: Known words kept by a worker; beyond it the store starts anew.
MOST_WORDS = 1_500_000
_CLASSES: list[np.ndarray] = []
_ENCODERS: dict[str, "Encoder"] = {}


def character_classes() -> np.ndarray:
    """Class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    if not _CLASSES:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[[ord(c) for c in m[0]]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def word_starts(codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where words start in the texts that ``codes`` holds one after another; ``text_start`` marks each text's first place."""
    kind = character_classes()[codes]
    new_run = np.empty(len(codes), bool)
    new_run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new_run[1:])
    new_run |= text_start
    is_space = kind == SPACE
    # The last place of a blank run that text follows: a blank joins the next word, anything else stands alone.
    last = np.zeros(len(codes), bool)
    last[:-1] = is_space[:-1] & ~is_space[1:] & ~text_start[1:]
    joins = last & (codes == 32)
    start = new_run | last
    start[1:] &= ~joins[:-1]
    quote = np.flatnonzero((codes[:-1] == 39) & new_run[:-1] & start[:-1] & new_run[1:] & (kind[1:] == LETTER) & ~text_start[1:])
    for p in quote:
        ahead = "".join(map(chr, codes[p + 1 : p + 3]))
        for tail in AFTER_APOSTROPHE:
            if ahead.startswith(tail) and (len(tail) == 1 or (kind[p + 2] == LETTER and not text_start[p + 2])):
                start[p + 1] = False
                if p + 1 + len(tail) < len(codes):
                    start[p + 1 + len(tail)] = True
                break
    return np.flatnonzero(start)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 as it is, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class WordStore:
    """Ids of words that were met before. Subclasses say where words start (``cut``) and what the ids of new words are (``ids_of``)."""

    most_words = MOST_WORDS

    def __init__(self) -> None:
        self.forget()

    def cut(self, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, number of ids per word, and a value per word."""
        raise NotImplementedError

    def forget(self) -> None:
        self.keys = [pd.Index(np.zeros(0, np.uint64))]
        self.ids, self.starts, self.sizes, self.values = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def known(self) -> int:
        return sum(map(len, self.keys))

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key among the known words, -1 for new ones."""
        found, before = np.full(len(keys), -1, np.int64), 0
        for index in self.keys:
            left = np.flatnonzero(found < 0)
            at = index.get_indexer(keys[left])
            found[left] = np.where(at < 0, -1, at + before)
            before += len(index)
        return found

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, sizes, values = self.ids_of(words)
        self.starts = np.concatenate([self.starts, len(self.ids) + offsets(sizes)[:-1]])
        self.sizes, self.ids, self.values = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids]), np.concatenate([self.values, values])
        # Each index is over twice as long as the next, so that few are looked up and each key is moved a few times.
        self.keys.append(pd.Index(keys))
        while len(self.keys) > 1 and len(self.keys[-2]) < 2 * len(self.keys[-1]):
            last = self.keys.pop()
            self.keys[-1] = self.keys[-1].append(last)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of every word of the texts in the store, and the offsets of the texts in this list."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        at = offsets(lengths)
        text_start = np.zeros(len(codes), bool)
        text_start[at[:-1][lengths > 0]] = True
        start = self.cut(codes, text_start)
        end = np.append(start[1:], len(codes))
        place, keys = pd.factorize(span_hash(prefix_hash(codes), start, end))
        if self.known() + len(keys) > self.most_words:
            self.forget()
        row = self.rows(keys)
        if len(new := np.flatnonzero(row < 0)):
            first = np.empty(len(keys), np.int64)
            first[place[::-1]] = np.arange(len(place))[::-1]
            joined = "".join(texts)
            known = self.known()
            self.learn(keys[new], [joined[start[i] : end[i]] for i in first[new]])
            row[new] = known + np.arange(len(new))
        return row[place], np.searchsorted(start, at)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row, at = self.places(texts)
        sizes = self.sizes[row]
        return self.ids[ragged_index(self.starts[row], sizes)], offsets(sizes)[at]


class Encoder(WordStore):
    """``encode(texts)`` gives one flat id array and the offsets of the texts in it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]

    def cut(self, codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        return word_starts(codes, text_start)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        model, table = self.tokenizer.model, byte_letters()
        got = [[t.id for t in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table))] for w in words]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum())), sizes, np.zeros(len(words))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Texts are taken in batches of about ``most`` characters, whatever their number."""
        flat, sizes = [], np.zeros(len(texts), np.int64)
        for part in batches([len(t) for t in texts], most):
            group = texts[part]
            odd = [i for i, t in enumerate(group) if not self.by_word or any(a in t for a in self.added)]
            if not odd:
                ids, at = self.words(group)
                flat.append(ids)
                sizes[part] = np.diff(at)
                continue
            by_text = {i: self.whole([group[i]])[0] for i in odd}
            ids, at = self.words([t for i, t in enumerate(group) if i not in by_text])
            plain = iter(np.split(ids, at[1:-1]) if len(at) > 1 else [])
            all_ids = [by_text[i] if i in by_text else next(plain) for i in range(len(group))]
            flat.extend(all_ids)
            sizes[part] = [len(x) for x in all_ids]
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), offsets(sizes)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
