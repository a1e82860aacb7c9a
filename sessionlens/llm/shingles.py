"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from sessionlens.llm.encode import SPACE, character_classes
from sessionlens.llm.ragged import mix, offsets, prefix_hash, span_hash


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, start and end of every word (what blanks part), and the offsets of the texts' words."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = offsets(lengths)
    if not len(codes):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    solid = character_classes()[codes] != SPACE
    cut = np.zeros(len(codes), bool)
    cut[at[:-1][lengths > 0]] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~np.concatenate([cut[1:], [True]])
    return codes, start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, at)


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, count)`` of the distinct shingles, ordered by text and hash.

    A text of fewer words than a shingle takes has one shingle of all its words; a text without words has none.
    """
    codes, start, end, at = word_spans(texts)
    per_text = np.diff(at)
    n = np.where(per_text == 0, 0, np.maximum(per_text - words + 1, 1))
    text = np.repeat(np.arange(len(texts)), n)
    if not len(text):
        return text, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = prefix_hash(mix(span_hash(prefix_hash(codes), start, end)))
    first = np.repeat(at[:-1] - offsets(n)[:-1], n) + np.arange(len(text))
    hashes = mix(span_hash(h, first, np.minimum(first + words, at[1:][text])))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    places = np.flatnonzero(new)
    return text[places], hashes[places], np.diff(np.append(places, len(text)))


def jaccard(texts: list[str], left: np.ndarray, right: np.ndarray, words: int = 5) -> np.ndarray:
    """Exact Jaccard similarity of the distinct shingles of ``texts[left[i]]`` and ``texts[right[i]]``; 0 without shingles."""
    text, hashes, _ = shingles(texts, words)
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x, y = hashes[at[a] : at[a + 1]], hashes[at[b] : at[b + 1]]
        if len(x) and len(y):
            place = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[place] == y).sum())
            out[i] = both / (len(x) + len(y) - both)
    return out
