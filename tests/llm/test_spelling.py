import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sessionlens.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=7, every=31):
    words = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= least}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least=7, every=31, times=10):
    words = {w: n for w, n in counted(rows, least, every).items() if n >= 2}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a < b and abs(len(a) - len(b)) < 2 and distance_one(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in near:
        best = min(near[w], key=lambda x: (-words[x], x))
        if words[best] >= times * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w, ""), words.get(form.get(w), 0), root(w)) for w, n in words.items())


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS form")
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in spelling.variants(df, **more).collect())


def corpus(seed, alphabet, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 11))) for _ in range(40)]

    def typo(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]])

    weights = [400 / (i + 1) ** 1.5 for i in range(40)]
    rows = []
    for d in range(docs):
        words = [typo(w) if rng.random() < 0.15 else typo(typo(w)) if rng.random() < 0.03 else w for w in rng.choices(base, weights, k=60)]
        rows.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in words).replace(" ", rng.choice([" ", ", ", "1", "—", "ß\t"]), 5)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abcdefghij"), (2, "ab"), (3, "éàèxyzÀß")])
def test_equals_brute_force(spark, monkeypatch, seed, alphabet):
    # Small blocks and tiles, so that words meet across both.
    for name, value in {"BLOCK": 50, "TILE": 7, "PIECE": 500, "FLUSH": 40}.items():
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(seed, alphabet)
    got = found(spark, rows)
    assert got == expected(rows) and any(r[3] for r in got)


def test_nulls_empty_repeated_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 100)
    long = " ".join(["anything"] * 900 + ["anythinge", "anythinge", "nything", "nything"] * 3)
    rows = [(1, long), (1, long), (None, "missing missing Missing"), (2, None), (3, ""), (4, "x" * 3000 + " " + "x" * 3000), (5, "x" * 3001), (5, "x" * 3001), (6, "× ÷ Ààààààà ààààààà ààààààà")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == [] and found(spark, [(1, "lonelyword")]) == []


def test_chains_of_forms(spark):
    rows = [(d, " ".join(["abcdefg"] * 1000 + ["abcdefgh"] * 90 + ["abcdefghi"] * 8 + ["abcdefgij"] * 8)) for d in range(1, 6)]
    got = found(spark, rows, every=1 << 33)
    assert got == expected(rows, every=1 << 33)
    assert {w: r for w, *_, r in got}["abcdefghi"] == "abcdefg"


def test_ties_between_forms(spark):
    rows = [(1, " ".join(["zzzzzza", "zzzzzzb"] * 30 + ["zzzzzzc"] * 2))]
    assert {w: f for w, _, _, f, _, _ in found(spark, rows, every=1 << 33)}["zzzzzzc"] == "zzzzzza"


def test_checksums():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 200)
    size = np.concatenate([rng.integers(1, 90, 198), [0, 700]])
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[s : s + n].tobytes()) for i, (s, n) in enumerate(zip(start, size, strict=True))]
    assert spelling.crc32_of(data, start, size, before).tolist() == want


@pytest.mark.parametrize("wider", [0, 1])
def test_one_edit(wider):
    rng = random.Random(wider)
    a = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(3000)]
    b = ["".join(rng.choice("abc") for _ in range(6 + wider)) for _ in range(3000)]
    as_matrix = lambda words: np.array([list(w.encode()) for w in words], np.uint8)
    assert spelling.one_edit(as_matrix(a), as_matrix(b)).tolist() == [distance_one(x, y) for x, y in zip(a, b, strict=True)]
