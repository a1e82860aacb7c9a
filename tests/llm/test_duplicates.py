"""Near copies, repeated passages and fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.llm import prob_minhash, suffix_groups, winnowing
from sessionlens.llm.common import components
from sessionlens.llm.shingles import jaccard, shingles

SCHEMA = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "'x' AS digest", "2 AS node")


def sets(text, k=5):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= threshold):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        d = rows[i][0]
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return [None if least[find(i)][0] else least[find(i)][1] for i in range(len(rows))]


def near_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    line = " ".join(word() for _ in range(8))
    rows += [(n, (line + "\n") * 30 + rows[0][1]), (n + 1, (line + "\n") * 30 + rows[9][1]), (n + 2, ""), (n + 3, ""), (n + 4, None), (n + 5, None), (n + 6, "one two"), (n + 7, " one  two ")]
    return rows + [rows[3], (None, rows[3][1]), (None, "lonely words in a row of no one else")]


def test_near_copies(spark):
    rows = near_rows()
    got = prob_minhash.near_copies(docs_of(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(((d, c) for (d, _), c in zip(rows, classes(rows), strict=True)), key=key)
    per_class = Counter(r.class_id for r in got if r.kept)
    assert all(n == 1 for c, n in per_class.items() if c is not None)


def test_near_copies_whose_repeat_counts_differ(spark):
    rng = random.Random(3)
    rows = []
    for n in range(12):
        words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
        # One text repeats its first fifth, the other its last; few distinct shingles are in one only.
        rows += [(2 * n, " ".join(words[:60] * 60 + words)), (2 * n + 1, " ".join(words + words[-60:] * 60))]
    assert classes(rows) == [2 * (i // 2) for i in range(len(rows))]
    got = {r.doc_id: r.class_id for r in prob_minhash.near_copies(docs_of(spark, rows)).collect()}
    assert got == {d: c for (d, _), c in zip(rows, classes(rows), strict=True)}


def test_kept_documents_keep_their_columns(spark):
    rows = near_rows()
    kept = prob_minhash.without_near_copies(docs_of(spark, rows)).collect()
    want = classes(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in want if c is not None})
    assert all(r.row == 1 and r.node == 2 for r in kept) and sum(r.doc_id is None for r in kept) == 1
    assert prob_minhash.without_near_copies(docs_of(spark, rows[:0])).count() == 0


def test_cross_bucket_blocks(spark, monkeypatch):
    # Tiny tiles: the comparison of what stars leave open is dealt out, and finds the same classes.
    monkeypatch.setattr(prob_minhash, "TILE", 2)
    monkeypatch.setattr(prob_minhash, "SET_TILE", 2)
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in prob_minhash.near_copies(docs_of(spark, rows)).collect() if r.doc_id is not None}
    assert got == {d: c for (d, _), c in zip(rows, classes(rows), strict=True) if d is not None}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 62, 300).astype(np.uint64), None
    b = np.concatenate([a[:200], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    wa, wb = rng.uniform(1, 4, 300), rng.uniform(1, 4, 300)
    wb[:200] = wa[:200]
    sig = prob_minhash.signatures(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, registers=4000)
    pa, pb = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    want = sum(1 / sum(max(pa.get(y, 0) / pa[x], pb.get(y, 0) / pb[x]) for y in {*pa, *pb}) for x in pa if x in pb)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_shingles_and_jaccard():
    texts = ["a b c d e f", "a b c d e g", "x", "", "a b c d e f a b c d e f"]
    text, _, count = shingles(texts)
    assert Counter(text.tolist()) == {0: 2, 1: 2, 2: 1, 4: 6} and count.max() == 2
    pairs = [(0, 1), (0, 4), (2, 3), (3, 3), (2, 2)]
    got = jaccard(texts, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert np.allclose(got, [len(sets(texts[a]) & sets(texts[b])) / max(1, len(sets(texts[a]) | sets(texts[b]))) for a, b in pairs])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def passage_texts():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh é") for _ in range(2500))

    def edited():
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        return "".join(t)

    other = lambda: "".join(rng.choice("abcdefgh ") for _ in range(500))
    return [*(edited() for _ in range(30)), *[base[500:1500]] * 3, "ab" * 700, "", "a" * 1000, None, base[:399], base[:400], *(other() + base[700 : 1100 + k * 7] for k in range(8))]


@pytest.mark.parametrize("many", [3, 2000])
def test_repeated_passages(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_groups, "MANY", many)
    monkeypatch.setattr(suffix_groups, "PIECE", 900)
    texts = passage_texts()
    got = suffix_groups.removal_report(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == repeats(texts, 400)


@pytest.mark.parametrize("size", [390, 399, 400, 410, 470])
def test_passage_in_many_texts_is_no_group_of_its_own(spark, monkeypatch, size):
    rng = random.Random(size)
    other = lambda: "".join(rng.choice("abcdefgh ") for _ in range(450))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(size))
    rims = [other() for _ in range(3)]
    texts = [rng.choice([other(), *rims])[rng.randint(0, 9) :] + passage + rng.choice([other(), *rims]) for _ in range(40)]
    compare = suffix_groups._compare

    def bounded(frames, length):
        frames = list(frames)
        most = Counter(k for f in frames for k in f["key"]).most_common(1)
        assert not most or most[0][1] <= 3, most
        yield from compare(iter(frames), length)

    monkeypatch.setattr(suffix_groups, "MANY", 3)
    monkeypatch.setattr(suffix_groups, "_compare", bounded)
    got = suffix_groups.removal_report(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == repeats(texts, 400)


@pytest.mark.parametrize("size", [390, 399, 400])
@pytest.mark.parametrize("tasks", [1, 211])
def test_shared_bytes_shorter_than_a_repeat(spark, size, tasks):
    # Anchors meet but nothing of the whole length does: batches without a single range.
    rng = random.Random(size)
    other = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(450))
    passage = "".join(rng.choice("ijklmnop ") for _ in range(size))
    texts = [other("abcd") + passage + other("abcd"), other("efgh") + passage + other("efgh"), other("qrst")]
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = suffix_groups.removal_report(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == repeats(texts, 400)


def test_texts_that_share_nothing(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(6)]
    got = suffix_groups.removal_report(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.text) for r in got] == [(0, 0, t) for t in texts]


def test_passages_are_cut_out_of_documents(spark):
    texts = passage_texts()
    df = docs_of(spark, [*enumerate(texts), (None, texts[0]), (3, texts[3])])
    got = suffix_groups.without_repeats(df).collect()
    assert sorted(got[0].asDict()) == sorted(df.columns) and len(got) == len(texts) + 2
    bytes_of = {r.doc_id: r.text for r in got}
    for i, (t, (_, removed, _, _)) in enumerate(zip([*texts], repeats([*texts, texts[0], texts[3]], 400), strict=False)):
        left = len((t or "").encode()) - removed
        assert (bytes_of[i] is None) == (t is None) and left - 3 <= len((bytes_of[i] or "").encode()) <= left
    assert suffix_groups.removal_report(docs_of(spark, [])).count() == 0


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(1500):
        x = [rng.randint(0, rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        assert suffix_groups.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize(("k", "w"), [(5, 16), (3, 7), (1, 1)])
def test_winnowing_keeps_the_rightmost_least(spark, k, w):
    rng = random.Random(k)
    texts = [" ".join(rng.choice(["a", "b", "cc", "dd"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 19, 20, 21, 60]))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = []
    for i, t in enumerate(texts):
        words = t.split()
        rows += [(i, j, *(words[j : j + k] + [None] * (k - len(words[j : j + k])))) for j in range(max(1, len(words) - k + 1)) if words]
    schema = "i int, j int, " + ", ".join(f"c{x} string" for x in range(k))
    one = [F.when(F.col(f"c{x}").isNotNull(), F.xxhash64(f"c{x}")) for x in range(k)]
    grams = {}
    for r in sorted(spark.createDataFrame(rows, schema).select("i", "j", F.xxhash64(*one).bitwiseAND(F.lit(0xFFFFFFFF)).alias("g")).collect()):
        grams.setdefault(r.i, []).append(r.g)
    for r in df.select("i", winnowing.fingerprint(F.col("text"), k, w).alias("f")).collect():
        g, want = grams.get(r.i, []), []
        for s in range(max(1, len(g) - w + 1) if g else 0):
            window = g[s : s + w]
            item = (min(window), s + max(p for p, v in enumerate(window) if v == min(window)))
            want += [item] if item not in want else []
        assert [(v >> 31, winnowing.PLACES - (v & winnowing.PLACES)) for v in r.f] == want


def test_edited_texts(spark):
    rows = [(1, "a b c d e f g" * 9), (2, ""), (3, None), (5, "x y"), (7, "héé " * 40), (8, "z" * 300), (8, "z" * 300), (None, "n n")]
    got = winnowing.fingerprints(docs_of(spark, rows)).collect()
    texts = {d: t or "" for d, t in rows}
    ring = [8, 7, 5, 3, 2, 1, None]
    after = dict(zip(ring, ring[1:] + ring[:1], strict=True))
    assert len(got) == len(rows)
    for r in got:
        own, new = texts[r.doc_id], texts[after[r.doc_id]]
        m = len(own) // 3
        edited = own[: len(own) - m] + new[:m]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = winnowing.fingerprints(docs_of(spark, [(4, "one two three four five six")])).collect()[0]
    assert one.near_next == 1.0
    assert winnowing.fingerprints(docs_of(spark, [])).count() == 0


def test_ids_with_many_texts(spark):
    # The hashes of texts that differ lie far apart: telling them apart must not overflow.
    several = [" ".join(f"{w}{i}" for w in "abcdefghijkl") for i in range(60)]
    rows = [(1, "first words of all " * 5), *((8, t) for t in several), *((None, t.upper()) for t in several), (9, "last words of all " * 5)]
    got = winnowing.fingerprints(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    texts_of = {}
    for d, t in rows:
        texts_of.setdefault(d, []).append(t)

    def edits(own, new):
        m = len(own) // 3
        return hashlib.sha256((own[: len(own) - m] + new[:m]).encode()).hexdigest()

    for d, after in {9: 8, 8: 1, 1: None, None: 9}.items():
        shas = Counter(r.edited_sha256 for r in got if r.doc_id == d)
        # One text of the next id follows all rows of an id.
        assert any(shas == Counter(edits(own, new) for own in texts_of[d]) for new in texts_of[after])
