"""Encoding, token files, packing: against the tokenizers library, exact round trips, and counting."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sessionlens.llm import packing, token_files
from sessionlens.llm.encode import encoder
from sessionlens.llm.token_files import WaveletMatrix

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["it's", "'s a", " 's", "''s", "a'sb c'll d'xx'", "a  b\n\n c \t d ", "", "  ", "x<|endoftext|>y", "'re", "é'tude 12ab３", "a'", "\x1c\x1d x", "\x85y", "日本語 テキスト", "a" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" 's\nabé1.,!") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):  # new words, then known ones
        ids, at = encoder(PATH).encode(texts, most=500)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 300, n).astype(np.uint32)
    w = WaveletMatrix.build(x)
    w = WaveletMatrix(w.n, w.zeros, [p.tobytes() for p in w.planes], [o.tobytes() for o in w.ones])
    assert (w.decode() == x).all() and (w.access(np.arange(n)) == x).all()
    for token in {*x[:2].tolist(), 299, 5, 1 << 20}:
        assert w.count(token) == (x == token).sum() and (w.find(token) == np.flatnonzero(x == token)).all()
        assert w.count(token, n // 3, n // 2) == (x[n // 3 : n // 2] == token).sum()


DOCS = [(5, "b c"), (None, "null id"), (3, None), (3, "again"), (3, "again"), (1, ""), *[(100 + i, t) for i, t in enumerate(ODD)]]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS ids", "1 AS length", "'x' AS part")


def test_token_files_round_trip(spark, tmp_path, library):
    token_files.write_tokens(docs_of(spark, DOCS), f"{tmp_path}/t", PATH, end_id=2, shard_tokens=20)
    got = token_files.read_documents(spark, f"{tmp_path}/t").orderBy("start").collect()
    want = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(got, want, strict=True):
        ids = ids_of(library, text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.crc) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes())) and bytes(row.ids) == ids.tobytes()
        start += len(ids)
    assert token_files.read_shards(spark, f"{tmp_path}/t").count() > 3
    token_files.write_tokens(docs_of(spark, DOCS[:0]), f"{tmp_path}/none", PATH, end_id=2)
    assert token_files.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_packing_is_whole_and_gapless(spark, library):
    capacity = 64
    packed = packing.pack(packing.token_pieces(docs_of(spark, DOCS * 3), PATH, capacity, end_id=0), capacity)
    rows = packed.toPandas()
    lengths = sorted(len(ids_of(library, t, 0)) for _, t in DOCS * 3)
    heads = rows[rows.piece == 0]
    assert len(heads) == len(lengths) and rows.length.sum() == sum(lengths)
    assert (rows[rows.piece > 0].length == capacity).all() and rows.length.between(1, capacity).all()
    in_order = rows.sort_values(["sequence_id", "offset"])
    assert (in_order.groupby("sequence_id").length.cumsum() - in_order.length == in_order.offset).all()
    assert in_order.groupby("sequence_id").length.sum().max() <= capacity
    # A sequence of the operator's is the ids of its pieces.
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed, capacity).collect()}
    assert whole == {k: b"".join(map(bytes, g.ids)) for k, g in in_order.groupby("sequence_id")}
    assert packing.pack(packing.token_pieces(docs_of(spark, DOCS[:0]), PATH, capacity, 0), capacity).count() == 0


def test_configurations_hold_the_histogram_and_are_few():
    rng = random.Random(4)
    for case in range(8):
        capacity = rng.choice([10, 50, 200])
        histogram = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 30))}
        got = packing.configurations(histogram, capacity, rounds=100)
        held = {}
        for config, times in got:
            assert sum(config) <= capacity and times > 0
            for length in config:
                held[length] = held.get(length, 0) + times
        assert held == histogram, case
        # Best fit in falling order as a yardstick.
        rooms = []
        for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            k = min((i for i, r in enumerate(rooms) if r >= length), key=lambda i: rooms[i], default=None)
            if k is None:
                rooms.append(capacity - length)
            else:
                rooms[k] -= length
        assert sum(t for _, t in got) <= len(rooms)
        need = np.zeros(capacity + 1, np.int64)
        need[list(histogram)] = list(histogram.values())
        assert sum(t for _, t in packing.best_fit(need, [], capacity)) == len(rooms)


def test_pieces_of_long_documents_are_the_library_s(spark, library):
    capacity = 16
    rows = packing.token_pieces(docs_of(spark, DOCS), PATH, capacity, end_id=0).toPandas()
    texts = dict(DOCS)
    for doc_id, text in texts.items():
        if doc_id is None or sum(d == doc_id for d, _ in DOCS) > 1:
            continue
        ids = ids_of(library, text, 0)
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        got = rows[rows.doc_id == doc_id].sort_values("piece")
        assert got.start.tolist() == cuts[:-1] and got.piece.tolist() == list(range(len(cuts) - 1))
        assert [bytes(x) for x in got.ids] == [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_pack_refuses_long_pieces_and_skips_empty_ones(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 5)], "doc_id long, length long")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(df, 10).collect()}
    assert got[2] == got[3] == (None, None) and {got[1][1], got[4][1]} == {0, 5} and got[1][0] == got[4][0]
    with pytest.raises(ValueError):
        packing.pack(df, 4)
