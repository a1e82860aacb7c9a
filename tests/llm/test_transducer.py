import random

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from sessionlens.llm import transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "in", "ing", "er", "  ", " ", "the", "\n", "ñ", "日本", "😀", "1", "=", "==", "▁", "e", "t", "h", "<s>", "----", "\t", "İ", "\x00"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def text_of(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_runs_and_state_maps_count_as_the_library(library):
    rng = random.Random(1)
    t = transducer.Transducer(MODEL)
    for _ in range(600):
        text = text_of(rng, rng.randint(0, 60))
        whole, want = t.normalize([text])[0], len(library.encode(text))
        assert t.run(whole)[0] == want == t.counts([whole])[0]
        step = rng.choice([16, 17, 20, 30])
        at = range(0, max(1, len(whole)), step)
        maps = pd.DataFrame([t.state_map(whole[max(0, i - t.longest) : i], whole[i : i + step], whole[i + step : i + step + t.longest]) for i in at])
        assert max(transducer.composed(maps)["counts"], default=0) == want
        # Composition is associative.
        k = rng.randint(1, len(maps))
        parts = pd.DataFrame([transducer.composed(p) for p in (maps.iloc[:k], maps.iloc[k:]) if len(p)])
        assert max(transducer.composed(parts)["counts"], default=0) == want


def test_states_are_compiled_again_after_the_bound(library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST", 50)
    rng, t = random.Random(2), transducer.Transducer(MODEL)
    texts = [text_of(rng, 40) for _ in range(60)]
    assert t.counts(t.normalize(texts)).tolist() == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("fan", [2, 16])
def test_documents(spark, library, monkeypatch, fan):
    monkeypatch.setattr(transducer, "FAN", fan)
    rng = random.Random(3)
    texts = ["", None, " ", "a", *(text_of(rng, n) for n in (30, 100, 1000, 3000)), "a" * 2000, "=" * 1999, " " * 1500, "😀" * 700, "ing" * 900 + "e"]
    rows = [*enumerate(texts), (None, texts[5]), (6, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS chunk", "2 AS n_bytes")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in transducer.token_counts(df, MODEL, chunk=64).collect())
    assert got == sorted((-1 if d is None else d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows)
    assert transducer.token_counts(df.limit(0), MODEL).count() == 0


def test_query_limit(spark, library, tmp_path):
    from sessionlens.llm.queries import token_counts_query

    texts = ["word " * 4095 + "x", "z 1 " * 3000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in token_counts_query(spark, str(tmp_path)).collect()}
    assert got == {i: (n, n > 4096) for i, n in enumerate(len(library.encode(t or "")) for t in texts)}
