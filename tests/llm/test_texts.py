"""Archives, quality, roles and pieces: round trips, held-out accuracy, brute force."""

import hashlib
import itertools
import json
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from sessionlens.llm import arc, neighbours, pieces, roles

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 150
    rows = [(5, "http://a b/\n", big), (3, None, big), (None, "u", big), (7, "u", None), (8, "u", ""), (9, "u", "short"), (2, "u", "short"),
            (11, "u", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n\r\n\n\nhttp://x 1 2 3 4\n" * 9), (12, "é", "日本\r\n\r\n" * 30), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS payload", "3 AS digest")
    arc.write_arc(pages.repartition(3), f"{tmp_path}/arc")
    arc.write_warc(arc.with_revisits(arc.read_arc(spark, f"{tmp_path}/arc")), f"{tmp_path}/warc")
    got = arc.read_warc(spark, f"{tmp_path}/warc").collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) >= len(rows) - 1
    html = {d: (h or "").encode() for d, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.key]), hashlib.sha256(html[r.key]).hexdigest())
        revisit = html[r.key] == big.encode() and r.key != 3
        assert (r.type, r.refers_key, r.payload) == (("revisit", 3, None) if revisit else ("response", None, html[r.key]))
    arc.write_arc(pages.limit(0), f"{tmp_path}/none")
    assert arc.read_arc(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parser_goes_by_declared_lengths(version):
    body = b"HTTP/1.0 404 Not\r\n\r\nhttp://fake 1 2 text/html 3\n\n"
    line = arc.header_line(version, "http://x/", "1.2.3.4", "1999", "text/html; charset=x", len(body))
    data = arc.version_block(version, "f.arc", "19990101000000").encode() + b"\n" + line.encode() + b"\n" + body + b"\n\n"
    (fields, block), = arc.parse_arc(data)
    assert block == body and fields["Archive-date"] == "1999"
    row = arc.converted(fields, block)
    assert row[1] == "response" and row[4] == "1999-01-01T00:00:00Z" and row[0].startswith("urn:uuid:")
    assert arc.converted({**fields}, b"GIF89a")[1] == "resource"
    with pytest.raises(ValueError):
        list(arc.parse_arc(data[:-20]))


def junk(rng, words):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in words)
    return " ".join([words[0]] * len(words))


def test_quality_votes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubcdlnrst") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.3
        docs.append((i, junk(rng, words) if bad else " ".join(words).capitalize() + "."))
        labels.append((i, int(not bad), 0))
    docs += [(None, "some text."), (9000, None), (9001, ""), (9001, "")]
    labels += [(None, 1, 0), (5, None, 0), (77777, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS quality")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = neighbours.scores(df, lab, sample=200).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict((d, q) for d, q, _ in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 600]
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1
    none = neighbours.scores(df, lab.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert neighbours.scores(df.limit(0), lab).count() == 0


def test_held_out_labels_teach_nothing(spark):
    df = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(60)], "doc_id long, text string")
    flags = {r.doc_id: r.h for r in df.select("doc_id", neighbours.held_out().alias("h")).collect()}
    lab = lambda flip: spark.createDataFrame([(i, (1 - i % 2 if flip and flags[i] else i % 2)) for i in range(60)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in neighbours.scores(df, lab(f)).collect()} for f in (False, True))
    assert a == b


def cheapest(names):
    best = None
    for seq in itertools.product((1, 2, 3), repeat=len(names)):
        cost, state = 0.0, 0
        for name, t in zip(names, seq, strict=True):
            cost += roles.LINK[state][t - 1][0] + roles.role_costs(name)[t - 1]
            state = t
        key = (cost + roles.INSERT * len(roles.ENDING[state]), state, seq[::-1])
        best = min(best, key) if best else key
    return best[0], best[2][::-1]


def repaired_one(names):
    costs = roles.START
    for name in names:
        costs = roles.step(costs, name)
    end = roles.best_end(costs)
    return costs[end] + roles.INSERT * len(roles.ENDING[end]), tuple(roles.trace(roles.START, names, end)[1:])


def test_repair_is_cheapest():
    rng = random.Random(5)
    for _ in range(200):
        names = [rng.choice(["user", "assistant", "system", "Human", None, "tool"]) for _ in range(rng.randint(1, 6))]
        assert repaired_one(names) == cheapest(names)


def test_repair_over_many_tasks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.choice(["user", "assistant", "user", "system", None, "x"]), rng.choice([f"t{i}", None, ""])) for i in range(300)]
    rows += [(9, j, rng.choice(["user", "assistant"]), f"h{j}") for j in range(1500)] + [(9, 5, "user", "h5"), (9, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS seq", "3 AS state")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = roles.repaired(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    source, found = defaultdict(list), defaultdict(list)
    none = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (none(r[0]), none(r[1]), (r[2] is not None, r[2] or ""), r[3] or "")):
        source[r[0]].append(r)
    for r in got:
        found[r.conv_id].append((none(r.turn), r.role, r.action, r.inserted, r.cost, r.rendered))
    for conv, turns in source.items():
        names = [r[2] for r in turns]
        _, states = repaired_one(names)
        want = [(none(r[1]), *x) for r, x in zip(turns, roles.rendered(names, [r[3] or "" for r in turns], [0, *states], True), strict=True)]
        assert sorted(found[conv]) == sorted(want)
    whole = "".join(x[-1] for x in roles.rendered(["user", "user", "assistant"], ["a", "b", "c"], [0, 2, 2, 3], True))
    assert whole == "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert roles.repaired(df.limit(0)).count() == 0


TEXTS = ["Hello world thtiont", "日本 ☃ x", "", "  a   b", "émentréch éêtre", "=======x", "line\nbreak\ttab", "Thtionoues erreoror whed the threonou edea", "-" * 90 + "a" * 90]


def best_sum(p, text):
    best = [0.0] + [-np.inf] * len(text)
    names = {p.model.id_to_piece(int(i)): p.scores[i] for i in p.usable}
    for end in range(1, len(text) + 1):
        for size in range(1, min(p.longest, end) + 1):
            part = text[end - size : end]
            w = names.get(part, p.unknown_score if size == 1 else -np.inf)
            best[end] = max(best[end], best[end - size] + w)
    return best[-1]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram file put together by hand: letters and some of their combinations with any scores."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    rng, model = random.Random(6), proto.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces = False
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=name, score=0.0, type=kind)
    parts = {*"▁abehlortd=-", "▁a", "er", "or", "the", "hou", "thr", "▁th", "==", "====", "ab", "abab", "ba", "▁▁", "oror"}
    for piece in sorted(parts):
        model.pieces.add(piece=piece, score=-rng.uniform(1, 9), type=1)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def lumps(text, size, p):
    at = list(range(0, len(text), size))
    if len(at) > 1 and len(text) - at[-1] < p.longest:
        at.pop()
    return at, [*at[1:], len(text)]


MORE = ["=-" * 150 + "a" * 333 + "日本" * 50, " " * 300, "ab" * 250 + "-" * 100, " ".join(TEXTS)]


def test_unigram_pieces_have_the_greatest_sum(unigram):
    p, library = pieces.Pieces(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    normal = p.normalize(TEXTS + MORE)
    ids, at = p.encode(normal)
    for i, t in enumerate(normal):
        assert abs(p.score(t) - best_sum(p, t)) < 1e-6
        known = [c for c in (TEXTS + MORE)[i] if c in " abehlortd=-"]
        again, ends = p.encode(p.normalize(["".join(known)]))
        assert again[: ends[1]].tolist() == library.encode("".join(known))
    for text in normal[len(TEXTS) :]:
        starts, ends = lumps(text, 40, p)
        states = pieces.scan([p.matrix(text[a:e], text[e : e + p.longest - 1]) for a, e in zip(starts, ends, strict=True)])
        parts = [text[a + s : e + o] for a, e, s, o in zip(starts, ends, states[:-1], states[1:], strict=True)]
        assert "".join(parts) == text and abs(sum(map(p.score, parts)) - p.score(text)) < 1e-6


def test_merged_pieces_are_the_library_s():
    p, library = pieces.pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = TEXTS + MORE + ["".join(rng.choice(["a", "in", "ing", " ", "the", "\n", "日本", "😀", "=", "er", "<s>"]) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    ids, at = p.encode(p.normalize(texts))
    for i, t in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == library.encode(t) and p.decode(np.array(mine, np.int64)) == t
    # A long stretch goes by a heap, a short one by passes over it.
    for t in ("=" * 999, "a" * 500 + "ing" * 200, "ab" * 300):
        assert p.merged(t) == p.merges.merged(t)


@pytest.mark.parametrize("size", [17, 40, 100])
def test_chunks_and_states_give_the_library_s_boundaries(size):
    p = pieces.pieces(MODEL)
    for text in p.normalize(MORE):
        starts, ends = lumps(text, size, p)
        states = pieces.scan_pieces([json.loads(p.transfer(text[max(0, a - p.longest) : a], text[a:e], text[e : e + p.longest - 1])) for a, e in zip(starts, ends, strict=True)])
        parts = [text[a + s : e + o] for a, e, s, o in zip(starts, ends, states[:-1], states[1:], strict=True)]
        assert "".join(parts) == text and [i for x in parts for i in p.encode([x])[0].tolist()] == p.encode([text])[0].tolist()


@pytest.mark.parametrize("kind", ["merges", "unigram"])
def test_pieces_on_tables(spark, unigram, kind):
    model = MODEL if kind == "merges" else unigram
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [*enumerate(TEXTS), (None, "null id"), (50, None), (51, "hello other road " * 300), (51, "hello other road " * 300), (52, "=" * 777)]
    if kind == "unigram":
        rows = [(d, "".join(c for c in t or "" if c in " abehlortd=-")) for d, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS chunk", "3 AS ids", "'x' AS behind")
    got = pieces.decoded(pieces.encoded(df, model, chunk=100), model).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    if kind == "merges":
        texts = dict(rows)
        assert all(np.frombuffer(r.ids, np.uint32).tolist() == library.encode(texts[r.doc_id] or "") for r in got)
    assert pieces.encoded(df.limit(0), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, sf)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.toPandas(), after.schema)
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert set(whole.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    quality = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    known = [quality[d] for d in set(whole.doc_id) if d in quality]
    assert np.mean(known) > 0.97
    # The last stage packs the very texts that are left, whole and in order.
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = dict(docs.select("doc_id", "text").collect())
    for d, rows in whole.sort_values("piece").groupby("doc_id"):
        held = np.concatenate([np.frombuffer(i, np.uint32) for i in rows.ids])
        assert held.tolist() == [*library.encode(texts[d] or "", add_special_tokens=False).ids, 0]
    kept = {r.doc_id for r in docs.where(F.length("text") > 0).collect()}
    assert kept <= set(whole.doc_id) and whole.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty texts, equal rows and clashing columns go through every stage; planted passages of 51 words are cut."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = fresh(51)
    hosts = [f"{fresh(120)} {passage} {fresh(120)}" for _ in range(6)]
    odd = [(9000 + i, t) for i, t in enumerate(hosts)] + [(9100, None), (9101, ""), (9102, hosts[0]), (9102, hosts[0]), (None, fresh(90)), (None, None)]
    extra = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[2:]])
    assert docs.columns[:2] == ["doc_id", "text"]
    mixed = docs.unionByName(extra).selectExpr("*", "1 AS row", "'x' AS digest", "2 AS starts", "3 AS node", "4 AS _row", "5 AS _id")
    stages = dict(corpus_pipeline.STAGES)
    cut = stages["repeated_passages"](spark, extra.limit(6).selectExpr("*", "1 AS row", "2 AS _starts"), sf)
    assert cut.columns == [*docs.columns, "row", "_starts"]
    assert all(passage[40:-40] not in r.text and r.n_chars == len(r.text) and len(r.text) > 700 for r in cut.collect())
    for name in ("quality_classifier", "near_copies", "repeated_passages"):
        mixed = stages[name](spark, mixed, sf)
        mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
        assert {"row", "digest", "starts", "node", "_row", "_id"} < set(mixed.columns), name
    packed = stages["best_fit_packing"](spark, mixed.drop("_row"), sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    none = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, none, sf).count() == 0, name
