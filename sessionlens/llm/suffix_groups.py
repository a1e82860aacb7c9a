"""Exact removal of repeated passages with suffix arrays built by linear grouping.

``suffix_array`` groups suffixes by their Lyndon prefixes. Groups are taken in descending order; each suffix of a group
points to the last suffix before it that stands in a lower group, and these targets are moved, by how often they are hit,
into new groups just above their old ones. Every suffix is taken once. Then one ascending pass puts each suffix in its
group's next place, following the same pointers; nothing is renamed or sorted again.

On a corpus, a string of ``length`` bytes is told by its anchor: its 32-byte gram of least hash (the leftmost of equals), which lies
at the same place in every copy. A task finds the anchors of its texts, each with the run of window starts it stands for and
a hash of all their bytes (its context). Anchors that occur once in the corpus are done. Equal contexts repeat as a whole. Of
contexts that share an anchor but differ, one copy each is gathered per anchor: a suffix array of their bytes from the anchor on,
in blocks named in byte order, gives common lengths to the right by range minima; windows with equal bytes left of the anchor
that are neighbours in that order are compared by them. The contexts of anchors with very many are split into blocks of windows. Equal
blocks are counted and one of each goes on, in groups by the bytes that all windows of the block share. Where such a group still has
very many, as at the rim of a passage that stands in many texts, single windows are counted instead. Counts are combined before
they are dealt out, so no task holds an unbounded group.

Bytes are UTF-8. Null text counts as empty. Ids may be null or repeated: each row is a text of its own, so equal rows
repeat each other. Texts shorter than ``length`` stay as they are. Other columns are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import whole_text
from sessionlens.llm.ragged import batches, mix, offsets, prefix_hash, span_hash
from sessionlens.session import stage, staging

GRAM = 32
BLOCK = 50
#: Bytes of text a task takes at a time; longer texts are taken in overlapping pieces.
PIECE = 2_000_000
#: An anchor with more distinct contexts is split into windows of this width.
MANY, WIDTH = 2000, 16


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes of a list of integers; a shorter suffix comes before those it begins."""
    n = len(symbols)
    if not n:
        return []
    names = sorted(set(symbols))
    # Groups are nodes of a list ordered from low to high; group 0 is the empty suffix behind the end.
    group_of_name = {s: i + 1 for i, s in enumerate(names)}
    members: list[list[int]] = [[n]] + [[] for _ in names]
    group = [0] * (n + 1)
    for i, s in enumerate(symbols):
        group[i] = g = group_of_name[s]
        members[g].append(i)
    lower, upper = list(range(-1, len(names))), list(range(1, len(names) + 2))
    upper[-1] = -1
    # Where a suffix stands within its group, for removal without a search.
    at = [0] * (n + 1)
    for m in members:
        for k, i in enumerate(m):
            at[i] = k
    done = bytearray(n + 1)
    before = [-1] * (n + 1)
    g = len(names)
    while g > 0:
        here = sorted(members[g])
        hits: dict[int, int] = {}
        for s in here:
            p = s - 1
            while p >= 0 and done[p]:
                p = before[p]
            if p >= 0 and group[p] == g:
                p = before[p]
            before[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        for s in here:
            done[s] = 1
        # A target hit k times goes to the k-th new group above its own.
        split: dict[int, dict[int, list[int]]] = {}
        for p, k in hits.items():
            split.setdefault(group[p], {}).setdefault(k, []).append(p)
        for old, by_count in split.items():
            rows = members[old]
            if len(by_count) == 1 and sum(map(len, by_count.values())) == len(rows):
                continue
            above = old
            for k in sorted(by_count):
                moved = by_count[k]
                new = len(members)
                for p in moved:
                    last = rows.pop()
                    if last != p:
                        rows[at[p]] = last
                        at[last] = at[p]
                for j, p in enumerate(moved):
                    group[p], at[p] = new, j
                members.append(moved)
                lower.append(above)
                upper.append(upper[above])
                if upper[above] >= 0:
                    lower[upper[above]] = new
                upper[above] = new
                above = new
        g = lower[g]
    place, total, g = [0] * len(members), 0, 0
    while g >= 0:
        place[g] = total
        total += len(members[g])
        g = upper[g]
    order = [-1] * (n + 1)
    order[0] = n
    put = bytearray(n + 1)
    put[n] = 1
    for i in range(n + 1):
        s = order[i] - 1
        while s >= 0 and not put[s]:
            put[s] = 1
            g = group[s]
            order[place[g]] = s
            place[g] += 1
            s = before[s]
    return order[1:]


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's windows: anchor hashes, context hashes, and per anchor its first window, place and last window."""
    n, span = len(data), length - GRAM + 1
    windows = n - length + 1
    h = prefix_hash(data)
    start = np.arange(n - GRAM + 1)
    grams = mix(span_hash(h, start, start + GRAM))
    # Value above, place below: the least is the leftmost of the least grams. Blocks of ``span`` give running minima both ways.
    ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | start.astype(np.uint64)
    padded = np.full(-(-len(ranked) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], windows) - 1
    place = least[first]
    context = mix(span_hash(h, first, last + length) + mix((place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)))
    return grams[place], context, first, place, last


def anchor_rows(docs: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    """One row per document: row, doc_id, digest, n_bytes, and its anchors as equally long arrays."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 200):
                group = frame.iloc[i : i + 200]
                out = []
                for text in group["text"]:
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    got = []
                    for base in range(0, max(1, len(data) - length + 1), PIECE):
                        piece = data[base : base + PIECE + length - 1]
                        if len(piece) >= length:
                            a, c, first, place, last = anchors(piece, length)
                            got.append((a.view(np.int64), c.view(np.int64), first + base, place + base, last + base))
                    cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 5
                    out.append((len(data), *cols))
                yield pd.concat([group[["row", "doc_id", "digest"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "anchor", "context", "first", "place", "last"])], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("digest"), whole_text(text_column).alias("text"))
    return rows.mapInPandas(find, "row long, doc_id long, digest binary, n_bytes long, anchor array<long>, context array<long>, first array<long>, place array<long>, last array<long>")


def common_lengths(rights: list[bytes]) -> np.ndarray:
    """Bytes that neighbours of a list share from the start."""
    if len(rights) < 2:
        return np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, rights), np.int64, len(rights))
    wide = int(sizes.max())
    flat = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rights), np.uint8).reshape(len(rights), wide)
    differ = np.concatenate([flat[1:] != flat[:-1], np.ones((len(rights) - 1, 1), bool)], axis=1).argmax(axis=1)
    return np.minimum(differ, np.minimum(sizes[1:], sizes[:-1]))


def repeated_windows(lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(context, j)`` of all windows that two or more contexts hold. A context's windows start j bytes left of its anchor,
    ``low <= j <= high``; ``lefts`` end at the anchor and ``rights`` begin there."""
    names: dict[bytes, int] = {}
    blocks = [[r[i : i + BLOCK] for i in range(0, len(r), BLOCK)] for r in rights]
    for i, b in enumerate(sorted({b for row in blocks for b in row})):
        names[b] = i + 1
    symbols, starts = [], []
    for row in blocks:
        starts.append(len(symbols))
        symbols.extend(names[b] for b in row)
        symbols.append(0)
    context_at = dict(zip(starts, range(len(starts)), strict=True))
    order = np.array([context_at[s] for s in suffix_array(symbols) if s in context_at], np.int64)
    shared = common_lengths([rights[i] for i in order])
    table = [shared]
    while 2 << len(table) - 1 <= len(shared):
        prev, step = table[-1], 1 << len(table) - 1
        table.append(np.minimum(prev[:-step], prev[step:]))
    longest = np.maximum(np.append(shared, 0), np.insert(shared, 0, 0))
    low, high = low[order], high[order]
    flat = np.frombuffer(b"".join(lefts[i] for i in order), np.uint8)
    ends = np.cumsum([len(lefts[i]) for i in order])
    h = prefix_hash(flat)
    found_context, found_j = [], []
    for j in range(int(low.min()), int(high.max()) + 1):
        rank = np.flatnonzero((low <= j) & (j <= high) & (longest >= length - j))
        if len(rank) < 2:
            continue
        left = span_hash(h, ends[rank] - j, ends[rank])
        by_left = np.argsort(left, kind="stable")
        left, rank = left[by_left], rank[by_left]
        pair = np.flatnonzero(left[1:] == left[:-1])
        a, b = rank[pair], rank[pair + 1]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        least = np.empty(len(pair), np.int64)
        for k in np.unique(level):
            of = level == k
            least[of] = np.minimum(table[k][a[of]], table[k][b[of] - (1 << int(k))])
        good = pair[least >= length - j]
        hit = np.unique(np.concatenate([rank[good], rank[good + 1]]))
        found_context.append(order[hit])
        found_j.append(np.full(len(hit), j))
    if not found_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_context), np.concatenate(found_j)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    places = np.flatnonzero(new)
    return start[places], end[np.append(places[1:], len(start)) - 1] if len(places) else end


def lists(items: Iterable[np.ndarray]) -> pd.Series:
    """A column of arrays. Without rows it stays one: pandas would make it a column of numbers."""
    return pd.Series(list(items), dtype=object)


def _compare(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows ordered by key, one per context; gives per context the byte ranges (from the anchor) its repeated windows cover."""

    def solve(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        lefts = [d[:a] for d, a in zip(rows["data"], rows["left"], strict=True)]
        rights = [d[a:] for d, a in zip(rows["data"], rows["left"], strict=True)]
        which, j = repeated_windows(lefts, rights, rows["low"].to_numpy(), rows["high"].to_numpy(), length)
        order = np.lexsort((-j, which))
        which, j = which[order], j[order]
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
        ranges = [merged(-x, length - x) for x in np.split(j, cut[1:])] if len(cut) else []
        of = which[cut]
        return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[of], "context": rows["context"].to_numpy()[of], "starts": lists(r[0] for r in ranges), "ends": lists(r[1] for r in ranges)})

    held: list[pd.DataFrame] = []
    total, key = 0, None
    for frame in frames:
        if not len(frame):
            continue
        # Whole keys are solved together, about 5000 contexts at a time.
        change = np.flatnonzero((frame["key"] != frame["key"].shift()).to_numpy())
        ends = np.append(change[1:], len(frame))
        for s, e in zip(change, ends, strict=True):
            run = frame.iloc[s:e]
            if run["key"].iloc[0] != key and total >= 5000:
                yield solve(held)
                held, total = [], 0
            key = run["key"].iloc[0]
            held.append(run)
            total += len(run)
    if held:
        yield solve(held)


def split(held: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Contexts (anchor, context, left, low, high, data) of anchors with very many, in blocks of ``WIDTH`` windows. Gives what is
    left to ``_compare``, at most ``MANY`` rows of a key, and byte ranges (from the anchor) that counting has found repeated."""
    def part(j: Column, size: Column) -> Column:
        return F.substring("data", F.col("left") - j + 1, size)

    block = F.explode(F.sequence(F.floor(F.col("low") / WIDTH).cast("int"), F.floor(F.col("high") / WIDTH).cast("int")))
    rows = held.withColumn("block", block)
    rows = rows.withColumn("lo", F.greatest("low", F.col("block") * WIDTH)).withColumn("hi", F.least("high", F.col("block") * WIDTH + WIDTH - 1))
    # All windows j of a block, [block * WIDTH, ... + WIDTH), hold the bytes from its least j to ``length`` behind its largest j.
    core = part(F.col("block") * WIDTH, F.col("block") * WIDTH + F.greatest(F.lit(length) - (F.col("block") + 1) * WIDTH + 1, F.lit(GRAM)))
    sub = part(F.col("hi"), F.col("hi") - F.col("lo") + length)
    same = ["anchor", "block", "lo", "hi", "core", "sub"]
    rows = stage(rows.select("anchor", "context", "block", "lo", "hi", F.xxhash64(core).alias("core"), F.xxhash64(sub).alias("sub")), "blocks")
    subs = stage(rows.groupBy(same).agg(F.count("*").alias("n"), F.min("context").alias("context")), "distinct-blocks")
    # Equal blocks repeat as a whole.
    equal = rows.join(stage(subs.where("n > 1").select(same), "equal-blocks"), same).select("anchor", "context", F.col("lo").alias("least"), F.col("hi").alias("most"))
    # One block of a core has nothing to be compared with.
    cores = stage(subs.groupBy("anchor", "block", "core").agg(F.count("*").alias("subs")).where("subs > 1"), "cores")
    open_blocks = stage(subs.join(cores, ["anchor", "block", "core"]).select("anchor", "context", "block", "lo", "hi", "core", "subs"), "open-blocks")
    bytes_of = open_blocks.join(held.select("anchor", "context", "left", "data"), ["anchor", "context"])
    compare = bytes_of.where(F.col("subs") <= MANY).select("anchor", "context", F.concat_ws(" ", "anchor", "block", "core").alias("key"), F.col("hi").alias("left"), F.col("lo").alias("low"), F.col("hi").alias("high"), sub.alias("data"))
    windows = bytes_of.where(F.col("subs") > MANY).withColumn("j", F.explode(F.sequence("lo", "hi")))
    windows = stage(windows.select("anchor", "context", "j", F.xxhash64(part(F.col("j"), F.lit(length))).alias("window")), "windows")
    twice = windows.groupBy("anchor", "j", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(stage(twice, "repeated-windows"), ["anchor", "j", "window"]).select("anchor", "context", F.col("j").alias("least"), F.col("j").alias("most"))
    # All windows of a context hold its anchor, so together they cover one range.
    ranges = equal.unionByName(single).groupBy("anchor", "context").agg(F.min("least").cast("long").alias("least"), F.max("most").cast("long").alias("most"))
    return compare, stage(ranges.select("anchor", "context", F.array(-F.col("most")).alias("starts"), F.array(length - F.col("least")).alias("ends")), "counted")


def _known_ranges(docs: DataFrame, rows: DataFrame, at: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    """``anchor, context, starts, ends`` (from the anchor) of all contexts with repeated windows; ``at`` holds the anchors that occur more than once."""
    one = F.min(F.struct("row", "first", "place", "last"))
    contexts = stage(at.groupBy("anchor", "context").agg(F.count("*").alias("n"), one.alias("o")).select("anchor", "context", "n", "o.*"), "contexts")
    several = stage(contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors-of-several-contexts")
    wanted = contexts.join(several, "anchor").join(rows.select("row", "doc_id", "digest"), "row")
    per_doc = wanted.groupBy("row", "doc_id", "digest").agg(F.collect_list(F.struct("anchor", "context", "kinds", "first", "place", "last")).alias("wanted"))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("sha"), whole_text(text_column).cast("binary").alias("data"))
    held = texts.join(per_doc, texts["id"].eqNullSafe(per_doc["doc_id"]) & (texts["sha"] == per_doc["digest"])).select("data", F.explode("wanted").alias("w")).select("data", "w.*")
    size = (F.col("last") - F.col("first") + length).cast("int")
    held = held.select("anchor", "context", "kinds", (F.col("place") - F.col("first")).cast("int").alias("left"), (F.col("place") - F.col("last")).cast("int").alias("low"), F.substring("data", F.col("first").cast("int") + 1, size).alias("data"))
    # Equal rows of the source give a context several times; one is enough.
    held = stage(held.withColumn("high", F.col("left")).dropDuplicates(["anchor", "context"]), "context-bytes")
    few = held.where(F.col("kinds") <= MANY).select("anchor", "context", F.col("anchor").cast("string").alias("key"), "left", "low", "high", "data")
    counted = None
    if several.where(F.col("kinds") > MANY).limit(1).count():
        blocks, counted = split(held.where(F.col("kinds") > MANY), length)
        few = few.unionByName(blocks)
    compared = few.repartition("key").sortWithinPartitions("key").mapInPandas(lambda f: _compare(f, length), "anchor long, context long, starts array<long>, ends array<long>")
    found = stage(compared, "compared")
    if counted is not None:
        found = found.unionByName(counted)
    found = found.groupBy("anchor", "context").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    known = contexts.join(found, ["anchor", "context"], "left").where("n > 1 or starts is not null")
    return known.select("anchor", "context", F.when(F.col("n") > 1, F.array(F.col("first") - F.col("place"))).otherwise(F.col("starts")).alias("starts"), F.when(F.col("n") > 1, F.array(F.col("last") - F.col("place") + length)).otherwise(F.col("ends")).alias("ends"))


def repeated_ranges(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``row, doc_id, digest, n_bytes, starts, ends, n_removed``: byte ranges covered by strings of
    ``length`` bytes that also start elsewhere (arrays are null where there are none)."""
    rows = stage(anchor_rows(docs, length, id_column, text_column), "anchors")
    at = rows.select("row", F.explode(F.arrays_zip("anchor", "context", "first", "place", "last")).alias("o")).select("row", "o.*")
    twice = rows.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    with staging(docs.sparkSession):
        # Staged sides leave both ends of a join to be dealt out anew, so that a frequent anchor's rows may be split among tasks.
        at = stage(at.join(stage(twice, "anchors-of-several"), "anchor"), "repeated-anchors", outer=True)
        known = stage(_known_ranges(docs, rows, at, length, id_column, text_column), "known", outer=True)
    shifted = at.join(known, ["anchor", "context"]).select("row", F.transform("starts", lambda x: x + F.col("place")).alias("starts"), F.transform("ends", lambda x: x + F.col("place")).alias("ends"))

    def union(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [merged(np.concatenate(s), np.concatenate(e)) for s, e in zip(frame["starts"], frame["ends"], strict=True)]
            yield pd.DataFrame({"row": frame["row"], "starts": lists(g[0] for g in got), "ends": lists(g[1] for g in got), "n_removed": np.array([(g[1] - g[0]).sum() for g in got], np.int64)})

    per_row = shifted.groupBy("row").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    spans = per_row.mapInPandas(union, "row long, starts array<long>, ends array<long>, n_removed long")
    return rows.select("row", "doc_id", "digest", "n_bytes").join(spans, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))


def _keep(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def _with_ranges(docs: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    """``doc`` (the row of ``docs``), ``starts`` and ``ends``, null where nothing is removed. Equal rows have equal ranges."""
    with staging(docs.sparkSession):
        found = repeated_ranges(docs, length, id_column, text_column).where("n_removed > 0")
        ranges = stage(found.groupBy("doc_id", "digest").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends")), "ranges", outer=True)
    texts = docs.select(F.struct("*").alias("doc"), F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("sha"))
    return texts.join(ranges, texts["id"].eqNullSafe(ranges["doc_id"]) & (texts["sha"] == ranges["digest"]), "left").select("doc", "starts", "ends")


def removal_report(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (SHA-256 of the bytes that stay) and ``text``, what stays
    (without the rest of characters that are cut in two)."""
    rows = _with_ranges(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), length, "doc_id", "text")

    @F.pandas_udf("sha string, text string")
    def kept(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for t, s, e in zip(text, starts, ends, strict=True):
            data = t.encode("utf-8", "surrogatepass") if s is None else _keep(t.encode("utf-8", "surrogatepass"), s, e)
            out.append((hashlib.sha256(data).hexdigest(), t if s is None else data.decode("utf-8", "ignore")))
        return pd.DataFrame(out, columns=["sha", "text"], dtype=object)

    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.coalesce(F.when(F.col("starts").isNotNull(), F.size("starts").cast("long")), F.lit(0).cast("long"))
    rows = rows.select("doc.*", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), spans.alias("n_spans"), kept("doc.text", "starts", "ends").alias("kept"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_removed", "n_spans", F.col("kept.sha").alias("kept_sha256"), F.col("kept.text").alias("text"))


def without_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of their text. Bytes of a character cut in two go with it; a null text stays null."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _keep(t.encode("utf-8", "surrogatepass"), s, e).decode("utf-8", "ignore") for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)

    rows = _with_ranges(docs, length, id_column, text_column)
    text = kept(F.col("doc").getField(text_column), F.col("starts"), F.col("ends")).alias("kept")
    return rows.select("doc", text).select(*[F.col("kept").alias(c) if c == text_column else F.col("doc").getField(c).alias(c) for c in docs.columns])
