"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into words (runs of other than blanks, at most ``WORD`` characters each, so text without blanks is cut too). Every ``k``
words in a row are hashed, every window of ``w`` such hashes keeps its least one, the rightmost of equals, and each kept hash
is listed once with its place. Any ``w + k - 1`` words that two texts share therefore leave a common hash in both, and nothing
below ``k`` words does.

A kept item is one long: 32 bits of hash above 31 bits that fall as the place rises, so that the least long of a window is the least
hash and of equal ones the rightmost. Texts of fewer words than ``k`` have one hash of all their words, those of fewer hashes
than ``w`` one window. Null and empty texts, and texts of blanks, have no item; two of them are alike (1), one of them and another
text are not (0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlens.llm.common import whole_text
from sessionlens.session import stage

K, W, WORD = 5, 16, 32
PLACES = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """Kept items in order of place, as longs: ``item_hash`` and ``item_place`` take them apart."""
    words = F.regexp_extract_all(text, F.lit(f"\\S{{1,{WORD}}}"), F.lit(0))

    def grams(h: Column) -> Column:
        last = F.greatest(F.size(h) - k, F.lit(0))
        hashed = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(hashed(i), 31) + (F.lit(PLACES) - i))

    def kept(items: Column) -> Column:
        # Minima of 2, 4, 8, ... neighbours, then of two such runs that overlap; what reaches over the end is cut off.
        def wider(least: Column, size: int) -> Column:
            if size == w:
                return F.array_distinct(F.slice(least, 1, F.greatest(F.size(least) - w + 1, F.lit(1))))
            step = min(size, w - size)
            return let(F.zip_with(least, F.slice(least, step + 1, F.size(least)), lambda a, b: F.least(a, b)), lambda x: wider(x, size + step))

        return wider(items, 1)

    def of_words(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(let(grams(h), kept))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of_words)


def item_hash(item: Column) -> Column:
    return F.shiftright(item, 31)


def item_place(item: Column) -> Column:
    return F.lit(PLACES) - item.bitwiseAND(F.lit(PLACES))


def as_text(items: Column) -> Column:
    """``hash@place`` of every item, hashes in hexadecimal."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lower(F.hex(item_hash(x))), F.lit("@"), item_place(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b)
    return F.when(whole == 0, F.lit(1.0)).otherwise(let(both, lambda n: n / (whole - n)))


def hashes(items: Column) -> Column:
    return F.array_distinct(F.transform(items, item_hash))


def following(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, next_id, previous_id, need, pick`` of every distinct id in descending order, a ring. ``need`` is how many characters of the text
    the document before it takes, ``pick`` tells which of several texts of an id follows."""
    text = whole_text(text_column)
    ids = docs.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(F.floor(F.char_length(text) / 3)).alias("takes"), F.min(F.xxhash64(text)).alias("pick"))
    # Ranges of ids, each numbered on its own; their ends are linked by one row per range.
    ranged = stage(ids.repartitionByRange("id").select("id", "takes", "pick", F.spark_partition_id().alias("part")), "id-ranges")
    ends = ranged.groupBy("part").agg(F.min(F.struct("id", "takes")).alias("lo"), F.max(F.struct("id", "takes")).alias("hi"))
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("hi").over(by_part), F.last("hi").over(whole)).alias("below"), F.coalesce(F.lead("lo").over(by_part), F.first("lo").over(whole)).alias("above"))
    in_part = Window.partitionBy("part").orderBy("id")
    me = F.struct("id", "takes")
    rows = ranged.withColumn("b", F.lag(me).over(in_part)).withColumn("a", F.lead(me).over(in_part)).join(ends, "part")
    below, above = F.coalesce("b", "below"), F.coalesce("a", "above")
    return rows.select("id", "pick", below["id"].alias("next_id"), above["id"].alias("previous_id"), above["takes"].alias("need"))


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and that of the document that follows in descending order of ids.

    The edited text has its last third replaced by as many characters of the start of the next text. Rows of one id have the
    same next document; of several texts of that id one follows. Null ids are one id, below all others. Other columns are ignored.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumns({"k": F.coalesce(name, F.lit(0)), "none": F.col(name).isNull()})

    # Texts are dealt out by id once: both joins below need the same columns of them, so they use the same exchange.
    order = keyed(stage(following(docs, id_column, text_column), "id-order"), "id")
    rows = keyed(docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text")), "doc_id").drop("doc_id")
    here = rows.join(order, ["k", "none"])
    # Bits that differ, not an equality, which would become a key of the join and need an exchange of its own; nothing can overflow.
    picked = here.where(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)
    starts = picked.select("previous_id", F.left("text", F.col("need").cast("int")).alias("start"), hashes(fingerprint(F.col("text"))).alias("next_hashes"))
    # Equal rows of an id give the same start; one is enough.
    starts = keyed(starts, "previous_id").groupBy("k", "none").agg(F.first("start").alias("start"), F.first("next_hashes").alias("next_hashes"))
    both = rows.join(starts, ["k", "none"]).withColumn("doc_id", F.when(~F.col("none"), F.col("k")))
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("m", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", (F.col("n_chars") - F.col("m")).cast("int")), F.left("start", F.col("m")))
    return both.select("doc_id", "n_chars", "text", edited.alias("edited"), "next_hashes")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    pairs = edited_pairs(docs, id_column, text_column)
    found = F.struct(fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("new"))

    def report(f: Column) -> Column:
        return let(F.struct(hashes(f["own"]).alias("own"), hashes(f["new"]).alias("new")), lambda h: F.struct(
            as_text(f["own"]).alias("fingerprint"), as_text(f["new"]).alias("edited_fingerprint"),
            likeness(h["own"], h["new"]).alias("near_edited"), likeness(h["own"], F.col("next_hashes")).alias("near_next")))

    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.inline(F.array(let(found, report))))
