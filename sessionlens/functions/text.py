"""Text expressions. All are column expressions, so they stay inside whole-stage code generation.

Lengths count code points.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from sessionlens import constants as K

# Prompts that are notices, not something a person typed.
NOISE_PREFIXES = ("[Request interrupted", "Caveat: The messages below")

# Patterns.
BLANKS = r"[\p{Z}\p{Cc}]+"
TAG_NAME = r"[a-z][a-z0-9_-]*"
TOKEN = r"[\p{L}\p{N}]+"
RAW_TOKEN = r"[\p{L}\p{N}\p{M}]+"
SEARCHABLE = r"[\p{L}\p{Nd}]"
NOT_BLANK = r"[^\p{Z}\s\x{85}]"

UNTITLED = "Untitled session"
UNKNOWN_FOLDER_NAME = "(folder unknown)"


def collapse(text: Column) -> Column:
    """One line: runs of whitespace and control characters become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def collapse_or_null(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(NOT_BLANK))


def truncate(text: Column, limit: int = K.TITLE_LENGTH) -> Column:
    """Cut at ``limit`` characters and mark the cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit(K.ELLIPSIS))
    ).otherwise(text)


def truncate_words(text: Column, limit: int) -> Column:
    """Like :func:`truncate`, but ends on a word when one ends in the last quarter."""
    head = F.left(text, F.lit(limit))
    back = F.instr(F.reverse(head), " ")
    space_at = F.lit(limit) - back
    cut = F.when((back > 0) & (space_at > limit * 3 // 4), space_at).otherwise(F.lit(limit))
    return F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.left(text, cut)), F.lit(K.ELLIPSIS))
    ).otherwise(text)


def strip_envelopes(text: Column) -> Column:
    """Drop paired lower-case tags with what they hold: from an opening tag to the next closing one of its name.

    The text is cut at every ``<`` and the pieces are read once from left to right. Where each name is closed last is looked up,
    so a tag that is never closed costs nothing, however many there are. Texts without a closing tag are left alone.
    """
    pieces = F.split(text, "<")

    def named(piece: Column) -> Column:
        opens = F.regexp_extract(piece, rf"^({TAG_NAME})(?:\s[^>]*)?>", 1)
        closes = F.regexp_extract(piece, rf"^/({TAG_NAME})\s*>", 1)
        return F.struct(piece.alias("piece"), opens.alias("opens"), closes.alias("closes"))

    def closed_last(tags: Column) -> Column:
        ends = F.filter(F.transform(tags, lambda t, i: F.struct(t["closes"].alias("name"), i.alias("at"))), lambda e: e["name"] != "")
        names = F.array_distinct(F.transform(ends, lambda e: e["name"]))
        count, reverse = F.size(tags) - 1, F.reverse(F.transform(tags, lambda t: t["closes"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: count - (F.array_position(reverse, n).cast("int") - 1)))

    def fold(read: Column) -> Column:
        # State: the name whose closing tag is awaited ("" for none), and the parts that stay.
        def step(state: Column, t: Column) -> Column:
            tag, at, waits = t["tag"], t["at"], state["waits"]
            ends = (waits != "") & (tag["closes"] == waits)
            starts = (waits == "") & (tag["opens"] != "") & F.coalesce(F.try_element_at(read["last"], tag["opens"]) > at, F.lit(False))
            plain = F.when(at == 0, tag["piece"]).otherwise(F.concat(F.lit("<"), tag["piece"]))
            after = F.substr(tag["piece"], F.instr(tag["piece"], ">") + 1)
            kept = F.when(ends, after).when(starts, F.lit(" ")).when(waits == "", plain).otherwise(F.lit(""))
            return F.struct(F.when(ends, F.lit("")).when(starts, tag["opens"]).otherwise(waits).alias("waits"), F.concat(state["parts"], F.array(kept)).alias("parts"))

        start = F.struct(F.lit("").alias("waits"), F.array().cast("array<string>").alias("parts"))
        tags = F.transform(read["tags"], lambda t, i: F.struct(t.alias("tag"), i.alias("at")))
        return F.array_join(F.aggregate(tags, start, step, lambda s: s["parts"]), "")

    tags = F.transform(pieces, named)
    whole = F.transform(F.array(tags), lambda t: F.struct(t.alias("tags"), closed_last(t).alias("last")))
    return F.when(F.contains(text, F.lit("</")), F.get(F.transform(whole, fold), F.lit(0))).otherwise(text)


def clean_prompt(text: Column) -> Column:
    """What a person typed, on one line; NULL when nothing is left or it is a notice."""

    def typed(stripped: Column) -> Column:
        line = collapse_or_null(stripped)
        noise = F.lit(False)
        for prefix in NOISE_PREFIXES:
            noise = noise | F.startswith(line, F.lit(prefix))
        return F.when(~noise, line)

    # The stripped text is a value of its own here, so the plan holds its expression once.
    return F.get(F.transform(F.array(strip_envelopes(text)), typed), F.lit(0))


def resolve_title(custom: Column, ai: Column, first_prompt: Column, file_name: Column) -> tuple[Column, Column]:
    """Title text and its source, first non-blank candidate in that order."""
    candidates = [
        (collapse_or_null(custom), K.TITLE_CUSTOM),
        (collapse_or_null(ai), K.TITLE_AI),
        (collapse_or_null(first_prompt), K.TITLE_FIRST_PROMPT),
        (collapse_or_null(file_name), K.TITLE_FILE_NAME),
    ]
    text = truncate(F.coalesce(*[c for c, _ in candidates], F.lit(UNTITLED)))
    source = F.coalesce(
        *[F.when(c.isNotNull(), F.lit(code)) for c, code in candidates], F.lit(K.TITLE_UNKNOWN)
    )
    return text, source


def folder_display(path: Column) -> Column:
    """Path without trailing separators; roots keep theirs; NULL when there is nothing to show."""
    text = F.regexp_replace(path, r"^[\p{Z}\s\x{85}]+|[\p{Z}\s\x{85}]+$", "")

    def shown(read: Column) -> Column:
        bare = read["bare"]
        return F.nullif(
            F.when(bare == "", F.left(read["text"], F.lit(1)))
            .when(F.rlike(bare, F.lit(r"^\p{L}:$")), F.concat(bare, F.lit("\\")))
            .otherwise(bare),
            F.lit(""),
        )

    # Both texts are values of their own here, so the plan holds their patterns once and generated methods stay small enough to be compiled.
    read = F.struct(text.alias("text"), F.regexp_replace(text, r"[\\/]+$", "").alias("bare"))
    return F.get(F.transform(F.array(read), shown), F.lit(0))


def folder_key(display: Column) -> Column:
    """Comparison form of a folder: one separator, upper case."""
    return F.upper(F.translate(display, "/", "\\"))


def folder_ancestors(key: Column) -> Column:
    """The folder key and the keys of all folders above it."""
    parts = F.split(key, r"\\")
    prefix = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\")
    )
    rooted = F.transform(
        prefix,
        lambda p: F.when(p == "", F.lit("\\")).when(F.rlike(p, F.lit("^[A-Z]:$")), F.concat(p, F.lit("\\"))).otherwise(p),
    )
    return F.array_distinct(F.array_append(rooted, key))


def folder_text(display: Column, branch: Column) -> Column:
    """What search sees of a folder: its path and, unless blank, the branch."""
    return F.concat_ws(" ", display, F.when(~is_blank(branch), branch))


def base_name(path: Column) -> Column:
    """Last path element; a path that is all root stays whole; empty means unknown."""
    last = F.regexp_extract(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]([^\\/]+)$", 1)
    return (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit(UNKNOWN_FOLDER_NAME))
        .when(last == "", path)
        .otherwise(last)
    )


def real_branch(branch: Column) -> Column:
    """NULL for a blank branch or a detached checkout."""
    return F.when(~is_blank(branch) & (branch != "HEAD"), branch)


def cap(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def count_noun(n: Column, noun: str) -> Column:
    """``1 session``, ``3 sessions``."""
    return F.concat(n.cast("string"), F.lit(" " + noun), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def describe_session(outcome: Column, key_prompts: Column) -> Column:
    """Outcome, else the first key prompt, without markup marks, on one line, at most 180 characters."""
    text = F.coalesce(outcome, F.get(key_prompts, F.lit(0)))
    plain = collapse(F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))
    return F.when(~is_blank(text), truncate_words(plain, K.DESCRIPTION_LENGTH))


@cache
def _accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, from the Unicode decomposition rule."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code)
        decomposed = unicodedata.normalize("NFD", letter)
        base = [c for c in decomposed if not unicodedata.combining(c)]
        if len(decomposed) > 1 and len(base) == 1 and letter == letter.lower():
            accented.append(letter)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    accented, plain = _accent_table()
    folded = F.regexp_replace(F.translate(F.lower(text), accented, plain), r"\p{M}+", "")
    # Text of one byte a letter has no diacritics, and is spared the search for them letter by letter.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def is_searchable(term: Column) -> Column:
    return F.rlike(term, F.lit(SEARCHABLE))
