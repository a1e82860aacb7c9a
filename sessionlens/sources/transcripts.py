"""Transcript files: listing, fingerprints, lines and records.

Lines are read through the splittable text source, so one huge file is read by many tasks. A line's
place in its file comes from two small sums: bytes before its split, and bytes before it inside the
split. Parsing is a projection and runs first, so only the few kept fields are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sessionlens import constants as K

SESSION_ID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
HEAD_BYTES = 4096
BOM_BYTES = 3
#: Bytes of a file that one task reads.
RANGE_BYTES = 128 << 20
#: What a line takes in a frame beside its text, about.
ROW_BYTES = 200


# ---------------------------------------------------------------- files


def _last_part(path: Column) -> Column:
    """What stands behind the last slash or backslash. A pattern that is anchored at the end only is tried at every place of a path."""
    return F.substring_index(F.substring_index(path, "/", -1), "\\", -1)


def session_id_of(path: Column) -> Column:
    """Session id from a file name or path, lower case; NULL when the name is not one."""
    name = _last_part(path)
    stem = F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1")
    return F.when(F.rlike(stem, F.lit(SESSION_ID)), F.lower(stem))


def file_name_of(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(_last_part(path), r"^([^/\\]*?)(\.[^./\\]*)?$", 1)


def locate(name: str):
    """File system and plain path of a file or folder name. Only scheme and authority are read as a URI, so names may hold anything."""
    from pyarrow import fs

    if name.startswith("file:") or "://" not in name:
        return fs.LocalFileSystem(), "/" + name.removeprefix("file:").lstrip("/")
    scheme, rest = name.split("://", 1)
    authority, _, path = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{path}"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts exactly one folder below the root, empty ones included; none where there is no such folder.

    The folders below the root are listed side by side in tasks; no file is opened.
    """
    base = root.rstrip("/")
    base = base if base.startswith("file:") or "://" in base else f"file:{base}"

    def entries(place: str):
        from pyarrow import fs

        system, path = locate(place)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return fs, [(f"{place}/{e.base_name}", e) for e in found]

    def folders(batches):
        import pandas as pd

        for batch in batches:
            for place in batch["place"]:
                fs, found = entries(place)
                yield pd.DataFrame({"place": [name for name, e in found if e.type == fs.FileType.Directory]}, dtype="object")

    def files(batches):
        import pandas as pd

        for batch in batches:
            for place in batch["place"]:
                fs, found = entries(place)
                kept = [(name, e.size, e.mtime.replace(tzinfo=None)) for name, e in found if e.type == fs.FileType.File and name.endswith(".jsonl")]
                yield pd.DataFrame(kept, columns=["file_path", "size", "mtime"]).astype({"size": "int64", "mtime": "datetime64[us]"})

    tasks = spark.sparkContext.defaultParallelism
    below = spark.createDataFrame([(base,)], "place string").mapInPandas(folders, "place string").repartition(tasks, "place")
    return below.mapInPandas(files, "file_path string, size bigint, mtime timestamp").select(
        session_id_of(F.col("file_path")).alias("session_id"), "file_path", file_name_of(F.col("file_path")).alias("file_name"), "size", "mtime"
    ).where(F.col("session_id").isNotNull())


def transcript_lines(records: DataFrame, *keys: str) -> DataFrame:
    """``session_id, seq, line`` and the columns ``keys``: records as the JSON lines a transcript holds. The inverse of parsing, for the
    fields that are kept."""
    content = F.when(F.size("blocks") > 0, F.to_json(F.transform("blocks", lambda b: F.struct(F.lit("text").alias("type"), b.alias("text"))))).otherwise(F.lit("[]"))
    line = F.to_json(F.struct(
        "type", "cwd", F.col("git_branch").alias("gitBranch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.when(F.col("has_parent"), F.lit("parent")).alias("parentUuid"), F.when(F.col("is_meta"), F.lit(True)).alias("isMeta"),
        F.when(F.col("type") == "custom-title", F.col("title_text")).alias("customTitle"),
        F.when(F.col("type") == "ai-title", F.col("title_text")).alias("aiTitle"),
        F.when(F.col("type") == "last-prompt", F.col("title_text")).alias("lastPrompt")))
    # Content is JSON already: it is put in before the closing brace.
    said = F.when(F.col("has_message"), F.concat(F.lit(',"message":{"content":'), content, F.lit("}"))).otherwise(F.lit(""))
    result = F.when(F.col("has_tool_result"), F.lit(',"toolUseResult":{}')).otherwise(F.lit(""))
    return records.select("session_id", *keys, "seq", F.concat(F.substring(line, F.lit(1), F.length(line) - 1), said, result, F.lit("}")).alias("line"))


def write_transcripts(lines: DataFrame, root: str, append: bool = False) -> None:
    """Write ``(session_id, folder, seq, line)`` as one file per session, ``<root>/<folder>/<session_id>.jsonl``, in order of ``seq``.

    Lines stream through the tasks, so a file may be of any length. ``append`` puts them behind what a file holds."""
    base = root.rstrip("/")
    base = base if base.startswith("file:") or "://" in base else f"file:{base}"

    def write(frames):
        import pandas as pd

        place, out = None, None
        for frame in frames:
            for folder, session, line in zip(frame["folder"], frame["session_id"], frame["line"], strict=True):
                if (folder, session) != place:
                    if out is not None:
                        out.close()
                    system, path = locate(f"{base}/{folder}/{session}.jsonl")
                    if place is None or folder != place[0]:
                        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    place = (folder, session)
                    out = system.open_append_stream(path) if append else system.open_output_stream(path)
                out.write((line + "\n").encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"done": [1]})

    ordered = per_file(lines, "folder", "session_id").sortWithinPartitions("folder", "session_id", "seq")
    ordered.select("folder", "session_id", "line").mapInPandas(write, "done int").count()


def delete_transcripts(files: DataFrame, root: str) -> None:
    """Delete the files of ``(session_id, folder)`` below ``root``; those that are not there are passed over."""
    base = root.rstrip("/")
    base = base if base.startswith("file:") or "://" in base else f"file:{base}"

    def remove(frames):
        from pyarrow import fs

        for frame in frames:
            for folder, session in zip(frame["folder"], frame["session_id"], strict=True):
                system, path = locate(f"{base}/{folder}/{session}.jsonl")
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    system.delete_file(path)
            yield frame.iloc[:0][["session_id"]]

    per_file(files.select("session_id", "folder"), "folder", "session_id").mapInPandas(remove, "session_id string").count()


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("mtime").desc(), F.col("file_path"))


def describe_paths(paths: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Left join of asked-for paths to the listing; NULL columns for anything that is not a session file."""
    prefix = root.rstrip("/") + "/"
    inside = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.when(F.startswith(inside, F.lit(prefix)), F.substr(inside, F.lit(len(prefix) + 1)))
    asked = paths.withColumn(
        "wanted", F.when(F.rlike(relative, F.lit(r"^[^/\\]+/[^/\\]+\.jsonl$")) & session_id_of(F.col("path")).isNotNull(), inside)
    )
    known = files.withColumn("wanted", F.regexp_replace("file_path", r"^file:/*", "/"))
    return asked.join(known, "wanted", "left").drop("wanted")


def per_file(files: DataFrame, *keys: str) -> DataFrame:
    """Deals rows out that are small but open a file each. The number is given: by their bytes they would all end in one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def head_hashes(files: DataFrame) -> DataFrame:
    """``(file_path, head_sha256, stored_part_sha256, readable, missing)`` from the first 4096 bytes of each file.

    ``stored_size``, where given, is the size a stored hash was taken at: the second hash covers no
    more than that, so a short file that grew is not mistaken for a rewritten one. Only the head is
    read. A file that cannot be opened is reported, never fatal; one that is gone is told apart.
    """
    stored = F.col("stored_size") if "stored_size" in files.columns else F.lit(None)
    sized = files.select(
        "file_path",
        F.least(F.col("size"), F.lit(HEAD_BYTES)).cast("bigint").alias("head_bytes"),
        F.coalesce(F.least(stored, F.lit(HEAD_BYTES)), F.lit(0)).cast("bigint").alias("part_bytes"),
    )

    def read(batches):
        import hashlib

        def digest(data):
            return hashlib.sha256(data).hexdigest().upper() if data else None

        for batch in batches:
            whole, part, readable, missing = [], [], [], []
            for path, head_bytes, part_bytes in zip(batch["file_path"], batch["head_bytes"], batch["part_bytes"]):
                head, problem = None, None
                try:
                    system, name = locate(path)
                    with system.open_input_file(name) as stream:
                        head = stream.read(max(head_bytes, part_bytes))
                except OSError as error:
                    problem = error
                whole.append(digest(head[:head_bytes]) if head is not None else None)
                part.append(digest(head[:part_bytes]) if head is not None else None)
                readable.append(problem is None)
                missing.append(isinstance(problem, FileNotFoundError))
            yield batch[["file_path"]].assign(head_sha256=whole, stored_part_sha256=part, readable=readable, missing=missing)

    return per_file(sized, "file_path").mapInPandas(read, "file_path string, head_sha256 string, stored_part_sha256 string, readable boolean, missing boolean")


# ---------------------------------------------------------------- lines


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw lines with their split and their order inside it."""
    return (
        spark.read.text(paths, lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_order"),
            (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
            F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("line"),
        )
    )


def lines_from(stream, start: int, end: int, first: int, size: int, piece: int = 4 << 20):
    """``(byte_start, line bytes)`` of the lines that begin in [start, end) and end by ``size``, line feed excluded.

    ``first`` is where reading of the file began: there, and behind every line feed, a line begins.
    """
    at = start if start == first else start - 1
    stream.seek(at)
    held, begins = b"", start if start == first else None
    while True:
        feed = held.find(b"\n")
        if feed < 0:
            data = stream.read(min(piece, size - at))
            if not data:
                return
            at += len(data)
            held += data
            continue
        if begins is not None:
            if begins >= end:
                return
            yield begins, held[:feed]
        held = held[feed + 1 :]
        begins = at - len(held)


def range_frames(frames, range_bytes: int = RANGE_BYTES, piece: int = 8 << 20):
    """Lines of the ranges in ``frames`` as frames of about ``piece`` bytes, whatever the size of the files: a frame for each small file
    costs far more than reading it. A range that cannot be read to its end gives a row with ``problem`` instead of what is held of it."""
    import pandas as pd

    columns = ["file_path", "block_start", "line_order", "byte_start", "byte_end", "line", "problem"]
    rows, held = [], 0
    for frame in frames:
        for path, size, offset, start in zip(frame["file_path"], frame["size"], frame["offset"], frame["block_start"]):
            own = len(rows)
            try:
                system, name = locate(path)
                with system.open_input_file(name) as stream:
                    if stream.size() < size:
                        raise OSError("the file is shorter than listed")
                    for i, (at, line) in enumerate(lines_from(stream, start, min(start + range_bytes, size), offset, size)):
                        text = line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line
                        rows.append((path, start, i, at, at + len(line) + 1, text.removesuffix(b"\r").decode("utf-8", "replace"), None))
                        # Empty lines take room too.
                        held += len(line) + ROW_BYTES
                        if held > piece:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held, own = [], 0, 0
            except OSError as error:
                rows[own:] = [(path, start, -1, start, start, None, "missing" if isinstance(error, FileNotFoundError) else "failed")]
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def read_tails(work: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of files from a byte on: ``work`` has (file_path, size, offset), each range of a file is a task's own.

    Only bytes from ``offset`` to the listed ``size`` are read, and a line without its line feed is left for later. A file that cannot
    be read to its end gives a row with ``problem`` (``missing`` or ``failed``) instead of a line: none of its lines may count.
    """
    ranges = work.where(F.col("size") > F.col("offset")).select(
        "file_path", "size", "offset", F.explode(F.sequence(F.col("offset"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("block_start"))
    schema = "file_path string, block_start bigint, line_order bigint, byte_start bigint, byte_end bigint, line string, problem string"
    return per_file(ranges, "file_path", "block_start").mapInPandas(lambda frames: range_frames(frames, range_bytes), schema)


# ---------------------------------------------------------------- records


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _string(document: Column, path: str) -> Column:
    """A property that is a JSON string, else NULL."""
    value = F.try_variant_get(document, path, "variant")
    return F.when(_is(value, "STRING"), F.try_variant_get(document, path, "string"))


def record_type(document: Column) -> Column:
    name = _string(document, "$.type")
    return F.when(name.isin(*K.READ_TYPES, *K.IGNORED_TYPES), name).otherwise(F.lit(K.UNKNOWN_TYPE))


def text_blocks(message: Column) -> Column:
    """Texts of a message: its content string, or the text blocks of its content array; blanks dropped."""
    whole = F.array(_string(message, "$.content"))
    listed = F.filter(
        F.try_variant_get(message, "$.content", "array<variant>"),
        lambda b: F.coalesce(_string(b, "$.type") == "text", F.lit(False)),
    )
    texts = F.coalesce(F.transform(listed, lambda b: _string(b, "$.text")), whole)
    return F.filter(texts, lambda t: F.coalesce(F.rlike(t, F.lit(r"[^\p{Z}\s\x{85}]")), F.lit(False)))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines to record fields. A projection: one pass over the text, nothing shuffled.

    Keeps every other column. Empty lines stay (they count as bytes) but are no records.
    """
    doc = F.col("doc")
    others = [c for c in lines.columns if c != line]
    parsed = lines.select(*others, (F.length(line) == 0).alias("empty"), F.try_parse_json(line).alias("doc"))
    typed = parsed.select(*others, "empty", "doc", record_type(doc).alias("type"),
                          F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False)).alias("ok"))
    read = F.col("ok") & ~F.col("type").isin(*K.IGNORED_TYPES)
    message = F.try_variant_get(doc, "$.message", "variant")
    has_message = read & F.coalesce(F.startswith(F.schema_of_variant(message), F.lit("OBJECT")), F.lit(False))
    has_tool = read & F.try_variant_get(doc, "$.toolUseResult", "variant").isNotNull()
    is_meta = read & F.coalesce(_is(F.try_variant_get(doc, "$.isMeta", "variant"), "BOOLEAN") & F.try_variant_get(doc, "$.isMeta", "boolean"), F.lit(False))
    spoken = has_message & ((F.col("type") == "assistant") | ((F.col("type") == "user") & ~has_tool & ~is_meta))
    return typed.select(
        *others, "empty", "type",
        (read & _string(doc, "$.parentUuid").isNotNull()).alias("has_parent"),
        is_meta.alias("is_meta"),
        has_tool.alias("has_tool_result"),
        F.when(read, _string(doc, "$.cwd")).alias("cwd"),
        F.when(read, _string(doc, "$.gitBranch")).alias("git_branch"),
        F.when(F.col("ok"), F.try_to_timestamp(_string(doc, "$.timestamp"))).alias("ts"),
        F.when(read, F.coalesce(_string(doc, "$.customTitle"), _string(doc, "$.aiTitle"), _string(doc, "$.lastPrompt"))).alias("title_text"),
        has_message.alias("has_message"),
        F.when(spoken, text_blocks(message)).otherwise(F.array().cast("array<string>")).alias("blocks"),
        (~F.col("ok") & ~F.col("empty")).alias("malformed"),
    )


def block_totals(parsed: DataFrame) -> DataFrame:
    """Lines and bytes per split, and what comes before each split of its file. One row per split."""
    totals = parsed.groupBy("file_path", "block_start").agg(
        F.max("file_size").alias("file_size"),
        F.count("*").alias("lines"),
        F.sum("n_bytes").alias("bytes"),
        F.max(F.struct("line_order", "n_bytes"))["n_bytes"].alias("last_bytes"),
    )
    earlier = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return totals.select(
        "file_path", "block_start",
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.sum("lines").over(whole).alias("file_lines"),
        F.sum("bytes").over(whole).alias("file_bytes"),
        F.last("last_bytes").over(whole).alias("last_bytes"),
        F.max("file_size").over(whole).alias("size"),
    )


def file_ends(totals: DataFrame) -> DataFrame:
    """Where each file's complete lines end. The byte count tells whether the last line is finished:
    every line was counted with one terminator, and the reader drops a leading byte order mark."""
    bom = F.when(F.col("file_bytes").isin(F.col("size") - BOM_BYTES, F.col("size") - BOM_BYTES + 1), F.lit(BOM_BYTES)).otherwise(F.lit(0))
    finished = F.col("file_bytes") + bom == F.col("size")
    return totals.withColumns(
        {
            "bom": bom,
            "complete_bytes": F.when(finished, F.col("file_bytes")).otherwise(F.col("file_bytes") - F.col("last_bytes")),
        }
    ).withColumn("parse_offset", F.when(F.col("complete_bytes") > 0, F.col("complete_bytes") + F.col("bom")).otherwise(F.lit(0)))


def number_lines(parsed: DataFrame) -> DataFrame:
    """Adds ``seq`` (line number from 1), ``byte_start`` and the file's ``parse_offset``; drops an
    unfinished last line and empty lines. Reads ``parsed`` twice: stage it first when it is large."""
    ends = file_ends(block_totals(parsed)).select(
        "file_path", "block_start", "lines_before", "bytes_before", "complete_bytes", "bom", "parse_offset"
    )
    inside = W.partitionBy("file_path", "block_start").orderBy("line_order")
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    placed = parsed.withColumns({"n": F.row_number().over(inside), "through": F.sum("n_bytes").over(running)})
    joined = placed.join(ends, ["file_path", "block_start"])
    return (
        joined.withColumns(
            {
                "seq": F.col("lines_before") + F.col("n"),
                "byte_start": F.col("bytes_before") + F.col("through") - F.col("n_bytes") + F.when(F.col("bytes_before") + F.col("through") > F.col("n_bytes"), F.col("bom")).otherwise(F.lit(0)),
            }
        )
        .where((F.col("bytes_before") + F.col("through") <= F.col("complete_bytes")) & ~F.col("empty"))
        .drop("n", "through", "lines_before", "bytes_before", "complete_bytes", "bom", "block_start", "line_order", "empty")
    )


def tail_ends(parsed: DataFrame) -> DataFrame:
    """``(file_path, parse_offset, new_lines)`` of the files that gave lines."""
    return parsed.groupBy("file_path").agg(F.max("byte_end").alias("parse_offset"), F.count("*").alias("new_lines"))


def number_tails(parsed: DataFrame, work: DataFrame) -> DataFrame:
    """Adds ``seq``: line numbers go on from the ``line_count`` that ``work`` has for a file. Empty lines count and are dropped.

    One row per range is summed up; the lines themselves meet these sums in a join on file and range.
    """
    earlier = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    counts = parsed.groupBy("file_path", "block_start").agg(F.count("*").alias("n"))
    before = counts.select("file_path", "block_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).join(work.select("file_path", "line_count"), "file_path")
    placed = parsed.join(before, ["file_path", "block_start"])
    return placed.withColumn("seq", F.col("line_count") + F.col("before") + F.col("line_order") + 1).where(~F.col("empty")).drop("line_count", "before", "block_start", "line_order", "empty")


def identify(records: DataFrame, owner: Column | None = None) -> DataFrame:
    """Adds owner, session id and file name from the path."""
    return records.withColumns(
        {
            "owner": owner if owner is not None else F.lit(""),
            "session_id": session_id_of(F.col("file_path")),
            "file_name": file_name_of(F.col("file_path")),
        }
    )


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return identify(number_lines(parse_lines(read_lines(spark, paths))))
