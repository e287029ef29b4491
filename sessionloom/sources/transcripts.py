"""Transcript files: raw lines, profiles, provider detection and discovery."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROVIDERS = ("tree", "rollout", "journal")


PACKED = r"\.(?:zst|gz|bz2|lz4|snappy|deflate)$"


def files(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """session_key, path, path_ix, length, modified of the transcript files below ``path``; nothing of their content is read.

    A session is a file together with the sidechain files in the folder that carries its name; the file comes first (path_ix 0), its sidechains follow in
    path order.  Files whose names begin with a dot are left out.
    """
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=glob).load(path)
    own = {"path": "file_path", "length": "file_size", "modified": "file_modification_time"}
    found = found.select(*[F.col(f"_metadata.{m}").alias(c) for c, m in own.items()])
    found = found.where(~F.regexp_like("path", F.lit(r"/\.[^/]*$"))).withColumn("side", F.contains("path", F.lit("/subagents/")))
    main = F.regexp_replace(F.regexp_replace("path", F.lit(r"/subagents/[^/]*$"), F.lit("")), F.lit(r"\.jsonl(?:\.[a-z0-9]+)?$"), F.lit(""))
    place = F.row_number().over(Window.partitionBy("session_key").orderBy("side", "path")) - 1
    return found.withColumn("session_key", main).select("session_key", "path", place.alias("path_ix"), "length", "modified")


def _scan(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, block (where the split begins), id (dense and rising within a split), value: the lines as they lie, a split of a file at a time."""
    text = spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, lineSep="\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """path, line_no (from 1), value of every line below ``path``.

    Plain files are read in splits of the session's ``spark.sql.files.maxPartitionBytes``, each in a task of its own; compressed ones whole.  A first pass counts the
    lines of each split, so a line's number is that of the splits before it and its place in its own.
    """
    scan = _scan(spark, path, glob)
    counts = scan.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    blocks = counts.select("path", "block", "first", before.alias("before"))  # a row for each split
    return scan.join(blocks, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), "value")


def raw_lines(spark: SparkSession, path: str, glob: str = "*.jsonl*", hashed: bool = True) -> DataFrame:
    """session_key, path, path_ix, line_no, raw and, if ``hashed``, sha256 (of the file, see ``file_hashes``) for every line of the transcripts below ``path`` (plain
    or compressed).

    Line numbers start at 1 and count blank lines; one closing carriage return is taken off, and bytes that are no UTF-8 become U+FFFD.
    """
    known = files(spark, path, glob).select("session_key", "path", "path_ix")
    if hashed:
        known = known.join(file_hashes(spark, path, glob), "path")
    lines = numbered_lines(spark, path, glob).where(~F.regexp_like("path", F.lit(r"/\.[^/]*$")))
    raw = F.regexp_replace(F.make_valid_utf8("value"), F.lit(r"\r\z"), F.lit(""))
    return lines.join(known, "path").select("session_key", "path", "path_ix", "line_no", raw.alias("raw"), *(["sha256"] if hashed else []))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by (path, line_no), with the file's length: a hash of each file's bytes.  Whether the last line was ended shows in the length."""
    path, digest, size, length = None, None, 0, 0

    def close() -> pa.RecordBatch:
        if size < length:
            digest.update(b"\n")
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "sha256"])

    for batch in batches:
        for name, long_, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if name != path:
                if path is not None:
                    yield close()
                path, digest, size, length = name, hashlib.sha256(), 0, long_
            else:
                digest.update(b"\n")
                size += 1
            digest.update(value)
            size += len(value)
    if path is not None:
        yield close()


def file_hashes(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """path, sha256 of each file's bytes, uncompressed ones.  A plain file's lines run through one task in order, none is held; a compressed file is read as one value."""
    found = files(spark, path, glob).select("path", "length")
    plain = numbered_lines(spark, path, glob).where(~F.regexp_like("path", F.lit(PACKED))).join(found, "path")
    ordered = plain.select("path", "line_no", "length", F.col("value").cast("binary").alias("value")).repartition("path").sortWithinPartitions("path", "line_no")
    hashed = ordered.mapInArrow(_hash_lines, "path string, sha256 string")
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), "value")
    packed = whole.where(F.regexp_like("path", F.lit(PACKED))).select("path", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    empty = found.where("length = 0").select("path", F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return hashed.unionByName(packed).unionByName(empty)


def source_hash(lines: DataFrame) -> DataFrame:
    """session_key, source_hash: the hash of the files' hashes, in file order."""
    known = lines.select("session_key", "path_ix", "sha256").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path_ix", "sha256"))), lambda f: f["sha256"]), "")
    return known.groupBy("session_key").agg(F.sha2(joined.cast("binary"), 256).alias("source_hash"))


def profile(lines: DataFrame, head: int = 60) -> DataFrame:
    """session_key, n_lines, first_line, last_line, head (the first ``head`` lines) of the non-blank lines of each main file."""
    own = lines.where((F.col("path_ix") == 0) & (F.trim("raw") != ""))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("session_key").orderBy("line_no")))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= head, F.struct("line_no", "raw"))))
    return own.groupBy("session_key").agg(
        F.count("*").alias("n_lines"), F.min_by("raw", "line_no").alias("first_line"), F.max_by("raw", "line_no").alias("last_line"), F.transform(kept, lambda x: x["raw"]).alias("head")
    )


def detect(line: Column) -> Column:
    """The provider that writes lines of this shape; null if none does."""
    v = F.try_parse_json(line)
    kind = F.try_variant_get(v, "$.type", "string")
    has = lambda key: F.get_json_object(line, f"$.{key}").isNotNull()
    envelope = kind.isin("session_meta", "response_item", "event_msg", "turn_context", "compacted", "token_usage_record", "turn_diff")
    tree = has("uuid") | has("parentUuid") | has("sessionId") | kind.isin("user", "assistant", "summary", "system")
    return (
        F.when(v.isNull(), None)
        .when((kind == "session") & has("version"), "journal")
        .when(envelope & (has("payload") | has("timestamp")), "rollout")
        .when(tree, "tree")
        .when(has("message") & has("id"), "journal")
    )


def id_from_filename(path: Column) -> Column:
    """The session id in a file's name: the five groups at the end of a rollout's, what follows the first underscore, or the stem."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), F.lit(r"\.jsonl(?:\.[a-z0-9]+)?$"), F.lit(""))
    groups = F.regexp_extract(stem, r"^rollout-.*?([0-9a-fA-F]+(?:-[0-9a-fA-F]+){4})$", 1)
    after = F.regexp_extract(stem, "^[^_]*_(.*)$", 1)
    return F.when(groups != "", groups).when(after != "", after).otherwise(stem)


def summaries(lines: DataFrame) -> DataFrame:
    """session_key, agent, id, cwd, title, started_at, ended_at, first_message (120 characters, one line), n_lines."""
    p = profile(lines)
    get = lambda key: F.get_json_object("l", f"$.{key}")
    each = p.select("session_key", "n_lines", "last_line", detect(F.col("first_line")).alias("agent"), F.posexplode("head").alias("at", "l"))
    text = F.when(get("type") == "user", F.coalesce(get("message.content[0].text"), get("message.content"))).when(
        (get("payload.type") == "message") & (get("payload.role") == "user"), get("payload.content[0].text")
    ).when(get("message.role") == "user", F.coalesce(get("message.content[0].text"), get("message.content")))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("at")))
    line = F.left(F.trim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" "))), F.lit(120))
    human = F.when(~F.startswith(line, F.lit("<")), line)
    return each.groupBy("session_key", "n_lines", "agent").agg(
        first(F.coalesce(get("sessionId"), get("payload.meta.id"), get("payload.id"), F.when(get("type") == "session", get("id")))).alias("id"),
        first(F.coalesce(get("cwd"), get("payload.meta.cwd"), get("payload.cwd"))).alias("cwd"),
        first(F.coalesce(get("summary"), get("title"))).alias("title"),
        first(F.coalesce(get("timestamp"), get("time"))).alias("started_at"),
        F.max(F.get_json_object("last_line", "$.timestamp")).alias("ended_at"),
        first(human).alias("first_message"),
    ).withColumn("id", F.coalesce("id", id_from_filename(F.col("session_key"))))


def in_project(cwd: Column, folder: str, up: bool = False) -> Column:
    """Whether a session's folder is the given one or, with ``up``, one above it."""
    own = cwd == folder
    above = F.startswith(F.lit(folder), F.concat(F.rtrim(cwd, F.lit("/")), F.lit("/"))) & F.startswith(cwd, F.lit("/"))
    return F.coalesce(own | above if up else own, F.lit(False))


def matching(found: DataFrame, project: str | None = None, query: str | None = None, limit: int | None = None, up: bool = False) -> DataFrame:
    """Summaries of a project (sessions in its folder and, with ``up``, in those above it; all, if none matches) whose title, first message or folder hold the query, latest first."""
    if project is not None:
        own = found.where(in_project(F.col("cwd"), project, up))
        found = found.join(own.select("session_key"), "session_key", "left_semi") if not own.isEmpty() else found
    if query is not None:
        hay = F.lower(F.concat_ws("\n", "title", "first_message", "cwd"))
        found = found.where(F.contains(hay, F.lit(query.lower())))
    found = found.orderBy(F.desc_nulls_last("started_at"), "session_key")
    return found if limit is None else found.limit(limit)


def resolve(found: DataFrame, reference: str) -> DataFrame:
    """The one session that a reference names: an id, the start of one (six characters at least), or ``last`` / ``last:N``."""
    if reference == "last" or reference.startswith("last:"):
        n = int(reference.partition(":")[2] or 1)
        rows = matching(found, limit=n).tail(1) if n > 0 else []
        ids = [r["session_key"] for r in rows][-1:]
        return found.where(F.col("session_key").isin(ids))
    exact = found.where(F.col("id") == reference)
    if not exact.isEmpty():
        return exact
    if len(reference) < 6:
        raise ValueError("a reference needs six characters")
    close = found.where(F.startswith(F.col("id"), F.lit(reference)) | F.contains(F.col("session_key"), F.lit(reference)))
    n = len(close.limit(2).collect())
    if n != 1:
        raise LookupError("no session has this id" if n == 0 else "several sessions have ids like this")
    return close
