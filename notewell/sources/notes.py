"""Sources: note folders, JSON lines (also compressed), sidecars, commit logs; and the note sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import durable, ship

# Folders that hold no notes.
SKIPPED = (".git", ".obsidian", ".trash", "node_modules", "__pycache__")
TITLE_KEYS, MODULE_KEYS = ("title", "título", "titulo"), ("module", "módulo", "modulo")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, with Hadoop's names of a scheme taken as Arrow's."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'wasbs': 'abfss', 'wasb': 'abfs'}.get(scheme, scheme)}://{rest}")


def underscored_files(spark: SparkSession, root: str, name: str = "_index.md") -> DataFrame:
    """(path, modificationTime, content) of the files ``name``, which Spark's readers pass over as their names begin with an underscore.

    Tasks walk the folders level by level until none is left, and read the files; the driver sees none of it. Folders
    in SKIPPED are not entered, and links to folders are not followed where the file system tells them apart. No files: no rows.
    """
    ship(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(root)
        for b in batches:
            found = [i for folder in b.column(0).to_pylist() for i in store.get_file_info(fs.FileSelector(folder))]
            found = [i for i in found if (i.is_file and i.base_name == name) or (i.type == fs.FileType.Directory and i.base_name not in SKIPPED)]
            yield pa.RecordBatch.from_pydict({"path": pa.array([i.path for i in found], pa.string()), "file": pa.array([i.is_file for i in found], pa.bool_()),
                                              "modificationTime": pa.array([i.mtime for i in found], pa.timestamp("us", "UTC"))})

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(root)
        for b in batches:
            content = [store.open_input_file(p).readall() for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary())], names=["path", "modificationTime", "content"])

    folders = spark.range(1).select(F.lit(file_system(root)[1]).alias("path"))
    files = None
    while True:
        level = durable(folders.mapInArrow(walk, "path string, file boolean, modificationTime timestamp"))
        here = level.where("file")
        files = here if files is None else files.union(here)
        folders = level.where("NOT file").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(F.col("path"))
    return files.select("path", "modificationTime").mapInArrow(load, "path string, modificationTime timestamp, content binary")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """The notes below ``root``, as ``parse_notes`` gives them, with paths relative to it.

    ``root`` may be any folder that Spark reads and Arrow knows the scheme of (local, hdfs, s3, gs, abfs). Bytes that are not UTF-8
    become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    files = files.select("path", "modificationTime", "content").union(underscored_files(spark, root))
    base = file_system(root)[1].rstrip("/")
    return parse_notes(files.select(
        F.regexp_extract("path", r"\Q" + base + r"\E/(.*)$", 1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"),
        F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha")))


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, name, scope, workspace, project, ticket_dir, title, description, module, tags, status, links, body, mtime, sha, authored) of (path, raw, mtime, sha).

    Files that no scope fits are left out, and those below a folder in SKIPPED. A note without a status takes that of its ticket's index, and a
    ticket's notes take the index's date (resolved, else last_update, else opened). ``links`` are the first ten of a note;
    ``operators.links.mentions`` reads all of them from the body.
    """
    rows = files.withColumn("scope", T.scope_of(F.col("path"))).where("scope IS NOT NULL")
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))
    rows = rows.withColumn("fm", T.front_matter(F.col("raw"))).withColumn("body", T.note_body(F.col("raw")))
    one = lambda *keys: F.coalesce(*(F.nullif(F.get(F.col("fm")[k], F.lit(0)), F.lit("")) for k in keys))
    day = lambda k: F.try_to_date(F.substring(one(k), 1, 10))
    parts = F.split("path", "/")
    notes = rows.select(
        "path", T.note_name(one("name"), F.col("path")).alias("name"), "scope", F.get(parts, F.lit(0)).alias("workspace"),
        F.when(F.col("scope") != "workspace", F.get(parts, F.lit(1))).alias("project"), T.ticket_dir(F.col("path")).alias("ticket_dir"),
        one(*TITLE_KEYS).alias("title"), T.describe(one("description"), one(*TITLE_KEYS), F.col("body")).alias("description"), one(*MODULE_KEYS).alias("module"),
        F.coalesce(F.col("fm")["tags"], F.array().cast("array<string>")).alias("tags"), one("status").alias("status"), T.wiki_links(F.col("body")).alias("links"),
        F.coalesce(day("resolved"), day("last_update"), day("opened")).alias("_dated"), "body", "mtime", "sha")
    return inherit(notes)


def inherit(notes: DataFrame) -> DataFrame:
    """Status and date of a ticket's notes from its index where they have none of their own."""
    index = notes.where("scope = 'index'").groupBy("ticket_dir").agg(F.max("status").alias("_status"), F.max("_dated").alias("_date"))
    return notes.join(index, "ticket_dir", "left").withColumn("status", F.coalesce("status", "_status", F.lit(""))).withColumn(
        "authored", F.coalesce("_date", "_dated")).drop("_status", "_date", "_dated")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-line files, plain or compressed; blank and broken lines are left out.

    Spark reads what its codecs know; ``.zst`` files are unpacked as they are read, and of a torn one the whole lines count.
    """
    from .growing import read_lines

    parsed = F.from_json("value", schema)
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file")).where(~F.col("file").endswith(".zst"))
    lines = lines.union(read_lines(spark, path, "", ".zst").select("line", "file"))
    rows = lines.where(F.trim("value").startswith("{") & F.expr("try_parse_json(value) IS NOT NULL")).select("file", parsed.alias("row"))
    return rows.select("file", "row.*")


def record_text(record: F.Column | str = "content", most: int = 400) -> F.Column:
    """Text of a transcript record's content, in JSON: a string, or blocks of text, tool_use and tool_result (cut to ``most``; a string or text blocks).

    The record is parsed once, as a variant. Other blocks and empty ones are left out; what is no JSON, or neither a string nor a list, is its own text.
    """
    raw = F.col(record) if isinstance(record, str) else record
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)

    def result(block: F.Column) -> F.Column:
        parts = F.filter(get(block, "$.content", "array<variant>"), lambda x: get(x, "$.type", "string") == "text")
        listed = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("[tool_result]: "), F.substring(get(x, "$.text", "string"), 1, most))), "\n")
        return F.coalesce(listed, F.concat(F.lit("[tool_result]: "), F.substring(get(block, "$.content", "string"), 1, most)))

    def rendered(block: F.Column) -> F.Column:
        kind = get(block, "$.type", "string")
        return (F.when(kind == "text", get(block, "$.text", "string")).when(kind == "tool_use", F.concat(F.lit("[tool_use:"), F.coalesce(get(block, "$.name", "string"), F.lit("?")), F.lit("]")))
                .when(kind == "tool_result", result(block)))

    def text(v: F.Column) -> F.Column:
        blocks = F.transform(get(v, "$", "array<variant>"), rendered)
        return F.coalesce(F.array_join(F.filter(blocks, lambda x: x.isNotNull() & (x != "")), "\n"), F.when(F.ltrim(raw).startswith('"'), get(v, "$", "string")), raw)

    return F.transform(F.array(F.try_parse_json(raw)), text)[0]


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, timestamp, role, text) of transcript logs {timestamp, item: {type, role, content}}."""
    rows = read_json_lines(spark, path, "timestamp string, item struct<type:string, role:string, content:string>")
    return rows.select("file", "timestamp", F.coalesce("item.role", "item.type").alias("role"), record_text(F.col("item.content")).alias("text"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Session sidecars, one JSON object a file; malformed ones are left out."""
    schema = "session_id string, branch string, cwd string, mark_token string, marked_at string, manual_override boolean"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).option("pathGlobFilter", "*.json").json(path).where("session_id IS NOT NULL")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, day, subject) of tab-separated log lines."""
    return spark.read.option("sep", "\t").schema("sha string, day string, subject string").csv(path).where("sha IS NOT NULL")


def set_status(notes: DataFrame, statuses: DataFrame) -> DataFrame:
    """Statuses (path, status) written into notes, inserted where a note has none."""
    new = statuses.select("path", F.col("status").alias("_new"))
    return notes.join(new, "path", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def context_block(rows: DataFrame, group: str, order: str, line: str, limit: int = 15_000) -> DataFrame:
    """Lines of each group joined in order into one text, up to ``limit`` bytes, with a marker where lines are left out."""
    from ..operators.retrieval import budget

    kept = budget(rows, [group], [F.col(order)], F.octet_length(F.col(line)) + 1, limit)
    whole = rows.groupBy(group).agg(F.count("*").alias("_all"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    blocks = kept.groupBy(group).agg(text.alias("block"), F.count("*").alias("_kept")).join(whole, group)
    return blocks.select(group, F.when(F.col("_kept") < F.col("_all"), F.concat("block", F.lit("\n[...truncated]"))).otherwise(F.col("block")).alias("block"))
