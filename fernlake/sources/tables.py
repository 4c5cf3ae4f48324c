"""Scans and sinks: Markdown trees, run logs, keyed upserts and guarded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernlake.plans.scratch import Scratch
from fernlake.sources.json_records import json_lines, json_records

#: Schema of exported run records.
RUN_SCHEMA = (
    "_id string, id string, name string, run_type string, status string, start_time string, end_time string, inputs string, outputs string, error string, latency double, "
    "prompt_tokens long, completion_tokens long, total_tokens long, prompt_cost string, completion_cost string, total_cost string, parent_run_id string, trace_id string, "
    "tags array<string>, extra string, feedback_stats string, exported_at string"
)


def scan_outline_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(source, line_number, line, file) of all matching files below a folder; source is the file's stem.

    Lines end at \\n, \\r\\n or \\r; a file has one line more than ends, but an empty one has none.  Large
    files are cut where Spark splits them, and lines are numbered from the counts of earlier
    parts; only a stretch without \\n has to be in one task.  Of a file that is no valid UTF-8 the lines before the
    first bad one are kept; `broken_files` names such files.
    """
    lines = _file_lines(spark, root, pattern)
    bad = lines.where("not valid").groupBy(F.col("key").alias("of")).agg(F.min("line_number").alias("bad"))
    good = lines.join(bad, F.col("key") == F.col("of"), "left").where("bad is null or line_number < bad")
    return good.select(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("source"), F.col("line_number").cast("int").alias("line_number"), "line", "file")


def broken_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(file, line_number, byte) of the first line that cannot be read, and where it begins, of each file that has one."""
    bad = _file_lines(spark, root, pattern).where("not valid")
    first = bad.groupBy("file").agg(F.min(F.struct("line_number", "byte")).alias("x"))
    return first.select("file", F.col("x.line_number").cast("int").alias("line_number"), F.col("x.byte").alias("byte"))


def _file_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(key, file, line_number, line, byte, valid) of all lines; `byte` is where a line begins."""
    read = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = read("binaryFile").load(root).select(F.col("_metadata.file_path").alias("key"), F.col("path").alias("file"), "length")
    # records end at \n alone, so that their bytes add up; ids ascend by one within a file's block
    records = read("text").option("lineSep", "\n").load(root)
    records = records.select(F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    records = Scratch(spark).keep(records, "records", last=True)
    # a bad byte survives as a character of its own in this encoding
    bytes_ = lambda c: F.decode(c.cast("binary"), "ISO-8859-1")
    back = lambda c: F.encode(c, "ISO-8859-1").cast("string")
    size = F.octet_length("value") + 1
    n = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\r"), F.lit(""))) + 1
    n = n - F.endswith("value", F.lit("\r")).cast("int")
    sums = records.groupBy("key", "block").agg(F.sum(size).alias("bytes"), F.sum(n).alias("lines"), F.max("id").alias("last"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    of_file = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    blocks = sums.select("key", "block", of_file("bytes").alias("bytes_before"), of_file("lines").alias("lines_before"), F.max("last").over(whole).alias("last"), F.sum("bytes").over(whole).alias("all_bytes"))
    within = Window.partitionBy("key", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = records.join(blocks, ["key", "block"]).join(files, "key")
    rows = rows.withColumn("line_before", F.col("lines_before") + F.coalesce(F.sum(n).over(within), F.lit(0))).withColumn("byte_before", F.col("bytes_before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    # the last record ends with the file, or at a last \n, behind which an empty line follows; the reader drops a byte order mark of three bytes
    open_end = (F.col("id") == F.col("last")) & (F.pmod(F.col("all_bytes") - F.col("length"), F.lit(3)) == 1)
    closed = F.col("id") == F.col("last")
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(bytes_(F.col("value")))
    text = F.when(~open_end & F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)
    parts = F.split(text, "\r", -1)
    rows = rows.withColumn("valid", F.is_valid_utf8("value")).withColumn("parts", F.when(closed & ~open_end, F.concat(parts, F.array(F.lit("")))).otherwise(parts))
    each = rows.select("key", "file", "valid", "line_before", "byte_before", "parts", F.posexplode("parts").alias("at", "part"))
    line = F.when(F.col("valid"), F.col("part")).otherwise(back(F.col("part")))
    earlier = F.aggregate(F.slice("parts", F.lit(1), F.col("at")), F.lit(0), lambda a, x: a + F.when(F.col("valid"), F.octet_length(x)).otherwise(F.length(x)) + 1)
    return each.select("key", "file", (F.col("line_before") + F.col("at")).alias("line_number"), line.alias("line"), (F.col("byte_before") + F.when(F.col("at") == 0, 0).otherwise(earlier)).alias("byte"), (F.col("valid") | F.is_valid_utf8(line)).alias("valid"))


def scan_runs_json(spark: SparkSession, path: str, schema: str = RUN_SCHEMA, key: str = "_id", multi_line: bool = True) -> DataFrame:
    """Run records of JSON arrays (or of JSON lines), one per id: the last in the file, of several files in the last by path.

    Large files, arrays on one line included, are read by many tasks.  What is no JSON object is left
    out, see `broken_runs`; a field of another type is null.  Records without an id count as one id.
    """
    rows = _run_texts(spark, path, multi_line).where("good").select("file", "block", "place", F.from_json("text", schema).alias("run"))
    last = rows.groupBy(F.col(f"run.`{key}`").alias("id")).agg(F.max_by("run", F.struct("file", "block", "place")).alias("run"))
    return last.select("run.*")


def broken_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(file, block, place, text) of what `scan_runs_json` leaves out; the text is null where a file breaks off."""
    return _run_texts(spark, path, multi_line).where("not good").select("file", "block", "place", "text")


def _run_texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    rows = json_records(spark, path) if multi_line else json_lines(spark, path)
    return rows.withColumn("good", F.col("whole") & F.json_object_keys("text").isNotNull())


def serialize_nested(df: DataFrame) -> DataFrame:
    """Every column as text: timestamps in ISO form, nested values as JSON, others cast."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def serialize_props(df: DataFrame) -> DataFrame:
    """Nested and boolean columns as JSON text, scalars kept."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def upsert_by_id(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Both tables, one row per key: the greatest version, and of equal versions the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__new")


def load_if_empty(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target if it has rows, else the source."""
    return source.select(*target.columns) if target.limit(1).isEmpty() else target


def filter_sources(nodes: DataFrame, allowed: DataFrame, key: str = "source", most: int | None = None) -> DataFrame:
    """Nodes of allowed sources; fails if more than `most` sources are left."""
    kept = nodes.join(allowed.select(key).distinct(), key, "left_semi")
    if most is not None and (n := kept.select(key).distinct().count()) >= most:
        raise ValueError(f"{n} sources; the limit is {most}")
    return kept


def written_outlines(docs: DataFrame, per_file: int = 50) -> tuple[SparkSession, str]:
    """Write texts as files in the shared folder, for a scan to read back: one folder and file for each stretch of ids."""
    spark = docs.sparkSession
    path = Scratch(spark).path("outlines")
    rows = docs.withColumn("part", F.floor(F.col("doc_id") / per_file)).repartition("part").sortWithinPartitions("part", "doc_id")
    rows.select("part", F.col("text").alias("value")).write.partitionBy("part").text(path)
    return spark, path


def written_arrays(rows: DataFrame, key: str, *order: str, files: int = 16) -> tuple[SparkSession, str]:
    """Write rows as JSON arrays in the shared folder, for a scan to read back: a file per hash of `key`, in the given order."""
    spark = rows.sparkSession
    path = Scratch(spark).path("arrays")
    texts = rows.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("part"), key, *order, F.to_json(F.struct(*(c for c in rows.columns if c not in order))).alias("json"))
    n = F.row_number().over(Window.partitionBy("part").orderBy(*order, key))
    lines = texts.select("part", n.alias("n"), F.concat(F.when(n == 1, "[").otherwise(", "), "json").alias("value"))
    ends = texts.groupBy("part").agg((F.count(F.lit(1)) + 1).cast("int").alias("n")).withColumn("value", F.lit("]"))
    lines.union(ends).repartition("part").sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").text(path)
    return spark, path
