"""Records of large JSON files, cut at closing braces so that one array is the work of many tasks.

A file is read in pieces that end at `}`.  In valid JSON no escape crosses such a cut, so whether a
piece starts inside a string is the parity of the quotes before it, and its depth is the sum of
the brackets outside strings before it.  Both are running sums: within a block of the file by a window, over
blocks from one row per block.  A piece that comes back to the level of the records ends one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernlake.plans.scratch import Scratch

_PLACE = ("_metadata.file_path as file", "_metadata.file_block_start as block", "monotonically_increasing_id() as id", "value")


def _count(c: Column, marks: str) -> Column:
    return F.length(c) - F.length(F.translate(c, marks, ""))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text, whole) of every line that is not blank; (block, place) ascends within a file."""
    lines = spark.read.format("text").option("recursiveFileLookup", "true").load(path)
    lines = lines.selectExpr(*_PLACE).withColumnsRenamed({"id": "place", "value": "text"})
    return lines.where(r"text rlike r'\S'").withColumn("whole", F.lit(True))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, text, whole) of the objects of each file's array, or of its objects one after another.

    `place` counts from 0 within a file and `block` is 0.  What follows a file's last object, unless it is blank or
    closes the array, is one row that is not whole and has no text.  An empty file or array has no
    rows.  Files are valid UTF-8 and not compressed; a record has to fit into one task, a file does not.
    """
    read = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true")
    files = read("binaryFile").load(path).selectExpr("_metadata.file_path as file", "length")
    pieces = read("text").option("lineSep", "}").load(path).selectExpr(*_PLACE)
    pieces = Scratch(spark).keep(pieces, "pieces", last=True)
    whole_file = Window.partitionBy("file")
    earlier = whole_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file", "block").orderBy("id")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))

    # the last piece of a file is closed only if the bytes add up with the mark behind it; the reader drops a byte order mark of three
    sizes = pieces.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.max(F.struct("block", "id")).alias("last"))
    sizes = sizes.join(files, "file").select("file", F.col("last.id").alias("last"), (F.pmod(F.col("bytes") - F.col("length"), F.lit(3)) == 1).alias("open_end"))
    rows = pieces.join(sizes, "file").withColumn("closed", ~((F.col("id") == F.col("last")) & F.col("open_end"))).drop("last", "open_end")
    rows = rows.withColumn("bare", F.regexp_replace("value", r"\\(?s:.)", "")).withColumn("quotes", _count(F.col("bare"), '"'))

    def step(odd: Column) -> Column:
        outside = F.array_join(F.filter(F.split("bare", '"', -1), lambda _, i: (i + odd) % 2 == 0), "")
        mark = F.when(F.col("closed") & ((odd + F.col("quotes")) % 2 == 0), 1).otherwise(0)
        return _count(outside, "{[") - _count(outside, "]") - mark

    # the steps if the block starts outside of a string, and if it starts inside of one
    rows = rows.withColumn("odd", sum_of("quotes", before) % 2)
    rows = rows.withColumn("step0", step(F.col("odd"))).withColumn("step1", step(1 - F.col("odd"))).drop("bare")
    array = F.ltrim(F.replace("value", F.lit("\ufeff"), F.lit("")), F.lit(" \t\r\n")).startswith("[")
    blocks = rows.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("step0").alias("s0"), F.sum("step1").alias("s1"), F.min_by(array, "id").alias("array"))
    blocks = blocks.withColumn("inside", sum_of("q", earlier) % 2).withColumn("base", F.first("array").over(whole_file.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int"))
    blocks = blocks.withColumn("depth_before", sum_of(F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1")), earlier)).select("file", "block", "inside", "base", "depth_before")
    rows = rows.join(blocks, ["file", "block"])
    depth = F.col("depth_before") + F.sum(F.when(F.col("inside") == 0, F.col("step0")).otherwise(F.col("step1"))).over(within)
    ends = F.col("closed") & ((F.col("inside") + F.col("odd") + F.col("quotes")) % 2 == 0) & (depth == F.col("base"))
    rows = rows.select("file", "block", "id", "value", "closed", ends.cast("int").alias("ends"))

    counts = rows.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    counts = counts.select("file", "block", sum_of("n", earlier).alias("n_before"), F.sum("n").over(whole_file).alias("n_file"))
    rows = rows.join(counts, ["file", "block"]).withColumn("place", F.col("n_before") + sum_of("ends", before))
    text = F.concat("value", F.when(F.col("closed"), "}").otherwise(""))
    done = rows.where("place < n_file").groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("block", "id", text.alias("text")))).alias("parts"))
    lead = F.regexp_replace(F.array_join("parts.text", ""), r"^[\s,\[\x{FEFF}]+", "")
    done = done.select("file", F.lit(0).cast("long").alias("block"), "place", lead.alias("text"), F.lit(True).alias("whole"))
    rest = rows.where(F.col("place") >= F.col("n_file")).where(text.rlike(r"[^\s\[\]\x{FEFF}]")).select("file", "place").distinct()
    return done.union(rest.select("file", F.lit(0).cast("long"), "place", F.lit(None).cast("string"), F.lit(False)))
