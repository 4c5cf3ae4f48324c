"""Numberings by buckets, joins on hot keys, scans with broken files, vectors of odd shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.operators import outline, retrieval, traces
from fernlake.plans.scratch import Scratch, shared_dir
from fernlake.plans.skew import dealt_anew, numbered
from fernlake.sources import tables


def test_numbered(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 101) for k in range(101)]
    got = numbered(spark.createDataFrame(rows, "g long, x long"), "no", ["g"], F.floor(F.col("x") / 10), "x").collect()
    for g in {r.g for r in got}:
        mine = sorted((r.no, r.x) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)
    assert set(got[0].asDict()) == {"g", "x", "no"}


def test_hot_join_is_split(spark):
    """The join of many rows on one key runs in more tasks than the key has partitions."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(1)).alias("k"), F.col("id").alias("x"))
    with Scratch(spark) as scratch:
        kept = scratch.keep(rows.repartition(8), "rows")
        keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
        before = {k: spark.conf.get(k) for k in keys}
        for k, v in keys.items():
            spark.conf.set(k, v)
        try:
            out = kept.join(dealt_anew(kept.groupBy("k").count(), "k"), "k")
            assert out.count() == 40_000
            df = out.select("k", "x", "count")
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)


def test_scratch_keeps_what_is_read(spark):
    scratch = Scratch(spark)
    a, b = scratch.keep(spark.range(3), "a"), scratch.keep(spark.range(4), "b", last=True)
    scratch.drop(spark.range(1))
    assert a.count() == 3
    scratch.close()
    assert b.count() == 4 and not scratch.tables and shared_dir(spark)


def test_broken_files_keep_earlier_lines(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "good.md").write_bytes("a\r\né\rc\n".encode())
    (tmp_path / "deep" / "bad.md").write_bytes(b"one\ntwo\nth\xff\xferee\nfour")
    (tmp_path / "worst.md").write_bytes(b"\xff\nx")
    (tmp_path / "marks.md").write_bytes("a \ufffd b\r\rc\n".encode() + b"x\rgood\rb\xe9d\rlost\r\nlost")
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "open end.md").write_bytes(b"x\r")
    (tmp_path / "other.txt").write_text("no")
    got = {}
    for r in tables.scan_outline_files(spark, str(tmp_path)).collect():
        got.setdefault(r.source, {})[r.line_number] = r.line
    assert got == {
        "good": {0: "a", 1: "é", 2: "c", 3: ""}, "bad": {0: "one", 1: "two"}, "marks": {0: "a \ufffd b", 1: "", 2: "c", 3: "x", 4: "good"},
        "open end": {0: "x", 1: ""},
    }
    broken = {r.file.rsplit("/", 1)[1]: (r.line_number, r.byte) for r in tables.broken_files(spark, str(tmp_path)).collect()}
    assert broken == {"bad.md": (2, 8), "worst.md": (0, 0), "marks.md": (5, 18)}


def test_large_files_are_cut(spark, tmp_path):
    """A file is read in several tasks, and its lines are numbered across them."""
    (tmp_path / "long.md").write_text("".join(f"line {k}\n" for k in range(60_000)), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = tables.scan_outline_files(spark, str(tmp_path))
        assert rows.where("line = concat('line ', line_number)").count() == 60_000 and rows.count() == 60_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_very_deep_lines(spark):
    rows = [("s", k, " " * (2 * d) + f"- x{k}") for k, d in enumerate([0, 4000, 1, 3000, 2, 1])] + [(None, 0, "- y"), (None, 1, "  - z")]
    got = {(r.source, r.line_number): r.parent_line for r in outline.build_nodes(spark.createDataFrame(rows, "source string, line_number int, line string")).collect()}
    assert got == {("s", 0): None, ("s", 1): 0, ("s", 2): 0, ("s", 3): 2, ("s", 4): 2, ("s", 5): 0, (None, 0): None, (None, 1): 0}


def test_ingest_guards(spark):
    lines = spark.createDataFrame([("s", 0, "- a")], "source string, line_number int, line string")
    stored = spark.createDataFrame([("kept",)], "node_id string")
    assert outline.ingest_pipeline(lines, stored=stored).collect() == stored.collect()
    assert outline.ingest_pipeline(lines, stored=stored.limit(0)).count() == 1
    with pytest.raises(ValueError):
        outline.ingest_pipeline(lines.limit(0))


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [(k, rng.normal(size=8).round(1).tolist()) for k in range(300)] + [(k, v) for k, v in ((400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (404, [None] * 8))]
    v += [(500, v[3][1]), (501, v[3][1])]
    df = spark.createDataFrame(v, "item_id long, embedding array<double>").repartition(5)
    ok = {k: np.array(x) / np.linalg.norm(x) for k, x in v if x and len(x) == 8 and k not in (401, 402, 404)}
    for blocks in (1 << 20, 300):
        got = {}
        for r in retrieval.vector_topk(df.where("item_id % 7 = 3 or item_id >= 400").withColumnRenamed("item_id", "query_id"), df, 4, max_bytes=blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score))
        want = {}
        for q in ok:
            if q % 7 == 3 or q >= 400:
                best = sorted((-round(float(ok[q] @ x), 6), k) for k, x in ok.items() if k != q)[:4]
                want[q] = [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
        assert {k: sorted(x) for k, x in got.items()} == want
    names = df.withColumn("item_id", F.concat(F.lit("v"), "item_id"))
    assert retrieval.vector_topk(names.where("item_id = 'v3'").withColumnRenamed("item_id", "query_id"), names, 2, least=0.99).count() == 2


def test_trimmed_nulls_stay(spark):
    df = spark.createDataFrame([(1, None), (2, "[SOURCE] " + "x" * 500)], "id long, text string")
    got = {r.id: r.text for r in traces.retriever_block_trim(df).collect()}
    assert got[1] is None and got[2].endswith("chars SOURCE TRUNCATED]")


def test_byte_order_mark(spark, tmp_path):
    """A file's last line end opens a line whether or not the file begins with a byte order mark."""
    (tmp_path / "marked.md").write_bytes(b"\xef\xbb\xbf- a\n- b\n")
    (tmp_path / "open.md").write_bytes(b"\xef\xbb\xbf- a\n- b")
    got = {}
    for r in tables.scan_outline_files(spark, str(tmp_path)).collect():
        got.setdefault(r.source, {})[r.line_number] = r.line
    assert got == {"marked": {0: "- a", 1: "- b", 2: ""}, "open": {0: "- a", 1: "- b"}}
