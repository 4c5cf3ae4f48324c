"""Large JSON files are cut at braces; records come back as a JSON parser reads them."""

import json
import random

import pytest

from fernlake.sources import json_records, tables

TEXTS = ["", "plain", 'a "quoted" } { [ ] one', "back\\slash\\", 'ends in \\"', "line\nbreak\r\n\ttab", "é € \U0001f600 \ufeff", "}}}}{{{{", "\\\\}", '","_id":"7"}, {"', "x" * 3000]


def _records(n: int) -> list[dict]:
    rng = random.Random(5)
    return [{"_id": f"r{rng.randrange(n)}", "name": rng.choice(TEXTS), "inputs": json.dumps({"messages": [rng.choice(TEXTS), {"deep": [[{}], []]}]}), "tags": rng.choices(TEXTS, k=rng.randrange(3)), "prompt_tokens": k} for k in range(n)]


def _got(df):
    return {r["_id"]: (r["name"], r["inputs"], r["tags"], r["prompt_tokens"]) for r in df.collect()}


def _last(rows):
    return {r["_id"]: (r["name"], r["inputs"], r["tags"], r["prompt_tokens"]) for r in rows}


@pytest.mark.parametrize("layout", ["one line", "indented", "one after another", "lines"])
def test_cut_anywhere(spark, tmp_path, layout):
    rows = _records(400)
    text = {
        "one line": json.dumps(rows), "indented": "\ufeff" + json.dumps(rows, indent=2, ensure_ascii=False) + "\n", "one after another": "\n".join(json.dumps(r, indent=1) for r in rows),
        "lines": "\n\n".join(json.dumps(r) for r in rows),
    }[layout]
    (tmp_path / "runs.json").write_text(text, encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert _got(tables.scan_runs_json(spark, str(tmp_path), multi_line=layout != "lines")) == _last(rows)
        if layout != "lines":
            whole = json_records.json_records(spark, str(tmp_path)).orderBy("place").collect()
            assert [json.loads(r.text) for r in whole] == rows and [r.place for r in whole] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_last_in_the_file_wins(spark, tmp_path):
    """Whatever the export times say; of two files the last by path."""
    (tmp_path / "a.json").write_text('[{"_id": "1", "name": "x", "exported_at": "9"}, {"_id": "1", "name": "y", "exported_at": "2"}, {"_id": "2", "name": "z"}]')
    (tmp_path / "b.json").write_text('[{"_id": "2", "name": "w"}]')
    assert {r["_id"]: r["name"] for r in tables.scan_runs_json(spark, str(tmp_path)).collect()} == {"1": "y", "2": "w"}


def test_empty_and_broken(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "cut.json").write_text('[{"_id": "1", "name": "kept"}, {"_id": "2", "prompt_tokens": 12')
    (tmp_path / "cut2.json").write_text('[{"_id": "3"}, {"_id": "4", "name": "in a text }')
    (tmp_path / "odd.json").write_text('[{"_id": "5"}, {"_id" "6"}, {"_id": "7", "prompt_tokens": "many"}, 3]')
    got = {r["_id"]: (r["name"], r["prompt_tokens"]) for r in tables.scan_runs_json(spark, str(tmp_path)).collect()}
    assert got == {"1": ("kept", None), "3": (None, None), "5": (None, None), "7": (None, None)}
    broken = {(r.file.rsplit("/", 1)[1], r.place, r.text) for r in tables.broken_runs(spark, str(tmp_path)).collect()}
    assert broken == {("cut.json", 1, None), ("cut2.json", 1, None), ("odd.json", 1, '{"_id" "6"}'), ("odd.json", 3, None)}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text('{"_id": "1"}\n{"_id": \n\n{"_id": "2"}\n')
    assert {r["_id"] for r in tables.scan_runs_json(spark, str(lines), multi_line=False).collect()} == {"1", "2"}
    assert [r.text for r in tables.broken_runs(spark, str(lines), multi_line=False).collect()] == ['{"_id": ']
