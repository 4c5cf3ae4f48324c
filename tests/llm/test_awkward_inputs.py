"""Very long and damaged inputs of the secret scan and the archive reader."""

import gzip
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import embedding_dedup, langid, mixing, quality, secrets, warc


def test_scan_is_linear_in_repeated_heads():
    auto = secrets.automaton()
    for text in ("eyJ" * 350_000, "eyJa." * 200_000, "eyJa.eyJ" * 125_000, "-----BEGIN " + "A " * 400_000, "token" * 200_000, "eyj" * 350_000):
        began = time.time()
        secrets.scan(text, auto)
        assert time.time() - began < 4


def test_tokens_behind_failed_heads_are_found():
    auto = secrets.automaton()
    good = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    for text in ("eyJx " + good, "eyJx.y " + good, "eyjabc" + "-" + good, "eyJeyJ.a," + good, "eyJ." + good):
        found = [(text[s:e], secrets.KINDS[k]) for s, k, e in secrets.scan(text, auto)]
        assert (good, "jwt") in found, text


def record(k, version=b"WARC/1.0", body=None):
    body = body if body is not None else b"body %d " % k * 40
    return version + b"\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"


def read(spark, path, columns="record_id string, payload binary"):
    return warc.read_warc(spark, f"file://{path}", columns)


def test_versions_before_one(spark, tmp_path):
    (tmp_path / "old.warc").write_bytes(record(1, b"WARC/0.18") + record(2) + record(3, b"WARC/1.1"))
    assert {r.record_id for r in read(spark, tmp_path).collect()} == {f"<urn:x:{k}>" for k in (1, 2, 3)}


def test_damaged_members_cost_their_own_record(spark, tmp_path):
    for name, bad in (("first", 0), ("middle", 3), ("last", 6)):
        members = [gzip.compress(record(k, body=bytes(range(256)) * 20 + b"%d" % k), mtime=0) for k in range(7)]
        hurt = bytearray(members[bad])
        hurt[40 : len(hurt) - 30] = b"\xff" * (len(hurt) - 70)
        members[bad] = bytes(hurt)
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(members))
        got = read(spark, tmp_path / f"{name}.warc.gz")
        assert {r.record_id for r in got.collect()} == {f"<urn:x:{k}>" for k in range(7) if k != bad}
        assert all(bytes(r.payload).startswith(bytes(range(256))) for r in got.collect())
        report = read(spark, tmp_path / f"{name}.warc.gz", "record_id string, damage string")
        at = sum(map(len, members[:bad]))
        assert [r.damage.rsplit("@", 1)[1] for r in report.where("damage is not null").collect()] == [str(at)]
        assert report.where(F.col("damage").isNull()).count() == 6


def test_headers_without_end(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"WARC/1.0\r\n" + b"x" * 9_000_000 + b"\r\n" + record(2))
    assert {r.record_id for r in read(spark, tmp_path).collect()} >= {"<urn:x:1>", "<urn:x:2>"}


@pytest.mark.parametrize("dims", [64, 768])
def test_spill_and_recall_do_not_depend_on_length(spark, dims):
    """Copies per level stay below the bound, and planted near pairs are found, over many levels of splits."""
    rng = np.random.default_rng(dims)
    n = 500
    base = rng.normal(size=(n, dims))
    noise = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = 0.952 + 0.04 * rng.random((n, 1))
    near = cos * base + np.sqrt(1 - cos**2) * noise
    axes = embedding_dedup.directions(1, 0, 0, 8, dims)
    scaled = base * dims**0.5
    cuts = embedding_dedup.fit_splits(scaled, axes, 0.16, 2)
    copies, todo = 0, [(1, np.arange(n))]
    while todo:
        node, rows = todo.pop()
        if node not in cuts:
            copies += len(rows)
            continue
        at = scaled[rows] @ axes[node.bit_length() - 1]
        todo += [(2 * node, rows[at <= cuts[node] + 0.16]), (2 * node + 1, rows[at > cuts[node] - 0.16])]
    assert copies / n < 3
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=4)
    found = {r.vec_id for r in got.collect() if r.n_links}
    assert sum(k in found for k in range(n)) >= 0.95 * n


def test_a_rare_class_survives_the_cut(spark):
    """When few pairs may be fitted, both classes are cut alike."""
    rows = [(k, ("good solid prose here " if k % 40 else "bad junk spam zzz ") + f"w{k} x{k % 7} " * 6, 1 if k % 40 else 0) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df, "label", max_rows=150, max_pairs=6000)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    wrong = [k for k, _, y in rows if (got[k] >= 0.5) != (y == 1)]
    assert len(wrong) < 0.02 * len(rows)


def test_weights_count_by_ratio_and_null_ids_are_spread(spark):
    rows = [(None, f"t{k}", "en", "ab"[k % 2], 1) for k in range(400)] + [(k, "x", "en", "a", 1) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = mixing.mix(df, {"a": 3, "b": 2}, block_docs=4)
    large = mixing.mix(df, {"a": 30_000, "b": 20_000}, block_docs=4)
    key = lambda d: sorted(map(str, d.select("doc_id", "text", "mix_source", "slot", "position").collect()))
    assert key(one) == key(large) and one.select("position").distinct().count() == 450


def test_long_texts_follow_the_likelihood(spark):
    """The prior does not outvote a long text: the best language is that of the full sums."""
    docs = [(k, "la casa es grande y bonita " * 3, "es") for k in range(300)] + [(1000 + k, "a casa e grande e bonita nao " * 3, "pt") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.learn(df)
    model.prior = np.log(np.where(np.array(model.languages) == "es", 1.0 - 1e-4, 1e-4))
    tests = spark.createDataFrame([(1, "a casa e grande e bonita nao " * 40), (2, "la casa es grande y bonita " * 40)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(tests, model).collect()} == {1: "pt", 2: "es"}


def test_period_of_many_slots(spark):
    """A period well beyond a stretch of the fold, against earliest deadline first slot by slot."""
    a = {"a": 17_001, "b": 12_011, "c": 1_303, "d": 1, "e": 8}
    total = sum(a.values())
    got = {r.source: list(r.slots) for r in mixing.schedule_table(spark, [mixing.Phase(0, 1, a, dict.fromkeys(a, 0))]).collect()}
    done, want = dict.fromkeys(a, 0), {x: [] for x in a}
    for t in range(total):
        _, x = min((-(-(done[x] + 1) * total // a[x]), x) for x in a if done[x] * total // a[x] <= t)
        want[x].append(t)
        done[x] += 1
    assert got == want
