"""The quality classifier learns from every labelled row."""

import random

from pyspark.sql import functions as F

from fernlake.llm import quality


def test_every_labelled_row_teaches(spark):
    """Each of 6,000 rows has words of its own and a label by chance, so that a model knows the rows it has seen and no others."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = [(k, f"{word()} {word()}", rng.randrange(2)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = quality.fit(df, "label", buckets=1 << 17)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    share = sum((got[k] >= 0.5) == (y == 1) for k, _, y in rows) / len(rows)
    assert share >= 0.9, share


def test_many_parts_learn_one_model(spark, monkeypatch):
    """Parts of few rows, some of one class alone, are averaged to a model as good as that of one part."""
    monkeypatch.setattr(quality, "PART_ROWS", 200)
    rng = random.Random(5)
    good, bad = [f"g{k}" for k in range(300)], [f"b{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(bad if k % 100 == 0 else good) for _ in range(12)), int(k % 100 > 0)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = quality.fit(df, "label", train=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert sum((got[k] >= 0.5) == (y == 1) for k, _, y in rows) >= 0.99 * len(rows)
    assert sum(got[k] < 0.5 for k, _, y in rows if not y) >= 0.9 * 40
