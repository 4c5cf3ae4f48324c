"""Recall of op10 against the rule of common subsequences alone, by corpus size, item length and number of items."""

import random

import numpy as np
import pytest

from fernlake.llm import decontaminate


def lcs_share(item, text):
    a, b = item.split(), text.split()
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = row.copy()
        for k, y in enumerate(b):
            new[k + 1] = row[k] + 1 if x == y else max(new[k], row[k + 1])
        row = new
    return row[-1] / len(a)


@pytest.mark.parametrize("size", [150, 4000])
def test_recall_by_length(spark, size):
    """Items of words that are common in the corpus, between words that no item has."""
    rng = random.Random(size)
    common, others = [f"c{k}" for k in range(150)], [f"o{k}" for k in range(3000)]
    text = lambda n, share: [rng.choice(common if rng.random() < share else others) for _ in range(n)]
    items = [(k, " ".join(rng.sample(common, (16, 20, 30, 45)[k % 4]))) for k in range(16)]
    rows, want = [(k, text(rng.randint(40, 250), 0.3)) for k in range(size)], set()
    for k in range(96):
        item, inner = items[k % 16][0], items[k % 16][1].split()
        if k >= 48:  # a paraphrase: every fourth word replaced, some words put in between
            inner = [rng.choice(others) if p % 4 == 1 else x for p, x in enumerate(inner)]
            for _ in range(len(inner) // 8):
                inner.insert(rng.randrange(len(inner)), rng.choice(others))
        at = rng.randint(0, len(rows[k][1]))
        rows[k] = (k, rows[k][1][:at] + inner + rows[k][1][at:])
        want.add((k, item))
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= want
    for k, item in got - want:
        assert lcs_share(items[item][1], " ".join(rows[k][1])) >= 0.5


def test_chance_words_are_no_match(spark):
    """A stretch that has an item's very common words in order, and no other of its words, does not hold it."""
    item = "what is the name of the river that is in the north of the land"
    stop = "is the of the that is in the of the"
    rows = [(k, f"{stop} a{k} b{k}") for k in range(200)] + [(1000, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1000, 1)] and got[0].cosine > 0.99
