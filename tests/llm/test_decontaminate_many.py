"""Thousands of items: more than the latent space's rank can keep."""

import random

from fernlake.llm import decontaminate


def test_several_thousand_items(spark):
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(5000)]
    text = lambda n: [vocab[int(len(vocab) * rng.random() ** 2)] for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(16, 48)))) for k in range(4000)]
    rows, want = [], set()
    for k in range(600):
        w = text(rng.randint(60, 300))
        if k % 3:
            item = rng.choice(items)
            inner = item[1].split()
            if k % 3 == 2:  # a paraphrase
                inner = [rng.choice(vocab) if p % 4 == 1 else x for p, x in enumerate(inner)]
            at = rng.randint(0, len(w))
            w[at:at] = inner
            want.add((k, item[0]))
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got
    assert len(got - want) <= len(want) // 100
