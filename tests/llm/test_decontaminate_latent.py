"""The latent space of op10 is that of all documents, not of some."""

import random

import numpy as np
import pyarrow as pa

from fernlake.llm import decontaminate
from fernlake.llm import textkernel as tk


def _corpus():
    """64 strong words, each on its own, and 40 weak ones that go along with them by chance."""
    rng = random.Random(3)
    strong, weak = [f"s{k}" for k in range(64)], [f"w{k}" for k in range(40)]
    docs = []
    for _ in range(6000):
        s = rng.choice(strong)
        docs.append(" ".join([s] * 30 + [rng.choice(weak) for _ in range(12)] + ["other"] * rng.randint(0, 40)))
    items = [" ".join(rng.sample(strong, 8) + rng.sample(weak, 5)) for _ in range(40)]
    return docs, items, strong + weak


def test_latent_space_is_fitted_on_all_documents(spark):
    docs, items, words = _corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(7)
    (index,) = (x.value for x in decontaminate._parts(rows, bench, max_rank=64))

    # the Gram matrix of all passages, word by word
    at = {w: int(np.searchsorted(index.vocab, tk.words(_column(w)).hash[0])) for w in words}
    size = len(index.vocab)
    exact = np.zeros((size, size))
    for text, weight in [(x, 1.0) for x in docs] + [(x, len(docs) / len(items)) for x in items]:
        w = text.split()
        for k in range(0, len(w), 64):
            tf = np.zeros(size + 1)
            for x in w[k : k + 64]:
                tf[at.get(x, size)] += 1
            v = tf[:-1] * index.idf[:-1]
            norm = (v * v).sum() + (tf[-1] * index.idf[-1] ** 2 if weight == 1.0 else 0)
            if norm:
                exact += weight * np.outer(v, v) / norm
    values, vectors = np.linalg.eigh(exact)
    rank = index.basis.shape[1]
    assert rank == 64 and size == 104
    held = np.trace(index.basis.T.astype(float) @ exact @ index.basis)
    assert held >= 0.9999 * values[-rank:].sum()


def _column(word):
    return pa.array([word])
