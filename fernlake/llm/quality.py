"""Quality classifier: averaged subword embeddings with a softmax output, trained by SGD.

Features of a text are its words, pairs of neighbouring words and the character n-grams inside
each word (with word ends marked), hashed to a fixed number of buckets.  Each bucket has a learned vector; a text is the
average of its features' vectors, and a softmax layer over two classes gives the probability.
Words keep their case, since shouting is a sign of quality.

Training covers every labelled row.  Executors turn the whole texts into bucket counts, which are
written once, dealt at random into parts.  In each epoch numpy runs stochastic gradient descent
over each part in a task of its own, from the same model, and the parts' models are averaged by
how often each part holds a bucket; so the driver sees the model alone.  Scoring needs one number
per bucket, because the output layer is linear in the average: the difference of the two class
logits of each bucket is broadcast (8 bytes x buckets, a fixed size).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch

#: Labelled rows of a part, about, and buckets of a block of a model that is summed at once
PART_ROWS = 8192
BLOCK = 512

_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def features(part: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of all texts, and offsets by text.

    Per text: one feature for each byte-trigram window that touches a word (word ends count as a
    byte), one per word, and one per pair of neighbouring words.  A pair is hashed by the
    difference of its words' hashes, so that repeated words of any kind share one bucket.
    """
    raw, off = tk.bytes_of(part.column(1))
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = (raw == 32) | ((raw - np.uint8(9)) < 5)
    x = np.where(gap, np.uint32(0), raw.astype(np.uint32) + np.uint32(1))
    first = np.zeros(n, bool)
    inner = off[:-1]
    first[inner[inner < n]] = True
    before = np.zeros_like(x)
    before[1:] = x[:-1]
    before[first] = 0
    after = np.zeros_like(x)
    after[:-1] = x[1:]
    after[:-1][first[1:]] = 0
    tri = (before * _M1 + x) * _M2 + after
    tri = (tri ^ (tri >> np.uint32(15))) * _M3
    tri = ((tri ^ (tri >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int32)
    live = np.flatnonzero(x)
    begin = live[before[live] == 0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.mix(before.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64) << np.uint64(16) | after.astype(np.uint64)), out=sums[1:])
    finish = live[after[live] == 0] + 1
    word = tk.mix(sums[finish] - sums[begin] + (finish - begin).astype(np.uint64))
    at_tri, at_word = np.searchsorted(live, off), np.searchsorted(begin, off)
    # pairs of neighbours within a text; the difference is 0 for every repeated word
    later = np.ones(len(word), bool)
    later[at_word[:-1][at_word[:-1] < len(word)]] = False
    later = np.flatnonzero(later)
    pair = tk.mix(word[later] - word[later - 1] + np.uint64(1))
    kinds = [(tri[live], at_tri)]
    kinds += [((x & np.uint64(buckets - 1)).astype(np.int32), at) for x, at in ((word, at_word), (pair, np.searchsorted(later, at_word)))]
    at = sum(k[1] for k in kinds)
    out = np.empty(at[-1], np.int32)
    before_kind = np.zeros(len(at) - 1, np.int64)
    for values, edge in kinds:
        size = np.diff(edge)
        out[np.arange(len(values)) + np.repeat(at[:-1] + before_kind - edge[:-1], size)] = values
        before_kind += size
    return out, at


@dataclass
class QualityModel:
    """delta[bucket]: logit of class 1 less that of class 0; bias likewise."""

    delta: np.ndarray
    bias: float
    buckets: int


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                f, at = features(part, buckets)
                found, times = [], []
                for i in range(part.num_rows):
                    b, n = np.unique(f[at[i] : at[i + 1]], return_counts=True)
                    found.append(b)
                    times.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["label", "bucket", "n"])

    return run


def _rows(batches: Iterator[pa.RecordBatch], max_pairs: int | None) -> Iterator[tuple]:
    """(label, size, bucket, weight) of the rows of each batch, while their pairs fit; a row's weights sum to 1."""
    held = 0
    for batch in batches:
        size = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
        rows = len(size) if max_pairs is None else int(np.searchsorted(np.cumsum(size), max_pairs - held, side="right"))
        part = batch.slice(0, rows)
        size = size[:rows]
        held += int(size.sum())
        n = np.asarray(part.column(2).flatten()).astype(np.float64)
        owner = np.repeat(np.arange(rows), size)
        yield np.asarray(part.column(0)).astype(np.float64), size, np.asarray(part.column(1).flatten()), n / np.bincount(owner, n, minlength=rows)[owner]
        if rows < batch.num_rows:
            return


def _heard(max_pairs: int | None, buckets: int):
    """Rows that hold each bucket; those of class 0 and 1 follow as two more."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets + 2, np.int64)
        for label, _, bucket, _ in _rows(batches, max_pairs):
            total[:buckets] += np.bincount(bucket, minlength=buckets)
            total[buckets:] += np.bincount(label.astype(np.int64), minlength=2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return run


@dataclass
class Network:
    vectors: np.ndarray  # buckets x dim
    out: np.ndarray  # dim x 2
    bias: np.ndarray


def _epoch(shared, max_pairs: int | None):
    """One epoch of a part: its rows and buckets times its model, in blocks; block -1 is the output layer."""

    def run(batches: Iterator[pa.RecordBatch]):
        net, gain, balance, epoch, epochs, part_rows, rate, seed = shared.value
        net = Network(net.vectors.copy(), net.out.copy(), net.bias.copy())
        buckets, done = len(gain), 0
        heard = np.zeros(buckets)
        for label, size, bucket, weight in _rows(batches, max_pairs):
            heard += np.bincount(bucket, minlength=buckets)
            at = np.append(0, np.cumsum(size))
            train_sgd(net, bucket, weight, at, label, gain, balance, lambda k, before=done: rate * (1 - (epoch + min(1.0, (before + k) / part_rows)) / epochs), [seed, epoch, done])
            done += len(label)
        if done:
            last = np.append(np.append(net.out.ravel(), net.bias) * done, done)
            blocks, parts = [-1], [last.astype(np.float32).tobytes()]
            sums = np.column_stack([net.vectors * heard[:, None], heard]).astype(np.float32)
            for k in range(0, buckets, BLOCK):
                blocks.append(k // BLOCK)
                parts.append(sums[k : k + BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["part"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.tobytes()]})


def fit(
    rows: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    train: Column | None = None,
    labels: DataFrame | None = None,
    max_rows: int | None = None,
    max_pairs: int | None = None,
    buckets: int = 1 << 15,
    dim: int = 8,
    epochs: int = 12,
    rate: float = 4.0,
    seed: int = 7,
) -> QualityModel:
    """Fit on all rows whose label is 0 or 1.

    With a table ``labels`` the label is its column, joined to the rows by the id; ``train`` then
    reads the rows alone.  Rows with a null label teach nothing.

    A caller may bound what is fitted: by ``max_rows``, about half of it from each class, taken by
    a hash of the id (of the text, if the id is null; repeated rows are drawn together), and by
    ``max_pairs``, as many of these as have so many (text, bucket) pairs in all, in one task.

    Without rows of both classes the model gives every text the share of class 1 among the labelled
    rows (0.5 without any).
    """
    spark = rows.sparkSession
    tk.bound_batches(spark)
    rows = rows.where(train if train is not None else F.lit(True))
    known = F.col(label_col).isin(0, 1)
    labels = None if labels is None else labels.select(id_col, label_col).where(known)
    labelled = rows.where(known) if labels is None else rows.join(labels, id_col)
    there = {int(x[label_col]): x["count"] for x in labelled.groupBy(label_col).count().collect()}
    n1, n = there.get(1, 0), sum(there.values())
    share = np.clip(n1 / n, 1e-6, 1 - 1e-6) if n else 0.5
    flat = QualityModel(np.zeros(buckets), float(np.log(share / (1 - share))), buckets)
    if not n1 or n1 == n:
        return flat
    # both sides of the join are dealt into the parts of the training, so that no text is shuffled twice
    parts = max(1, round(n / PART_ROWS)) if max_rows is None and max_pairs is None else 1
    if labels is not None:
        labelled = rows.repartition(parts, id_col).join(labels.repartition(parts, id_col), id_col)
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    hashed = F.when(key.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(key, F.lit(seed)))
    drawn = labelled.select(F.col(label_col).cast("int").alias("label"), text.alias("text"), key.alias("id"), (F.shiftrightunsigned(hashed, 1) / float(1 << 63)).alias("draw"))
    if max_rows is not None:
        # the share of a class that is drawn is never rounded to none
        limit = F.when(F.col("label") == 1, max_rows / 2 / there[1]).otherwise(max_rows / 2 / there[0])
        # in units of its class's limit, so that a cut at max_pairs takes both classes alike
        drawn = drawn.where(F.col("draw") < limit).withColumn("draw", F.col("draw") / limit)
    if labels is None or parts == 1:
        drawn = drawn.repartition(parts, "draw") if parts > 1 else drawn.repartition(1)
    with Scratch(spark) as scratch:
        counts = drawn.sortWithinPartitions("draw", "id", "label").select("label", "text").mapInArrow(_counts(buckets), "label int, bucket array<int>, n array<int>")
        counts = scratch.keep(counts, "counts").coalesce(parts)
        total = np.zeros(buckets + 2)
        for x in counts.mapInArrow(_heard(max_pairs, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            total[x["bucket"]] = x["n"]
        heard, classes = total[:buckets], total[buckets:]
        if not classes.all():
            return flat
        rng = np.random.default_rng(seed)
        net = Network(rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)), rng.normal(0, 0.1, (dim, 2)), np.zeros(2))
        # frequent buckets dominate an average; steps on a bucket are scaled by its rarity
        gain = 1.0 / np.sqrt(1.0 + heard / max(1.0, heard.mean()))
        schema = "block int, part binary"
        for epoch in range(epochs):
            shared = spark.sparkContext.broadcast((net, gain, 0.5 * classes.sum() / classes, epoch, epochs, classes.sum() / parts, rate, seed))
            sums = counts.mapInArrow(_epoch(shared, max_pairs), schema).groupBy("block").applyInPandas(_average, schema).collect()
            for x in sums:  # one model in all
                part = np.frombuffer(x["part"])
                if x["block"] < 0:
                    net.out, net.bias = part[: 2 * dim].reshape(dim, 2) / part[-1], part[2 * dim : -1] / part[-1]
                    continue
                part = part.reshape(-1, dim + 1)
                some = np.flatnonzero(part[:, -1])
                net.vectors[x["block"] * BLOCK + some] = part[some, :-1] / part[some, -1:]
            shared.destroy()
    return QualityModel(net.vectors @ (net.out[:, 1] - net.out[:, 0]), float(net.bias[1] - net.bias[0]), buckets)


def train_sgd(net: Network, bucket, weight, at, label, gain, balance, rate, seed, batch: int = 16) -> None:
    """Mini-batch SGD over averaged embeddings and a two-class softmax, in place; classes weigh the same.

    `rate` gives the rate of a step by the number of rows before it.
    """
    vectors, out, bias = net.vectors, net.out, net.bias
    buckets, dim = vectors.shape
    onehot = np.stack([1 - label, label], axis=1)
    order = np.random.default_rng(seed).permutation(len(label))
    for k in range(0, len(label), batch):
        rows = order[k : k + batch]
        lens = at[rows + 1] - at[rows]
        pos = np.repeat(at[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        b, w = bucket[pos], weight[pos][:, None]
        owner = np.repeat(np.arange(len(rows)), lens)
        mean = np.zeros((len(rows), dim))
        np.add.at(mean, owner, vectors[b] * w) if len(b) < 64 else _sum_rows(mean, owner, vectors[b] * w, lens)
        z = mean @ out + bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        grad = (p - onehot[rows]) * balance[label[rows].astype(np.int64)][:, None] / len(rows)
        lr = rate(k)
        back = grad @ out.T
        out -= lr * (mean.T @ grad)
        bias -= lr * 0.1 * grad.sum(axis=0)
        delta = back[owner] * w * (lr * 64)
        for d in range(dim):
            vectors[:, d] -= np.bincount(b, delta[:, d], minlength=buckets) * gain


def _sum_rows(mean: np.ndarray, owner: np.ndarray, values: np.ndarray, lens: np.ndarray) -> None:
    some = lens > 0
    begin = (np.cumsum(lens) - lens)[some]
    mean[some] = np.add.reduceat(values, begin, axis=0)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model: QualityModel = shared.value
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            row = 0
            for part in tk.slices(batch, "text"):
                f, at = features(part, model.buckets)
                n = at[1:] - at[:-1]
                some = n > 0
                if some.any():
                    mean = np.add.reduceat(model.delta[f], at[:-1][some]) / n[some]
                    z[row : row + part.num_rows][some] += mean
                row += part.num_rows
            score = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, from the whole text alone; a null or empty text scores by the bias.

    Repeated rows are scored alike; null ids come back as null; other columns are not read.
    """
    tk.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with their own columns, whose text scores at least ``least``; one pass, no shuffle."""
    tk.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    scorer = _score(shared)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["id", "text"])
            keep = np.concatenate([b.column(1).to_numpy() for b in scorer(iter([rows]))]) >= least
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
