"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed byte-exact character n-grams (1 to 3 characters, letters lower-cased by the
case map of the Basic Latin, Latin-1, Latin Extended-A, Greek and Cyrillic blocks, other
characters as one separator) are learned by language.  Tasks count sparsely, a language's
log-probabilities are made in a task of its own, and the driver sees the matrix alone.  The
matrix, languages by buckets, is broadcast; ``max_bytes`` bounds its size: for very many languages
there are fewer buckets.  Positions of a batch are scored in blocks: their hashes index the
matrix, and sums per text give the log-likelihoods.
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

UNKNOWN = "und"
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _case_table() -> np.ndarray:
    """Code point -> class: lower-cased letter, or 0 for anything that is no letter."""
    table = np.zeros(0x10000, np.uint32)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE = _case_table()


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts of a batch, two separators before each text, and offsets."""
    texts = batch.column(1).to_pylist()
    joined = "".join("\x00\x00" + (t or "") for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    low = _TABLE[np.minimum(cp, 0xFFFF)]
    astral = cp > 0xFFFF
    if astral.any():
        where = np.flatnonzero(astral)
        low[where] = [int(c) if chr(int(c)).isalpha() else 0 for c in cp[where]]
    return low, at


def _grams(low: np.ndarray, buckets: int, order: int) -> np.ndarray:
    """Bucket of the n-gram of `order` that ends at each position; separators run together."""
    h = low * _MUL[0]
    for k in range(1, order):
        prev = np.zeros_like(low)
        prev[k:] = low[:-k]
        h = (h ^ (h >> np.uint32(15))) * _MUL[1] + prev * _MUL[2]
    h = h + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
    h = (h ^ (h >> np.uint32(16))) * _MUL[1]
    return (h >> np.uint32(7)) & np.uint32(buckets - 1)


@dataclass
class LanguageModel:
    """log_prob[bucket, language] and the learned languages; none if nothing was learned."""

    languages: list[str]
    log_prob: np.ndarray
    prior: np.ndarray
    buckets: int
    orders: tuple[int, ...]


def _count(buckets: int, orders: tuple[int, ...]):
    """(lang, bucket, n) of each slice of a batch; sums are left to the grouping."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                low, at = _codes(part)
                code = part.column(2).dictionary_encode()
                live = np.flatnonzero(low)
                lang = np.repeat(code.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(live, at))).astype(np.int64) * buckets
                key, n = np.unique(np.concatenate([lang + _grams(low, buckets, o)[live] for o in orders]), return_counts=True)
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(key // buckets)), pa.array((key % buckets).astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    return run


def _log_prob(buckets: int, smooth: float):
    """A language's log-probabilities from its counts, at most one row per bucket."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(buckets, smooth)
        counts[pdf["bucket"].to_numpy()] += pdf["n"].to_numpy()
        return pd.DataFrame({"lang": [key[0]], "row": [(np.log(counts) - np.log(counts.sum())).astype(np.float32).tobytes()]})

    return run


def learn(
    docs: DataFrame,
    train: Column | None = None,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    max_rows: int = 20_000,
    buckets: int = 1 << 15,
    orders: tuple[int, ...] = (1, 2, 3),
    max_bytes: int = 64 << 20,
    smooth: float = 0.1,
) -> LanguageModel:
    """Learn from rows where `train` holds and the language is not null.

    At most about ``max_rows`` rows, taken by a hash of the id (of the text where it is null), are used (a documented bound for
    fitting), as many of each language as there are, so that rare languages keep theirs; the
    whole text of each counts.  Priors come from all rows.  Null or empty texts teach nothing but
    their prior.  ``buckets`` is halved while the matrix would take over ``max_bytes``.
    """
    tk.bound_batches(docs.sparkSession)
    rows = docs.where(train if train is not None else F.lit(True)).where(F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    most = max_bytes // (4 << 8)
    there = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
    if len(there) > most:
        raise ValueError(f"more than {most} languages; raise max_bytes")
    languages = sorted(there)
    while len(languages) * buckets * 4 > max_bytes:
        buckets //= 2
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), buckets, orders)
    # languages below an even share leave their rest to the others
    left, share = max_rows, 0.0
    for k, n in enumerate(sorted(there.values())):
        share = left / (len(there) - k)
        if n > share:
            break
        left -= n
    sizes = docs.sparkSession.createDataFrame([(x, share / n) for x, n in there.items() if n > share], "lang string, limit double")
    draw = F.shiftrightunsigned(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), 1) / float(1 << 63)
    rows = rows.join(F.broadcast(sizes), "lang", "left").where(F.col("limit").isNull() | (draw < F.col("limit"))).select("id", "text", "lang")
    counts = rows.mapInArrow(_count(buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = np.full((buckets, len(languages)), -np.log(buckets), np.float32)
    place = {x: k for k, x in enumerate(languages)}
    for x in counts.groupBy("lang").applyInPandas(_log_prob(buckets, smooth), "lang string, row binary").collect():  # max_bytes in all
        matrix[:, place[x["lang"]]] = np.frombuffer(x["row"], np.float32)
    prior = np.array([there[x] + 1.0 for x in languages])
    return LanguageModel(languages, matrix, np.log(prior) - np.log(prior.sum()), buckets, orders)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model: LanguageModel = shared.value
        width = len(model.languages)
        step = (1 << 23) // max(1, width)
        for batch in batches:
            names, scores = [], []
            for part in tk.slices(batch, "text"):
                low, at = _codes(part)
                live = np.flatnonzero(low)
                edge = np.searchsorted(live, at)
                total = np.zeros((part.num_rows, width))
                owner = np.repeat(np.arange(part.num_rows), np.diff(edge))
                grams = [_grams(low, model.buckets, order) for order in model.orders]
                for k in range(0, len(live) if width else 0, step):
                    sums = sum(model.log_prob[g[live[k : k + step]]] for g in grams)
                    own = owner[k : k + step]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    total[own[first]] += np.add.reduceat(sums, first, axis=0, dtype=np.float64)
                letters = edge[1:] - edge[:-1]
                for i in range(part.num_rows):
                    if not letters[i] or not width:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(total[i] + model.prior))
                    names.append(model.languages[best])
                    # for the score alone, the mean per letter over about one word keeps the posterior from saturating
                    z = total[i] / letters[i] * min(letters[i], 12) + model.prior
                    scores.append(float(np.exp(z[best] - z.max()) / np.exp(z - z.max()).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
    was learned.  Ties go to the first language by name.  Repeated rows are scored alike.
    """
    tk.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
