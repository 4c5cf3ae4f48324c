"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is that of the benchmark; document frequencies of its words are counted over
   all documents.  A benchmark of more than ``max_items`` items or ``max_vocab`` words is
   searched in parts, one pass over the documents each.
2. TF-IDF passages of the benchmark and of all documents are factored by a distributed
   randomised SVD.  One pass over the documents sums the products of the words' weights in their
   passages (the Gram matrix, a sparse table of one row per vocabulary word); each power step
   reads that table, and only vocabulary-by-rank products travel.  The rank grows until the latent space keeps ``energy`` of the benchmark's own passages.
3. Every window of every document (two neighbouring blocks of words) is projected and compared
   with all benchmark passages by cosine.  A window whose weight on the vocabulary promises less
   than ``margin`` of the threshold is passed over (a margin of 0 tries all).
4. Candidates are confirmed by the longest common subsequence of words, and by the passage's
   answer: a paraphrase keeps the answer's words close together.
5. What the latent space keeps badly, or a window's other words dilute, is found exactly: text
   that meets the rule of step 4 holds half of a passage's words, so also some of its rarest
   ones.  Every stretch that does is held against the rule in windows of twice the passage's
   length.  Here only the passage's own words weigh, each by its frequency, so a verbatim
   copy has cosine 1 whatever the corpus.

The document side is maps over the rows: nothing is shuffled but word frequencies, word pairs that
a task has summed, and the hits, so hot sources, long texts and shared passages cost what their
words cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernlake.llm import textkernel as tk
from fernlake.plans.scratch import Scratch

BLOCK = 32
#: Rare words of a passage that a stretch must hold to be tried; any number finds the same.
SEEDS = 5
#: (stretch, passage) counts and seed entries held at once; a quarter of it for passage entries, word pairs and cells of the Gram matrix
CELLS = 1 << 22


@dataclass
class Seeds:
    """The rarest words of each passage, by word.

    A match of `need` of a passage's n words leaves out n - need; so of any n - need + k of them
    at least k are in the text.
    """

    at: np.ndarray  # at[c]:at[c + 1] are the entries of vocabulary word c; other words have none
    passage: np.ndarray
    count: np.ndarray
    least: np.ndarray  # k of each passage


def _seeds(cols: list, df: np.ndarray, share: float) -> Seeds:
    """Seeds of passages given as vocabulary indexes, for matches of at least `share` of the words."""
    word, passage, count, least = [], [], [], np.zeros(len(cols), np.int64)
    for j, c in enumerate(cols):
        need = min(len(c), max(1, int(np.ceil(share * len(c) - 1e-9))))
        least[j] = min(need, SEEDS)
        rare = c[np.argsort(df[c], kind="stable")][: len(c) - need + least[j]]
        c, n = np.unique(rare, return_counts=True)
        word.append(c)
        passage.append(np.full(len(c), j))
        count.append(n)
    word, passage, count = (np.concatenate(x) for x in (word, passage, count))
    order = np.argsort(word, kind="stable")
    return Seeds(np.searchsorted(word[order], np.arange(len(df) + 1)), passage[order], count[order], least)


@dataclass
class Index:
    """What tasks need: all sizes are bounded by the benchmark's vocabulary, rank and passages."""

    vocab: np.ndarray  # sorted word hashes
    idf: np.ndarray  # by vocabulary word; the last is that of any other word
    basis: np.ndarray  # vocabulary x rank
    passages: np.ndarray  # rank x passages, unit length before projection
    item: list  # item id of each passage
    columns: list  # vocabulary indexes of each passage's words
    answers: list  # and of its answer's words
    cosine: float
    lcs: float
    paraphrase: float
    table: np.ndarray  # _slots(vocab)
    reach: np.ndarray  # by vocabulary word, idf times its largest part in a passage; 0 for others
    margin: float
    seeds: Seeds
    weight: np.ndarray  # by vocabulary word, from its frequency alone


def _slots(vocab: np.ndarray) -> np.ndarray:
    """First vocabulary index at or after each value of a hash's top 16 bits."""
    return np.searchsorted(vocab, np.arange(1 << 16, dtype=np.uint64) << tk.U(48)).astype(np.int32)


def _columns(h: np.ndarray, vocab: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Vocabulary index of each word hash, len(vocab) for other words."""
    size = len(vocab)
    if not size:
        return np.zeros(len(h), np.int32)
    at = table[(h >> tk.U(48)).astype(np.int64)].copy()
    out = np.full(len(h), size, np.int32)
    todo = np.flatnonzero(at < size)
    todo = todo[vocab[at[todo]] <= h[todo]]
    while len(todo):
        same = vocab[at[todo]] == h[todo]
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
        todo = todo[at[todo] < size]
        todo = todo[vocab[at[todo]] <= h[todo]]
    return out


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        vocab, table = shared.value
        df = np.zeros(len(vocab) + 1, np.int64)
        docs = 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column(1))
                col = _columns(w.hash, vocab, table)
                owner = np.repeat(np.arange(part.num_rows), np.diff(w.at))
                inside = col < len(vocab)
                pairs = np.unique(owner[inside].astype(np.int64) * len(vocab) + col[inside])
                df += np.bincount(pairs % max(1, len(vocab)), minlength=len(df))
                docs += part.num_rows
        df[-1] = docs
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["word", "n"])

    return run


def _passages(w: tk.Words, col: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF passages of a batch of texts, unit length: word and weight of all entries by passage, and entries by passage."""
    words = len(idf) - 1
    count = np.diff(w.at)
    passages = -(-count // (2 * BLOCK))
    first = np.repeat(np.cumsum(passages) - passages, count)
    passage = first + (np.arange(len(col)) - np.repeat(w.at[:-1], count)) // (2 * BLOCK)
    key, tf = np.unique(passage * (words + 1) + col, return_counts=True)
    passage, c = key // (words + 1), key % (words + 1)
    other = c == words
    v = tf * idf[c]
    norm = np.sqrt(np.bincount(passage, np.where(other, tf * idf[-1] ** 2, v * v)))
    some = ~other & (norm[passage] > 0)
    passage, c, v = passage[some], c[some], v[some]
    size = np.bincount(passage)
    return c, v / norm[passage], size[size > 0]


def _products(c: np.ndarray, v: np.ndarray, size: np.ndarray, words: int) -> Iterator[pa.RecordBatch]:
    """Sums over passages of the products of two words' weights, by word pair with a <= b.

    Words rise within a passage.  Rows of the matrix are taken in strips of a bounded number of cells.
    """
    end = np.repeat(np.cumsum(size), size)
    order = np.argsort(c, kind="stable")
    strip = max(1, CELLS // 4 // max(1, words))
    edge = np.searchsorted(c[order], np.arange(0, words + strip, strip))
    for k in range(len(edge) - 1):
        e = order[edge[k] : edge[k + 1]]
        if not len(e):
            continue
        low = k * strip
        m = end[e] - e
        upto = np.append(0, np.cumsum(m))
        total = np.zeros(strip * words)
        i = 0
        while i < len(e):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + CELLS // 4, side="right")) - 1)
            one = np.repeat(e[i:j], m[i:j])
            two = one + np.arange(len(one)) - np.repeat(upto[i:j] - upto[i], m[i:j])
            total += np.bincount((c[one] - low) * words + c[two], v[one] * v[two], minlength=len(total))
            i = j
        at = np.flatnonzero(total)
        arrays = [pa.array(low + at // words, pa.int32()), pa.array(at % words, pa.int32()), pa.array(total[at])]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "v"])


def _gram(shared):
    """Word-pair sums of the passages of whole documents; a task holds a bounded number of entries, and a batch."""

    def run(batches: Iterator[pa.RecordBatch]):
        vocab, table, idf = shared.value
        held: list = []

        def flush():
            if held:
                c, v, size = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                yield from _products(c, v, size, len(vocab))

        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column(1))
                held.append(_passages(w, _columns(w.hash, vocab, table), idf))
                if sum(len(x[0]) for x in held) >= CELLS // 4:
                    yield from flush()
        yield from flush()

    return run


def _gram_of_lists(words: int):
    """Word-pair sums of passages given as lists."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            c, v = (np.asarray(batch.column(k).flatten()) for k in (0, 1))
            yield from _products(c.astype(np.int64), v, np.asarray(batch.column(0).value_lengths()), words)

    return run


def _gram_rows(pairs: DataFrame) -> DataFrame:
    """One row per word, of all its products, from word pairs with a <= b of any number of tasks."""
    sums = pairs.groupBy("a", "b").agg(F.sum("v").alias("v"))
    one = F.struct(F.col("a").alias("word"), F.col("b").alias("other"), "v")
    two = F.struct(F.col("b").alias("word"), F.col("a").alias("other"), "v")
    both = sums.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two))))
    rows = both.groupBy("word").agg(F.collect_list(F.struct("other", "v")).alias("x"))
    return rows.select("word", F.col("x.other").alias("col"), F.col("x.v").alias("weight"))


def _times(shared):
    """The product of each row of the Gram matrix and a matrix."""

    def run(batches: Iterator[pa.RecordBatch]):
        x = shared.value
        for batch in batches:
            c, v = (np.asarray(batch.column(k).flatten()) for k in (1, 2))
            at = np.append(0, np.cumsum(np.asarray(batch.column(1).value_lengths())))
            parts = [(v[i:j] @ x[c[i:j]]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["word", "part"])

    return run


def randomised_svd(gram: DataFrame, size: int, rank: int, power: int = 2, extra: int = 8, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors of passages over `size` words, by the rows of their Gram matrix.

    Range finder with power steps on the Gram operator; each step is one pass over its rows, of
    which tasks return one product each.
    """
    spark = gram.sparkSession
    width = min(size, rank + extra)
    q = np.random.default_rng(seed).normal(size=(size, width))
    for _ in range(power):
        q, _ = np.linalg.qr(q)
        shared = spark.sparkContext.broadcast(q)
        new = np.zeros_like(q)
        for x in gram.mapInArrow(_times(shared), "word int, part binary").collect():  # vocabulary by rank in all
            new[x["word"]] = np.frombuffer(x["part"])
        shared.destroy()
        q = new
    u, _, _ = np.linalg.svd(q, full_matrices=False)
    return u[:, :rank]


def _masks(a: list) -> dict:
    """The places of each word of a sequence, as bits."""
    masks: dict = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    return masks


def _lcs(masks: dict, n: int, b: list) -> int:
    """Length of the longest common subsequence of a sequence of n words, given by its masks, and b."""
    full = (1 << n) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def lcs_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, bit-parallel over `a`."""
    return _lcs(_masks(a.tolist()), len(a), b.tolist())


def _hits(ix: Index, col: pa.Array) -> Iterator[tuple]:
    """(row, item, cosine, LCS share, answer found) of each confirmed pair of a column of texts."""
    weight2, base = ix.idf**2, 0
    batch = pa.RecordBatch.from_arrays([col, col], names=["id", "text"])
    for part in tk.slices(batch, "text", 1 << 20):
        w = tk.words(part.column(1))
        for row, *found in _windows(ix, w, _columns(w.hash, ix.vocab, ix.table), len(ix.vocab), weight2):
            yield base + row, *found
        base += part.num_rows


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            found = list(_hits(shared.value, batch.column(1)))
            row, *rest = (pa.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *rest], names=["id", "item_id", "cosine", "lcs", "answer_found"])

    return run


def _clean(shared, id_at: int, text_at: int):
    """The rows without those that have an id and a hit."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in _hits(shared.value, batch.column(text_at))]] = False
            yield batch.filter(pa.array(keep | np.asarray(batch.column(id_at).is_null())))

    return run


def _stretches(seeds: Seeds, w: tk.Words, col: np.ndarray, owner: np.ndarray, start: np.ndarray, first: np.ndarray):
    """(block, passage) of each stretch, from the block before to two after, that holds enough of the passage's seeds."""
    size, most = len(seeds.at) - 1, len(seeds.least)
    entries = np.diff(seeds.at)
    pos = np.flatnonzero(entries[col] > 0)
    block = np.searchsorted(start, pos, side="right") - 1
    ends = np.append(first[1:], len(owner))
    keys = []
    for shift in (-2, -1, 0, 1):
        near = block + shift
        inside = (near >= first[owner[block]]) & (near < ends[owner[block]])
        keys.append(near[inside] * size + col[pos[inside]])
    key = np.sort(np.concatenate(keys))
    key = key[np.diff(key, prepend=-1) > 0]
    near, word = key // size, key % size
    upto = np.append(0, np.cumsum(entries[word]))
    i = 0
    while i < len(key):
        j = int(np.searchsorted(upto, upto[i] + CELLS, side="right")) - 1
        j = min(j, int(np.searchsorted(near, near[i] + max(1, CELLS // most))))
        if j < len(key):  # whole stretches, at least one
            j = int(np.searchsorted(near, near[j]))
        if j <= i:
            j = int(np.searchsorted(near, near[i], side="right"))
        n = entries[word[i:j]]
        at = np.repeat(seeds.at[word[i:j]] - (upto[i:j] - upto[i]), n) + np.arange(n.sum())
        cell = np.repeat(near[i:j] - near[i], n) * most + seeds.passage[at]
        total = np.bincount(cell, seeds.count[at], minlength=1)
        some = np.flatnonzero(total)
        some = some[total[some] >= seeds.least[some % most]]
        yield from zip((some // most + near[i]).tolist(), (some % most).tolist(), strict=True)
        i = j


def _exact(ix: Index, j: int, col: np.ndarray, inside: np.ndarray) -> tuple[float, float, bool] | None:
    """(cosine, LCS share, answer found) of passage j in a stretch of words, if it meets the rule.

    `inside` is a mask over the vocabulary, false throughout; only words of the passage can match,
    so the others are left out first.
    """
    ref, answer = ix.columns[j], ix.answers[j]
    n, least = len(ref), min(ix.lcs, ix.paraphrase) * len(ref)
    inside[ref] = True
    at = np.flatnonzero(inside[col])
    inside[ref] = False
    if len(at) < least:
        return None
    masks = _masks(ref.tolist())
    if _lcs(masks, n, col[at].tolist()) < least:
        return None
    own, tf = np.unique(ref, return_counts=True)
    parts = (tf * ix.weight[own]) ** 2
    has: bool | None = None
    found = None
    for k in range(0, len(col), max(1, n // 2)):
        here = col[at[np.searchsorted(at, k) : np.searchsorted(at, k + 2 * n)]]
        share = _lcs(masks, n, here.tolist()) / n if len(here) >= least else 0.0
        if share >= min(ix.lcs, ix.paraphrase):
            if has is None:
                has = _answered(answer, col)
            cos = float(np.sqrt(parts[np.isin(own, here)].sum() / parts.sum()))
            if cos >= ix.cosine and (share >= ix.lcs or share >= ix.paraphrase and has):
                found = (max(cos, found[0]), max(share, found[1]), has) if found else (cos, share, has)
        if k + 2 * n >= len(col):
            break
    return found


def _answered(answer: np.ndarray, words: np.ndarray) -> bool:
    return bool(len(answer)) and lcs_words(answer, words) == len(answer)


def _windows(ix: Index, w: tk.Words, col: np.ndarray, size: int, weight2: np.ndarray):
    """(text, item, cosine, LCS share, answer found) of each confirmed pair of a batch of texts."""
    count = np.diff(w.at)
    blocks = -(-count // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total or not ix.passages.shape[1]:
        return
    owner = np.repeat(np.arange(len(count)), blocks)
    start = w.at[owner] + (np.arange(total) - first[owner]) * BLOCK
    gain = np.add.reduceat(ix.reach[col], start)
    mass = np.add.reduceat(weight2[col], start)
    last = np.zeros(total, bool)
    last[first[blocks > 0] + blocks[blocks > 0] - 1] = True
    gain = gain + np.where(last, 0.0, np.append(gain[1:], 0.0))
    mass = mass + np.where(last, 0.0, np.append(mass[1:], 0.0))
    finish = np.minimum(start + np.where(last, BLOCK, 2 * BLOCK), w.at[owner + 1])
    # what a passage of the largest part of every word would reach, before projection
    maybe = np.flatnonzero(gain * gain >= (ix.margin * ix.cosine) ** 2 * mass)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}

    def add(row: int, j: int, cos: float, share_lcs: float, has: bool) -> None:
        old = best.get((row, ix.item[j]), (0.0, 0.0, False))
        best[row, ix.item[j]] = (max(old[0], cos), max(old[1], share_lcs), old[2] or has)

    inside = np.zeros(size + 1, bool)
    for b, j in _stretches(ix.seeds, w, col, owner, start, first):
        row = int(owner[b])
        lo, hi = max(w.at[row], start[b] - BLOCK), min(w.at[row + 1], finish[b] + BLOCK)
        found = _exact(ix, j, col[lo:hi], inside)
        if found:
            add(row, j, *found)
    step = max(16, min(2048, CELLS // ix.passages.shape[1]))
    for chunk in range(0, len(maybe), step):
        at = maybe[chunk : chunk + step]
        length = finish[at] - start[at]
        pos = np.repeat(start[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        win = np.repeat(np.arange(len(at)), length)
        c = col[pos]
        inner = c < size
        key, tf = np.unique(win[inner].astype(np.int64) * size + c[inner], return_counts=True)
        kw, kc = key // size, key % size
        v = tf * ix.idf[kc]
        norm = np.bincount(kw, v * v, minlength=len(at)) + np.bincount(win[~inner], minlength=len(at)) * weight2[-1]
        if not len(kw):
            continue
        begin = np.flatnonzero(np.diff(kw, prepend=-1))
        some = kw[begin]
        latent = np.add.reduceat(ix.basis[kc] * v[:, None].astype(np.float32), begin, axis=0)
        score = latent @ ix.passages / np.sqrt(norm[some])[:, None]
        for i, j in zip(*np.nonzero(score >= ix.cosine), strict=True):
            b = at[some[i]]
            row = int(owner[b])
            lo, hi = max(w.at[row], start[b] - BLOCK), min(w.at[row + 1], finish[b] + BLOCK)
            ref = ix.columns[j]
            inside[ref] = True
            words = col[lo:hi][inside[col[lo:hi]]]
            inside[ref] = False
            if len(words) < min(ix.lcs, ix.paraphrase) * len(ref):
                continue
            share_lcs = lcs_words(ref, words) / len(ref)
            has = _answered(ix.answers[j], col[lo:hi])
            if share_lcs >= ix.lcs or share_lcs >= ix.paraphrase and has:
                add(row, j, float(score[i, j]), share_lcs, has)
    for (row, item), found in sorted(best.items()):
        yield row, item, *found


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    cosine: float = 0.3,
    lcs: float = 0.6,
    paraphrase: float = 0.5,
    answer_words: int = 4,
    energy: float = 0.98,
    max_rank: int = 256,
    max_items: int = 8192,
    max_vocab: int = 1 << 15,
    margin: float = 0.9,
    seed: int = 5,
) -> DataFrame:
    """(id, item_id, cosine, lcs, answer_found) of each document that holds a benchmark item.

    An item is cut into passages of at most 48 words; a document holds it if it holds a passage.
    ``cosine`` of a pair is the larger one of the latent space and of the exact search.
    Without an answer column an item's last ``answer_words`` words are its answer.  Null and
    wordless texts on either side match nothing; an item of very few words is held by every text
    that has its share of them.  A pair of ids is returned once, whatever rows repeat them.  Other
    columns are not read.  Frequencies, the latent space and the search cover all documents.  An
    item's id is an integer.
    ``max_items`` and ``max_vocab`` bound what one part of the benchmark puts in memory (about
    100 MB); they change no document's search but for the latent space's cosine.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id long, cosine double, lcs double, answer_found boolean"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = [rows.mapInArrow(_search(ready), schema) for ready in _parts(rows, benchmark, item_col, item_text_col, answer_col, cosine, lcs, paraphrase, answer_words, energy, max_rank, max_items, max_vocab, margin, seed)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    whole = found[0]
    for x in found[1:]:
        whole = whole.union(x)
    best = [F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer_found").alias("answer_found")]
    return whole.groupBy("id", "item_id").agg(*best).withColumnRenamed("id", id_col)


def _parts(
    rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, cosine: float = 0.3, lcs: float = 0.6, paraphrase: float = 0.5,
    answer_words: int = 4, energy: float = 0.98, max_rank: int = 256, max_items: int = 8192, max_vocab: int = 1 << 15, margin: float = 0.9, seed: int = 5,
) -> Iterator:
    """A broadcast index for each part of the benchmark; a part that is too large is split by a hash."""
    spark = rows.sparkSession
    tk.bound_batches(spark)
    picked = [F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")]
    picked.append((F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("answer"))
    items = benchmark.select(*picked).where("text is not null and item is not null").distinct()
    part_of = F.xxhash64("item", "text", F.lit(seed))
    todo = [(1, 0)]
    while todo:
        parts, k = todo.pop()
        part = items.where(F.pmod(part_of, F.lit(parts)) == k).limit(max_items + 1).toArrow()
        index = None if part.num_rows > max_items else _index(rows, part, cosine, lcs, paraphrase, answer_words, energy, max_rank, max_vocab, margin, seed)
        if index is None:
            todo += [(2 * parts, k), (2 * parts, k + parts)]
        elif index.item:
            yield spark.sparkContext.broadcast(index)


def _index(
    rows: DataFrame, items: pa.Table, cosine: float, lcs: float, paraphrase: float, answer_words: int, energy: float, max_rank: int, max_vocab: int, margin: float, seed: int
) -> Index | None:
    """What the search for these items needs; None if they have too many words for one part."""
    spark = rows.sparkSession
    order = np.lexsort((np.array([str(x) for x in items["text"].to_pylist()]), items["item"].to_numpy()))
    items = items.take(pa.array(order)).combine_chunks()
    column = lambda name: items[name].combine_chunks() if items.num_rows else pa.array([], pa.string())
    w, ans = tk.words(column("text")), tk.words(column("answer"))
    item, words, answers = [], [], []
    for i in range(items.num_rows):
        own = w.hash[w.at[i] : w.at[i + 1]]
        answer = ans.hash[ans.at[i] : ans.at[i + 1]]
        parts = max(1, -(-len(own) // 48)) if len(own) else 0
        for piece in np.array_split(own, parts) if parts else []:
            item.append(items["item"][i].as_py())
            words.append(piece)
            answers.append(answer if len(answer) else piece[-answer_words:])
    vocab = np.unique(np.concatenate([w.hash, ans.hash]))
    if len(vocab) > max_vocab and items.num_rows > 1:
        return None
    table = _slots(vocab)
    if not words:
        none = np.zeros(0)
        return Index(vocab, none, none, none, [], [], [], cosine, lcs, paraphrase, table, none, margin, Seeds(none, none, none, none), none)

    shared = spark.sparkContext.broadcast((vocab, table))
    df = np.zeros(len(vocab) + 1)
    counted = rows.mapInArrow(_frequencies(shared), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df[counted["word"].to_numpy()] = counted["n"].to_numpy()
    shared.destroy()
    there = max(1.0, df[-1])
    idf = np.log((there + len(words) + 1) / (np.append(df[:-1], 0) + 1))

    # at least one in a hundred, so that no word outweighs the rest of a passage as documents grow
    weight = np.log(1.1 / np.clip((df + 1) / (there + 1), 0.01, 1.0))
    columns, answers = ([_columns(piece, vocab, table) for piece in x] for x in (words, answers))
    seeds = _seeds(columns, df, min(lcs, paraphrase))

    sparse, reach = [], np.zeros(len(vocab) + 1)
    for piece in columns:
        c, n = np.unique(piece, return_counts=True)
        v = n * idf[c]
        v = v / (np.sqrt((v * v).sum()) or 1.0)
        sparse.append((c, v))
        reach[c] = np.maximum(reach[c], v)
    with Scratch(spark) as scratch:
        model = spark.sparkContext.broadcast((vocab, table, idf))
        kind = "a int, b int, v double"
        # the benchmark's passages weigh as much as the documents, since it is they that are looked for
        scale = np.sqrt(max(1.0, there / len(words)))
        own = pa.table({"col": pa.array([c for c, _ in sparse], pa.list_(pa.int32())), "weight": pa.array([v * scale for _, v in sparse], pa.list_(pa.float64()))})
        own = spark.createDataFrame(own, "col array<int>, weight array<double>").mapInArrow(_gram_of_lists(len(vocab)), kind)
        gram = scratch.keep(_gram_rows(rows.mapInArrow(_gram(model), kind).union(own)), "gram")
        model.destroy()
        rank = min(64, len(vocab))
        while True:
            basis = randomised_svd(gram, len(vocab), rank, seed=seed)
            latent = np.stack([v @ basis[c] for c, v in sparse])
            held = (latent**2).sum(axis=1)
            if np.quantile(held, 0.02) >= energy or rank >= min(max_rank, len(vocab)):
                break
            rank = min(max_rank, len(vocab), rank * 4)
    latent = (latent / np.sqrt(np.maximum(held, 1e-9))[:, None]).T
    return Index(vocab, idf, basis.astype(np.float32), latent.astype(np.float32), item, columns, answers, cosine, lcs, paraphrase, table, reach * idf, margin, seeds, weight)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows whose text holds no benchmark item, with their own columns; one pass, no shuffle.

    Options are those of `contaminated`.  A row with a null id stays.
    """
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs
    for ready in _parts(rows, benchmark, **options):
        out = out.mapInArrow(_clean(ready, *at), docs.schema)
    return out
