"""Independent models of what SQL cannot say, held-out quality, and the SQL twins of what it can."""

import base64
import heapq
import random
import re

import numpy as np
import oracle
import pytest
import regex
from pyspark.sql import functions as F

from fernlake.llm import encoding, decontaminate, embedding_dedup, langid, mixing, quality, registry, token_counts

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, name):
    assert oracle.compare(oracle.connect(SF), registry.queries()[name](spark, SF), registry.oracle_sql()[name]) == ""


def bpe(text, ranks):
    """Byte-pair encoding of one piece by merging the pair of the lowest rank."""
    parts = [bytes([b]) for b in text.encode()]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return len(parts)


def test_token_lengths_against_own_encoder(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(encoding.vocabulary_path("byte_bpe_50k.tiktoken"), "rb").read().splitlines() if x)}
    texts = ["Plain words, 123 numbers!", "don't  stop\n\n now", "", None, "漢字 and é ß", "a" * 400, "x <|endoftext|> y", " \t\n"]
    texts += [r.text[:600] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(20).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.document_tokens(df).collect()}
    split = regex.compile(encoding.PATTERN)
    assert got == {k: sum(bpe(p, ranks) for p in split.findall(x or "")) for k, x in enumerate(texts)}


def test_limits_and_quantiles(spark):
    rng = random.Random(4)
    n = [rng.choice([0, 1, 5, 5, 9, 30, 31, 400]) for _ in range(300)]
    hist = token_counts.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    limits = [0, 1, 4, 5, 30, 399, 400, 10**6]
    got = {r.context_limit: (r.docs_cut, r.tokens_kept) for r in token_counts.at_limits(hist, limits).collect()}
    assert got == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in limits}
    for r in token_counts.quantiles(hist, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == min(m for m in set(n) if sum(x <= m for x in n) >= r.share * len(n))
    none = token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0, 0)] and token_counts.quantiles(none, [0.5]).first().n_tokens is None


def test_language_of_held_out_documents(spark):
    got = registry.op6_language_id(spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = got.where("held_out and lang is not null and text rlike '[a-z]'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_several_hundred_languages(spark):
    """More languages than any bound before; a rare one keeps all its rows, common ones share the rest; buckets follow the bytes."""
    rng = random.Random(5)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4)] for k in range(450)}
    rows = [(k * 10 + j, " ".join(rng.choices(w, k=12)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)]
    rows += [(10**6 + j, " ".join(rng.choices(words["l000"], k=12)), "l000") for j in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, max_rows=1500, max_bytes=4 << 20)
    assert len(model.languages) == 450 and model.buckets == 2048 and model.log_prob.nbytes <= 4 << 20
    got = langid.identify(df, model).join(df, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    few = langid.learn(df, max_rows=1)
    assert few.languages == model.languages


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "aa", "x"), (1, "aa", "x"), (2, "aa", "y"), (2, "aa", "y"), (None, "aa", "x")], "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id is not null"))
    got = langid.identify(df, model).collect()
    assert len(got) == 5 and {r.lang_pred for r in got} == {"x"} and len({r.score for r in got}) == 1
    labels = df.withColumn("quality", F.col("doc_id") % 2)
    scored = quality.score(df, quality.fit(labels, "quality")).collect()
    assert len(scored) == 5 and len({r.score for r in scored}) == 1


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_quality_of_held_out_documents(spark):
    rows = registry.op8_quality(spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    y = np.array([r.quality for r in rows])
    assert auc(np.array([r.score for r in rows]), y) >= 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97


def test_quality_sample_is_never_empty(spark):
    """A share of a class far below one in a million still draws by its share, and the pair bound cuts the sample, not the model."""
    df = spark.createDataFrame([(k, "good words here" if k % 2 else "BAD!! ###", k % 2) for k in range(400)], "doc_id long, text string, quality int")
    model = quality.fit(df, "quality", max_rows=20)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((s >= 0.5) == (k % 2 == 1) for k, s in got.items())
    small = quality.fit(df, "quality", max_pairs=300)
    assert small.delta.any()
    assert not quality.fit(df, "quality", max_pairs=3).delta.any()


def planted(seed, n, pairs, dims=64):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = np.arange(pairs), np.arange(pairs) + n // 2
    noise = rng.normal(size=(pairs, dims))
    noise -= (noise * v[a]).sum(axis=1, keepdims=True) * v[a]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.999, pairs)[:, None]
    v[b] = cos * v[a] + np.sqrt(1 - cos**2) * noise
    return v


def test_forest_recall_through_many_splits(spark):
    """Leaves of 16 rows of 3,000: over seven levels of splits in three or more stages; links against all pairs."""
    v = planted(3, 3000, 600)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, leaf=16, depth=3).collect()}
    want = np.concatenate([(v[k : k + 2000] @ v.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(v), 2000)])
    links = np.array([got[k] for k in range(len(v))])
    assert (links <= want).all() and want.sum() >= 1200
    assert links.sum() >= 0.9 * want.sum(), links.sum() / want.sum()


def test_forest_lengths_and_repeated_ids(spark):
    """Vectors of two lengths link within theirs; one id may name vectors of its own, each placed and counted."""
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [1.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (5, [2.0, 0.0]), (6, [0.0, 0.0, 1.0]), (6, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (6, 0, 6, True)])


def test_mix_against_simulated_edf(spark):
    """Each phase's slots against a simulation with a heap of deadlines over all its blocks."""
    rng = random.Random(7)
    rows = [(k, rng.choice(["a"] * 7 + ["b", "b", "c", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    use = {"a": 5, "b": 3}
    got = {(r.mix_source, r.block): r.slot for r in mixing.mix(df, use, block_docs=5).select("mix_source", "block", "slot").distinct().collect()}
    blocks = {}
    for s, k in got:
        blocks[s] = max(blocks.get(s, 0), k + 1)
    left, done, slot, want = dict(blocks), dict.fromkeys(blocks, 0), 0, {}
    weight = {s: use.get(s, 1) for s in blocks}
    while left:
        periods = min(n // weight[s] for s, n in left.items())
        a = {s: weight[s] if periods else min(weight[s], n) for s, n in left.items()}
        total, rounds = sum(a.values()), max(1, periods)
        waiting = sorted((k * total // a[s], -(-(k + 1) * total // a[s]), sorted(left).index(s), s, k) for s in left for k in range(a[s] * rounds))
        ready, at = [], 0
        for t in range(total * rounds):
            while at < len(waiting) and waiting[at][0] <= t:
                heapq.heappush(ready, waiting[at][1:])
                at += 1
            due, _, s, k = heapq.heappop(ready)
            assert t < due
            want[s, done[s] + k] = slot + t
        for s in a:
            done[s] += a[s] * rounds
            left[s] -= a[s] * rounds
        slot += total * rounds
        left = {s: n for s, n in left.items() if n}
    assert got == want


def leaks(spark, **options):
    rng = random.Random(12)
    word = lambda: f"w{int(800 * rng.random() ** 2)}"
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 55)))) for k in range(60)]
    rows = []
    for k in range(200):
        w = [word() for _ in range(rng.randint(20, 200))]
        if k % 2:
            inner = items[k % 60][1].split()
            if k % 3 == 0:
                inner = [word() if p % 5 == 1 else x for p, x in enumerate(inner)]
            at = rng.randint(0, len(w))
            w[at:at] = inner
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()}


def test_decontamination_in_parts_and_without_prefilter(spark):
    """Neither a benchmark searched in parts nor a margin of 0, which tries every window, changes a pair."""
    want = leaks(spark)
    assert len(want) >= 100
    assert leaks(spark, max_items=20) == want
    assert leaks(spark, max_vocab=500) == want
    assert leaks(spark, margin=0.0) == want


def test_every_planted_item_is_found(spark):
    """Documents that hold a benchmark item word for word, by search with strings, are all found."""
    plain = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0d]+", (x or "").lower()))
    items = [(r.item_id, f" {plain(r.text)} ") for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    docs = [(r.doc_id, f" {plain(r.text)} ") for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for i, x in items for d, text in docs if x in text}
    got = {(r.doc_id, r.item_id) for r in registry.op10_decontaminate(spark, LARGER).collect()}
    assert len(want) > 10 and want <= got
    assert len({d for d, _ in got} - {d for d, _ in want}) <= 0.005 * len(docs)
