"""Retrieval for tables of queries: vector search, relation context, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernlake.functions import text as tx
from fernlake.operators.graph import khop_relations

EMPTY = "No relevant information found."


def embedding_backlog(docs: DataFrame, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """(item_id, text) still to embed: documents without a vector, and all entities."""
    return docs.join(vectors.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "text").union(entities.select("item_id", "text"))


def embed_batch(rows: DataFrame, embed: Callable | None = None, dims: int = 64, text_col: str = "text") -> DataFrame:
    """The rows with an `embedding`.

    `embed` maps a pandas Series of texts to a Series of lists and runs on Arrow batches; without
    one, the default is a count of words by slot in SQL, of unit length; a word's slot comes from
    its MD5, so that any engine finds the same.  A null or wordless text has zeros.
    """
    if embed is not None:
        return rows.withColumn("embedding", F.pandas_udf(embed, "array<double>")(F.col(text_col)))
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[ \t\r\n\f\x0B]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims).cast("int"))
    # one-element arrays hold a value for the lambda inside, which would compute it again at each step
    held = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    every = F.sequence(F.lit(0), F.lit(dims - 1))
    count = held(slots, lambda s: F.transform(every, lambda k: (F.size(s) - F.size(F.array_remove(s, k))).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: held(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return rows.withColumn("embedding", held(count, unit))


def _units(column: pa.Array, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each vector length; null, zero and non-finite vectors are left out."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64) if rows else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    out = []
    for dims in np.unique(size[size > 0]):
        at_rows = np.flatnonzero(size == dims)
        v = flat[at[at_rows][:, None] + np.arange(dims)]
        norm = np.linalg.norm(v, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        out.append((at_rows[fine], v[fine] / norm[fine][:, None]))
    return out


def _best(shared, k: int, least: float | None, digits: int, cells: int = 1 << 22):
    """A task's own k best items of every query, from one matrix product per piece of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units = shared.value
        kind = None
        best: pa.Table | None = None  # q, item, score
        for batch in batches:
            kind = batch.schema.field(0).type
            own = {len(v[0]): (rows, v) for rows, v in units if len(v)}
            for rows, v in _units(batch.column(1), batch.num_rows):
                if not len(v) or v.shape[1] not in own:
                    continue
                at, q = own[v.shape[1]]
                step = max(1, cells // len(at))
                for i in range(0, len(v), step):
                    score = np.round(q @ v[i : i + step].T, digits)
                    if score.shape[1] > k:
                        floor = np.partition(score, -k - 1, axis=1)[:, -k - 1][:, None]  # one more, for the query itself
                        x, y = np.nonzero(score >= floor)
                    else:
                        x, y = np.nonzero(score > -2)
                    if least is not None:
                        fine = score[x, y] >= least
                        x, y = x[fine], y[fine]
                    items = batch.column(0).take(pa.array(rows[i + y]))
                    new = pa.table({"q": pa.array(at[x]), "item": items, "score": pa.array(score[x, y])})
                    new = new.filter(pc.invert(pc.fill_null(pc.equal(new["item"], names.take(new["q"]).cast(kind)), False)))
                    best = _first(pa.concat_tables([best, new]) if best is not None else new, k)
        if best is not None:
            for b in best.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], names=["query_id", "item_id", "score"])

    return run


def _first(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each q by score, then item."""
    rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("item", "ascending")])
    q = rows["q"].to_numpy()
    begin = np.searchsorted(q, q)
    return rows.filter(pa.array(np.arange(len(q)) - begin < k))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, least: float | None = None, digits: int = 6, max_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar items by cosine in double precision.

    Queries are broadcast in blocks of about `max_bytes`, one pass over the vectors each.  A task
    keeps its own k best of every query before the final ranking, so what is shuffled is tasks x
    queries x k rows, whatever the number of vectors.  An item with the query's own id is left
    out; ties go to the smaller id; null, zero and non-finite vectors are not found.  Query and
    item ids are of one type.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q is not null")
    size = q.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    v = vectors.select("item_id", F.col("embedding").cast("array<double>").alias("v"))
    ids = [f.dataType.simpleString() for f in (q.schema["query_id"], v.schema["item_id"])]
    parts = []
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        names = rows["query_id"].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field("query_id").type)
        units = _units(rows["q"].combine_chunks(), rows.num_rows) if rows.num_rows else []
        shared = spark.sparkContext.broadcast((names, units))
        parts.append(v.mapInArrow(_best(shared, k, least, digits), f"query_id {ids[0]}, item_id {ids[1]}, score double"))
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.union(x)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vector_context(hits: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 30) -> DataFrame:
    """Relations around the hits; a triplet's score is the larger of its ends' similarities, 0 for an unscored end."""
    seeds = hits.select("query_id", F.col("rank").alias("seed_no"), F.col("item_id").alias("seed"))
    rel = khop_relations(seeds, edges, depth, limit)
    score = lambda end, name: hits.select("query_id", F.col("item_id").alias(end), F.col("score").alias(name))
    rel = rel.join(score("src", "a"), ["query_id", "src"], "left").join(score("dst", "b"), ["query_id", "dst"], "left")
    return rel.select("query_id", "seed_no", "seed", "src", "rel", "dst", F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))).alias("score"))


def include_text(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triplets regrouped under their source chunk, with the chunk's text."""
    fact = F.concat_ws(" -> ", "src", "rel", "dst")
    grouped = triplets.groupBy("query_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set(fact)), "\n").alias("facts"), F.max("score").alias("score"))
    return grouped.join(chunks, "chunk_id").select("query_id", "chunk_id", "score", F.concat_ws("\n\n", "facts", "text").alias("text"))


def rerank_fallback(hits: DataFrame, keep: int = 10) -> DataFrame:
    """The first raw results, where no reranked ones exist."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")


def min_score_filter(facts: DataFrame, least: float = 0.10, child_least: float = 0.30) -> DataFrame:
    """Unscored rows pass, CHILD rows need more and count unscored as 0, PARENT rows go."""
    return facts.where(
        (F.col("rel") != "PARENT") & (F.col("score").isNull() | (F.col("score") >= least)) & ((F.col("rel") != "CHILD") | (F.coalesce("score", F.lit(0.0)) >= child_least))
    )


def parse_facts(facts: DataFrame) -> DataFrame:
    """Fact texts split into relation lines and source text; inline ({...}) properties go."""
    lines = F.split("text", "\n")
    is_rel = lambda x: x.contains(" -> ")
    bare = F.transform(F.filter(lines, is_rel), lambda x: tx.strip(F.regexp_replace(x, r"\(\{.*?\}\)", "")))
    rest = tx.strip(F.array_join(F.filter(lines, lambda x: ~is_rel(x)), "\n"))
    return facts.withColumn("relations", bare).withColumn("source_text", rest).drop("text")


def parse_child_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """CHILD edges as 'parent -> CHILD -> child' with the texts of both ends."""
    end = lambda c, t: nodes.select(F.col("node_id").alias(c), F.col("clean").alias(t))
    rows = edges.where("rel = 'CHILD'").join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    return rows.select("src", "dst", F.concat_ws(" -> ", "a", F.lit("CHILD"), "b").alias("fact"))


def evidence_dedup(evidence: DataFrame, clip: int = 1200, same: int = 120) -> DataFrame:
    """Evidence with bodies clipped; of bodies that begin alike the first by query and rank stays."""
    rows = evidence.withColumn("body", tx.smart_truncate(F.col("body"), clip))
    w = Window.partitionBy("request_id", "kind", F.when(F.col("kind") == "SOURCE", F.substring("body", 1, same)).otherwise(F.col("body"))).orderBy("query_no", "rank")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def evidence_format(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """One text per request: a block per query, lines by rank; the empty notice where nothing survived.

    `hits` names the requests and the number of rows that passed the filters.
    """
    score = F.when(F.col("score").isNotNull(), F.format_string(" (Score: %.2f)", F.col("score"))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("body"), score)
    rows = F.array_sort(F.collect_list(F.struct("rank", "kind", line.alias("line"))))
    block = evidence.groupBy("request_id", "query_no").agg(F.array_join(rows["line"], "\n").alias("body"))
    block = block.withColumn("body", F.concat(F.lit("QUERY: "), F.col("query_no"), F.lit("\n"), F.col("body")))
    whole = F.array_sort(F.collect_list(F.struct("query_no", "body")))
    text = block.groupBy("request_id").agg(F.concat(F.lit("RETRIEVER RESULTS:\n"), F.array_join(whole["body"], "\n\n")).alias("text"))
    out = hits.join(text, "request_id", "left")
    return out.select("request_id", F.when(F.coalesce("n_hits", F.lit(0)) == 0, F.lit(EMPTY)).otherwise(F.coalesce("text", F.lit("RETRIEVER RESULTS:\n"))).alias("text"))


def evidence_usable(results: DataFrame, least: float = 0.30) -> DataFrame:
    """usable: the text holds markers and a score of `least` or more, or no score at all."""
    text = tx.strip(F.col("text"))
    scores = F.regexp_extract_all("text", F.lit(r"\(Score:\s*([\d.]+)\)"), 1)
    scored = F.exists(scores, lambda s: s.try_cast("double") >= least)
    ok = (text != "") & (text != EMPTY) & (text.contains("[RELATION]") | text.contains("[SOURCE]")) & ((F.size(scores) == 0) | scored)
    return results.withColumn("usable", F.coalesce(ok, F.lit(False)))


def collect_subgraph(facts: DataFrame) -> DataFrame:
    """Distinct triplets per request from 'a -> rel -> b' texts; rows with other than three parts are left out."""
    parts = F.split("fact", " -> ", -1)
    return facts.where(F.size(parts) == 3).select("request_id", parts[0].alias("src"), parts[1].alias("rel"), parts[2].alias("dst")).distinct()
