"""Queries of this subpackage: one per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm import chat, decontaminate, embedding_dedup, langid, mixing, packing, quality, ranked, secrets, spelling, token_counts, warc
from fernlake.llm.ngram_jaccard import jaccard_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.document_tokens(table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for k, role in enumerate(("user", "assistant"))]
    two = spark.range(1).select(F.inline(F.array(*extra)))
    out = chat.format_conversations(rows.unionByName(two))
    turns = chat.parse_turns(F.col("formatted"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    inside = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    loss = chat.unescape(F.array_join(inside, ""))
    out = out.withColumn("turns", turns).withColumn("loss", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
p as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from p union all select b, a from p),
reach as (select doc_id as id, doc_id as r from documents union select reach.id, e.b from reach join e on e.a = reach.r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select id, min(r) as component_id from reach group by id) c on c.id = d.doc_id
"""

OP7_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as id, vec_id as r from v union select reach.id, p.b from reach join p on p.a = reach.r)
select v.vec_id, coalesce(l.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v left join (select a, count(*) as n from p group by a) l on l.a = v.vec_id join (select id, min(r) as component_id from reach group by id) c on c.id = v.vec_id
"""

OP5_SQL = r"""
with src as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc as (
  select *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) as n_body,
         length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) as n_role
  from src)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(case when lower(role) = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when lower(role) = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(4 + n_role + 2 + n_body + 8) as bigint) as formatted_chars
from esc group by conv_id
"""

OP4_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
       case when f.first is not null and f.first <> p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> p.page_id then f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(4) == 2
    model = langid.learn(docs, train=~held)
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, sf_dir: str, train=None) -> quality.QualityModel:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.fit(rows, "quality", train=train, labels=table(spark, sf_dir, "labels"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(3) == 1
    found = quality.score(docs, quality_model(spark, sf_dir, train=~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Target weights of a mixture that holds the crawl-like source to a quarter.
MIX_WEIGHTS = {"src0": 7}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "mix_source", "block", "slot", "release", "deadline", "position")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with recursive tab as (
  select list(c order by i) as t from (select i, list_reduce([cast(i as bigint)] || range(8)::bigint[], lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) as c from range(256) r(i))),
run as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as r from documents),
occ as (select d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from run where length(r) >= 7 group by all),
hex as (select r, n, hex(encode(d || ':' || r)) as x from occ),
h as (select r, n, xor(4294967295::bigint, list_reduce([4294967295::bigint] || list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) as h from hex, tab),
w as (select case when h % 31 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end as word, sum(n)::bigint as n from h group by 1 having length(word) >= 7 and sum(n) >= 2),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (
  select a.word as a, b.word as b, b.n from cut a join cut b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select c.word, w.word, w.n from cut c join w on w.word = c.less
  union select w.word, c.word, c.n from cut c join w on w.word = c.less),
best as (select a as word, count(*) as n_near, max(n) as top, arg_min(b, (-n, encode(b))) as form from near group by a),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 10 * w.n then form end as form, case when top >= 10 * w.n then top end as form_n from w left join best using (word)),
climb as (select word, word as at from f union all select climb.word, f.form from climb join f on f.word = climb.at where f.form is not null)
select f.word, f.form, c.at as root, f.n, f.n_near, f.form_n
from f join (select climb.word, climb.at from climb join f e on e.word = climb.at where e.form is null) c on c.word = f.word
"""

OP13_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
g as (select count(*) as nd, sum(len(w))::bigint as l from d where len(w) > 0),
tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from d) group by all),
df as (select t, count(*) as df from tf group by t),
imp as (select tf.doc_id, tf.t, cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * nd) // l))) as s
  from tf join d using (doc_id) join df using (t), g where t in (select t from q)),
sc as (select item_id, doc_id, sum(s)::bigint as score from q join imp using (t) group by all having sum(s) > 0)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from sc qualify rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_counts": op2_token_counts,
        "op3_secret_scan": op3_secret_scan,
        "op4_warc": op4_warc,
        "op5_chat_format": op5_chat_format,
        "op6_language_id": op6_language_id,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_quality": op8_quality,
        "op9_mix_sources": op9_mix_sources,
        "op10_decontaminate": op10_decontaminate,
        "op11_packing": op11_packing,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op4_warc": OP4_SQL, "op5_chat_format": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op12_spelling_variants": OP12_SQL, "op13_ranked_search": OP13_SQL}
