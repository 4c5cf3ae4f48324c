"""Operators of the llm subpackage against brute force, on small fixtures with the awkward cases."""

import binascii
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernlake.llm import chat, decontaminate, embedding_dedup, langid, mixing, ngram_jaccard, quality, secrets, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """Rows (id, text) with the other columns, and extra ones with names that operators use inside."""
    full = [(i, x, "en", "s", len(x or "")) for i, x in rows]
    return spark.createDataFrame(full, DOC).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(None).cast("int")).withColumn("block_no", F.lit(2))


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size, num, den):
    sets = [(i, shingles(x, size)) for i, x in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows = []
    base = [rng.choice(vocab) for _ in range(120)]
    for k in range(n):
        kind = k % 4
        if kind == 0:  # near copies of one text, about the threshold
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 1:  # a common passage in unlike texts
            w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))] + common
        elif kind == 2:  # small edits of the passage alone
            w = list(common)
            if k % 3:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 12))]
        rows.append((k, " ".join(x.upper() if rng.random() < 0.1 else x for x in w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, rows[0][1]), (n + 4, rows[0][1].upper()), (n + 5, "é ß 漢字  x")]
    return rows


@pytest.mark.parametrize(("size", "num", "over"), [(4, 85, 64), (5, 80, 3), (2, 70, 1)])
def test_jaccard_components(spark, size, num, over):
    rows = near_copies(size)
    got = ngram_jaccard.jaccard_components(docs_frame(spark, rows), size, num, 100, frequent_over=over, cell=8).collect()
    want = brute_components(rows, size, num, 100)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(x, size)) for i, x in rows}


def test_jaccard_nulls_and_repeats(spark):
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(None, text), (3, text), (3, "other words here now"), (5, "other words here now"), (9, None)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(docs_frame(spark, rows), 4, 85, 100).collect()), key=str)
    assert got == sorted([(None, None), (3, 3), (3, 3), (5, 3), (9, 9)], key=str)
    assert ngram_jaccard.jaccard_components(docs_frame(spark, []), 4, 85, 100).count() == 0


def test_index_keys_meet():
    """Any two sets over the threshold share an index key, whatever the frequent class."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7, 8, 15, 16, 31, 60, 64, 130, 257):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 40, dtype=np.uint64))
            rng.shuffle(pool)
            a = np.sort(pool[:n])
            for cut in range(n):
                b = np.sort(np.concatenate([pool[cut:n], pool[n : n + rng.integers(0, cut + 1)]]))
                both = len(np.intersect1d(a, b))
                if not both or 100 * both < 80 * (len(a) + len(b) - both):
                    break
                hot = np.sort(rng.choice(pool, rng.integers(0, len(pool)), replace=False))
                x, y = (ngram_jaccard.index_keys(s, hot, 80, 100) for s in (a, b))
                assert len(np.intersect1d(x, y)), (n, cut)


def test_long_word_and_long_text(spark):
    long = "x" * 300_000
    rows = [(1, long + " b c d"), (2, long + " b c d"), (3, "b " * 200_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs_frame(spark, rows), 4, 85, 100).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3)}


def test_histogram(spark):
    rows = [(0, "a b c"), (1, "hello <|endoftext|> world"), (2, None), (3, ""), (4, "a b c"), (5, "x " * 5000)]
    lengths = token_counts.document_tokens(docs_frame(spark, rows))
    n = sorted(r.n_tokens for r in lengths.collect())
    for r in token_counts.length_histogram(lengths).collect():
        m = r.n_tokens
        assert (r.n_docs, r.docs_from, r.docs_cut) == (n.count(m), sum(x >= m for x in n), sum(x > m for x in n))
        assert (r.tokens_from, r.tokens_kept) == (sum(x for x in n if x >= m), sum(min(x, m) for x in n))
        assert abs(r.share_within - sum(x <= m for x in n) / len(n)) < 1e-12
    limits = {r.context_limit: (r.docs_cut, r.tokens_kept) for r in token_counts.at_limits(token_counts.length_histogram(lengths), [1, 4, 10**6]).collect()}
    assert limits == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (1, 4, 10**6)}
    assert token_counts.length_histogram(token_counts.document_tokens(docs_frame(spark, []))).count() == 0


def spans_by_search(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secret_base_spans(spark):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", " ", ":", "=", "'", '"', "\n", "é", "ſecret", "K", "abcdefgh", "-", "/"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(300)] + [(900, None), (901, ""), (902, "x" * 100_000 + "token=abcdefgh1")]
    got = {r.doc_id: r for r in secrets.find_secrets(docs_frame(spark, rows)).collect()}
    for i, x in rows:
        want = spans_by_search(x or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), x
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(w[1] == k for w in want) for k in range(3)]


def test_secret_checksums_and_redaction(spark):
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + secrets.base62_crc(body)
    assert len(good) == 40 and binascii.crc32(body.encode())
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    rows = [(1, f"see {good}."), (2, f"see {bad}."), (3, "card number: 4111 1111 1111 1111"), (4, "card number: 4111 1111 1111 1112"), (5, None), (6, "token = 'abcdefgh1' x")]
    df = docs_frame(spark, rows)
    assert {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()} == {1: "forge:4:44", 2: "", 3: "card:0:32", 4: "", 5: "", 6: "assign:0:18"}
    out = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert out[1].text == "see <SECRET:forge>." and out[1].n_chars == len(out[1].text) and out[2].text == rows[1][1] and out[5].text is None
    assert secrets.redact(df).columns == df.columns


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a", big), (2, "http://b\r\nX: y", big), (9, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (7, "http://e", None), (None, "http://f", big), (8, "u%0A", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1))
    got = {r.page_id: r for r in warc.archive_pages(pages, f"file://{tmp_path}/w").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 3: ("response", None), 4: ("response", None), 7: ("response", None), None: ("response", None), 8: ("response", None),
    }
    for i, url, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].target_uri) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
    back = warc.read_warc(spark, f"file://{tmp_path}/w", "record_id string, record_type string, payload binary")
    assert back.where("record_type = 'revisit'").count() == 2
    assert [bytes(r.payload).decode() for r in back.where("record_id = '<urn:page:2>' and record_type = 'response'").collect()] == [big]
    plan = back.where("record_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan
    assert warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_gzip_is_standard(spark, tmp_path):
    import glob
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(pages), f"file://{tmp_path}/w")
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.gz"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"hello\r\n\r\n")


def foreign_records():
    """Records as other tools write them: bare line feeds, folded and odd lines, no payload length, no HTTP, WARC/1.0."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = b"<html>WARC/1.0 is in the text\r\n\r\nWARC/1.0\r\n</html>" * 50
    one = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-record-id: <urn:1>\r\nWARC-Target-URI: http://x/\r\n  folded\r\nno colon here\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http + body) + http + body + b"\r\n\r\n"
    two = b"WARC/1.0\nWARC-Type: warcinfo\nWARC-Record-ID: <urn:2>\nContent-Type: application/warc-fields\nContent-Length: 5\n\nab: c\n\n"
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: none\r\n\r\njunk\r\n\r\n"
    three = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:3>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: image/png\r\nContent-Length: 3\r\n\r\nx\r\n\r\n\r\n"
    return [one, two, bad, three], {"<urn:1>": body, "<urn:2>": b"ab: c", "<urn:3>": b"x\r\n"}


@pytest.mark.parametrize("kind", ["plain", "members", "one member"])
def test_warc_of_other_tools(spark, tmp_path, kind):
    import gzip

    records, payload = foreign_records()
    name = "a.warc" if kind == "plain" else "a.warc.gz"
    text = b"".join(records) if kind == "plain" else b"".join(gzip.compress(r) for r in records) if kind == "members" else gzip.compress(b"".join(records))
    (tmp_path / "w" / "deep").mkdir(parents=True)
    (tmp_path / "w" / "deep" / name).write_bytes(text)
    for path in (f"file://{tmp_path}/w", f"file://{tmp_path}/w/deep/{name}"):
        got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
        assert {k: bytes(r.payload) for k, r in got.items()} == payload
        assert all(r.payload_bytes == len(payload[k]) and r.stored_sha256 == hashlib.sha256(payload[k]).hexdigest() for k, r in got.items())
    assert got["<urn:1>"].target_uri == "http://x/ folded" and got["<urn:3>"].payload_digest == "sha1:ABC" and got["<urn:2>"].record_type == "warcinfo"
    assert [r.record_id for r in warc.read_warc(spark, path).where("record_type = 'resource'").collect()] == ["<urn:3>"]


def test_warc_skips_are_seeks(spark, tmp_path):
    """Unwanted records of an own archive, and all of an uncompressed one, are stepped over: their bytes are neither read nor inflated."""
    import glob
    import zlib

    from pyarrow import fs

    rng = random.Random(1)
    html = ["".join(rng.choice("0123456789abcdef") for _ in range(5_000_000 if k % 2 else 300)) for k in range(6)]
    pages = spark.createDataFrame([(k, f"http://{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.page_records(pages).coalesce(1), f"file://{tmp_path}/w")
    file = glob.glob(f"{tmp_path}/w/*.gz")[0]
    plain = f"{tmp_path}/p.warc"
    with open(plain, "wb") as out:
        raw = open(file, "rb").read()
        while raw:
            one = zlib.decompressobj(31)
            out.write(one.decompress(raw))
            raw = one.unused_data

    class Counted:
        def __init__(self, src):
            self.src, self.n = src, 0

        def read(self, n):
            out = self.src.read(n)
            self.n += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.src, name)

    inflated = []
    real = warc._Inflated._more

    def more(self):
        before = len(self.ready)
        ok = real(self)
        inflated.append(len(self.ready) - before)
        return ok

    for path in (file, plain):
        src = Counted(fs.LocalFileSystem().open_input_file(path))
        whole = src.size()
        warc._Inflated._more = more
        try:
            got = list(warc._records(src, {"target_uri": {"http://0", "http://4"}}, ["record_id", "payload"]))
        finally:
            warc._Inflated._more = real
        assert {bytes(r["payload"]).decode() for r in got} == {html[0], html[4]}
        assert src.n < whole / 1.2 and sum(inflated) < 100_000


def test_warc_splits_by_record(spark, tmp_path):
    from fernlake.llm.warc import WarcReader, page_records

    rng = random.Random(2)
    pages = spark.createDataFrame([(k, None, "".join(rng.choice("abcdefghij") for _ in range(300_000))) for k in range(40)], "page_id long, url string, html string")
    warc.write_warc(page_records(pages).coalesce(1), f"file://{tmp_path}/w")
    plan = WarcReader(f"file://{tmp_path}/w", warc.StructType(), 1 << 20).partitions()
    assert len(plan) >= 2
    got = warc.read_warc(spark, f"file://{tmp_path}/w", split_bytes=1 << 20)
    assert got.rdd.getNumPartitions() == len(plan) and got.select("record_id").distinct().count() == got.count() == 40


def test_chat_round_trip(spark):
    texts = ["a\\b<c>#d", "\\### Assistant: </turn> ok", "</turn>\n### user: x", "", None, "\\b\\l\\h\\\\", "é漢\U0001f600"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(texts)] + [(2, 0, None, "alone"), (None, 0, "a: b", "z"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(0)).withColumn("tree", F.lit("x"))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    for conv in (1, 2, None):
        want = [(r or "", x or "") for c, _, r, x in rows if c == conv]
        assert [tuple(t) for t in got[conv].turns] == want
        spans = [got[conv].formatted[s.start : s.end] for s in got[conv].loss_spans]
        plain = [s.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") for s in spans]
        assert plain == [x for r, x in want if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_reply_tree_branches(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 2.0), ("t", 4, 2, 0.0), ("t", 5, 3, 9.0), ("t", 6, 5, None), ("u", 1, 77, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0)]
    nodes += [("w", k, k - 1 if k else None, 1.0) for k in range(70)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.reply_paths(df).collect():
        got.setdefault((r.tree, r.rank), []).append((r.pos, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got == {("t", 1): [1, 3, 5, 6], ("t", 2): [1, 2, 4], ("u", 1): [1], ("w", 1): list(range(70))}
    best = chat.reply_paths(df, best=1)
    assert best.where("tree = 't'").count() == 4


def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "with", "from"], "bb": ["ñasque", "ción", "los", "doó"]}
    rows = [(k, " ".join(rng.choice(words["aa" if k % 2 else "bb"]) for _ in range(30)), "aa" if k % 2 else "bb") for k in range(60)]
    rows += [(100, None, None), (101, "123 !!", "aa"), (102, "", "bb"), (103, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(1))
    model = langid.learn(df, train=F.col("doc_id") < 40)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[40:60])
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.learn(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_forest_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    tight = base[:1] + rng.normal(size=(150, 16)) * 0.002
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near, tight]))] + [(800, base[5].tolist()), (801, (3 * base[6]).tolist())]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (None, base[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf=40, depth=3).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    want = hit.sum(axis=1) - 1
    links = np.array([got[i].n_links for i, _ in rows])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    label = np.arange(len(rows))
    for _ in range(20):
        label = np.array([label[h].min() for h in hit])
    assert np.mean([got[i].component_id == rows[label[k]][0] for k, (i, _) in enumerate(rows)]) > 0.97
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (900, 901, 902, 903, 904))
    assert got[None].component_id is None and not got[None].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["plain", "words", "make", "sense", "here", "today"]) for _ in range(40)) for _ in range(60)]
    junk = [" ".join(rng.choice(["BUY!!", "***", "NOW###", "x"]) for _ in range(40)) for _ in range(40)]
    rows = [(k, x, 1) for k, x in enumerate(good)] + [(200 + k, x, 0) for k, x in enumerate(junk)] + [(500, None, None), (501, "", 1), (502, "word " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df, "quality", train=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (q == 1) for i, x, q in rows if q is not None and x and i % 3 == 1)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    one = quality.fit(df.where("quality = 1"), "quality")
    assert all(r.score > 0.5 for r in quality.score(df, one).collect())
    assert quality.fit(df.limit(0), "quality").bias == 0


def test_mix_windows(spark):
    rng = random.Random(6)
    rows = [(k, "x", "en", rng.choice(["a"] * 6 + ["b", "c", None]), 1) for k in range(700)] + [(5, "y", "en", "a", 1), (None, "z", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOC)
    for clash in ("a", "total", "first", "start", "slots", "block", "names", "n", "t"):
        df = df.withColumn(clash, F.lit(1))
    out = mixing.mix(df, {"a": 3, "b": 2}, block_docs=4)
    got = out.collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.mix_source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    order = [next(iter(slots[k]))[0] for k in range(len(slots))]
    blocks = {s: order.count(s) for s in set(order)}
    use = {"a": 3, "b": 2}
    for p in mixing.plan_phases(blocks, {s: use.get(s, 1) for s in blocks}):
        total = sum(p.a.values())
        for s, w in p.a.items():
            done = 0
            for k in range(total * p.periods):
                done += order[p.start + k] == s
                assert abs(done - (k + 1) * w / total) < 1
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert mixing.mix(df.limit(0)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_lcs_words():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 8, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 8, rng.integers(0, 60)).astype(np.uint64)
        assert decontaminate.lcs_words(a, b) == lcs(a.tolist(), b.tolist())


def test_decontamination(spark):
    rng = random.Random(9)
    stop = ["the", "of", "and", "to"]
    word = lambda: rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60)))) for k in range(30)]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 300)))) for k in range(120)]
    want = set()
    for k in range(0, 60, 2):
        item = items[k % 30]
        w = rows[k][1].split()
        at = rng.randint(0, len(w))
        inner = item[1].split()
        if k % 3 == 0:  # a paraphrase: some words replaced
            for _ in range(len(inner) // 6):
                inner[rng.randrange(len(inner) - 4)] = word()
        rows[k] = (k, " ".join(w[:at] + [x.upper() for x in inner] + w[at:]))
        want.add((k, item[0]))
    rows += [(500, None), (501, ""), (502, "the of and to " * 30_000), (None, items[3][1])]
    df = docs_frame(spark, rows)
    bench = spark.createDataFrame(items + [(77, None), (78, " "), (None, "x y z")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 3)}
    kept = decontaminate.remove_contaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
