"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import re
from collections import Counter

from test_llm_ops import brute_components

import corpus_pipeline as cp
from fernlake.llm import registry, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = registry.table(spark, SF, "documents").select(*cp.COLUMNS)
    kept = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == cp.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert set(kept[k]) <= set(before)
    label = {r.doc_id: r.quality for r in registry.table(spark, SF, "labels").collect()}
    good = [(label[i] == 1) == (i in kept[0]) for i in label]
    assert sum(good) >= 0.97 * len(good)

    comp = brute_components([(i, r.text) for i, r in kept[0].items()], 5, 80, 100)
    assert set(kept[1]) == {i for i, c in comp.items() if i == c}

    plain = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0d]+", x.lower()))
    items = [plain(r.text) for r in registry.table(spark, SF, "benchmark").collect()]
    held = {i for i, r in kept[1].items() if any(x in plain(r.text) for x in items)}
    assert held and not held & set(kept[2])
    assert len(set(kept[1]) - set(kept[2]) - held) <= 0.02 * len(kept[1])

    auto = secrets.automaton()
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert not [s for s in secrets.scan(r.text, auto) if secrets.KINDS[s[1]] in secrets.BASE]
        if not secrets.scan(kept[2][i].text, auto):
            assert r == kept[2][i]
    assert set(kept[4]) == set(kept[3]) and len({r.position for r in kept[4].values()}) == len(kept[4])


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "slot", "position"} <= set(out.columns) and out.count() > 100


def _awkward(spark):
    """Good documents with nulls in every column, empty, blank and very long texts, repeated rows and clashing columns."""
    good = [r.doc_id for r in registry.table(spark, SF, "labels").where("quality = 1").collect()]
    docs = registry.table(spark, SF, "documents").select(*cp.COLUMNS)
    base = [tuple(r) for r in docs.where(docs.doc_id.isin(good)).orderBy("doc_id").limit(40).collect()]
    text = base[0][1]
    long = " ".join(f"{w}{k}" for k in range(3_000) for w in text.split()[:20])
    odd = [
        (None, text, "en", "web", 1), (None, None, None, None, None), (9001, None, "en", "web", None), (9002, "", "en", None, 0), (9003, " \n\t ", None, "web", 3),
        (9004, long, "en", "web", len(long)), (9004, long, "en", "web", len(long)), (9005, text, None, "", None), (9006, "password = abcdefgh12345", "en", "web", 24),
    ]
    rows = [(*r, 1.5, "mine", 7, [1]) for r in base + base[:3] + odd]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return spark.createDataFrame(rows, f"{kinds}, score double, id string, component_id long, position array<int>").repartition(5)


def test_awkward_rows_in_every_stage(spark):
    """Each stage on nulls, empty and long texts, repeats and columns that clash with its own."""
    docs = _awkward(spark)
    rows = [tuple(r)[:5] for r in docs.collect()]
    count = lambda xs: Counter(xs)
    quality, near, clean, secret, mixed = (stage(spark, docs, SF) for _, stage in cp.STAGES)
    for out in (quality, near, clean, secret):
        assert out.columns == cp.COLUMNS

    got = count(tuple(r) for r in quality.collect())
    assert not got - count(rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", set()).add(got[r] > 0)
    assert all(len(x) == 1 for x in by_text.values()), "rows of one text are decided alike"
    assert all(got[r] in (0, n) for r, n in count(rows).items())

    got = count(tuple(r) for r in near.collect())
    texts = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            texts[r[0]] = r[1]
    comp = brute_components(sorted(texts.items()), 5, 80, 100)
    assert got == count(r for r in rows if r[0] is None or comp.get(r[0], r[0]) == r[0])
    assert not [r for r in got if r[0] == 9005], "a copy of an earlier text goes"

    got = count(tuple(r) for r in clean.collect())
    assert not got - count(rows) and all(got[r] == n for r, n in count(rows).items() if r[0] is None or not (r[1] or "").strip())

    auto = secrets.automaton()
    got = count(tuple(r) for r in secret.collect())
    plain = count(r for r in rows if not secrets.scan(r[1], auto))
    assert not plain - got and sum(got.values()) == len(rows)
    assert [r for r in got if r[0] == 9006 and "abcdefgh12345" not in r[1] and r[4] == len(r[1])]

    got = mixed.collect()
    assert count(tuple(r[c] for c in cp.COLUMNS) for r in got) == count(rows)
    assert len({r.position for r in got}) == len(rows) and {r.mix_source for r in got if r.source is None} == {"(none)"}


def test_empty_tables_in_every_stage(spark):
    docs = _awkward(spark).limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() == 0
        assert out.columns[:5] == cp.COLUMNS or k == len(cp.STAGES) - 1
