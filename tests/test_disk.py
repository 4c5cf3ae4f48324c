"""Bytes that queries write to the shared folder, of all tables, deleted ones too, as a multiple of their input."""

from pathlib import Path

import pytest

from fernlake import catalog
from fernlake.plans.scratch import Scratch

SF = "/root/testdata/sf0.01"
MOST = {"outline_path": 1.5, "embed_text_view": 1.5, "restore_unparsed_text": 1.5, "prune_empty_leaves": 1.5, "graft_documents": 1.5, "parsed_links": 1.5, "ingest_grafted": 1.5, "ingest_pipeline": 1.5, "curate_graph": 2.5}


def size(path):
    return sum(f.stat().st_size for f in ([path] if path.is_file() else path.rglob("*.parquet")))


@pytest.mark.parametrize("name", MOST)
def test_tables_written(spark, monkeypatch, name):
    sizes, keep = [], Scratch.keep

    def kept(self, df, *args, **kwargs):
        table = keep(self, df, *args, **kwargs)
        sizes.append(size(Path(table.inputFiles()[0].removeprefix("file://")).parent) if table.inputFiles() else 0)
        return table

    monkeypatch.setattr(Scratch, "keep", kept)
    catalog.queries()[name](spark, SF)
    given = size(Path(SF, "documents.parquet")) + (size(Path(SF, "pages.parquet")) if name in ("ingest_grafted", "graft_documents", "parsed_links") else 0)
    print(name, "wrote", round(sum(sizes) / given, 2), "x input")
    assert sum(sizes) < MOST[name] * given
