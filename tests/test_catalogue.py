"""Every query of the catalogue on the smallest tables, against its SQL."""

import os

import duckdb
import pytest

from segloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([r[k] for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["epub_segments", "docx_segments", "epub_render", "docx_render"])
def test_archives_read_back(spark, name):
    got = catalogue.QUERIES[name](spark, SF).collect()
    assert got and all(r.error is None for r in got)


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_rendered_archives_hold_old_and_new(spark):
    from segloom.sources import zipped

    old = [r.text for r in catalogue.QUERIES["docx_segments"](spark, SF).collect() if r.doc_id == 2]
    new = [r.text for r in sorted(catalogue.QUERIES["docx_render"](spark, SF).collect(), key=lambda r: (r.doc_id, r.seg_id)) if r.doc_id == 2]
    want = [y for i, x in enumerate(old) for y in ([x, f"T & {x.upper()}"] if i % 2 == 0 else [x])]
    assert new == want
    with pytest.raises(ValueError):
        zipped.docx_render(zipped.docx_of(["a"]), {0: "b"}, "replace")
