from pathlib import Path

import duckdb
import pytest

from tektonis.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

FOUND = {
    "p1_found": [("src", "string"), ("row_id", "bigint"), ("node", "string"), ("ref_id", "bigint")],
    "p3_found": [("box_id", "bigint"), ("prop", "string"), ("line_no", "bigint"), ("kind", "string"), ("repaired", "string")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("sent_no", "bigint"), ("start_char", "bigint"), ("end_char", "bigint")],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = sorted(map(tuple, Q.QUERIES[name](spark, SF).collect()))
    assert got == sorted(con.sql(Q.SQL[name]).fetchall())


def test_sentences_tile_the_text(spark):
    spans = {}
    for r in Q.p8_found(spark, SF).collect():
        spans.setdefault(r.doc_id, []).append((r.sent_no, r.start_char, r.end_char))
    for d, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect():
        at = 0
        for n, (no, a, b) in enumerate(sorted(spans.get(d, [])), 1):
            assert no == n and not text[at:a].strip() and text[a:b] == text[a:b].strip() and b > a
            at = b
        assert not text[at:].strip()
