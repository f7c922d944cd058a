"""Every registered query against its SQL on the small tables."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from siltstone.functions.encoders import plain_encode
from siltstone.plans import catalogue, quality

ORACLES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        path = os.path.join(data, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    def one(v):
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else "" if v is None else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, data, duck, name):
    got = entry.queries()[name](spark, data)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())


def test_queries_without_sql_are_tested_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"p2_table", "p3_valid", "semantic_search", "text_embeddings"}


def nodes_of(duck):
    """(node_id, text) of all documents, from the SQL of the chunks and summaries."""
    found = {f"{f}:file": s for f, s in duck.execute(f"SELECT d.file_id, m.summary FROM documents d JOIN ({entry.oracle_sql()['doc_summary5']}) m USING (doc_id)").fetchall()}
    return found | {f"{f}:chunk:{i}": t for f, i, t in duck.execute(f"SELECT d.file_id, c.chunk_index, c.text FROM documents d JOIN ({entry.oracle_sql()['doc_chunks']}) c USING (doc_id)").fetchall()}


def test_text_embeddings(spark, data, duck):
    got = {r["node_id"]: r["squared_norm"] for r in entry.queries()["text_embeddings"](spark, data).collect()}
    want = {k: plain_encode(t) for k, t in nodes_of(duck).items()}
    assert got == {k: None if v is None else 1.0 for k, v in want.items()}


def test_semantic_search(spark, data, duck):
    nodes = {k: np.array(v, np.float64) for k, t in nodes_of(duck).items() if (v := plain_encode(t)) is not None}
    asked = [f"{f}:file" for (f,) in duck.execute("SELECT file_id FROM documents WHERE doc_id % 100 = 0").fetchall()]
    got: dict = {}
    for r in entry.queries()["semantic_search"](spark, data).orderBy("query_id", "distance", "node_id").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert asked and set(got) == {a for a in asked if a in nodes}
    for q, rows in got.items():
        near = sorted((float(((v - nodes[q]) ** 2).sum()), k) for k, v in nodes.items())[:8]
        assert [r["distance"] for r in rows] == pytest.approx([d for d, _ in near], abs=2e-5)
        assert all(r["distance"] == pytest.approx(float(((nodes[r["node_id"]] - nodes[q]) ** 2).sum()), abs=2e-5) for r in rows)
        assert all(r["is_chunk"] == (":chunk:" in r["node_id"]) for r in rows)


def test_valid_rows(spark, data, duck):
    sql = f"""WITH {quality.SQL_RECORDS} SELECT c.file_no, c.row_no, c.table_name, coalesce(column_name, name) AS column_name, CASE WHEN kind IS NULL OR kind IN ('TEXT', 'VARCHAR') THEN nullif(v, '') END AS text,
        CASE WHEN kind = 'INTEGER' THEN CAST(nullif(regexp_replace(v, '^\\+', ''), '') AS INTEGER) END AS integer, CASE WHEN kind = 'NUMERIC' THEN CAST(nullif(v, '') AS DOUBLE) END AS numeric,
        CASE WHEN kind = 'BOOLEAN' THEN CAST(nullif(lower(v), '') AS BOOLEAN) END AS flag, CASE WHEN kind = 'TIMESTAMP' THEN CAST(nullif(replace(v, 'T', ' '), '') AS TIMESTAMP) END AS moment
        FROM cells c JOIN judged j ON j.file_no = c.file_no AND j.row_no = c.row_no WHERE reason IS NULL"""
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    got = entry.queries()["p3_valid"](spark, data).select(*columns).collect()
    assert len(got) > 1000 and plain(tuple(r) for r in got) == plain(want.fetchall())


def test_consistent_table(spark, data, duck):
    """Every readable line is one row; values under the plain names are read as they are, and hardly any field stays unread."""
    lines = duck.execute(f"WITH {quality.SQL_FIELDS} SELECT feed, report_file, line_no, load, map_from_entries(list((field, value))) FROM fields GROUP BY ALL").fetchall()
    got = {(r["feed"], r["report_file"], r["line_no"]): r for r in entry.queries()["p2_table"](spark, data).collect()}
    assert len(got) == len(lines) > 100
    for feed, file, no, load, held in lines:
        r = got[feed, file, no]
        assert r["file_id"] == load
        if (raw := held.get("match_ratio")) and raw.replace(".", "", 1).isdigit() and float(raw) <= 1:
            assert r["match_ratio"] == pytest.approx(float(raw))
        if (raw := held.get("decision")) and raw.startswith('"'):
            assert r["decision"] == raw.strip('"')
    for column in ("decision", "match_ratio", "mapping"):
        assert sum(r[column] is not None for r in got.values()) > 0.6 * len(got), column
    plain_lists = [k for *k, _, held in lines if (held.get("new_fields") or "").startswith("[")]
    assert plain_lists and all(got[tuple(k)]["new_fields"] is not None for k in plain_lists)
    assert sum(len(r["failed_casts"]) > 0 for r in got.values()) < 0.1 * len(got)


def test_flagship(spark, data):
    assert entry.entry(spark).count() > 0
