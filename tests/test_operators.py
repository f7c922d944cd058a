"""Classifiers, evolution, loading, search and catalog on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import catalog, classify, documents, evolution, loader, search
from siltstone.plans import structures


def scores(spark, kind, text, columns=None):
    rows = spark.createDataFrame([(kind, text, columns)], "file_type string, text string, columns array<string>")
    r = classify.classify_files(rows, columns_col="columns").first()
    return r["sql_score"], r["nosql_score"], r["classification"], r["confidence"]


CASES = [
    ("json", '{"k": 87}', None, (7, 0, "SQL", 1.0)),
    ("json", '[{"id":1,"v":2},{"id":2,"v":3}]', None, (7, 4, "SQL", 0.43)),
    ("json", '[{"a":1},{"b":2}]', None, (0, 11, "NoSQL", 1.0)),
    ("csv", "", ["user_id", "n"], (8, 0, "SQL", 1.0)),
    ("csv", "", ["name"], (7, 0, "SQL", 1.0)),
    ("unknown", "a\tb\n1\t2\n3\t4", None, (3, 2, "SQL", 0.33)),
    ("ini", "a=1", None, (0, 2, "NoSQL", 1.0)),
    ("xml", "<r><p id='1'><n>A</n></p><p id='2'><n>B</n></p></r>", None, (5, 0, "SQL", 1.0)),
    ("html", "<table></table>", None, (3, 0, "SQL", 1.0)),
    ("html", "<p>x</p>", None, (0, 0, "SQL", 0.0)),
    ("text", "one line", None, (0, 3, "NoSQL", 1.0)),
    ("text", "x" * 5001, None, (0, 5, "NoSQL", 1.0)),
    ("text", "a,b\n1,2\n", None, (3, 3, "SQL", 0.0)),
    ("pdf", "short", None, (0, 3, "NoSQL", 1.0)),
    ("docx", "x" * 3001, None, (0, 5, "NoSQL", 1.0)),
    ("yaml", "a: 1\nb: 2", None, (6, 0, "SQL", 1.0)),
    ("unknown", '{"k": 87}', None, (7, 0, "SQL", 1.0)),
    ("json", "{broken", None, (0, 2, "NoSQL", 1.0)),
    ("text", None, None, (0, 3, "NoSQL", 1.0)),
]


@pytest.mark.parametrize(("kind", "text", "columns", "want"), CASES)
def test_classification(spark, kind, text, columns, want):
    assert scores(spark, kind, text, columns) == want


def test_deep_json_does_not_overflow(spark):
    depth = 900
    assert classify.nesting(json.loads("[" * depth + "]" * depth)) == depth - 1
    assert scores(spark, "json", "[" * depth + "1" + "]" * depth)[2] == "NoSQL"


@pytest.mark.parametrize(("ratio", "new", "attrs", "want"), [(1.0, 0, 5, "same_table"), (1.0, 1, 5, "evolved_table"), (0.7, 3, 10, "evolved_table"), (0.6, 4, 10, "evolved_table_jsonb"), (0.5, 3, 6, "evolved_table"), (0.49, 3, 6, "new_table")])
def test_decision(spark, ratio, new, attrs, want):
    df = spark.createDataFrame([(ratio, new, attrs)], "r double, n int, a int")
    assert df.select(evolution.decision("r", "n", "a")).first()[0] == want


def test_decide(spark):
    cat = spark.createDataFrame([("goods", 1, "id"), ("goods", 2, "price"), ("goods", 3, "stock"), ("goods", 4, "name"), ("people", 1, "email"), ("people", 2, "phone")], "table_name string, ordinal int, column_name string")
    new = spark.createDataFrame([("a", 0, "cost"), ("a", 1, "qty"), ("a", 2, "product_name"), ("b", 0, "zzz"), ("b", 1, "qqq"), ("c", 0, "mobile"), ("c", 1, "mail")], "source string, ordinal int, attribute string")
    got = {r["source"]: r for r in evolution.decide(new, cat, None).collect()}
    assert got["a"]["decision"] == "same_table" and got["a"]["table_name"] == "goods" and got["a"]["mapping"] == {"cost": "price", "qty": "stock", "product_name": "name"}
    assert got["b"]["decision"] == "new_table" and got["b"]["table_name"] == "table_zzz_qqq" and got["b"]["new_fields"] == ["zzz", "qqq"]
    assert got["c"]["table_name"] == "people"
    empty = evolution.decide(new, cat.where("false"), None).collect()
    assert {r["decision"] for r in empty} == {"new_table"}


def test_conflicts_and_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 0), (3, "y", 1), (3, "z", 2), (None, "n", 3)], "id int, v string, seq int")
    got = loader.insert_if_absent(new, old, "id", "seq").select("id", "v").collect()
    assert {tuple(r) for r in got} == {(3, "y"), (None, "n")}
    rows = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "v string, seq int")
    target = spark.createDataFrame([(5,)], "id int")
    assert {(r["v"], r["id"]) for r in loader.surrogate_keys(rows, target, "id", ["seq"]).collect()} == {("p", 6), ("q", 7), ("r", 8)}
    assert {r["id"] for r in loader.surrogate_keys(rows, target.where("false"), "id", ["seq"]).collect()} == {1, 2, 3}
    assert loader.surrogate_keys(rows.where("false"), target, "id", ["seq"]).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([("a", [1.0], "1"), ("b", [2.0], "1")], "id string, e array<double>, v string")
    new = spark.createDataFrame([("b", [3.0], "2", 0), ("b", [4.0], "3", 1), ("c", None, "4", 2), (None, [5.0], "5", 3)], "id string, e array<double>, v string, seq int")
    assert {(r["id"], r["v"]) for r in loader.upsert(old, new, "id", "seq", ["e"]).collect()} == {("a", "1"), ("b", "3")}


def test_mapped_rows(spark):
    rows = spark.createDataFrame([("Shoes", "500", None)], "Product string, Cost string, colour string")
    target = {"name": "string", "price": "int", "note": "string", "extra": "string"}
    r = loader.mapped_rows(rows, target, {"product": "name", "Cost": "price"}, (), ("colour",)).first()
    assert (r["name"], r["price"], r["note"], json.loads(r["extra"])) == ("Shoes", 500, None, {"colour": None})


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS goods_t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert loader.create_table(spark, "goods_t", rows) and not loader.create_table(spark, "goods_t", rows)
    assert loader.table_key(spark, "goods_t") == "id"
    assert loader.insert_rows(spark, "goods_t", rows) == 2
    more = spark.createDataFrame([(2, "x", 9), (3, "c", 8)], "id int, name string, price int")
    assert loader.insert_rows(spark, "goods_t", more, {"id": "id", "name": "name"}, ["price"]) == 1
    got = {tuple(r) for r in spark.table("goods_t").select("id", "name", "price").collect()}
    assert got == {(1, "a", None), (2, "b", None), (3, "c", 8)}
    keyless = spark.createDataFrame([("d", "w", "k")], "name string, weird string, odd string")
    assert loader.insert_rows(spark, "goods_t", keyless, {"name": "name"}, (), ["weird", "odd"]) == 1
    r = spark.table("goods_t").where("name = 'd'").first()
    assert r["id"] == 4 and json.loads(r["extra"]) == {"weird": "w", "odd": "k"}
    assert loader.column_types(rows) == {"id": "INTEGER", "name": "VARCHAR(50)"}
    assert "goods_t" in loader.clear_tables(spark) and spark.catalog.tableExists("goods_t")
    loader.clear_tables(spark, confirm=True)
    assert not spark.catalog.tableExists("goods_t")


def test_documents(spark):
    rows = spark.createDataFrame([("f1", "test_document.txt", "This is a test document for NoSQL processing. It contains some text content.", None), ("f2", "test.pdf", None, "t"), ("f3", "b.txt", "  ", "t")], "file_id string, file_name string, text string, tenant_id string")
    meta = {r["file_id"]: r for r in documents.metadata(rows).collect()}
    assert meta["f1"]["collection_hint"] == "documents" and meta["f1"]["tenant_id"] == "tenant_default"
    assert meta["f2"]["summary"] == "PDF document: test.pdf"
    assert documents.chunks(rows).count() == 3 and documents.nodes(rows).count() == 6
    media = documents.media_fallback(spark.createDataFrame([("test_video.mp4",)], "file_name string")).first()
    assert (media["summary"], media["collection_hint"], media["modality"]) == ("Video file test_video.mp4", "media_assets", "video")
    names = spark.createDataFrame([("d", "a.txt", i) for i in range(3)] + [("e", "a.txt", 9)], "f string, n string, o int")
    assert sorted(r["stored_name"] for r in documents.stored_names(names, "f", "n", "o").collect()) == ["a.txt", "a.txt", "a_1.txt", "a_2.txt"]


def test_search(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0], "text"), ("b", [0.0, 1.0], "video"), ("c", [1.0, 0.0], "image"), ("d", None, "text"), ("e", [1.0], "text")], "node_id string, embedding array<float>, modality string")
    hits = search.nearest(nodes, [1.0, 0.0], 2)
    assert [(r["node_id"], r["distance"], r["similarity"]) for r in hits.collect()] == [("a", 0.0, 1.0), ("c", 0.0, 1.0)]
    assert [r["node_id"] for r in search.media_filter(hits, "a video").collect()] == ["c"]
    only_text = hits.where("modality = 'text'")
    assert [r["node_id"] for r in search.media_filter(only_text, "a song").collect()] == ["a"]
    assert search.media_filter(hits, "words").count() == 2
    assert [search.clamp_limit(x) for x in (None, "7", 0, 99, "x")] == [10, 7, 1, 50, 10]
    meta = spark.createDataFrame([("1", "A.B report"), ("2", None)], "file_id string, original_name string")
    assert [r["file_id"] for r in search.metadata_search(meta, "a.b", 5).collect()] == ["1"]
    assert search.metadata_search(meta, "axb", 5).count() == 0 and search.metadata_search(meta, "", 5).count() == 0
    chain = search.first_filled(("x", meta.where("false")), ("y", meta), ("z", meta))
    assert {r["source"] for r in chain.collect()} == {"y"}
    pooled = search.mean_pool(spark.createDataFrame([("k", [3.0, 0.0]), ("k", [0.0, 4.0]), ("z", [0.0, 0.0])], "k string, v array<double>"), "k", "v")
    got = {r["k"]: [round(x, 4) for x in r["embedding"]] for r in pooled.collect()}
    assert got == {"k": [0.6, 0.8], "z": [0.0, 0.0]}
    captions = spark.createDataFrame([("v", 1, "cat"), ("v", 0, "dog"), ("v", 2, "dog"), ("v", 3, None)], "f string, o int, t string")
    assert search.joined_captions(captions, "f", "o", "t").first()["caption"] == "dog | cat"


def test_catalog(spark):
    cat = catalog.columns_of(spark, {"t": spark.createDataFrame([(1, "x")], "user_id int, name string")})
    assert [(r["column_name"], r["is_id"]) for r in cat.orderBy("ordinal").collect()] == [("user_id", True), ("name", False)]
    assert [r["norm_name"] for r in catalog.inverted_index(cat).collect()] == ["name"]
    paths = spark.createDataFrame([("/s/b/x.txt", 10), ("/s/a.txt", 2048), ("/s/.git/c", 1)], "path string, length bigint")
    got = [(r["parent"], r["place"], r["name"], r["kind"]) for r in catalog.storage_entries(paths, "/s").orderBy("parent", "place").collect()]
    assert got == [("", 1, "b", "folder"), ("", 2, "a.txt", "file"), ("b", 1, "x.txt", "file")]
    files_ = spark.createDataFrame([("Report one", "a.txt", 1, "general", "text", 5), ("Report two", "a.txt", 2, "general", "text", 9)], "s string, n string, o int, c string, m string, b bigint")
    tree = catalog.placed_tree(catalog.tree_rows(files_, "s", "n", "o", "c", "m", "b")).collect()
    assert [(r["folder"], r["size"], r["place"]) for r in tree] == [("Report", "9 B", 1)]


def test_nearest_for_every_query(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [1.0, None])]
    nodes = spark.createDataFrame(rows, "node_id bigint, embedding array<float>").repartition(5)
    queries = nodes.where("node_id % 10 = 0 or node_id > 60")
    got = search.nearest_each(nodes, queries, 4, block=3).orderBy("query_id", "distance", "node_id").collect()
    want = []
    for i in range(0, 60, 10):
        near = sorted((float((i % 7 - j % 7) ** 2 + (i % 5 - j % 5) ** 2), j) for j in range(60))[:4]
        want += [(i, j, d) for d, j in near]
    want.append((61, 61, 0.0))
    assert [(r["query_id"], r["node_id"], r["distance"]) for r in got] == want
    assert search.nearest_each(nodes, queries.where("false"), 4).count() == 0


def test_media_filter_for_each_query(spark):
    hits = spark.createDataFrame([(1, "image"), (1, "text"), (2, "text")], "q int, modality string")
    assert sorted(map(tuple, search.media_filter(hits, "a video", "q").collect())) == [(1, "image"), (2, "text")]


def test_captions_are_whole(spark, tmp_path):
    rows = [("f", 1, "a red house by the sea"), ("f", 0, "a red house on a hill"), ("f", 2, "a red house by the sea")]
    nodes = spark.createDataFrame(rows, "file_id string, node_no bigint, text string")
    nodes.selectExpr("named_struct('file_id', file_id) AS metadata", "node_no", "text").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    got = structures.caption_join(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("f", "a red house on a hill | a red house by the sea")]
