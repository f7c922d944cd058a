"""Readers, streams and the engine on generated files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.sources import readers
from siltstone.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    files = {
        "people.xml": '<r><p id="1"><n>A</n></p><p id="2"><n>B</n></p></r>', "leaf.xml": '<r a="1">hi</r>', "obj.json": '{"a": 1}', "arr.json": '[{"a": 1}, {"a": 2}]', "num.json": "5",
        "list.yaml": "- a: 1\n- a: 2\n", "table.html": "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr><tr><td>short</td></tr></table>", "comma.txt": "a,b\n1,2\n3,4\n",
        "tab.txt": "a\tb\n1\t2\n", "prose.txt": "Just some words, here.\nAnd more", "single.txt": "one line", "any.pdf": "%PDF-1.4", "conf.ini": "a=1\n# c\nb=x=y\n", "bad.json": "{", "goods.csv": "id,price\n1,2\n2,3\n",
    }
    for name, text in files.items():
        (d / name).write_text(text)
    (d / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (d / "sub").mkdir()
    (d / "sub" / "pic.png").write_bytes(b"no image")
    with zipfile.ZipFile(d / "any.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>')
    return d


def test_file_rows(spark, folder):
    rows = readers.file_rows(readers.list_files(spark, str(folder))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    get = lambda n: [r["fields"] for r in sorted(by.get(n, []), key=lambda r: r["ordinal"])]
    assert get("people.xml") == [{"id": "1", "n": "A"}, {"id": "2", "n": "B"}] and get("leaf.xml") == [{"a": "1", "text": "hi"}]
    assert (len(get("obj.json")), len(get("arr.json")), len(get("num.json")), len(get("list.yaml"))) == (1, 2, 0, 2)
    assert get("table.html") == [{"h": "1", "k": "2"}] and get("comma.txt") == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}] and get("tab.txt") == [{"a": "1", "b": "2"}]
    assert get("prose.txt") == get("single.txt") == get("any.pdf") == get("any.docx") == []
    assert get("conf.ini") == [{"a": "1", "b": "x=y"}] and "JSONDecodeError" in by["bad.json"][0]["error"]
    assert "pic.png" not in by


def test_texts_and_media(spark, folder):
    listed = readers.list_files(spark, str(folder))
    got = {r["path"].rsplit("/", 1)[1]: r["t"] for r in listed.select("path", readers.full_text("content", "extension").alias("t")).collect()}
    assert got["latin.txt"] == "caf\xe9" and got["any.docx"] == "Hello\nWorld" and got["any.pdf"] == ""
    assert [r["caption"] for r in readers.media_captions(listed).collect()] == ["Image file pic.png"]


def test_spark_readers(spark, folder):
    assert readers.read_json(spark, str(folder / "arr.json")).count() == 2 and readers.read_json(spark, str(folder / "num.json")).count() == 0
    assert {tuple(r) for r in readers.read_xml(spark, str(folder / "people.xml"), "p").select("id", "n").collect()} == {("1", "A"), ("2", "B")}
    assert [tuple(r) for r in readers.read_csv(spark, str(folder / "goods.csv")).collect()] == [("1", "2"), ("2", "3")]


def test_sniff(spark):
    rows = [("a,b\n1,2",), ("a\tb\n1\t2",), ("a,b\n1",), ("words",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(readers.sniff_delimiter("t")).collect()] == [",", "\t", None, None, None, None]


@pytest.fixture
def clean(spark):
    def drop():
        for t in spark.catalog.listTables():
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")

    drop()
    yield
    drop()


def test_typed_loads(spark, tmp_path, clean):
    d = tmp_path / "up"
    d.mkdir()
    (d / "a_goods.csv").write_text("product_name,price,stock,weight,sold,note\nShoe,500,10,1.5,True,plain-looking text\nHat,20,,2,False,\n")
    (d / "b_more.csv").write_text("product_name,price,stock,weight,sold,note\nSock,7,3,0.25,True,x\n")
    (d / "c_stock.csv").write_text("name,cost,quantity,colour\nScarf,9,4,red\n")
    (d / "d_people.json").write_text('[{"person_id": 7, "email": "a@b.c", "born": "2001-02-03T04:05:06", "tags": ["x"]}, {"person_id": 7, "email": "twice", "born": null, "tags": []}, {"person_id": 8, "email": null, "born": null, "tags": null}]')
    engine = Engine(spark, str(tmp_path / "store"))
    loads = {t["path"].rsplit("/", 1)[1]: t for t in engine.ingest(str(d)).tables}
    assert loads["a_goods.csv"]["table_name"] == "table_product_name_price_stock" and loads["a_goods.csv"]["files"] == 2 and loads["a_goods.csv"]["rows_inserted"] == 3
    table = spark.table("table_product_name_price_stock")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    assert kinds == {"product_name": "string", "price": "bigint", "stock": "double", "weight": "double", "sold": "boolean", "note": "string"} | {k: kinds[k] for k in kinds if k in ("colour", "extra")}
    declared = {c["name"]: c["type"] for c in engine.table_details("table_product_name_price_stock")["columns"]}
    assert declared["price"] == "INTEGER" and declared["stock"] == "NUMERIC" and declared["product_name"] == "VARCHAR(50)" and declared["note"] == "TEXT"
    got = {r["product_name"]: r for r in table.collect()}
    assert (got["Shoe"]["price"], got["Shoe"]["stock"], got["Shoe"]["sold"], got["Hat"]["stock"], got["Sock"]["weight"]) == (500, 10.0, True, None, 0.25)
    third = loads["c_stock.csv"]
    assert third["decision"] == "evolved_table" and third["table_name"] == "table_product_name_price_stock" and third["new_fields"] == ["colour"]
    assert (got["Scarf"]["price"], got["Scarf"]["colour"], got["Shoe"]["colour"]) == (9, "red", None)
    people = spark.table(loads["d_people.json"]["table_name"])
    assert people.schema["person_id"].dataType.simpleString() == "bigint" and people.schema["born"].dataType.simpleString() == "timestamp"
    assert {(r["person_id"], r["email"], r["tags"]) for r in people.collect()} == {(7, "a@b.c", '["x"]'), (8, None, None)}
    assert engine.table_details(loads["d_people.json"]["table_name"])["primary_key"] == "person_id"


def test_stored_documents(spark, tmp_path, clean):
    from siltstone.functions.encoders import hashing_encoder

    d, root = tmp_path / "up", tmp_path / "store"
    (d / "sub").mkdir(parents=True)
    (d / "invoice.txt").write_text("The invoice of the warehouse. " * 60)
    (d / "sub" / "invoice.txt").write_text("Another invoice of the warehouse.")
    (d / "pic.png").write_bytes(b"no image")
    (d / "film.mp4").write_bytes(b"no film")
    engine = Engine(spark, str(root), hashing_encoder(32))
    report = engine.ingest(str(d))
    meta = {(r["original_name"], r["storage_path"]): r for r in engine.files().collect()}
    assert sorted(meta) == [("film.mp4", "video/media_assets/film.mp4"), ("invoice.txt", "text/general/invoice.txt"), ("invoice.txt", "text/general/invoice_1.txt"), ("pic.png", "image/media_assets/pic.png")]
    by = {r["original_name"]: r for r in meta.values()}
    assert by["pic.png"]["summary"] == "Image file pic.png" and by["film.mp4"]["summary"] == "Video file film.mp4"
    assert (root / "text/general/invoice_1.txt").exists() and by["pic.png"]["size_bytes"] == 8
    assert engine.chunks().count() == 3 and engine.nodes().count() == 2 + 3
    assert {r["metadata"]["path"] for r in engine.nodes().collect()} == {"text/general/invoice.txt", "text/general/invoice_1.txt"}
    again = engine.ingest(str(d))
    assert again.files.count() == 0 and engine.files().count() == 4 and engine.nodes().count() == 5
    (d / "sub" / "more").mkdir()
    (d / "sub" / "more" / "invoice.txt").write_text("A third invoice.")
    assert engine.ingest(str(d)).files.first()["storage_path"] == "text/general/invoice_2.txt"
    assert report.files.count() == 4
    hits = engine.search("another invoice of the warehouse", 3).collect()
    assert {r["source"] for r in hits} == {"semantic"} and hits[0]["path"].startswith("text/general/invoice")
    stats = engine.stats().first()
    assert (stats["total_files"], stats["media_directories"], stats["recent_uploads"]) == (5, 2, 5) and "image: 8 B" in stats["storage_breakdown"]


def test_media_without_and_with_encoders(spark, tmp_path):
    from siltstone.operators import media

    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.mp3").write_bytes(b"y")
    listed = readers.list_files(spark, str(tmp_path))
    plain = {r["path"]: r for r in media.media_metadata(media.encode_files(listed)).selectExpr("original_name AS path", "summary", "collection_hint", "modality").collect()}
    assert (plain["a.jpg"]["summary"], plain["a.jpg"]["collection_hint"], plain["b.mp3"]["summary"]) == ("Image file a.jpg", "media_assets", "Audio file b.mp3")
    seen = lambda content, path: F.struct(F.lit("a photo of a cat").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    encoded = {r["modality"]: r for r in media.encode_files(listed, {"image": seen}).collect()}
    assert (encoded["image"]["text"], encoded["image"]["embedding"], encoded["audio"]["text"], encoded["audio"]["embedding"]) == ("a photo of a cat", [1.0], "Audio file b.mp3", None)
    assert {r["collection_hint"] for r in media.media_metadata(media.encode_files(listed, {"image": seen})).collect()} == {"media", "media_assets"}
    assert media.media_nodes(media.encode_files(listed)).count() == 2


def test_kinds_of_columns():
    assert [readers.column_kind(v) for v in (["1", "-2"], ["1", ""], ["1", "2.5"], ["1e3"], ["True", "False"], ["x", "1"], ["", None], [])] == ["integer", "double", "double", "double", "boolean", "string", "string", "string"]
    assert [readers.kind_of(v) for v in (None, True, 3, 2.5, "s", [1], {})] == [None, "boolean", "integer", "double", "string", "json", "json"]


def test_large_files_are_read_in_splits(spark, folder, monkeypatch, clean):
    monkeypatch.setattr(readers, "LARGE_FILE", 10)
    (folder / "goods.csv").write_text("id,price\n1,2\n2,3.5\n")
    rows = readers.large_csv_rows(spark, str(folder / "goods.csv")).collect()
    assert [(dict(r["fields"]), r["kinds"]) for r in rows] == [({"id": "1", "price": "2"}, ["integer", "double"]), ({"id": "2", "price": "3.5"}, ["integer", "double"])]
    done = Engine(spark, "/store").load(readers.list_files(spark, str(folder / "goods.csv")))
    assert done[0]["rows_inserted"] == 2 and spark.table("table_id_price").schema["price"].dataType.simpleString() == "double"


def test_engine(spark, folder, tmp_path, clean):
    engine = Engine(spark, str(tmp_path / "store"), None)
    for name in ("people.xml", "leaf.xml", "bad.json", "table.html", "list.yaml", "obj.json", "arr.json", "num.json", "conf.ini", "comma.txt", "tab.txt"):
        (folder / name).unlink()
    report = engine.ingest(str(folder))
    kinds = {r["path"].rsplit("/", 1)[1]: r["classification"] for r in report.classified.collect()}
    assert kinds["goods.csv"] == "SQL" and kinds["prose.txt"] == "NoSQL"
    assert [t["rows_inserted"] for t in report.tables if t["path"].endswith("goods.csv")] == [2]
    assert report.files.where("original_name = 'any.docx'").first()["summary"].startswith("Hello")
    assert report.chunks.count() == engine.chunks().count() > 0 and report.nodes.count() == 0, "no encoder, no nodes"
    again = spark.createDataFrame([("3", "9", "x"), ("2", "0", "y")], "id string, price string, colour string")
    done = engine.load_rows(again)
    assert (done["decision"], done["table_name"], done["rows_inserted"]) == ("evolved_table", "table_id_price", 1)
    assert engine.tables().first()["row_count"] == 3 and engine.table_details("table_id_price")["primary_key"] == "id"
    assert [r["source"] for r in engine.search("hello", 5).collect()] == ["metadata"]
    root = str(tmp_path / "store")
    assert engine.resolve_path("a/../b.txt") == f"{root}/b.txt" and engine.resolve_path("../x") is None
    assert engine.file_tree().count() > 0 and engine.database_state().count() > 0
    assert engine.health()["spark"] == spark.version


def test_stream(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_documents(ingest.watch_folder(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    files = spark.read.parquet(out + "/files")
    assert files.count() == len([p for p in folder.iterdir() if p.is_file()])
    assert spark.read.parquet(out + "/chunks").where("collection is not null").count() >= files.count()


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "ev"))
    q = ingest.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_broken_inputs():
    assert readers.html_rows("<p>none</p>") == [] and readers.html_rows("<table></table>") == []
    assert readers.decode_text(b"\xff\xfe") == "\xff\xfe"
    with pytest.raises(Exception):
        readers.excel_rows(io.BytesIO(b"x").getvalue())


def test_storage_copies(spark, folder, tmp_path):
    from siltstone.sources import storage

    (folder / "sub" / "goods.csv").write_text("x")
    listed = readers.list_files(spark, str(folder)).where("extension = 'csv'").withColumn("collection", F.lit("orders")).withColumn("modality", F.lit(None).cast("string"))
    done = storage.store_files(storage.placed_files(listed), str(tmp_path / "store")).collect()
    assert sorted(r["storage_path"] for r in done) == ["text/orders/goods.csv", "text/orders/goods_1.csv"] and all(r["error"] is None for r in done)
    assert (tmp_path / "store" / "text" / "orders" / "goods_1.csv").read_text() in ("x", "id,price\n1,2\n2,3\n")
    by_path = storage.store_files(storage.placed_files(listed.drop("content")), str(tmp_path / "other")).collect()
    assert {(r["storage_path"], r["bytes"], r["error"]) for r in by_path} == {(r["storage_path"], r["bytes"], None) for r in done}
    assert storage.local_path("file:/a%20b/c.txt") == "/a b/c.txt" and storage.local_path("hdfs://h/a") is None
    outside = listed.select("path", "content", F.lit("../../out.bin").alias("storage_path"))
    assert all("outside" in r["error"] for r in storage.store_files(outside, str(tmp_path / "store")).collect())


def test_headers(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r["h"] for r in readers.list_files(spark, str(folder)).select("path", readers.header_names("content", "extension").alias("h")).collect()}
    assert got["goods.csv"] == ["id", "price"] and got["prose.txt"] is None and got["any.pdf"] is None


def test_encoder(spark):
    from siltstone.functions.encoders import hashing_encoder, plain_encode

    df = spark.createDataFrame([("the price sheet",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(hashing_encoder(32)(F.col("t"))).collect()]
    assert got[0] == plain_encode("the price sheet", 32) and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1:] == [None, None]
    engine = Engine(spark, "/store", hashing_encoder(32))
    nodes = spark.createDataFrame([("a", "price sheet"), ("b", "zebra")], "node_id string, text string").withColumn("embedding", hashing_encoder(32)(F.col("text"))).withColumn("metadata", F.struct(F.lit("p").alias("path"), F.lit("text").alias("modality")))
    assert engine.search("price sheet", 1, nodes=nodes).first()["id"] == "a"


def test_tree_matches(spark):
    from siltstone.functions import files
    from siltstone.operators import catalog

    rows = spark.createDataFrame([("Invoices", "a.mp4"), ("Other", "INVOICE.pdf"), ("Other", None)], "folder string, file string")
    assert catalog.tree_matches(rows, "invoice").count() == 2 and catalog.tree_matches(rows, "").count() == 3
    assert [r[0] for r in rows.select(files.is_video_node(files.mime_type("file"), F.coalesce("file", F.lit("")))).collect()] == [True, False, False]
