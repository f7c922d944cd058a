"""Attribute, text and file functions against hand-derived values."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.functions import files, texts


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize_and_ids(spark):
    names = ["Email Address", "productName", "cost_per_unit", "  user_id  ", "_id", None, ""]
    assert values(spark, [(n,) for n in names], "n string", A.normalize("n")) == [("email_address",), ("productname",), ("cost_per_unit",), ("user_id",), ("id",), (None,), ("",)]
    yes, no = ["id", "user_id", "id_code", "pk", "_id", "Primary Key"], ["productId", "name", "width", "keyword"]
    assert values(spark, [(n,) for n in yes + no], "n string", A.is_id("n")) == [(True,)] * 6 + [(False,)] * 4
    assert [A.plain_is_id(n) for n in yes + no] == [True] * 6 + [False] * 4


def test_synonyms_and_tokens(spark):
    names = ["cost", "qty", "E-Mail", "title", "nation", "zebra"]
    assert values(spark, [(n,) for n in names], "n string", A.synonym_group("n")) == [("price",), ("stock",), ("email",), ("name",), ("country",), (None,)]
    assert values(spark, [("product_name",), ("productName",), ("addr2_line",)], "n string", F.array_sort(A.tokens("n"))) == [(["name", "product"],), (["productname"],), (["addr", "line"],)]
    assert values(spark, [("product_name", "productName"), ("email_address", "email"), ("", "x")], "a string, b string", A.token_overlap("a", "b")) == [(0.0,), (0.5,), (0.0,)]
    assert values(spark, [("zebra", "lion")], "a string, b string", A.are_synonyms("a", "b")) == [(False,)]


@pytest.mark.parametrize(("a", "b", "ratio"), [("price", "cost", 0.2222), ("name", "age", 0.5714), ("cost", "stock", 0.4444), ("unit_price", "price", 0.6667), ("category", "name", 0.3333), ("category", "description", 0.3158)])
def test_sequence_ratio(spark, a, b, ratio):
    assert values(spark, [(a, b)], "a string, b string", F.round(A.sequence_ratio("a", "b"), 4)) == [(ratio,)]


def test_similarity(spark):
    rows = [("name", "name"), ("price", "cost"), ("name", "age"), ("category", "description")]
    assert values(spark, rows, "a string, b string", F.round(A.attribute_similarity("a", "b"), 4)) == [(1.0,), (0.965,), (0.7,), (0.5211,)]
    assert [round(A.plain_similarity(a, b), 4) for a, b in rows] == [1.0, 0.965, 0.7, 0.5211]
    assert [round(A.plain_similarity(a, b, 0.3), 4) for a, b in [("name", "name"), ("price", "cost"), ("name", "age"), ("colour", "color")]] == [0.79, 0.755, 0.49, 0.7264]


def test_matching():
    mapping, new = A.match_lists(["cost", "qty", "category", "product_name"], ["price", "stock", "name", "description"])
    assert mapping == {"cost": "price", "qty": "stock", "product_name": "name"} and new == ["category"]
    assert A.match_lists(["id", "name"], ["employee_id", "name"])[0] == {"id": "employee_id", "name": "name"}
    assert A.match_lists(["id", "user_id"], ["id"])[0] == {"id": "id"}, "no column is taken twice"
    assert A.match_lists([], ["a"]) == ({}, [])


def test_types(spark):
    pairs = [("INTEGER", "INTEGER", 1.0), ("INTEGER", "NUMERIC", 0.8), ("VARCHAR", "TEXT", 0.8), ("DATE", "TIMESTAMP", 0.8), ("INTEGER", "TEXT", 0.3), ("INTEGER", "integer", 0.3)]
    assert values(spark, [p[:2] for p in pairs], "a string, b string", A.type_compatibility("a", "b")) == [(p[2],) for p in pairs]
    texts_ = [None, "abc", "2024-01-01", "2024-01-01 10:00", "T-Shirt Large", "a" * 300]
    assert values(spark, [(t,) for t in texts_], "v string", A.infer_text_type("v")) == [("TEXT",), ("VARCHAR",), ("VARCHAR",), ("TIMESTAMP",), ("TIMESTAMP",), ("TEXT",)]
    kinds = [(["INTEGER"], 1, "INTEGER"), (["INTEGER", "NUMERIC"], 3, "TEXT"), (["VARCHAR"], 3, "VARCHAR(50)"), (["VARCHAR"], 49, "VARCHAR(50)"), (["VARCHAR"], 50, "VARCHAR(100)"), ([], None, "TEXT")]
    assert values(spark, [k[:2] for k in kinds], "k array<string>, n int", A.unified_type(F.col("k"), F.col("n"))) == [(k[2],) for k in kinds]
    assert values(spark, [(["product_name", "price", "stock", "x"],)], "n array<string>", A.table_name(F.col("n"))) == [("table_product_name_price_stock",)]


@pytest.mark.parametrize(("length", "count"), [(0, 0), (1, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3), (2600, 3), (2601, 4)])
def test_chunks(spark, length, count):
    text = "".join(chr(97 + i % 26) for i in range(length))
    (chunks,) = values(spark, [(text,)], "t string", texts.character_chunks("t"))[0]
    assert len(chunks) == count and (not count or text.endswith(chunks[-1]))
    assert "".join([*chunks[:1], *[c[200:] for c in chunks[1:]]]) == text


def test_null_texts(spark):
    row = values(spark, [(None,)], "t string", texts.character_chunks("t"), texts.short_summary("t"), texts.topic("t"), texts.first_sentences("t", F.lit("f.txt")))
    assert row == [([], "", "general", "f.txt")]


def test_summaries(spark):
    t = "One two.  Three!\nFour? Five. Six. Seven."
    assert values(spark, [(t,)], "t string", texts.first_sentences("t", F.lit("f"))) == [("One two. Three! Four? Five. Six.",)]
    long = "A" * 150 + ". " + "B" * 60 + ". C."
    cut = "D" * 250
    got = values(spark, [(long,), (cut,), (" a \n b ",)], "t string", texts.short_summary("t"))
    assert got == [("A" * 150 + ".",), ("D" * 200 + "...",), ("a b",)]


def test_folders_and_titles(spark):
    assert values(spark, [("can't",), ("state-of",), ("x1y",)], "t string", texts.title_case("t")) == [("Can'T",), ("State-Of",), ("X1Y",)]
    rows = [("This is a test", "documents", "text"), ("PDF document: test.pdf", "documents", "text"), ("", "general", "video"), (None, "media", ""), ("the an is", "general", "")]
    assert values(spark, rows, "t string, c string, m string", texts.folder_name("t", "c", "m")) == [("Documents",), ("Pdf",), ("Video",), ("Media",), ("Other",)]


def test_sizes_and_similarity(spark):
    assert values(spark, [(1023,), (1024,), (1536,), (1048576,), (1073741824,)], "n bigint", texts.human_size("n")) == [("1023 B",), ("1.00 KB",), ("1.50 KB",), ("1.00 MB",), ("1.00 GB",)]
    assert values(spark, [(0.0,), (0.25,), (1.0,), (1.5,)], "d double", texts.similarity("d")) == [(1.0,), (0.75,), (0.0,), (0.0,)]


def test_files(spark):
    rows = [("a/b/photo.JPG",), ("clip.mp4",), ("notes",), ("x.unknown",), (".hidden",), ("report.pdf",), ("a.docx",)]
    got = values(spark, rows, "p string", files.media_type("p"), files.modality("p"), files.file_type("p"), files.encoder_modality("p"))
    assert got == [("image", "image", "unknown", "image"), ("video", "video", "unknown", "video"), ("unknown", "text", "unknown", "other"), ("unknown", "text", "unknown", "other"), ("unknown", "text", "unknown", "other"), ("unknown", "text", "pdf", "text"), ("unknown", "text", "docx", "text")]
    inside = [("/r/a.txt", True), ("/r/../x", False), ("a/../../x", False), ("a/../b", True), ("/rx/a", False), ("/r", True)]
    assert values(spark, [(p,) for p, _ in inside], "p string", files.is_within("p", "/r")) == [(x,) for _, x in inside]
    assert values(spark, [("a.txt", 0), ("a.txt", 2), ("a", 1)], "n string, k int", files.collision_name("n", "k")) == [("a.txt",), ("a_2.txt",), ("a_1",)]


def test_frame_plan(spark):
    rows = [(300, 30.0, 8), (1, 30.0, 8), (0, 30.0, 8), (3000, 0.0, 4)]
    assert values(spark, rows, "n int, fps double, cap int", files.frame_plan("n", "fps", "cap")) == [([0, 149, 299],), ([0],), ([],), ([0, 999, 1999, 2999],)]


def test_headers_meet_all_column_names(spark, tmp_path):
    from siltstone.plans import catalogue

    spark.sql("SELECT map('Order Date', 'order_date') AS mapping").write.parquet(f"{tmp_path}/load_results.parquet")
    spark.sql("SELECT explode(array('order_date', 'colour', null)) AS column_name").write.parquet(f"{tmp_path}/catalog_columns.parquet")
    for name in ("attr_similarity", "attr_token_jaccard"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(r["column_name"] for r in got) == ["colour", "order_date"]


def test_both_normal_forms_agree(spark):
    """The rule as a Column and on plain strings, over names of every kind of character."""
    import random

    rng = random.Random(3)
    names = ["", "_", "__a__", "A b", "İd", "ÄÖ_x", "a\tb\nc", "product-Name ", "日本_1", "é", "x" * 300, "1_2__3"]
    names += ["".join(rng.choice("aZ_ -.9é日\t") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = values(spark, [(n,) for n in names], "n string", A.normalize("n"), A.is_id("n"))
    assert got == [(A.plain_normalize(n), A.plain_is_id(n)) for n in names]
