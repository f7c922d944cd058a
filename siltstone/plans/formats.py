"""Queries over readers, typed loads, structure classifiers, media and storage trees, with their SQL.

Files are built from table rows, so that the SQL can say what a reader must find in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import files
from siltstone.operators import catalog, classify, documents, loader, media
from siltstone.plans.texts_files import sql_list, sql_modality, sql_size, sql_topic
from siltstone.runtime import table
from siltstone.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


# --- readers -------------------------------------------------------------------------


def _of_customers(spark: SparkSession, base: str, line: Column) -> DataFrame:
    """(key, lines): the lines of each customer's orders in their order."""
    rows = table(spark, base, "orders").select("o_custkey", "o_orderkey", line.alias("line"))
    lists = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("l"))
    return lists.select(F.col("o_custkey").alias("key"), F.transform("l", lambda x: x["line"]).alias("lines"))


def _as_files(rows: DataFrame, text: Column, ext: str) -> DataFrame:
    content = F.encode(text, "UTF-8")
    return rows.select(F.concat(F.col("key").cast("string"), F.lit(f".{ext}")).alias("path"), content.alias("content"), F.lit(ext).alias("extension"), F.lit(False).alias("is_media"), F.length(content).cast("bigint").alias("length"))


def _cells(listed: DataFrame) -> DataFrame:
    """Every value that was read, by file, row and name."""
    rows = readers.file_rows(listed)
    return rows.select(F.col("path").alias("file"), F.col("ordinal").cast("bigint").alias("row_no"), F.explode("fields").alias("name", "value"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


_ROWS = "r AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)"


def sql_cells(ext: str, *columns: tuple[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT c || '.{ext}' AS file, n AS row_no, '{name}' AS name, {value} AS value FROM r" for name, value in columns)
    return f"WITH {_ROWS} {parts}"


@query(sql_cells("csv", ("order id", "k"), ("status", "s || ',\"' || p || '\"'"), ("priority", "p")))
def read_delimited(spark, base):
    line = F.concat(_text("o_orderkey"), F.lit(',"'), _text("o_orderstatus"), F.lit(',""'), _text("o_orderpriority"), F.lit('""",'), _text("o_orderpriority"))
    rows = _of_customers(spark, base, line)
    return _cells(_as_files(rows, F.concat(F.lit("\ufefforder id,status,priority\r\n"), F.array_join("lines", "\r\n")), "csv"))


@query(sql_cells("json", ("k", "k"), ("parts", "'[\"' || s || '\", null]'"), ("flag", "'true'")))
def read_json_lists(spark, base):
    line = F.concat(F.lit('{"k":'), _text("o_orderkey"), F.lit(',"parts":["'), _text("o_orderstatus"), F.lit('",null],"flag":true}'))
    return _cells(_as_files(_of_customers(spark, base, line), F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")), "json"))


@query(sql_cells("xml", ("id", "k"), ("text", "s"), ("p", "p"), ("gone", "''")))
def read_xml_children(spark, base):
    line = F.concat(F.lit('<o id="'), _text("o_orderkey"), F.lit('">'), _text("o_orderstatus"), F.lit("<p>first</p><p> "), _text("o_orderpriority"), F.lit(" <deep>x</deep></p><gone/></o>"))
    return _cells(_as_files(_of_customers(spark, base, line), F.concat(F.lit("<r>"), F.array_join("lines", ""), F.lit("</r>")), "xml"))


@query(sql_cells("yaml", ("k", "k"), ("s", "s"), ("list", "'[1, 2]'")))
def read_yaml_lists(spark, base):
    line = F.concat(F.lit("- k: "), _text("o_orderkey"), F.lit("\n  s: '"), _text("o_orderstatus"), F.lit("'\n  list: [1, 2]"))
    return _cells(_as_files(_of_customers(spark, base, line), F.array_join("lines", "\n"), "yaml"))


@query(sql_cells("html", ("Key", "k"), ("Status", "s")))
def read_html_tables(spark, base):
    line = F.concat(F.lit("<tr><td>"), _text("o_orderkey"), F.lit("</td><td> "), _text("o_orderstatus"), F.lit(" </td></tr>"))
    start, stop = "<p>x</p><table><tr><th>Key</th><th>Status</th></tr>", "<tr><td>short</td></tr></table><table><tr><td>other</td></tr></table>"
    # A row of another width is left out, and so is every table but the first.
    return _cells(_as_files(_of_customers(spark, base, line), F.concat(F.lit(start), F.array_join("lines", ""), F.lit(stop)), "html"))


@query(f"WITH {_ROWS} SELECT c || '.txt' AS file, n AS row_no, name, CASE name WHEN 'a' THEN k ELSE s END AS value FROM r, (VALUES ('a'), ('b')) t(name) WHERE c % 3 <> 2")
def read_sniffed_text(spark, base):
    """Texts with commas, with tabs, and without columns."""
    rows = _of_customers(spark, base, F.concat(_text("o_orderkey"), F.lit(","), _text("o_orderstatus")))
    text = F.concat(F.lit("a,b\n"), F.array_join("lines", "\n"))
    return _cells(_as_files(rows, F.when(F.col("key") % 3 == 0, text).when(F.col("key") % 3 == 1, F.translate(text, ",", "\t")).otherwise(F.translate(text, ",", " ")), "txt"))


@query("SELECT n_nationkey || '.ini' AS file, 0 AS row_no, name, CASE name WHEN 'name' THEN n_name ELSE 'a=b' END AS value FROM nation, (VALUES ('name'), ('pair')) t(name)")
def read_settings(spark, base):
    rows = table(spark, base, "nation").withColumnRenamed("n_nationkey", "key")
    return _cells(_as_files(rows, F.concat(F.lit("[s]\nname = "), F.col("n_name"), F.lit("\n# x=y\npair=a=b\n")), "ini"))


@query("SELECT n_nationkey || '.json' AS file, CASE n_nationkey % 4 WHEN 0 THEN 1 ELSE 0 END AS n_rows, n_nationkey % 4 = 3 AS failed FROM nation")
def read_odd_json(spark, base):
    """An object is one row, a list of scalars and a scalar none, broken text an error row."""
    rows = table(spark, base, "nation").withColumnRenamed("n_nationkey", "key")
    text = F.when(F.col("key") % 4 == 0, '{"a": {"b": 1}}').when(F.col("key") % 4 == 1, "[1, 2]").when(F.col("key") % 4 == 2, "5").otherwise("{")
    listed = _as_files(rows, text, "json")
    found = readers.file_rows(listed).groupBy("path").agg(F.count("fields").alias("n"), F.max(F.col("error").isNotNull()).alias("e"))
    return listed.select("path").join(found, "path", "left").select(F.col("path").alias("file"), F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("e", F.lit(False)).alias("failed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), chr(0), '') ELSE 'caf' || chr(233) || doc_id END AS text FROM documents")
def full_texts(spark, base):
    """UTF-8 as it is, without null characters; other bytes as Latin-1."""
    d = table(spark, base, "documents")
    latin = F.concat(F.unhex(F.lit("636166E9")), F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    return d.select("doc_id", readers.full_text(F.when(F.col("doc_id") % 2 == 0, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).otherwise(latin), F.lit("txt")).alias("text"))


# --- typed loads ---------------------------------------------------------------------

_TYPED = "SELECT c % 5 AS g, c, n, k, s, p, '1994-01-02T03:04:' || lpad(CAST(CAST(k AS BIGINT) % 60 AS VARCHAR), 2, '0') AS t FROM r"


@query(
    f"""WITH {_ROWS} SELECT c || '.csv' AS file, name, type FROM (SELECT DISTINCT c FROM r), (VALUES ('id', 'INTEGER'), ('part', 'NUMERIC'), ('rush', 'BOOLEAN'), ('at', 'TIMESTAMP'), ('status', 'VARCHAR(50)'), ('title', 'TEXT')) t(name, type)"""
)
def typed_fields(spark, base):
    """Column types of delimited files from their first values; a dash alone makes no time."""
    at = F.concat(F.lit("1994-01-02T03:04:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    line = F.concat_ws(",", _text("o_orderkey"), F.concat(_text("o_orderkey"), F.lit(".5")), F.lit("True"), at, _text("o_orderstatus"), F.lit("long-sleeved shirt"))
    rows = _of_customers(spark, base, line)
    parsed = readers.file_rows(_as_files(rows, F.concat(F.lit("id,part,rush,at,status,title\n"), F.array_join("lines", "\n")), "csv"))
    # Every file has the same header here; a number of its own makes it a schema of its own.
    own = parsed.withColumn("schema", F.xxhash64("path"))
    names = own.select("schema", "path").distinct()
    return loader.field_types(own).join(names, "schema").select(F.col("path").alias("file"), "name", "type")


@query(
    """SELECT file_id, CASE WHEN size_bytes IS NULL THEN NULL ELSE CAST(size_bytes AS VARCHAR) END AS size, '["' || coalesce(modality, '') || '"]' AS kinds FROM (SELECT file_id, max(size_bytes) AS size_bytes, max(modality) AS modality FROM processing_results GROUP BY file_id)"""
)
def metadata_values(spark, base):
    """Metadata values: numbers and texts stay, lists become JSON text."""
    p = table(spark, base, "processing_results").groupBy("file_id").agg(F.max("size_bytes").alias("size"), F.max("modality").alias("m"))
    rows = documents.sanitized_row(p.select("file_id", "size", F.array(F.coalesce("m", F.lit(""))).alias("kinds")))
    return rows.select("file_id", F.col("size").cast("string").alias("size"), "kinds")


# --- classifiers ---------------------------------------------------------------------

_SCORED = "CASE WHEN s >= n THEN 'SQL' ELSE 'NoSQL' END AS classification, s::DOUBLE AS sql_score, n::DOUBLE AS nosql_score"


def _scores(rows: DataFrame, kind: str) -> DataFrame:
    return classify.classify_files(rows.withColumn("file_type", F.lit(kind))).select("key", "classification", "sql_score", "nosql_score")


@query(f"WITH {_ROWS}, f AS (SELECT c, count(*) AS n_rows FROM r GROUP BY c) SELECT c AS key, {_SCORED} FROM (SELECT c, CASE WHEN n_rows > 1 THEN 5 ELSE 0 END AS s, CASE WHEN c % 2 = 0 THEN 3 ELSE 0 END AS n FROM f)")
def classify_xml(spark, base):
    """Repeated tags with equal attributes; every second file is deeply nested."""
    deep = F.when(F.col("o_custkey") % 2 == 0, "<a><b><c/></b></a>").otherwise("")
    rows = table(spark, base, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit('<o id="'), _text("o_orderkey"), F.lit('">'), deep, F.lit("</o>")).alias("line"))
    lists = rows.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return _scores(lists.select("key", F.concat(F.lit("<r>"), F.array_join("lines", ""), F.lit("</r>")).alias("text")), "xml")


@query(f"SELECT o_orderkey AS key, {_SCORED} FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 2 END AS s, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 4 END AS n FROM orders)")
def classify_yaml(spark, base):
    flat, nested = F.concat(F.lit("a: "), _text("o_orderkey"), F.lit("\nb: 2")), F.concat(F.lit("a:\n  b: "), _text("o_orderkey"))
    rows = table(spark, base, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, flat).otherwise(nested).alias("text"))
    return _scores(rows, "yaml")


@query("SELECT o_orderkey AS key, CAST(greatest(1 + o_orderkey % 7, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END) AS INTEGER) AS depth, o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0 AS mostly_primitive, length(o_orderpriority) + 490 > 500 AS large_text FROM orders")
def json_facts(spark, base):
    """Depth of nesting, share of plain values, long texts: lists of so many levels beside a text and plain or nested values."""
    levels = (F.col("o_orderkey") % 7).cast("int")
    nested = F.concat(F.lpad(F.lit(""), levels, "["), F.lit("1"), F.rpad(F.lit(""), levels, "]"))
    # Ten values: two nested ones are too many for mostly plain ones.
    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":'), i.cast("string"))), ",")
    second = F.when(F.col("o_orderkey") % 5 == 0, "[1]").otherwise("1")
    text = F.concat(F.lit('{"deep":'), nested, F.lit(',"second":'), second, F.lit(","), plain, F.lit(',"body":"'), F.rpad(F.col("o_orderpriority"), F.char_length("o_orderpriority") + 490, "x"), F.lit('"}'))
    rows = table(spark, base, "orders").select(F.col("o_orderkey").alias("key"), classify.json_facts(text).alias("f"))
    return rows.select("key", F.col("f.depth").alias("depth"), F.col("f.primitive").alias("mostly_primitive"), F.col("f.large_text").alias("large_text"))


# --- media, storage, statistics ------------------------------------------------------

_MEDIA = f"SELECT DISTINCT file_id, original_name, {sql_modality('original_name')} AS modality FROM processing_results WHERE {sql_modality('original_name')} <> 'text'"


@query(
    f"""WITH m AS ({_MEDIA}), t AS (SELECT *, CASE modality WHEN 'image' THEN 'a photo of ' || original_name ELSE upper(modality[1:1]) || modality[2:] || ' file ' || original_name END AS text FROM m)
    SELECT file_id, original_name, modality, text, CASE WHEN modality = 'image' THEN {sql_topic('text')} ELSE 'media_assets' END AS collection, modality = 'image' AS has_vector FROM t"""
)
def media_encoding(spark, base):
    """Media by modality: images through an injected encoder, the rest by their caption."""
    rows = table(spark, base, "processing_results").where(files.is_media("original_name")).select("file_id", "original_name").distinct()
    listed = rows.select(F.concat_ws("/", "file_id", "original_name").alias("path"), F.encode("original_name", "UTF-8").alias("content"))
    image = lambda content, path: F.struct(F.concat(F.lit("a photo of "), F.decode(content, "UTF-8")).alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    encoded = media.encode_files(listed, {"image": image})
    known = F.col("embedding").isNotNull()
    named = encoded.select(F.substring_index("path", "/", 1).alias("file_id"), files.file_name("path").alias("original_name"), "modality", "text", F.sha2("path", 256).alias("k"), known.alias("has_vector"))
    meta = media.media_metadata(encoded).select(F.col("file_id").alias("k"), F.col("collection_hint").alias("collection")).distinct()
    return named.join(meta, "k").drop("k")


_TREE_PATHS = "p AS (SELECT DISTINCT replace(ltrim(path, './'), '//', '/') AS path FROM path_plans WHERE path IS NOT NULL), q AS (SELECT path, string_split(path, '/') AS s FROM p WHERE path <> ''), k AS (SELECT * FROM q WHERE len(list_filter(s, lambda x: starts_with(x, '.'))) = 0)"


@query(
    f"""WITH {_TREE_PATHS}, e AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS parent, s[len(s)] AS name, 'file' AS kind FROM k
        UNION ALL SELECT DISTINCT array_to_string(s[1:i - 1], '/'), s[i], 'folder' FROM (SELECT s, unnest(range(1, len(s))) AS i FROM k))
    SELECT parent, name, kind, row_number() OVER (PARTITION BY parent ORDER BY kind = 'file', lower(name), name) AS place FROM e"""
)
def storage_tree(spark, base):
    """Entries of a storage tree: dotted names left out, folders before files."""
    path = F.replace(F.ltrim(F.col("path"), F.lit("./")), F.lit("//"), F.lit("/"))
    rows = table(spark, base, "path_plans").where("path is not null").select(path.alias("path"), F.lit(1).cast("bigint").alias("length")).distinct().where("path <> ''")
    return catalog.storage_entries(rows, "/").select("parent", "name", "kind", "place")


@query(
    f"""WITH t AS (SELECT count(DISTINCT table_name) AS tables FROM catalog_columns), g AS (SELECT modality, sum(size_bytes) AS bytes FROM processing_results GROUP BY modality)
    SELECT count(*) AS total_files, {sql_size('CAST(coalesce(sum(size_bytes), 0) AS BIGINT)')} AS total_size, any_value(tables) AS tables, count(DISTINCT collection_hint) FILTER (modality = 'text') + max(CASE WHEN modality = 'text' AND collection_hint IS NULL THEN 1 ELSE 0 END) AS collections,
    count(DISTINCT modality) FILTER (modality <> 'text') AS media_directories, count(*) FILTER (created_at >= (SELECT max(created_at) FROM processing_results) - INTERVAL 7 DAY) AS recent_uploads,
    (SELECT string_agg(modality || ': ' || {sql_size('CAST(coalesce(bytes, 0) AS BIGINT)')}, ', ' ORDER BY modality) FROM g WHERE modality IS NOT NULL) AS storage_breakdown FROM processing_results, t"""
)
def statistics(spark, base):
    tables = table(spark, base, "catalog_columns").agg(F.count_distinct("table_name").alias("tables"))
    return catalog.totals(table(spark, base, "processing_results"), tables)


@query(f"SELECT DISTINCT original_name AS name, original_name IS NOT NULL AND lower(regexp_extract(list_extract(string_split(original_name, '/'), -1), '[^.]\\.([^.]+)$', 1)) IN {sql_list(files.VIDEO)} AS is_video FROM processing_results WHERE contains(lower(original_name), 'mp4') OR contains(lower(original_name), 'mov')")
def tree_video_matches(spark, base):
    rows = table(spark, base, "processing_results").select(F.col("original_name").alias("name")).distinct()
    found = catalog.tree_matches(rows, "MP4", ("name",)).unionByName(catalog.tree_matches(rows, "mov", ("name",))).distinct()
    return found.select("name", files.is_video_node(files.mime_type("name"), "name").alias("is_video"))
