"""Queries over classification, evolution, loading, vectors, search and the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.functions import files, texts
from siltstone.functions.encoders import hashing_encoder
from siltstone.operators import catalog as K
from siltstone.operators import classify as C
from siltstone.operators import documents as D
from siltstone.operators import evolution as E
from siltstone.operators import loader as L
from siltstone.operators import search as S
from siltstone.plans.matching import _catalog, _incoming
from siltstone.plans.texts_files import docs, sql_content, sql_ext, sql_folder, sql_is_id, sql_list, sql_mime, sql_modality, sql_normalize, sql_sentences, sql_size, sql_topic
from siltstone.runtime import table
from siltstone.sources.storage import placed_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- classification ------------------------------------------------------------------


def sql_verdict(key: str, s: str, n: str, source: str) -> str:
    return f"WITH r AS (SELECT {key}, CAST({s} AS DOUBLE) AS sql_score, CAST({n} AS DOUBLE) AS nosql_score FROM {source}) SELECT {key}, CASE WHEN sql_score >= nosql_score THEN 'SQL' ELSE 'NoSQL' END AS classification, sql_score, nosql_score, round_even(abs(sql_score - nosql_score) / greatest(1, sql_score, nosql_score), 2) AS confidence FROM r"


def sql_lines(t: str, d: str) -> str:
    lines = f"string_split({t}, chr(10))"
    return f"(len({lines}) > 1 AND len(string_split({lines}[1], {d})) > 1 AND len(list_filter({lines}[1:10], lambda s: trim(s, ' ' || chr(9) || chr(13)) <> '' AND len(string_split(s, {d})) <> len(string_split({lines}[1], {d})))) = 0)"


def _verdicts(df: DataFrame, key: str, points: C.Points) -> DataFrame:
    return df.select(key, points.struct().alias("r")).select(key, "r.classification", "r.sql_score", "r.nosql_score", "r.confidence")


_ORDER_LINES = "SELECT o_custkey AS key, string_agg(o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey UNION ALL SELECT -1 - doc_id, coalesce(text, '') FROM documents"


def _line_texts(spark: SparkSession, base: str, sep: str = ",") -> DataFrame:
    lines = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat_ws(sep, F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("line")))).alias("l"))
    rows = lines.select("key", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return rows.unionByName(docs(spark, base).select((-1 - F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).alias("text")))


_COMMA, _TAB = sql_lines("text", "','"), sql_lines("text", "chr(9)")


@query(sql_verdict("key", f"CASE WHEN {_COMMA} THEN 3 ELSE 0 END", "3 + CASE WHEN length(text) > 5000 THEN 2 ELSE 0 END", f"({_ORDER_LINES})"))
def classify_text(spark, base):
    return _verdicts(_line_texts(spark, base), "key", C.text_points("text"))


@query(sql_verdict("doc_id", "0", "3 + CASE WHEN length(text) > 3000 THEN 2 ELSE 0 END", "documents"))
def classify_document(spark, base):
    return _verdicts(docs(spark, base), "doc_id", C.document_points("text"))


_HTML = "(SELECT doc_id, lower('<html><p>' || coalesce(text, '') || '</p>' || CASE WHEN doc_id % 3 = 0 THEN '<TABLE><tr><td>' || doc_id || '</td></tr></TABLE>' ELSE '' END || '</html>') AS h FROM documents)"


@query(sql_verdict("doc_id", "CASE WHEN contains(h, '<table') THEN 3 ELSE 0 END", "CASE WHEN length(h) > 5000 AND NOT contains(h, '<table') THEN 1 ELSE 0 END + CASE WHEN length(regexp_replace(h, '<[^>]+>', '', 'g')) > 3000 THEN 2 ELSE 0 END", _HTML))
def classify_html(spark, base):
    h = F.concat(F.lit("<html><p>"), F.coalesce("text", F.lit("")), F.lit("</p>"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<TABLE><tr><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr></TABLE>"))).otherwise(""), F.lit("</html>"))
    return _verdicts(docs(spark, base).select("doc_id", h.alias("h")), "doc_id", C.html_points("h"))


def _json_orders(spark: SparkSession, base: str) -> DataFrame:
    """JSON texts of several shapes: events as they are, orders flat or nested with a list."""
    o = table(spark, base, "orders")
    flat = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    nested = F.to_json(F.struct(F.struct("o_orderkey").alias("head"), F.array(F.struct(F.col("o_orderstatus").alias("status"))).alias("parts")))
    rows = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, flat).otherwise(nested).alias("j"))
    return table(spark, base, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("j")).unionByName(rows)


_JSON = "SELECT 'e' || event_id AS id, props AS j FROM events UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' ELSE '{\"head\":{\"o_orderkey\":' || o_orderkey || '},\"parts\":[{\"status\":\"' || o_orderstatus || '\"}]}' END FROM orders"
_KEYS = "list_filter(regexp_extract_all(j, '\"([a-z_]+)\":', 1), lambda k: regexp_matches(k, 'id|key|pk|fk|foreign'))"
_NESTED = "contains(j, ':{') OR contains(j, ':[')"


@query(sql_verdict("id", f"CASE WHEN {_NESTED} THEN 0 ELSE 5 END + CASE WHEN len({_KEYS}) > 0 THEN 1 ELSE 0 END + 2", f"CASE WHEN {_NESTED} THEN 4 ELSE 0 END", f"({_JSON})"))
def classify_json(spark, base):
    rows = _json_orders(spark, base).withColumn("file_type", F.lit("json"))
    return C.classify_files(rows, "file_type", "j").select("id", "classification", "sql_score", "nosql_score", "confidence")


@query(f"WITH c AS ({_JSON}) SELECT id, NOT ({_NESTED}) AS flat, len({_KEYS}) > 0 AS relational FROM c")
def json_flat(spark, base):
    rows = _json_orders(spark, base).withColumn("f", C.json_facts("j"))
    return rows.select("id", F.col("f.flat").alias("flat"), F.col("f.relational").alias("relational"))


@query(f"WITH c AS ({_JSON}), k AS (SELECT substring(id, 1, 1) AS kind, array_to_string(list_sort(json_keys(j)), ',') AS keys FROM c) SELECT kind, count(DISTINCT keys) AS key_sets, count(DISTINCT keys) = 1 AS consistent, count(*) AS objects FROM k GROUP BY kind")
def json_keyset_consistency(spark, base):
    k = _json_orders(spark, base).select(F.substring("id", 1, 1).alias("kind"), F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"))
    sets = k.groupBy("kind", "keys").agg(F.count("*").alias("n"))
    return sets.groupBy("kind").agg(F.count("*").alias("key_sets"), (F.count("*") == 1).alias("consistent"), F.sum("n").cast("bigint").alias("objects"))


@query(sql_verdict("key", f"CASE WHEN {_COMMA} THEN 3 ELSE 0 END + CASE WHEN {_TAB} THEN 3 ELSE 0 END", "2 + CASE WHEN length(text) > 5000 THEN 2 ELSE 0 END", f"(SELECT key, replace(text, ',', CASE WHEN key >= 0 AND key % 2 = 0 THEN chr(9) ELSE ',' END) AS text FROM ({_ORDER_LINES}))"))
def classify_unknown(spark, base):
    t = _line_texts(spark, base).select("key", F.when((F.col("key") >= 0) & (F.col("key") % 2 == 0), F.translate("text", ",", "\t")).otherwise(F.col("text")).alias("text"))
    rows = C.classify_files(t.withColumn("file_type", F.lit("unknown")), "file_type", "text")
    return rows.select("key", "classification", "sql_score", "nosql_score", "confidence")


@query(sql_verdict("table_name", "7 + CASE WHEN bool_or_id THEN 1 ELSE 0 END", "0", "(SELECT table_name, bool_or(contains(lower(column_name), 'id')) AS bool_or_id FROM catalog_columns GROUP BY table_name)"))
def classify_tabular(spark, base):
    rows = table(spark, base, "catalog_columns").groupBy("table_name").agg(F.collect_list("column_name").alias("c"))
    return _verdicts(rows, "table_name", C.tabular_points(F.col("c")))


_ALL_T = "coalesce(text, '')"


@query(
    f"""WITH d AS (SELECT doc_id, file_name, {_ALL_T} AS text, CASE WHEN {sql_ext('file_name')} IN ('html','htm') THEN 'h' WHEN {sql_ext('file_name')} IN ('pdf','docx','doc') THEN 'd' WHEN {sql_ext('file_name')} IN ('txt','md','log') THEN 't' ELSE 'u' END AS k FROM documents),
    p AS (SELECT *, CASE WHEN {sql_lines('text', "','")} THEN 3 ELSE 0 END AS comma, CASE WHEN {sql_lines('text', 'chr(9)')} THEN 3 ELSE 0 END AS tab FROM d),
    r AS (SELECT doc_id, CASE k WHEN 'h' THEN 0 WHEN 'd' THEN 0 WHEN 't' THEN comma ELSE comma + tab END::DOUBLE AS sql_score, CASE k WHEN 'h' THEN CASE WHEN length(text) > 5000 THEN 1 ELSE 0 END + CASE WHEN length(regexp_replace(lower(text), '<[^>]+>', '', 'g')) > 3000 THEN 2 ELSE 0 END WHEN 'd' THEN 3 + CASE WHEN length(text) > 3000 THEN 2 ELSE 0 END WHEN 't' THEN 3 + CASE WHEN length(text) > 5000 THEN 2 ELSE 0 END ELSE 2 + CASE WHEN length(text) > 5000 THEN 2 ELSE 0 END END::DOUBLE AS nosql_score FROM p)
    SELECT doc_id, CASE WHEN sql_score >= nosql_score THEN 'SQL' ELSE 'NoSQL' END AS classification, sql_score, nosql_score, round_even(abs(sql_score - nosql_score) / greatest(1, sql_score, nosql_score), 2) AS confidence FROM r"""
)
def classify_all(spark, base):
    rows = docs(spark, base).select("doc_id", files.file_type("file_name").alias("file_type"), "text")
    return C.classify_files(rows).select("doc_id", "classification", "sql_score", "nosql_score", "confidence")


_FILLED = "len(list_filter(string_split({}, {}), lambda x: trim(x) <> ''))".format
_SNIFF = lambda d: f"(len(l) > 1 AND {_FILLED('l[1]', d)} > 1 AND len(list_filter(l[2:11], lambda s: trim(s) <> '' AND {_FILLED('s', d)} <> {_FILLED('l[1]', d)})) = 0)"


@query(f"WITH t AS (SELECT key, string_split(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), ',', CASE WHEN key >= 0 AND key % 2 = 0 THEN chr(9) ELSE ',' END), chr(10)) AS l FROM ({_ORDER_LINES})) SELECT key, CASE WHEN {_SNIFF(chr(39) + ',' + chr(39))} THEN 'comma' WHEN {_SNIFF('chr(9)')} THEN 'tab' ELSE 'none' END AS delimiter FROM t")
def delimiter_sniff(spark, base):
    from siltstone.sources.readers import sniff_delimiter

    t = _line_texts(spark, base).select("key", F.when((F.col("key") >= 0) & (F.col("key") % 2 == 0), F.translate("text", ",", "\t")).otherwise(F.col("text")).alias("text"))
    d = sniff_delimiter("text")
    return t.select("key", F.when(d == ",", "comma").when(d == "\t", "tab").otherwise("none").alias("delimiter"))


# --- evolution -----------------------------------------------------------------------


_INCOMING = "SELECT DISTINCT CAST(file_no AS VARCHAR) AS source, unnest(list_concat(map_keys(mapping), coalesce(new_fields, []))) AS attribute FROM load_results"


@query(f"WITH i AS ({_INCOMING}), n AS (SELECT DISTINCT source, {sql_normalize('attribute')} AS norm FROM i WHERE NOT {sql_is_id('attribute')}), c AS (SELECT DISTINCT table_name, {sql_normalize('column_name')} AS norm FROM catalog_columns WHERE NOT {sql_is_id('column_name')}) SELECT source, table_name, count(DISTINCT n.norm) AS matched FROM n JOIN c ON n.norm = c.norm GROUP BY ALL")
def candidate_exact_join(spark, base):
    return E.exact_candidates(_incoming(spark, base), _catalog(spark, base))


@query("WITH g AS (SELECT r.range / 20.0::DOUBLE AS ratio, n.range AS n_new, a.range AS n_attrs FROM range(0, 21) r, range(0, 6) n, range(1, 13) a) SELECT ratio, n_new, n_attrs, CASE WHEN ratio >= CASE WHEN n_attrs < 10 THEN 0.6 ELSE 0.8 END AND n_new = 0 THEN 'same_table' WHEN ratio >= 0.5 AND n_new <= 3 THEN 'evolved_table' WHEN ratio >= 0.5 THEN 'evolved_table_jsonb' ELSE 'new_table' END AS decision FROM g")
def evolution_decision(spark, base):
    grid = spark.range(21).select((F.col("id") / 20.0).alias("ratio"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("n_new")).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))).alias("n_attrs"))
    return grid.select("ratio", "n_new", "n_attrs", E.decision("ratio", "n_new", "n_attrs").alias("decision"))


# --- loading -------------------------------------------------------------------------

_SPLIT = "WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice, 'old' AS origin FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey - o_orderkey % 4 AS o_orderkey, o_custkey, o_totalprice, 'new' AS origin, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 <> 0)"


def _halves(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old"))
    new = o.where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("o_orderkey"), "o_custkey", "o_totalprice", F.lit("new").alias("origin"), F.col("o_orderkey").alias("seq"))
    return old, new


@query(f"{_SPLIT}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS r FROM n) WHERE r = 1) SELECT * FROM t UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, origin FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def insert_on_conflict(spark, base):
    old, new = _halves(spark, base)
    return old.unionByName(L.insert_if_absent(new, old, "o_orderkey", "seq").drop("seq"))


@query("WITH m AS (SELECT coalesce(max(o_orderkey), 0) AS top FROM orders WHERE o_orderkey % 2 = 0) SELECT top + row_number() OVER (ORDER BY o_orderkey) AS new_key, o_orderkey AS seq FROM orders, m WHERE o_orderkey % 2 = 1")
def surrogate_keys(spark, base):
    o = table(spark, base, "orders")
    rows = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("seq"))
    return L.surrogate_keys(rows, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("new_key")), "new_key", ["seq"])


@query("SELECT o_orderkey AS order_id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS note, '{\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}' AS extra FROM orders")
def mapped_insert(spark, base):
    rows = table(spark, base, "orders").withColumnRenamed("o_orderstatus", "Status").withColumnRenamed("o_orderpriority", "Priority")
    target = {"order_id": "bigint", "price": "double", "note": "string", "extra": "string"}
    return L.mapped_rows(rows, target, {"o_orderkey": "order_id", "o_totalprice": "price"}, (), ("Status", "Priority"))


@query("SELECT o_orderkey, '{\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_shippriority\":null}' AS extra FROM orders")
def json_overflow_pack(spark, base):
    rows = table(spark, base, "orders").withColumn("o_shippriority", F.lit(None).cast("string"))
    return L.mapped_rows(rows, {"o_orderkey": "bigint", "extra": "string"}, {"o_orderkey": "o_orderkey"}, (), ("o_orderstatus", "o_shippriority"))


@query("WITH inc AS (SELECT vec_id * 2 AS vec_id, label + 100 AS label, vec_id AS seq FROM embeddings WHERE embedding IS NOT NULL UNION ALL SELECT vec_id * 2, label + 200, vec_id + 1000000 FROM embeddings WHERE vec_id % 5 = 0 AND embedding IS NOT NULL), l AS (SELECT vec_id, arg_max(label, seq) AS label FROM inc GROUP BY vec_id) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM l) UNION ALL SELECT vec_id, label FROM l")
def node_upsert(spark, base):
    e = table(spark, base, "embeddings")
    a = e.select((F.col("vec_id") * 2).alias("vec_id"), "embedding", (F.col("label") + 100).alias("label"), F.col("vec_id").alias("seq"))
    b = e.where("vec_id % 5 = 0").select((F.col("vec_id") * 2).alias("vec_id"), "embedding", (F.col("label") + 200).alias("label"), (F.col("vec_id") + 1_000_000).alias("seq"))
    return L.upsert(e, a.unionByName(b), "vec_id", "seq", ["embedding"]).select("vec_id", "label")


# --- vectors and search --------------------------------------------------------------

_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
#: What the labels of the vector table stand for in these queries.
_MODALITY = "CASE label % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'audio' END"


_KNN = f"SELECT query_id, vec_id, label, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_DIST} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND len(e.embedding) = len(q.embedding)) WHERE d IS NOT NULL) WHERE r <= 12"


def _hits(spark: SparkSession, base: str, k: int = 12) -> DataFrame:
    """The hits of every row whose id is divisible by 100."""
    rows = table(spark, base, "embeddings")
    return S.nearest_each(rows, rows.where("vec_id % 100 = 0"), k, "vec_id", keep=("label",))


@query(f"SELECT query_id, vec_id, round(d, 6) AS distance FROM ({_KNN})")
def knn_search(spark, base):
    return _hits(spark, base).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, vec_id, round(greatest(0, 1 - d), 6) AS similarity FROM ({_KNN})")
def knn_similarity(spark, base):
    return _hits(spark, base).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH k AS (SELECT query_id, vec_id, {_MODALITY} AS modality FROM ({_KNN})) SELECT * FROM k WHERE modality IN ('video', 'audio', 'image') OR query_id NOT IN (SELECT query_id FROM k WHERE modality IN ('video', 'audio', 'image'))")
def knn_media_filter(spark, base):
    hits = _hits(spark, base).select("query_id", "vec_id", F.expr(_MODALITY).alias("modality"))
    return S.media_filter(hits, "a short video clip", "query_id")


@query("WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label) SELECT m.label, CAST(i AS INTEGER) - 1 AS pos, round(m / n, 6) AS value FROM m JOIN n ON m.label = n.label")
def embedding_mean_pool(spark, base):
    pooled = S.mean_pool(table(spark, base, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("value"))


@query("WITH c AS (SELECT metadata.file_id AS file_id, node_no, text FROM graph_nodes WHERE text IS NOT NULL), f AS (SELECT file_id, text, min(node_no) AS n FROM c GROUP BY ALL) SELECT file_id, string_agg(text, ' | ' ORDER BY n, text) AS caption FROM f GROUP BY file_id")
def caption_join(spark, base):
    """The captions of every file at their full length."""
    rows = table(spark, base, "graph_nodes").select(F.col("metadata.file_id").alias("file_id"), "node_no", "text").distinct()
    return S.joined_captions(rows, "file_id", "node_no", "text")


_META = f"SELECT file_id, file_name AS original_name, array_to_string({sql_sentences(sql_content())}[1:5], ' ') AS summary FROM documents"


@query(f"WITH m AS ({_META}) SELECT file_id, original_name FROM m WHERE contains(lower(substring(summary, 1, 500)), 'invoice') OR contains(lower(original_name), 'invoice') OR contains({sql_topic('summary')}, 'invoice') ORDER BY file_id LIMIT 50")
def metadata_search(spark, base):
    return S.metadata_search(D.metadata(docs(spark, base)), "Invoice", 50).select("file_id", "original_name")


@query("SELECT DISTINCT path FROM path_plans WHERE contains(lower(path || ' ' || list_extract(string_split(path, '/'), -1)), 'invoices') ORDER BY path LIMIT 25")
def storage_search(spark, base):
    return S.storage_search(table(spark, base, "path_plans").select("path").distinct(), "Invoices", 25)


_PATHS = "SELECT DISTINCT path AS id FROM path_plans WHERE contains(lower(path || ' ' || list_extract(string_split(path, '/'), -1)), '{}') ORDER BY path LIMIT 10".format
_FILES = "SELECT file_id AS id FROM m WHERE contains(lower(substring(summary, 1, 500)), '{0}') OR contains(lower(original_name), '{0}') ORDER BY file_id LIMIT 10".format


@query(
    f"""WITH m AS ({_META}), s AS (SELECT CAST(vec_id AS VARCHAR) AS id FROM ({_KNN}) WHERE query_id = 0 ORDER BY d, vec_id LIMIT 10), f AS ({_FILES('invoice')}), g AS ({_FILES('zzzz-nothing')}), p AS ({_PATHS('scans')})
    SELECT 'vector' AS chain, id, 'semantic' AS source FROM s UNION ALL SELECT 'words', id, 'metadata' FROM f UNION ALL SELECT 'paths', id, 'storage' FROM p WHERE NOT EXISTS (SELECT 1 FROM g)"""
)
def search_fallback(spark, base):
    """Three chains: one that its vector answers, one whose vector fits no node, one without vector and metadata hits."""
    vectors, meta = table(spark, base, "embeddings"), D.metadata(docs(spark, base))
    query = list(vectors.where("vec_id = 0").select("embedding").first()[0])
    stored = table(spark, base, "path_plans").select("path").distinct()

    def chain(name: str, vector: list[float], words: str, path: str) -> DataFrame:
        semantic = S.nearest(vectors, vector, 10, "vec_id").select(F.col("vec_id").cast("string").alias("id"))
        found = S.metadata_search(meta, words, 10, columns=("summary_preview", "original_name")).select(F.col("file_id").alias("id"))
        paths = S.storage_search(stored, path, 10).select(F.col("path").alias("id"))
        return S.first_filled(("semantic", semantic), ("metadata", found), ("storage", paths)).select(F.lit(name).alias("chain"), "id", "source")

    return chain("vector", query, "invoice", "scans").unionByName(chain("words", query[:3], "invoice", "scans")).unionByName(chain("paths", query[:3], "zzzz-nothing", "scans"))


@query("SELECT DISTINCT node_id, metadata.path AS path, list_extract(string_split(metadata.path, '/'), -1) AS name, contains(node_id, ':chunk:') AS is_chunk, CASE WHEN starts_with(metadata.path, 'storage/') THEN substring(metadata.path, 9) ELSE nullif(metadata.path, '') END AS download_path FROM graph_nodes")
def search_rows(spark, base):
    rows = S.flattened(table(spark, base, "graph_nodes").select("node_id", "metadata"))
    shown = S.display_rows(rows.select("node_id", "path"))
    return shown.withColumn("download_path", files.relative_path("path", "storage")).distinct()


@query()
def text_embeddings(spark, base):
    """Unit vectors of all chunks by the hashing encoder."""
    n = D.nodes(docs(spark, base), hashing_encoder())
    return n.select("node_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


@query()
def semantic_search(spark, base):
    """The summaries of all documents whose id is divisible by 100 as queries: the nearest nodes of each, with their metadata flattened."""
    every = D.nodes(docs(spark, base), hashing_encoder())
    asked = D.nodes(docs(spark, base).where("doc_id % 100 = 0"), hashing_encoder()).where("metadata.node_type = 'file'")
    hits = S.nearest_each(every, asked, 8, keep=("metadata",))
    return S.display_rows(S.flattened(hits)).select("query_id", "node_id", "name", "is_chunk", "modality", F.round("distance", 5).alias("distance"), F.round("similarity", 5).alias("similarity"))


@query(f"SELECT DISTINCT file_id, original_name, {sql_ext('original_name')} IN {sql_list(files.VIDEO)} OR starts_with({sql_mime('original_name')}, 'video/') AS is_video FROM processing_results")
def video_nodes(spark, base):
    p = table(spark, base, "processing_results").select("file_id", "original_name").distinct()
    return p.select("file_id", "original_name", files.is_video_node(files.mime_type("original_name"), "original_name").alias("is_video"))


@query("SELECT DISTINCT file_id, concat_ws('/', coalesce(modality, 'text'), coalesce(collection_hint, 'general'), 'item' || (ascii(substring(file_id, 22, 1)) % 3) || CASE WHEN r = 1 THEN '' ELSE '_' || (r - 1) END || '.bin') AS storage_path FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(modality, 'text'), coalesce(collection_hint, 'general'), ascii(substring(file_id, 22, 1)) % 3 ORDER BY file_id || '/item' || (ascii(substring(file_id, 22, 1)) % 3) || '.bin') AS r FROM (SELECT file_id, max(modality) AS modality, max(collection_hint) AS collection_hint FROM processing_results GROUP BY file_id))")
def storage_placement(spark, base):
    p = table(spark, base, "processing_results").groupBy("file_id").agg(F.max("modality").alias("modality"), F.max("collection_hint").alias("collection"))
    named = p.withColumn("path", F.concat("file_id", F.lit("/item"), (F.ascii(F.substring("file_id", 22, 1)) % 3).cast("string"), F.lit(".bin")))
    return placed_files(named).select("file_id", "storage_path")


# --- catalog -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, greatest((SELECT count(*) FROM orders) - 10, 0) AS more_rows FROM orders ORDER BY o_orderkey LIMIT 10")
def table_preview(spark, base):
    return K.preview(table(spark, base, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_counts(spark, base):
    return K.table_counts({t: table(spark, base, t) for t in TABLES})


@query("SELECT column_name, list_aggregate(list_sort(list(DISTINCT table_name)), 'string_agg', ',') AS tables FROM (SELECT table_name, " + sql_normalize("column_name") + " AS column_name FROM catalog_columns WHERE NOT " + sql_is_id("column_name") + ") GROUP BY column_name")
def inverted_index(spark, base):
    c = _catalog(spark, base).withColumn("norm_name", A.normalize("column_name")).withColumn("is_id", A.is_id("column_name"))
    return K.inverted_index(c).select(F.col("norm_name").alias("column_name"), F.array_join("tables", ",").alias("tables"))


@query("WITH o AS (SELECT DISTINCT table_name, column_name FROM catalog_columns WHERE col_no % 3 <> 0), n AS (SELECT DISTINCT table_name, column_name FROM catalog_columns WHERE col_no % 4 <> 0) SELECT 'added' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def catalog_diff(spark, base):
    c = _catalog(spark, base)
    return K.catalog_diff(c.where("ordinal % 3 <> 0"), c.where("ordinal % 4 <> 0"))


@query("SELECT 'table' AS kind, table_name AS name, string_agg(column_name || ' ' || data_type, ', ' ORDER BY col_no) AS details FROM catalog_columns GROUP BY table_name UNION ALL SELECT 'collection', collection_hint, count(*) || ' files' FROM processing_results WHERE modality = 'text' GROUP BY collection_hint UNION ALL SELECT 'media', modality, count(*) || ' files' FROM processing_results WHERE modality <> 'text' GROUP BY modality")
def database_state(spark, base):
    p = table(spark, base, "processing_results")
    return K.state(_catalog(spark, base), p.where("modality = 'text'").select(F.col("collection_hint").alias("name")), p.where("modality <> 'text'").select(F.col("modality").alias("name")))


@query(f"SELECT modality, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, {sql_size('CAST(coalesce(sum(size_bytes), 0) AS BIGINT)')} AS display FROM processing_results GROUP BY modality")
def storage_stats(spark, base):
    return K.storage_stats(table(spark, base, "processing_results"), "modality", "size_bytes")


@query("SELECT count(*) AS total_files, count(*) FILTER (success) AS sql_files, count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS errors FROM load_results")
def upload_summary(spark, base):
    rows = table(spark, base, "load_results").withColumn("classification", F.expr("CASE WHEN success THEN 'SQL' ELSE 'NoSQL' END"))
    return K.upload_summary(rows)


_TREE = f"WITH m AS (SELECT doc_id, file_name, n_chars, array_to_string({sql_sentences(sql_content())}[1:5], ' ') AS s FROM documents), f AS (SELECT *, {sql_folder('s', sql_topic('s'), sql_modality('file_name'))} AS folder FROM m), l AS (SELECT folder, file_name, arg_max(n_chars, doc_id) AS n FROM f GROUP BY ALL)"


def _tree(spark: SparkSession, base: str) -> DataFrame:
    d = docs(spark, base).withColumn("s", texts.first_sentences(D.content("text", "file_name"), "file_name")).withColumn("topic", texts.topic("s")).withColumn("modality", files.modality("file_name"))
    return K.tree_rows(d, "s", "file_name", "doc_id", "topic", "modality", "n_chars")


@query(f"{_TREE} SELECT folder, file_name AS file, {sql_size('n')} AS size, {sql_mime('file_name')} AS mime_type FROM l")
def file_tree(spark, base):
    return _tree(spark, base)


@query(f"{_TREE} SELECT folder, file_name AS file, row_number() OVER (PARTITION BY folder ORDER BY lower(file_name), file_name) AS place FROM l")
def file_tree_order(spark, base):
    return K.placed_tree(_tree(spark, base)).select("folder", "file", "place")


@query(f"{_TREE} SELECT folder, file_name AS file FROM l WHERE contains(lower(folder), 'pdf') OR contains(lower(file_name), 'pdf')")
def file_tree_matches(spark, base):
    return K.tree_matches(_tree(spark, base), "Pdf").select("folder", "file")


@query("SELECT DISTINCT path, CASE WHEN starts_with(path, '/') THEN regexp_matches(path, '^/+archive(/|$)') ELSE true END AS inside FROM path_plans WHERE path IS NOT NULL")
def path_containment(spark, base):
    p = table(spark, base, "path_plans").where("path is not null").select("path").distinct()
    return p.select("path", files.is_within("path", "/archive").alias("inside"))
