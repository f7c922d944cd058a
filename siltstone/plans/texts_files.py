"""Queries over documents, names and files, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.functions import files, texts
from siltstone.operators import documents as D
from siltstone.runtime import table

# --- SQL fragments -------------------------------------------------------------------

#: Unicode white space as a character class of RE2 (\s is ASCII there).
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def sql_content(t: str = "text", n: str = "file_name") -> str:
    return f"CASE WHEN {t} IS NULL OR {sql_strip(t)} = '' THEN 'PDF document: ' || {n} ELSE {t} END"


def sql_sentences(t: str) -> str:
    return f"string_split(regexp_replace({sql_strip(t)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def sql_topic(t: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({t}), '{'|'.join(words)}') THEN '{name}'" for name, words in texts.TOPICS)
    return f"CASE {cases} ELSE 'general' END"


def sql_chunks(t: str, size: int = 1000, step: int = 800) -> str:
    return f"CASE WHEN length({t}) > 0 THEN list_transform(range(0, greatest(CAST(ceil((length({t}) - {size}) / {step}.0) AS BIGINT), 0) + 1), lambda i: substring({t}, CAST(i * {step} + 1 AS BIGINT), {size})) ELSE [] END"


def sql_title(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({t}), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda r: upper(r[1:1]) || r[2:]), '')"


def sql_ext(p: str) -> str:
    return f"lower(regexp_extract(list_extract(string_split({p}, '/'), -1), '[^.]\\.([^.]+)$', 1))"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_media(p: str) -> str:
    e = sql_ext(p)
    return f"CASE WHEN {e} IN {sql_list(files.IMAGE)} THEN 'image' WHEN {e} IN {sql_list(files.VIDEO)} THEN 'video' WHEN {e} IN {sql_list(files.AUDIO)} THEN 'audio' ELSE 'unknown' END"


def sql_mime(p: str) -> str:
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MIME.items())
    return f"CASE {sql_ext(p)} {pairs} ELSE '' END"


def sql_modality(p: str) -> str:
    return f"CASE WHEN string_split({sql_mime(p)}, '/')[1] IN ('image', 'video', 'audio') THEN string_split({sql_mime(p)}, '/')[1] WHEN {sql_media(p)} <> 'unknown' THEN {sql_media(p)} ELSE 'text' END"


def sql_size(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN format('{{}} B', CAST({n} AS BIGINT)) WHEN {n} < 1048576 THEN format('{{:.2f}} KB', {n} / 1024.0::DOUBLE) WHEN {n} < 1073741824 THEN format('{{:.2f}} MB', {n} / 1048576.0::DOUBLE) ELSE format('{{:.2f}} GB', {n} / 1073741824.0::DOUBLE) END"


def sql_normalize(n: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({n}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')"


def sql_is_id(n: str) -> str:
    x = sql_normalize(n)
    return f"({x} IN {sql_list(A.ID_NAMES)} OR {x} LIKE '%\\_id' ESCAPE '\\' OR {x} LIKE 'id\\_%' ESCAPE '\\')"


def sql_group(n: str) -> str:
    x = sql_normalize(n)
    return "CASE " + " ".join(f"WHEN {x} IN {sql_list(sorted({A.plain_normalize(w) for w in words}))} THEN '{g}'" for g, words in A.SYNONYMS.items()) + " END"


def sql_folder(t: str, c: str, m: str) -> str:
    words = f"string_split(regexp_replace({sql_strip(f'lower({t})')}, '{WS}+', chr(1), 'g'), chr(1))[1:3]"
    named = f"list_filter({words}, lambda w: w NOT IN {sql_list(texts.FOLDER_STOP_WORDS)} AND length(w) > 2)"
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN CASE WHEN {c} <> '' AND {c} <> 'general' THEN {sql_title(c)} WHEN {m} <> '' THEN {sql_title(m)} ELSE 'Other' END WHEN len({named}) > 0 THEN substring({sql_title(f'{named}[1]')}, 1, 20) WHEN {c} <> 'general' THEN {sql_title(c)} ELSE 'Other' END"


SUMMARY = f"array_to_string({sql_sentences('content')}[1:5], ' ')"
META = f"SELECT *, {sql_content()} AS content FROM documents"
WITH_META = f"WITH base AS ({META}), meta AS (SELECT *, {SUMMARY} AS summary FROM base)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents")


def names(spark: SparkSession, base: str) -> DataFrame:
    """Attribute names of uploads: headers and catalog columns."""
    loads = table(spark, base, "load_results")
    heads = loads.select(F.explode(F.map_keys("mapping")).alias("name")).unionByName(loads.select(F.explode("new_fields").alias("name")))
    return heads.unionByName(table(spark, base, "catalog_columns").select(F.col("column_name").alias("name"))).distinct()


SQL_NAMES = "names AS (SELECT DISTINCT name FROM (SELECT unnest(map_keys(mapping)) AS name FROM load_results UNION ALL SELECT unnest(new_fields) FROM load_results UNION ALL SELECT column_name FROM catalog_columns))"


# --- documents -----------------------------------------------------------------------


@query(f"{WITH_META} SELECT doc_id, i - 1 AS chunk_index, chunks[i] AS text, length(chunks[i]) AS chunk_size FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM (SELECT doc_id, {sql_chunks('content')} AS chunks FROM meta))")
def doc_chunks(spark, base):
    full = docs(spark, base).withColumn("content", D.content("text", "file_name"))
    rows = full.select("doc_id", F.posexplode(texts.character_chunks("content")).alias("i", "text"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), "text", F.char_length("text").cast("bigint").alias("chunk_size"))


@query(f"{WITH_META}, c AS (SELECT {sql_topic('summary')} AS collection, {sql_chunks('content')} AS chunks FROM meta), e AS (SELECT collection, unnest(chunks) AS chunk FROM c) SELECT collection, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM e GROUP BY collection")
def doc_chunk_stats(spark, base):
    return D.chunks(docs(spark, base)).groupBy("collection").agg(F.count("*").alias("chunks"), F.sum("chunk_size").cast("bigint").alias("chars"))


@query(f"{WITH_META} SELECT doc_id, summary FROM meta")
def doc_summary5(spark, base):
    return docs(spark, base).select("doc_id", texts.first_sentences(D.content("text", "file_name"), "file_name").alias("summary"))


@query(f"SELECT doc_id, substring(text, 1, 500) AS preview FROM documents")
def doc_preview(spark, base):
    return docs(spark, base).select("doc_id", texts.preview("text").alias("preview"))


_COLLAPSED = f"regexp_replace({sql_strip('text')}, '{WS}+', ' ', 'g')"


@query(
    f"""WITH b AS (SELECT doc_id, coalesce({_COLLAPSED}, '') AS t FROM documents),
    s AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM b),
    c AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) AS BIGINT) + i - 1) AS sizes FROM s),
    k AS (SELECT *, coalesce(list_position(list_transform(sizes, lambda z: z > 200), true), 0) AS stop FROM c)
    SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN stop = 1 THEN regexp_replace(substring(t, 1, 200), '{WS}+$', '') || '...' ELSE array_to_string(p[1:(CASE WHEN stop = 0 THEN len(p) ELSE stop - 1 END)], ' ') END AS summary FROM k"""
)
def doc_summary200(spark, base):
    return docs(spark, base).select("doc_id", texts.short_summary("text").alias("summary"))


_UNION = "SELECT 'doc' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), event_type FROM events UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name || ' p_retailprice' FROM part UNION ALL SELECT 'node', CAST(node_no AS VARCHAR), text FROM graph_nodes"


def _texts_of(spark, base):
    parts = [
        docs(spark, base).select(F.lit("doc").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text"),
        table(spark, base, "events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text")),
        table(spark, base, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text")),
        table(spark, base, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" p_retailprice")).alias("text")),
        table(spark, base, "graph_nodes").select(F.lit("node").alias("kind"), F.col("node_no").cast("string").alias("id"), "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH u AS ({_UNION}) SELECT kind, id, {sql_topic('coalesce(text, chr(32))')} AS collection FROM u")
def doc_collection(spark, base):
    return _texts_of(spark, base).select("kind", "id", texts.topic("text").alias("collection"))


@query(f"WITH u AS ({_UNION}) SELECT kind, {sql_topic('coalesce(text, chr(32))')} AS collection, count(*) AS n FROM u GROUP BY ALL")
def doc_collection_counts(spark, base):
    return _texts_of(spark, base).groupBy("kind", texts.topic("text").alias("collection")).agg(F.count("*").alias("n"))


_FOLDER = sql_folder("summary", sql_topic("summary"), sql_modality("file_name"))


@query(f"{WITH_META} SELECT doc_id, {_FOLDER} AS folder FROM meta")
def doc_folder(spark, base):
    s = docs(spark, base).withColumn("s", texts.first_sentences(D.content("text", "file_name"), "file_name"))
    return s.select("doc_id", texts.folder_name("s", texts.topic("s"), files.modality("file_name")).alias("folder"))


@query(
    f"""{WITH_META} SELECT file_id, file_name AS original_name, coalesce(tenant_id, 'tenant_default') AS tenant_id, {sql_topic('summary')} AS collection_hint, substring(summary, 1, 500) AS summary_preview, {sql_ext('file_name')} AS extension, {sql_modality('file_name')} AS modality, length(content) AS size_chars FROM meta"""
)
def doc_metadata(spark, base):
    return D.metadata(docs(spark, base)).drop("summary")


@query(f"{WITH_META}, c AS (SELECT file_id, file_name, tenant_id, unnest({sql_chunks('content')}) AS chunk FROM meta) SELECT file_id, any_value(file_name) AS original_name, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM c GROUP BY file_id")
def chunk_file_join(spark, base):
    d = docs(spark, base)
    sizes = D.chunks(d).groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("chunk_size").cast("bigint").alias("chars"))
    return sizes.join(D.metadata(d).select("file_id", "original_name"), "file_id").select("file_id", "original_name", "chunks", "chars")


@query(f"{WITH_META}, c AS (SELECT file_id, {sql_chunks('content')} AS chunks FROM meta) SELECT file_id || ':file' AS node_id, 'file' AS node_type, -1 AS chunk_index FROM c UNION ALL SELECT file_id || ':chunk:' || (i - 1), 'chunk', CAST(i - 1 AS INTEGER) FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM c)")
def node_build(spark, base):
    return D.nodes(docs(spark, base)).select("node_id", F.col("metadata.node_type").alias("node_type"), F.coalesce("metadata.chunk_index", F.lit(-1)).alias("chunk_index"))


@query(f"SELECT file_id, {sql_size('size_bytes')} AS size FROM processing_results WHERE size_bytes IS NOT NULL GROUP BY ALL")
def human_sizes(spark, base):
    return table(spark, base, "processing_results").where("size_bytes is not null").select("file_id", texts.human_size("size_bytes").alias("size")).distinct()


@query("SELECT table_name, column_name, CASE WHEN max_chars IS NOT NULL THEN data_type || '(' || max_chars || ')' ELSE data_type END AS display FROM catalog_columns")
def display_types(spark, base):
    return table(spark, base, "catalog_columns").select("table_name", "column_name", texts.display_type("data_type", "max_chars").alias("display"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digest(spark, base):
    return docs(spark, base).where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, coalesce(nullif(text, ''), nullif(file_name, ''), 'none') AS description FROM documents")
def descriptive_choice(spark, base):
    return docs(spark, base).select("doc_id", texts.descriptive_text("text", "file_name", F.lit("none")).alias("description"))


# --- files ---------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT original_name AS name FROM processing_results"


def _file_names(spark, base):
    return table(spark, base, "processing_results").select(F.col("original_name").alias("name")).distinct()


@query(f"WITH n AS ({_NAMES}) SELECT name, {sql_media('name')} <> 'unknown' AS is_media, {sql_media('name')} AS media_type FROM n")
def media_route(spark, base):
    return _file_names(spark, base).select("name", files.is_media("name").alias("is_media"), files.media_type("name").alias("media_type"))


_TYPES = " ".join(f"WHEN {sql_ext('name')} IN {sql_list(e)} THEN '{k}'" for k, e in files.FILE_TYPES.items())


@query(f"WITH n AS ({_NAMES}) SELECT name, CASE {_TYPES} ELSE 'unknown' END AS file_type FROM n")
def file_type_map(spark, base):
    return _file_names(spark, base).select("name", files.file_type("name").alias("file_type"))


_OTHER = f"CASE WHEN {sql_modality('name')} <> 'text' THEN {sql_modality('name')} WHEN string_split({sql_mime('name')}, '/')[1] = 'text' OR {sql_ext('name')} IN ('txt','md','csv','json','html','htm','xml','yaml','yml','log','pdf','doc','docx') THEN 'text' ELSE 'other' END"


@query(f"WITH n AS ({_NAMES}) SELECT name, {sql_mime('name')} AS mime_type, {sql_modality('name')} AS modality, {_OTHER} AS encoder_modality FROM n")
def mime_modality(spark, base):
    return _file_names(spark, base).select("name", files.mime_type("name").alias("mime_type"), files.modality("name").alias("modality"), files.encoder_modality("name").alias("encoder_modality"))


@query(f"SELECT file_id, original_name, {sql_media('original_name')} AS modality, {sql_title(sql_media('original_name'))} || ' file ' || original_name AS summary, 'media_assets' AS collection_hint FROM processing_results WHERE {sql_media('original_name')} <> 'unknown' GROUP BY ALL")
def media_fallback(spark, base):
    rows = table(spark, base, "processing_results").where(files.is_media("original_name")).select("file_id", F.col("original_name").alias("file_name")).distinct()
    return D.media_fallback(rows).join(rows.select("file_id", F.col("file_name").alias("original_name")), "original_name").select("file_id", "original_name", "modality", "summary", "collection_hint").distinct()


@query("SELECT count(*) AS total_files, CAST(count(*) FILTER (m) AS BIGINT) AS media, CAST(count(*) FILTER (NOT m) AS BIGINT) AS non_media FROM (SELECT " + sql_media("original_name") + " <> 'unknown' AS m FROM processing_results)")
def file_counts(spark, base):
    m = files.is_media("original_name")
    return table(spark, base, "processing_results").agg(F.count("*").alias("total_files"), F.count_if(m).alias("media"), F.count_if(~m).alias("non_media"))


@query(
    """WITH d AS (SELECT DISTINCT file_id, tenant_id AS folder, 'upload' || (ascii(substring(file_id, 20, 1)) % 7) || '.txt' AS name FROM processing_results), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY file_id) - 1 AS k FROM d)
    SELECT file_id, folder, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.txt$', '') || '_' || k || '.txt' END AS stored_name FROM r"""
)
def storage_name_dedupe(spark, base):
    rows = table(spark, base, "processing_results").select("file_id", F.col("tenant_id").alias("folder"), F.concat(F.lit("upload"), (F.ascii(F.substring("file_id", 20, 1)) % 7).cast("string"), F.lit(".txt")).alias("name")).distinct()
    return D.stored_names(rows, "folder", "name", "file_id").select("file_id", "folder", "stored_name")


@query(
    """WITH v AS (SELECT DISTINCT file_id, size_bytes % 20000 AS frames, CAST(CASE WHEN size_bytes % 5 = 0 THEN 0 ELSE 24 + size_bytes % 7 END AS DOUBLE) AS fps FROM processing_results WHERE modality = 'video' AND size_bytes IS NOT NULL), n AS (SELECT *, CAST(least(greatest(1, floor(frames / CASE WHEN fps > 0 THEN fps ELSE 30.0 END * 0.3)), 32, frames) AS INTEGER) AS k FROM v)
    SELECT file_id, array_to_string(CASE WHEN k > 0 THEN list_transform(range(0, k), lambda i: CAST(floor(i * (frames - 1) / greatest(k - 1, 1)::DOUBLE) AS INTEGER)) ELSE [] END, ',') AS frames FROM n"""
)
def video_frame_plan(spark, base):
    v = table(spark, base, "processing_results").where("modality = 'video' and size_bytes is not null").select("file_id", (F.col("size_bytes") % 20000).alias("frames"), F.when(F.col("size_bytes") % 5 == 0, 0.0).otherwise((24 + F.col("size_bytes") % 7).cast("double")).alias("fps")).distinct()
    return v.select("file_id", F.array_join(files.frame_plan("frames", "fps", F.lit(32)).cast("array<string>"), ",").alias("frames"))


@query("SELECT plan_no, CASE WHEN starts_with(path, '/archive/') THEN substring(path, 10) ELSE nullif(path, '') END AS relative FROM path_plans GROUP BY ALL")
def relative_paths(spark, base):
    return table(spark, base, "path_plans").select("plan_no", files.relative_path("path", "/archive").alias("relative")).distinct()


# --- attribute names -----------------------------------------------------------------


@query(f"WITH {SQL_NAMES} SELECT name, {sql_normalize('name')} AS norm FROM names")
def attr_normalize(spark, base):
    return names(spark, base).select("name", A.normalize("name").alias("norm"))


@query(f"WITH {SQL_NAMES} SELECT name, {sql_is_id('name')} AS is_id FROM names")
def attr_is_id(spark, base):
    return names(spark, base).select("name", A.is_id("name").alias("is_id"))


@query(f"WITH {SQL_NAMES} SELECT name, {sql_group('name')} AS synonym_group FROM names")
def attr_synonym_group(spark, base):
    return names(spark, base).select("name", A.synonym_group("name").alias("synonym_group"))


_TOKENS = "list_distinct(regexp_extract_all({}, '[a-z]+'))".format


@query(f"WITH {SQL_NAMES} SELECT name, array_to_string(list_sort({_TOKENS(sql_normalize('name'))}), ' ') AS tokens FROM names")
def attr_tokens(spark, base):
    return names(spark, base).select("name", F.array_join(F.array_sort(A.tokens("name")), " ").alias("tokens"))


_A, _B = _TOKENS(sql_normalize("h")), _TOKENS(sql_normalize("c"))
_HEADERS = "SELECT DISTINCT h, c FROM (SELECT unnest(map_keys(mapping)) AS h FROM load_results), (SELECT DISTINCT column_name AS c FROM catalog_columns WHERE column_name IS NOT NULL)"


@query(f"WITH p AS ({_HEADERS}) SELECT h AS header, c AS column_name, round(CASE WHEN len({_A}) > 0 AND len({_B}) > 0 THEN len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B})))::DOUBLE ELSE 0 END, 6) AS overlap, coalesce({sql_group('h')} = {sql_group('c')}, false) AS synonyms FROM p")
def attr_token_jaccard(spark, base):
    from siltstone.plans.matching import header_pairs

    return header_pairs(spark, base).select("header", "column_name", F.round(A.token_overlap("header", "column_name"), 6).alias("overlap"), A.are_synonyms("header", "column_name").alias("synonyms"))


@query(
    """WITH t AS (SELECT DISTINCT data_type AS a FROM catalog_columns), u AS (SELECT a, b.b FROM t, (SELECT DISTINCT data_type AS b FROM catalog_columns) b)
    SELECT a AS type_a, b AS type_b, CASE WHEN a = b THEN 1.0 WHEN (a IN ('INTEGER','NUMERIC','BIGINT') AND b IN ('INTEGER','NUMERIC','BIGINT')) OR (a IN ('VARCHAR','TEXT','CHAR') AND b IN ('VARCHAR','TEXT','CHAR')) OR (a IN ('TIMESTAMP','DATE','TIME') AND b IN ('TIMESTAMP','DATE','TIME')) THEN 0.8 ELSE 0.3 END::DOUBLE AS score FROM u"""
)
def attr_type_compat(spark, base):
    kinds = table(spark, base, "catalog_columns").agg(F.collect_set("data_type").alias("kinds"))
    pairs = kinds.select("kinds", F.explode("kinds").alias("type_a")).select("type_a", F.explode("kinds").alias("type_b"))
    return pairs.select("type_a", "type_b", A.type_compatibility("type_a", "type_b").alias("score"))


_VALUE_TYPE = "CASE WHEN v IS NULL THEN 'TEXT' WHEN length(v) > 10 AND (contains(v, 'T') OR contains(v, '-')) THEN 'TIMESTAMP' WHEN length(v) > 255 THEN 'TEXT' ELSE 'VARCHAR' END"


@query(f"WITH u AS (SELECT 'documents.text' AS c, text AS v FROM documents UNION ALL SELECT 'documents.lang', lang FROM documents UNION ALL SELECT 'customer.c_name', c_name FROM customer UNION ALL SELECT 'events.props', props FROM events UNION ALL SELECT 'path_plans.path', path FROM path_plans) SELECT c AS column_name, {_VALUE_TYPE} AS value_type, count(*) AS n FROM u GROUP BY ALL")
def infer_value_type(spark, base):
    parts = [("documents", "text"), ("documents", "lang"), ("customer", "c_name"), ("events", "props"), ("path_plans", "path")]
    out = None
    for t, c in parts:
        p = table(spark, base, t).select(F.lit(f"{t}.{c}").alias("column_name"), A.infer_text_type(c).alias("value_type"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("column_name", "value_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY k) AS i FROM (SELECT 'customer.c_name' AS c, c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT 'customer.c_mktsegment', c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'documents.text', doc_id, text FROM documents UNION ALL SELECT 'documents.source', doc_id, source FROM documents) WHERE v IS NOT NULL), s AS (SELECT c, {_VALUE_TYPE} AS t, length(v) AS n FROM r WHERE i <= 100)
    SELECT c AS column_name, CASE WHEN count(DISTINCT t) <> 1 THEN 'TEXT' WHEN min(t) = 'VARCHAR' THEN 'VARCHAR(' || least((max(n) // 50 + 1) * 50, 1000) || ')' ELSE min(t) END AS column_type FROM s GROUP BY c"""
)
def infer_column_type(spark, base):
    out = None
    for t, k, c in (("customer", "c_custkey", "c_name"), ("customer", "c_custkey", "c_mktsegment"), ("documents", "doc_id", "text"), ("documents", "doc_id", "source")):
        first = table(spark, base, t).where(F.col(c).isNotNull()).orderBy(k).limit(100)
        p = first.agg(A.unified_type(F.collect_set(A.infer_text_type(c)), F.max(F.char_length(c))).alias("column_type")).select(F.lit(f"{t}.{c}").alias("column_name"), "column_type")
        out = p if out is None else out.unionByName(p)
    return out


@query(f"WITH l AS (SELECT table_name AS t, list(column_name ORDER BY col_no) AS c FROM catalog_columns GROUP BY table_name) SELECT t AS table_name, substring('table_' || array_to_string(list_transform(c[1:3], lambda x: {sql_normalize('x')}), '_'), 1, 50) AS generated FROM l")
def generate_table_name(spark, base):
    l = table(spark, base, "catalog_columns").groupBy("table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_no", "column_name"))), lambda s: s["column_name"]).alias("c"))
    return l.select("table_name", A.table_name(F.col("c")).alias("generated"))
