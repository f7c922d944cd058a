"""Queries over drifting schemas and failing rows, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import row_validation, schema_drift
from siltstone.runtime import table

#: The report lines that can be read, each once, as fields with their types.
SQL_FIELDS = """lines AS (SELECT feed, report_file, line_no, max(reported_at) AS reported_at, max(raw_json) AS raw FROM load_reports WHERE feed IS NOT NULL AND report_file IS NOT NULL GROUP BY ALL),
    objects AS (SELECT * FROM lines WHERE CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' AND len(json_keys(raw)) = len(list_distinct(json_keys(raw))) ELSE false END),
    fields AS (SELECT feed, report_file, reported_at, line_no, json_extract_string(raw, '$.file_id') AS load, e.key AS field, CAST(e.value AS VARCHAR) AS value,
        CASE e.type WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'string' END AS kind
        FROM objects, json_each(raw) e)"""

SQL_DRIFT = f"""{SQL_FIELDS},
    kinds AS (SELECT feed, report_file, field, kind, count(*) AS n, row_number() OVER (PARTITION BY feed, report_file, field ORDER BY kind IS NULL, count(*) DESC, kind) AS r FROM fields GROUP BY feed, report_file, field, kind),
    typed AS (SELECT feed, report_file, field, kind FROM kinds WHERE r = 1),
    files AS (SELECT feed, report_file, lag(report_file) OVER (PARTITION BY feed ORDER BY max(reported_at), report_file) AS previous FROM fields GROUP BY feed, report_file),
    changes AS (SELECT f.feed, f.report_file, f.previous, x.field, o.kind AS old_kind, n.kind AS new_kind, n.field IS NULL AS gone, o.field IS NULL AS fresh
        FROM files f, (SELECT DISTINCT feed, report_file, field FROM typed) x
        LEFT JOIN typed o ON o.feed = f.feed AND o.report_file = f.previous AND o.field = x.field LEFT JOIN typed n ON n.feed = f.feed AND n.report_file = f.report_file AND n.field = x.field
        WHERE f.previous IS NOT NULL AND x.feed = f.feed AND x.report_file IN (f.report_file, f.previous)),
    changed AS (SELECT DISTINCT * FROM (SELECT feed, report_file, previous, field AS name, old_kind, new_kind, gone, fresh FROM changes)),
    held AS (SELECT feed, report_file, load, field, max(value) AS value FROM fields WHERE load IS NOT NULL GROUP BY ALL),
    loads AS (SELECT DISTINCT feed, report_file, load FROM held),
    shared AS (SELECT f.feed, f.report_file, f.previous, a.load FROM files f JOIN loads a ON a.feed = f.feed AND a.report_file = f.report_file JOIN loads b ON b.feed = f.feed AND b.report_file = f.previous AND b.load = a.load),
    sides AS (SELECT c.feed, c.report_file, c.name, c.gone, string_agg(s.load || '=' || coalesce(h.value, '(none)'), chr(1) ORDER BY s.load) AS all_values
        FROM changed c JOIN shared s ON s.feed = c.feed AND s.report_file = c.report_file LEFT JOIN held h ON h.feed = c.feed AND h.report_file = CASE WHEN c.gone THEN c.previous ELSE c.report_file END AND h.load = s.load AND h.field = c.name
        WHERE c.gone OR c.fresh GROUP BY c.feed, c.report_file, c.name, c.gone HAVING count(*) FILTER (h.value IS NOT NULL AND h.value <> 'null') > 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY feed, report_file, gone, all_values ORDER BY name) AS i FROM sides),
    renamed AS (SELECT o.feed, o.report_file, o.name AS old_field, n.name AS new_field FROM placed o JOIN placed n ON o.feed = n.feed AND o.report_file = n.report_file AND o.all_values = n.all_values AND o.i = n.i AND o.gone AND NOT n.gone)"""

SQL_RECORDS = """latest AS (SELECT file_no, arg_max(struct_pack(d := delim, t := table_name, m := mapping), loaded_at) AS l FROM load_results WHERE delim <> '' GROUP BY file_no),
    heads AS (SELECT file_no, regexp_replace(max(raw), '^﻿', '') AS raw FROM raw_rows WHERE row_no = 0 GROUP BY file_no),
    records AS (SELECT file_no, row_no, max(coalesce(raw, '')) AS raw FROM raw_rows WHERE row_no >= 1 GROUP BY ALL),
    texts AS (SELECT file_no, 0 AS row_no, raw FROM heads UNION ALL SELECT * FROM records),
    formed AS (SELECT r.file_no, row_no, raw, l.d AS d, l.t AS table_name, l.m AS mapping, '(?:"[^"]*(?:""[^"]*)*"|[^"' || l.d || ']*)' AS f FROM texts r JOIN latest USING (file_no)),
    cut AS (SELECT *, CASE WHEN NOT contains(raw, '"') THEN string_split(raw, d) WHEN regexp_full_match(raw, f || '(?:[' || d || ']' || f || ')*')
        THEN list_transform(regexp_extract_all(raw || d, '(' || f || ')[' || d || ']', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substring(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS parts FROM formed),
    named AS (SELECT file_no, table_name, i AS pos, parts[i] AS name, coalesce(mapping[parts[i]], mapping[trim(parts[i], ' ')]) AS column_name FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut WHERE row_no = 0)),
    rules AS (SELECT n.*, c.data_type AS kind, c.max_chars AS most, coalesce(c.is_nullable, true) AS nullable FROM named n LEFT JOIN (SELECT DISTINCT ON (table_name, column_name) * FROM catalog_columns) c ON c.table_name = n.table_name AND c.column_name = n.column_name),
    widths AS (SELECT file_no, count(*) AS width FROM rules GROUP BY file_no),
    body AS (SELECT c.*, width FROM cut c JOIN widths USING (file_no) WHERE row_no >= 1),
    cells AS (SELECT b.file_no, b.row_no, r.*, trim(b.parts[r.pos], ' ') AS v FROM body b JOIN rules r ON r.file_no = b.file_no WHERE len(b.parts) = width),
    bad AS (SELECT file_no, row_no, arg_min(name, pos) AS field FROM cells WHERE kind IS NOT NULL AND NOT CASE WHEN v = '' THEN nullable
        WHEN kind = 'INTEGER' THEN regexp_full_match(v, '[+-]?[0-9]+') AND coalesce(TRY_CAST(regexp_replace(v, '^\\+', '') AS HUGEINT) BETWEEN -2147483648 AND 2147483647, false)
        WHEN kind = 'NUMERIC' THEN regexp_full_match(v, '[+-]?[0-9]+([.][0-9]+)?') WHEN kind = 'BOOLEAN' THEN lower(v) IN ('true', 'false')
        WHEN kind = 'TIMESTAMP' THEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?') AND substring(v, 1, 4) <> '0000' AND TRY_CAST(substring(v, 1, 10) AS DATE) IS NOT NULL
        WHEN kind = 'VARCHAR' THEN coalesce(length(v) <= most, true) ELSE true END GROUP BY ALL),
    judged AS (SELECT b.file_no, b.row_no, CASE WHEN b.parts IS NULL THEN 'quoting' WHEN len(b.parts) <> b.width THEN 'column_count' WHEN bad.row_no IS NOT NULL THEN 'invalid_value' END AS reason, bad.field FROM body b LEFT JOIN bad ON bad.file_no = b.file_no AND bad.row_no = b.row_no)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(
    f"""WITH {SQL_DRIFT} SELECT feed, report_file, 'renamed' AS drift_kind, old_field, new_field FROM renamed
    UNION ALL SELECT feed, report_file, 'removed', name, '' FROM changed c WHERE gone AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.report_file = c.report_file AND r.old_field = c.name)
    UNION ALL SELECT feed, report_file, 'added', '', name FROM changed c WHERE fresh AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.report_file = c.report_file AND r.new_field = c.name)
    UNION ALL SELECT feed, report_file, 'retyped', name, name FROM changed WHERE old_kind <> new_kind"""
)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return schema_drift.drift(table(spark, base, "load_reports"))


@query()
def p2_table(spark: SparkSession, base: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, base, "load_reports"))


def _checked(spark: SparkSession, base: str) -> DataFrame:
    return row_validation.checked_rows(table(spark, base, "raw_rows"), table(spark, base, "load_results"), table(spark, base, "catalog_columns"))


@query(f"WITH {SQL_RECORDS} SELECT file_no, row_no, reason FROM judged WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return row_validation.failed_rows(_checked(spark, base))


@query()
def p3_valid(spark: SparkSession, base: str) -> DataFrame:
    out = row_validation.valid_values(_checked(spark, base))
    return out.select("file_no", "row_no", "table_name", "column_name", *[F.col(f"value.{k}").alias(k) for k in ("text", "integer", "numeric", "flag", "moment")])


@query(
    f"""WITH {SQL_RECORDS} SELECT file_no, CAST(count(*) FILTER (reason IS NULL) AS INTEGER) AS rows_inserted, CAST(count(*) FILTER (reason IS NOT NULL) AS INTEGER) AS rows_failed,
    arg_min('row ' || row_no || ': ' || reason || CASE WHEN reason = 'invalid_value' THEN ' in ' || field ELSE '' END, row_no) FILTER (reason IS NOT NULL) AS error FROM judged GROUP BY file_no"""
)
def p3_load_results(spark: SparkSession, base: str) -> DataFrame:
    return row_validation.load_summary(_checked(spark, base))
