"""Rows that fail to parse: typed valid rows, and the others with their reasons.

Every record is split into nullable text fields (native ``split`` for records without a
quote, one Arrow UDF for the rest, since a regular expression on the JVM can exhaust the
stack on long quoted fields). Cast and constraint rules are evaluated as native expressions
over the zipped arrays of fields and column rules into an array of errors; rows are split by
whether it is empty.

Records of a file that repeat a row number count once. A null record reads as empty. Files
without a header or without a load result are skipped. Records meet their file's rules in a
join that spreads files with more than their share of all records over salts in proportion.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import skew_join

BOM = "﻿"


@F.pandas_udf(T.ArrayType(T.StringType()))
def quoted_fields(raw: pd.Series, delim: pd.Series) -> pd.Series:
    """The fields of records that hold quotes; null where the quoting is broken."""
    rules: dict[str, re.Pattern] = {}

    def split(text: str | None, d: str) -> list[str] | None:
        if text is None:
            return None
        rule = rules.get(d)
        if rule is None:
            rule = rules[d] = re.compile(r'(?:"([^"]*(?:""[^"]*)*)"|([^"' + re.escape(d) + r"]*))(" + re.escape(d) + r"|\Z)")
        out, at = [], 0
        while True:
            m = rule.match(text, at)
            if m is None:
                return None
            out.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2))
            at = m.end()
            if not m.group(3):
                return out

    return pd.Series([split(t, d) for t, d in zip(raw, delim)], dtype=object)


def split_fields(raw: Column, delim: Column) -> Column:
    """Fields of a record, null where its quoting is broken."""
    plain = F.when(delim == ",", F.split(raw, ",", -1)).when(delim == ";", F.split(raw, ";", -1)).when(delim == "\t", F.split(raw, "\t", -1)).when(delim == "|", F.split(raw, "\\|", -1))
    plain = plain.otherwise(F.split(raw, F.concat(F.lit("\\Q"), delim, F.lit("\\E")), -1))
    quoted = raw.contains('"')
    return F.when(quoted, quoted_fields(F.when(quoted, raw), delim)).otherwise(plain)


def fits(value: Column, kind: Column, most: Column, nullable: Column) -> Column:
    """Whether a trimmed text fits a column of the catalog."""
    date = F.substring(value, 1, 10)
    time_ok = (F.length(value) == 10) | value.substr(F.lit(11), F.length(value)).rlike("^[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\\z")
    digits = F.regexp_replace(value, "^[+-]?0*", "")
    size = F.when(digits == "", 0).when(F.length(digits) <= 10, digits.try_cast("bigint"))
    whole = value.rlike("^[+-]?[0-9]+\\z") & F.coalesce(size <= F.when(value.startswith("-"), 2147483648).otherwise(2147483647), F.lit(False))
    return (
        F.when(value == "", nullable)
        .when(kind == "INTEGER", whole)
        .when(kind == "NUMERIC", value.rlike("^[+-]?[0-9]+(?:\\.[0-9]+)?\\z"))
        .when(kind == "BOOLEAN", F.lower(value).isin("true", "false"))
        .when(kind == "TIMESTAMP", date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z") & (F.substring(date, 1, 4) != "0000") & date.try_cast("date").isNotNull() & time_ok)
        .when(kind == "VARCHAR", F.coalesce(F.char_length(value) <= most, F.lit(True)))
        .otherwise(True)
    )


def file_rules(rows: DataFrame, loads: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_no, delim, rules): for each header field of a file the catalog column it goes to, if any."""
    files = loads.where(F.col("delim").isNotNull() & (F.col("delim") != "")).groupBy("file_no").agg(F.max_by(F.struct("delim", "table_name", "mapping"), "loaded_at").alias("l")).select("file_no", "l.*")
    heads = rows.where("row_no = 0").groupBy("file_no").agg(F.max("raw").alias("raw"))
    heads = heads.join(files, "file_no").select("file_no", "delim", "table_name", "mapping", split_fields(F.regexp_replace("raw", f"^{BOM}", ""), F.col("delim")).alias("names"))
    fields = heads.select("file_no", "delim", "table_name", "mapping", F.posexplode("names").alias("pos", "name"))
    fields = fields.withColumn("column_name", F.coalesce(F.col("mapping")[F.col("name")], F.col("mapping")[F.trim("name")]))
    columns = catalog.select("table_name", "column_name", "data_type", "max_chars", "is_nullable").dropDuplicates(["table_name", "column_name"])
    known = fields.join(columns, ["table_name", "column_name"], "left")
    rule = F.struct("pos", F.col("name"), F.col("column_name"), F.col("data_type").alias("kind"), F.col("max_chars").alias("most"), F.coalesce("is_nullable", F.lit(True)).alias("nullable"))
    return known.groupBy("file_no").agg(F.max("delim").alias("delim"), F.max("table_name").alias("table_name"), F.sort_array(F.collect_list(rule)).alias("rules"))


def checked_rows(rows: DataFrame, loads: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_no, row_no, table_name, raw, fields, rules, errors): every record once, with all its errors in order."""
    records = rows.where("row_no >= 1").groupBy("file_no", "row_no").agg(F.max(F.coalesce("raw", F.lit(""))).alias("raw"))
    counts = rows.groupBy("file_no").agg(F.count("*").alias("n"))
    joined = skew_join(records, file_rules(rows, loads, catalog), ["file_no"], ["row_no"], counts=counts).withColumn("fields", split_fields(F.col("raw"), F.col("delim")))
    pairs = F.arrays_zip(F.col("rules").alias("rule"), F.col("fields").alias("value"))
    # Both arrays have the same length here; spaces around a value do not count.
    bad = F.filter(pairs, lambda p: p["rule"]["kind"].isNotNull() & ~fits(F.trim(p["value"]), p["rule"]["kind"], p["rule"]["most"], p["rule"]["nullable"]))
    errors = (
        F.when(F.col("fields").isNull(), F.array(F.struct(F.lit("quoting").alias("reason"), F.lit(None).cast("string").alias("field"))))
        .when(F.size("fields") != F.size("rules"), F.array(F.struct(F.lit("column_count").alias("reason"), F.lit(None).cast("string").alias("field"))))
        .otherwise(F.transform(bad, lambda p: F.struct(F.lit("invalid_value").alias("reason"), p["rule"]["name"].alias("field"))))
    )
    return joined.withColumn("errors", errors).select("file_no", "row_no", "table_name", "raw", "fields", "rules", "errors")


def failed_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0).select("file_no", "row_no", F.col("errors")[0]["reason"].alias("reason"))


def typed_value(value: Column, kind: Column) -> Column:
    """A fitting text as (text, int, double, boolean, timestamp); the member of its kind is filled."""
    v = F.nullif(F.trim(value), F.lit(""))
    return F.struct(
        F.when(kind.isNull() | kind.isin("TEXT", "VARCHAR"), v).alias("text"),
        F.when(kind == "INTEGER", F.regexp_replace(v, "^\\+", "").try_cast("int")).alias("integer"),
        F.when(kind == "NUMERIC", v.try_cast("double")).alias("numeric"),
        F.when(kind == "BOOLEAN", F.lower(v) == "true").alias("flag"),
        F.when(kind == "TIMESTAMP", F.regexp_replace(v, "T", " ").try_cast("timestamp")).alias("moment"),
    )


def valid_values(checked: DataFrame) -> DataFrame:
    """(file_no, row_no, table_name, column_name, value): typed values of the valid rows, new fields under their header name."""
    ok = checked.where(F.size("errors") == 0)
    cells = ok.select("file_no", "row_no", "table_name", F.explode(F.arrays_zip(F.col("rules").alias("rule"), F.col("fields").alias("value"))).alias("c"))
    return cells.select("file_no", "row_no", "table_name", F.coalesce("c.rule.column_name", "c.rule.name").alias("column_name"), typed_value(F.col("c.value"), F.col("c.rule.kind")).alias("value"))


def load_summary(checked: DataFrame) -> DataFrame:
    """(file_no, rows_inserted, rows_failed, error): what the load results should say."""
    first = F.min(F.when(F.size("errors") > 0, F.struct("row_no", F.col("errors")[0]["reason"].alias("reason"), F.col("errors")[0]["field"].alias("field"))))
    out = checked.groupBy("file_no").agg(F.count_if(F.size("errors") == 0).cast("int").alias("rows_inserted"), F.count_if(F.size("errors") > 0).cast("int").alias("rows_failed"), first.alias("e"))
    return out.select("file_no", "rows_inserted", "rows_failed", F.when(F.col("e").isNotNull(), F.concat(F.lit("row "), F.col("e.row_no"), F.lit(": "), F.col("e.reason"), F.coalesce(F.concat(F.lit(" in "), F.col("e.field")), F.lit("")))).alias("error"))
