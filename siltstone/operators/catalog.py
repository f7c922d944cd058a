"""The catalog, database state, statistics and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.functions import files, texts
from siltstone.operators.loader import SYSTEM_TABLES, number_rows, quoted, table_key
from siltstone.runtime import cut_lineage, skew_join

CATALOG = "table_name string, ordinal int, column_name string, data_type string"


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog rows of named DataFrames, with normal form and identifier mark; schemas only, no data is read."""
    rows = [(name, i, f.name, f.metadata.get("comment") or f.dataType.simpleString()) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, CATALOG).withColumn("norm_name", A.normalize("column_name")).withColumn("is_id", A.is_id("column_name"))


def session_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {t.name: spark.table(quoted(t.name)) for t in spark.catalog.listTables() if not t.isTemporary and t.name not in SYSTEM_TABLES}


def inverted_index(catalog: DataFrame) -> DataFrame:
    """(norm_name, tables): in which tables an attribute that is no identifier occurs."""
    return catalog.where(~F.col("is_id")).groupBy("norm_name").agg(F.sort_array(F.collect_set("table_name")).alias("tables"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count); counts come from the file footers where Parquet allows it."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """The first rows in order, each with the number of rows that are not shown."""
    total = df.agg(F.count("*").alias("_n"))
    top = df.orderBy(*order).limit(limit)
    return top.join(F.broadcast(total)).withColumn("more_rows", F.greatest(F.col("_n") - limit, F.lit(0))).drop("_n")


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, table_name, column_name): what was added and what was removed."""
    key = ["table_name", "column_name"]
    added = new.select(*key).distinct().join(old.select(*key), key, "left_anti").select(F.lit("added").alias("change"), *key)
    removed = old.select(*key).distinct().join(new.select(*key), key, "left_anti").select(F.lit("removed").alias("change"), *key)
    return added.unionByName(removed)


def table_details(spark: SparkSession, name: str) -> dict:
    df = spark.table(quoted(name))
    return {"name": name, "columns": [{"name": f.name, "type": f.metadata.get("comment") or f.dataType.simpleString()} for f in df.schema.fields], "primary_key": table_key(spark, name), "row_count": df.count(), "relationships": []}


def state(catalog: DataFrame, collections: DataFrame, media: DataFrame) -> DataFrame:
    """(kind, name, details): tables with their columns, collections and media folders with their counts."""
    tables = catalog.groupBy("table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))), lambda c: F.concat(c["column_name"], F.lit(" "), c["data_type"])).alias("l"))
    count = lambda df, kind: df.groupBy("name").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", F.concat(F.col("n").cast("string"), F.lit(" files")).alias("details"))
    return tables.select(F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.array_join("l", ", ").alias("details")).unionByName(count(collections, "collection")).unionByName(count(media, "media"))


def storage_stats(df: DataFrame, group: str, size: str) -> DataFrame:
    """(group, files, bytes, display): files and sizes of each group, largest first by name."""
    return df.groupBy(group).agg(F.count("*").alias("files"), F.sum(size).cast("bigint").alias("bytes")).withColumn("display", texts.human_size(F.coalesce("bytes", F.lit(0))))


def totals(meta: DataFrame, tables: int | DataFrame, recent: str = "7 days") -> DataFrame:
    """One row (total_files, total_size, tables, collections, media_directories, recent_uploads, storage_breakdown) over file metadata.

    Recent are files created within ``recent`` of the last one. Grouped by modality and collection
    first, which are few, so that only these groups are gathered.
    """
    groups = meta.groupBy("modality", "collection_hint").agg(F.count("*").alias("n"), F.sum("size_bytes").cast("bigint").alias("bytes"))
    last = meta.agg(F.max("created_at").alias("last"))
    new = meta.join(F.broadcast(last)).agg(F.count_if(F.col("created_at") >= F.expr(f"last - INTERVAL {recent}")).alias("recent_uploads"))
    kinds = groups.groupBy("modality").agg(F.sum("n").alias("n"), F.sum("bytes").cast("bigint").alias("bytes"), F.count_if(F.col("modality") == "text").alias("collections"))
    shown = F.sort_array(F.collect_list(F.concat(F.col("modality"), F.lit(": "), texts.human_size(F.coalesce("bytes", F.lit(0))))))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), texts.human_size(F.coalesce(F.sum("bytes"), F.lit(0))).alias("total_size"), F.coalesce(F.sum("collections"), F.lit(0)).alias("collections"), F.count_if(F.col("modality") != "text").alias("media_directories"), F.array_join(shown, ", ").alias("storage_breakdown"))
    counted = F.lit(tables) if isinstance(tables, int) else F.col("tables")
    rows = total.join(F.broadcast(new))
    rows = rows if isinstance(tables, int) else rows.join(F.broadcast(tables))
    return rows.select("total_files", "total_size", counted.cast("bigint").alias("tables"), "collections", "media_directories", "recent_uploads", "storage_breakdown")


def tree_rows(docs: DataFrame, text: str, name: str, order: str, collection: str, modality: str, size: str) -> DataFrame:
    """(folder, file, size, mime_type, files): the two-level tree as rows; of equal names in a folder the last wins."""
    rows = docs.select(texts.folder_name(text, collection, modality).alias("folder"), F.col(name).alias("file"), texts.human_size(size).alias("size"), files.mime_type(name).alias("mime_type"), F.col(order).alias("_o"))
    return rows.groupBy("folder", "file").agg(F.max_by(F.struct("size", "mime_type"), "_o").alias("s")).select("folder", "file", "s.size", "s.mime_type")


def placed_tree(rows: DataFrame) -> DataFrame:
    """rows + place: 1, 2 ... of the files of each folder, whatever their case.

    Files are numbered over range partitions and each folder's numbers moved to start at 1, so
    that a folder with a third of all files is no single task's.
    """
    numbered = cut_lineage(number_rows(rows.withColumn("_k", F.lower("file")), ["folder", "_k", "file"], "_n"))
    starts = numbered.groupBy("folder").agg(F.min("_n").alias("_first"), F.count("*").alias("n"))
    placed = skew_join(numbered, starts.select("folder", "_first"), ["folder"], ["file"], counts=starts.select("folder", "n"))
    return placed.withColumn("place", F.col("_n") - F.col("_first") + 1).drop("_k", "_n", "_first")


def tree_matches(rows: DataFrame, query: str, columns: tuple[str, ...] = ("folder", "file")) -> DataFrame:
    """Tree rows whose name or path holds the query at any depth, whatever its case; all rows for an empty query."""
    hit = F.lit(not query)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    return rows.where(hit)


def storage_entries(paths: DataFrame, root: str, path_col: str = "path", size_col: str = "length") -> DataFrame:
    """(parent, name, kind, size, place): entries of a storage tree; dotted names are skipped, folders come before files."""
    rel = files.relative_path(path_col, root)
    rows = paths.select(rel.alias("rel"), F.col(size_col).alias("bytes")).where(~F.exists(F.split("rel", "/"), lambda s: s.startswith(".")))
    parent = lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_extract(p, "^(.*)/[^/]*$", 1)).otherwise("")
    leaf = rows.select(parent(F.col("rel")).alias("parent"), files.file_name("rel").alias("name"), F.lit("file").alias("kind"), texts.human_size("bytes").alias("size"))
    parts = F.split("rel", "/")
    folders = rows.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("dir")).distinct()
    dirs = folders.select(parent(F.col("dir")).alias("parent"), files.file_name("dir").alias("name"), F.lit("folder").alias("kind"), F.lit(None).cast("string").alias("size"))
    w = Window.partitionBy("parent").orderBy((F.col("kind") == "file").cast("int"), F.lower("name"), "name")
    return leaf.unionByName(dirs).withColumn("place", F.row_number().over(w))


def upload_summary(files_df: DataFrame, classification: str = "classification", error: str = "error") -> DataFrame:
    return files_df.agg(F.count("*").alias("total_files"), F.count_if(F.col(classification) == "SQL").alias("sql_files"), F.count_if(F.col(error).isNull()).alias("processed"), F.count_if(F.col(error).isNotNull()).alias("errors"))
