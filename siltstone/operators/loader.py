"""Loading rows into catalog tables: DDL, mapped inserts, keys and upserts.

Tables are Parquet tables of the session catalog; a table's key is its property
``siltstone.primary_key``. A load is appended, never rewritten, except by ``upsert``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.runtime import cut_lineage

KEY_PROPERTY = "siltstone.primary_key"
SYSTEM_TABLES = ("schema_jobs",)
#: Column that holds the order of incoming rows, if they have one.
ORDER = "__order"
SAMPLE_VALUES = 100
#: Storage of the inferred types; whole numbers may exceed 32 bits.
STORAGE = {"INTEGER": "bigint", "NUMERIC": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def first_values(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first 100 values (not null) of each of the keys; tasks keep only their own first ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return values.where("value is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLE_VALUES).drop("_r")


def column_types(rows: DataFrame, order: str | None = None) -> dict[str, str]:
    """Column type of each attribute from its first 100 values that are not null, in one pass over the rows."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    fields = [f for f in rows.schema.fields if f.name != order]
    cells = [F.struct(F.lit(f.name).alias("name"), F.col(quoted(f.name)).cast("string").alias("value"), A.infer_type(quoted(f.name), f.dataType.simpleString()).alias("kind")) for f in fields]
    found = first_values(rows.select(at.alias("_at"), F.explode(F.array(*cells)).alias("c")).select("_at", "c.*"), ["name"], ["_at"])
    types = {r["name"]: r["t"] for r in found.groupBy("name").agg(A.unified_type(F.collect_set("kind"), F.max(F.char_length("value"))).alias("t")).collect()}
    return {f.name: types.get(f.name, "TEXT") for f in fields}


def field_types(rows: DataFrame) -> DataFrame:
    """(schema, name, type, storage): the column type of each field of each schema of rows (schema, path, ordinal, fields, kinds).

    One pass for all schemas. Texts with a dash that are no times are TEXT here.
    """
    cells = F.arrays_zip(F.map_keys("fields").alias("name"), F.map_values("fields").alias("value"), F.col("kinds").alias("kind"))
    values = rows.where("fields is not null").select("schema", "path", "ordinal", F.explode(cells).alias("c")).select("schema", "path", "ordinal", "c.*")
    sample = first_values(values, ["schema", "name"], ["path", "ordinal"]).withColumn("kind", A.infer_kind_type("value", "kind"))
    types = sample.groupBy("schema", "name").agg(A.unified_type(F.collect_set("kind"), F.max(F.char_length("value"))).alias("type"), F.bool_and(F.col("value").try_cast("timestamp").isNotNull()).alias("times"))
    kind = F.when((F.col("type") == "TIMESTAMP") & ~F.col("times"), "TEXT").otherwise(F.col("type"))
    stored = F.create_map(*[F.lit(x) for pair in STORAGE.items() for x in pair])
    return types.withColumn("type", kind).select("schema", "name", "type", F.coalesce(stored[F.col("type")], F.lit("string")).alias("storage"))


def primary_key(names: list[str]) -> str | None:
    """The first identifier among the attributes, normalised."""
    return next((A.plain_normalize(n) for n in names if A.plain_is_id(n)), None)


def distinct_names(names: list[str]) -> list[str]:
    """The names that can be columns: those with a normal form, of equal ones the first."""
    return list({A.plain_normalize(n): n for n in reversed(names) if A.plain_normalize(n)}.values())[::-1]


def commented(types: dict[str, str], name: str) -> str:
    """The declared type of a column as its comment, for the catalog."""
    return f" COMMENT '{types[name]}'" if name in types else ""


def create_table(spark: SparkSession, name: str, rows: DataFrame, key: str | None = None, types: dict[str, str] | None = None) -> bool:
    """Create the table if it does not exist, with the columns of rows and their declared types as comments; True when it was created."""
    if spark.catalog.tableExists(name):
        return False
    fields = [f for f in rows.schema.fields if f.name != ORDER]
    key = key or primary_key([f.name for f in fields])
    columns = ", ".join(f"{quoted(A.plain_normalize(f.name))} {f.dataType.simpleString()}{commented(types or {}, f.name)}" for f in fields)
    properties = f" TBLPROPERTIES ('{KEY_PROPERTY}'='{key}')" if key else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({columns}) USING parquet{properties}")
    return True


def table_key(spark: SparkSession, name: str) -> str | None:
    found = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").where(F.col("key") == KEY_PROPERTY).first()
    return found["value"] if found else None


def add_columns(spark: SparkSession, name: str, wanted: dict[str, str]) -> list[str]:
    """Add the columns the table lacks; old rows read null."""
    have = {c.lower() for c in spark.table(name).columns}
    fresh = {c: t for c, t in wanted.items() if c.lower() not in have}
    if fresh:
        spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({', '.join(f'{quoted(c)} {t}' for c, t in fresh.items())})")
    return list(fresh)


def ensure_overflow(spark: SparkSession, name: str, column: str = "extra") -> None:
    add_columns(spark, name, {column: "string"})


def mapped_rows(rows: DataFrame, target: dict[str, str], mapping: dict[str, str], new_fields: list[str] = (), extra_fields: list[str] = (), overflow: str = "extra", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows in the columns of target: mapped by name (case does not matter), missing ones null, extra fields as JSON.

    ``target`` gives the columns and types; a source that no column takes is dropped. Columns
    to ``keep`` pass as they are.
    """
    by_lower = {c.lower(): c for c in rows.columns}
    source_of = {v: k for k, v in mapping.items() if k.lower() in by_lower} | {A.plain_normalize(f): f for f in new_fields if f.lower() in by_lower}
    extras = [by_lower[f.lower()] for f in extra_fields if f.lower() in by_lower]
    out = []
    for column, kind in target.items():
        if column == overflow and extras:
            out.append(F.to_json(F.struct(*[F.col(quoted(e)).alias(A.plain_normalize(e)) for e in extras]), {"ignoreNullFields": "false"}).alias(column))
        else:
            source = source_of.get(column) or column
            found = by_lower.get(source.lower())
            out.append((F.expr(f"try_cast({quoted(found)} AS {kind})") if found else F.lit(None).cast(kind)).alias(column))
    return rows.select(*out, *keep)


def insert_if_absent(rows: DataFrame, existing: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The rows to append: of each key the first in order, if the target does not hold it. Null keys are kept."""
    w = Window.partitionBy(key).orderBy(order)
    first = rows.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return first.join(existing.select(key), key, "left_anti").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def number_rows(rows: DataFrame, order: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """rows + name: start + 1, start + 2, ... in order, without one task that sorts all rows.

    Rows are range-partitioned by the order; partition sizes, one row each, give the offsets.
    """
    spread = cut_lineage(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    w = Window.partitionBy("_p").orderBy(*order)
    begin = F.lit(start) if isinstance(start, int) else start
    return spread.join(F.broadcast(offsets), "_p").withColumn(name, (begin + F.col("_o") + F.row_number().over(w)).cast("bigint")).drop("_p", "_o")


def surrogate_keys(rows: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows + key: numbers after the largest key of the target, in order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    return number_rows(rows, order, key, int(top))


def insert_rows(spark: SparkSession, name: str, rows: DataFrame, mapping: dict[str, str] | None = None, new_fields: list[str] = (), extra_fields: list[str] = ()) -> int:
    """Append rows to the table under its key rules; the number of rows that were added."""
    if extra_fields:
        ensure_overflow(spark, name)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows if ORDER in rows.columns else rows.withColumn(ORDER, F.monotonically_increasing_id())
    add_columns(spark, name, {A.plain_normalize(f): kinds[f] for f in new_fields if f in kinds})
    table = spark.table(name)
    target = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    mapping = mapping if mapping is not None else {c: A.plain_normalize(c) for c in rows.columns if c != ORDER and A.plain_normalize(c) in target}
    ready = mapped_rows(rows, target, mapping, new_fields, extra_fields, keep=(ORDER,))
    key = table_key(spark, name)
    if key and key in target:
        given = any(v == key for v in mapping.values()) or key in {A.plain_normalize(f) for f in new_fields}
        ready = insert_if_absent(ready, table, key, ORDER) if given else surrogate_keys(ready.drop(key), table, key, [ORDER])
    ready = cut_lineage(ready.select(*target))
    added = ready.count()
    ready.createOrReplaceTempView("_siltstone_load")
    spark.sql(f"INSERT INTO {quoted(name)} BY NAME SELECT * FROM _siltstone_load")
    spark.catalog.dropTempView("_siltstone_load")
    return added


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: Column | str, required: list[str] = ()) -> DataFrame:
    """existing with incoming rows put in place of those of equal key; the last incoming row of a key wins. Rows that lack the key or a required column are skipped."""
    ok = F.col(key).isNotNull()
    for c in required:
        ok = ok & F.col(c).isNotNull()
    kept = [c for c in incoming.columns if c in existing.columns]
    last = incoming.where(ok).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in kept]), order).alias("_s")).select("_s.*")
    return existing.join(last.select(key), key, "left_anti").select(*existing.columns).unionByName(last, allowMissingColumns=True)


def clear_tables(spark: SparkSession, keep: tuple[str, ...] = SYSTEM_TABLES, confirm: bool = False) -> list[str]:
    """Drop all tables but those kept; nothing happens without ``confirm``."""
    names = [t.name for t in spark.catalog.listTables() if not t.isTemporary and t.name not in keep]
    for n in names if confirm else []:
        spark.sql(f"DROP TABLE {quoted(n)}")
    return names
