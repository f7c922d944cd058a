"""Schemas that drift between files: changes of fields, and one consistent table.

Lines are loaded as path-value rows: each readable JSON object yields its top-level fields
with the raw value as text and its raw type, through the VARIANT type. Path and type
statistics are aggregated by file (partial aggregation; a file may hold a third of all
lines), each file is compared with the preceding one of its feed, and the consistent table
is projected with casts that report their failures. Lines meet what is known of their file or
field in joins that spread hot files and fields over salts.

Unreadable lines (cut, not an object, repeated keys) and null lines take no part. A line
delivered twice counts once. A file without readable lines is not part of its feed's
sequence. Field names compare exactly. A field that is null in a whole file has no type
there and is not retyped. Lines of a null feed or file have no predecessor, so no cases; the
consistent table holds them. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut_lineage, skew_join

KEY_FIELD = "file_id"


def _kind(v: Column) -> Column:
    """boolean, integer, decimal, string, array, object or null of a VARIANT."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "VOID", F.lit(None).cast("string"))
        .when(t == "BOOLEAN", "boolean")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def path_values(lines: DataFrame, json_col: str = "raw_json", keep: tuple[str, ...] = ("feed", "report_file", "reported_at", "line_no")) -> DataFrame:
    """keep + (load, field, value, kind): one row for each top-level field of each readable line, each line once.

    ``load`` is the line's key field as text; ``value`` the raw JSON text of the field.
    """
    docs = lines.select(*keep, F.try_parse_json(json_col).alias("doc")).where(F.schema_of_variant("doc").startswith("OBJECT"))
    fields = docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    load = F.try_variant_get("doc", f"$.{KEY_FIELD}", "string")
    return fields.select(*keep, load.alias("load"), F.col("key").alias("field"), F.to_json("value").alias("value"), _kind(F.col("value")).alias("kind"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each (feed, report_file, line_no) once; of different deliveries of a line the last text in order counts."""
    key = ["feed", "report_file", "line_no"]
    return lines.groupBy(*key).agg(F.max("reported_at").alias("reported_at"), F.max("raw_json").alias("raw_json"))


def file_order(fields: DataFrame) -> DataFrame:
    """(feed, report_file, previous): the preceding file of each file's feed by reported_at.

    Files are range-partitioned by feed and time, so a feed with a third of all files spreads
    over many tasks; a partition's first file follows the last one of the partition before it,
    of which there is one row each.
    """
    order = ["feed", "reported_at", "report_file"]
    files = fields.groupBy("feed", "report_file").agg(F.max("reported_at").alias("reported_at"))
    spread = cut_lineage(files.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    here = F.struct("feed", "report_file")
    ends = spread.groupBy("_p").agg(F.max_by(here, F.struct(*order)).alias("last"))
    before = ends.select("_p", F.lag("last").over(Window.orderBy("_p")).alias("before"))
    rows = spread.withColumn("inner", F.lag(here).over(w)).join(before, "_p").withColumn("prior", F.coalesce("inner", "before"))
    return rows.select("feed", "report_file", F.when(F.col("prior.feed") == F.col("feed"), F.col("prior.report_file")).alias("previous"))


def field_statistics(fields: DataFrame) -> DataFrame:
    """(feed, report_file, field, kind, filled, lines): type of most non-null values of each field of each file (ties: first by name)."""
    counts = fields.groupBy("feed", "report_file", "field", "kind").agg(F.count("*").alias("n"), F.max("reported_at").alias("reported_at"))
    most = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", F.translate("kind", "abdijos", "sojidba"))))
    return counts.groupBy("feed", "report_file", "field").agg(F.max("reported_at").alias("reported_at"), most.alias("kind"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.sum("n").alias("lines"))


def field_changes(stats: DataFrame) -> DataFrame:
    """(feed, report_file, previous, field, old_kind, new_kind, gone, fresh): fields of a file and its predecessor side by side."""
    order = file_order(stats).where(F.col("previous").isNotNull())
    key = ["feed", "report_file", "field"]
    now = stats.join(order, ["feed", "report_file"]).select(*key, "previous", F.lit(0).alias("old"), "kind")
    then = order.join(stats.select("feed", F.col("report_file").alias("previous"), "field", "kind"), ["feed", "previous"]).select(*key, "previous", F.lit(1).alias("old"), "kind")
    both = now.unionByName(then).groupBy(*key, "previous")
    side = lambda n: F.max(F.when(F.col("old") == n, F.col("kind")))
    return both.agg(side(1).alias("old_kind"), side(0).alias("new_kind"), (F.min("old") == 1).alias("gone"), (F.max("old") == 0).alias("fresh"))


def value_digests(fields: DataFrame, changes: DataFrame, stats: DataFrame) -> DataFrame:
    """(feed, report_file, old, field, d1, d2, filled, loads): one digest of the values of a vanished or new field over all loads that both files hold.

    Two fields hold the same values for all loads when their digests agree, so no pairs of
    fields are compared value by value. A field that a load lacks counts as a value of its own.
    """
    sides = changes.groupBy("feed", "report_file", "previous").agg(F.collect_list(F.when(F.col("gone"), F.col("field"))).alias("gone"), F.collect_list(F.when(F.col("fresh"), F.col("field"))).alias("fresh")).where((F.size("gone") > 0) & (F.size("fresh") > 0))
    wanted = cut_lineage(sides.select("feed", F.col("report_file").alias("change"), F.explode(F.array(F.struct(F.col("report_file"), F.lit(0).alias("old"), F.col("fresh").alias("names")), F.struct(F.col("previous").alias("report_file"), F.lit(1).alias("old"), F.col("gone").alias("names")))).alias("s")).select("feed", "change", "s.*"))
    # ``file_id`` marks that a file holds a load; it is a field of the line itself.
    lines = stats.groupBy("feed", "report_file").agg(F.max("lines").alias("n"))
    rows = skew_join(fields.where(F.col("load").isNotNull()), wanted, ["feed", "report_file"], ["line_no", "field"], counts=lines)
    rows = rows.where(F.array_contains("names", F.col("field")) | (F.col("field") == KEY_FIELD))
    once = rows.groupBy("feed", "change", "load", "old", "field").agg(F.max("value").alias("value"))
    shared = once.groupBy("feed", "change", "load").agg(F.max("old").alias("hi"), F.min("old").alias("lo"), F.map_from_entries(F.collect_list(F.struct(F.struct("old", "field"), "value"))).alias("held")).where("hi = 1 and lo = 0")
    names = wanted.groupBy("feed", "change").agg(F.flatten(F.collect_list(F.transform("names", lambda n: F.struct("old", n.alias("field"))))).alias("wanted"))
    held = skew_join(shared, names, ["feed", "change"], ["load"], counts=lines.withColumnRenamed("report_file", "change"))
    values = held.select("feed", "change", "load", "held", F.explode("wanted").alias("w")).select("*", "w.*").select("feed", F.col("change").alias("report_file"), "old", "field", "load", F.try_element_at("held", F.struct("old", "field")).alias("v"))
    number = lambda h: F.sum(h.cast("decimal(20,0)"))
    digest = [number(F.xxhash64("load", F.coalesce("v", F.lit("\u0000")))).alias("d1"), number(F.xxhash64("v", "load", F.lit(7))).alias("d2"), F.count_if(F.coalesce(F.col("v"), F.lit("null")) != "null").alias("filled"), F.count("*").alias("loads")]
    return values.groupBy("feed", "report_file", "old", "field").agg(*digest).where(F.col("filled") > 0)


def drift(lines: DataFrame) -> DataFrame:
    """(feed, report_file, drift_kind, old_field, new_field): every change of a file against its predecessor.

    Fields that vanish and appear with the same values for all loads in both files (at least
    one value that is not null) are renames; several such pair up in the order of their names.
    """
    fields = path_values(distinct_lines(lines))
    stats = cut_lineage(field_statistics(fields))
    changes = cut_lineage(field_changes(stats))
    digests = cut_lineage(value_digests(fields, changes, stats))
    twins = ["feed", "report_file", "d1", "d2", "loads"]
    place = F.row_number().over(Window.partitionBy(*twins, "old").orderBy("field"))
    ranked = digests.withColumn("i", place)
    old = ranked.where("old = 1").select(*twins, "i", F.col("field").alias("old_field"))
    new = ranked.where("old = 0").select(*twins, "i", F.col("field").alias("new_field"))
    renamed = cut_lineage(old.join(new, [*twins, "i"]).select("feed", "report_file", F.lit("renamed").alias("drift_kind"), "old_field", "new_field"))
    key = ["feed", "report_file"]
    retyped = changes.where("new_kind <> old_kind").select(*key, F.lit("retyped").alias("drift_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    removed = changes.where("gone").select(*key, F.col("field").alias("old_field")).join(renamed, [*key, "old_field"], "left_anti").select(*key, F.lit("removed").alias("drift_kind"), "old_field", F.lit("").alias("new_field"))
    added = changes.where("fresh").select(*key, F.col("field").alias("new_field")).join(renamed, [*key, "new_field"], "left_anti").select(*key, F.lit("added").alias("drift_kind"), F.lit("").alias("old_field"), "new_field")
    return renamed.unionByName(removed).unionByName(added).unionByName(retyped)


#: The columns of the consistent table and the names under which fields occur without a rename being seen.
TARGETS = {"decision": "string", "match_ratio": "double", "mapping": "map<string,string>", "new_fields": "array<string>"}


def canonical_names(changes: DataFrame, targets: list[str]) -> DataFrame:
    """(feed, field, canonical): the names under which each feed holds the target columns, followed through its renames.

    Names spread along distinct (feed, old, new) pairs in rounds until no name is new, at most
    as many rounds as a feed has names; a name that two targets reach in the same round goes to
    the first of them by name.
    """
    pairs = changes.where("drift_kind = 'renamed'").select("feed", "old_field", "new_field").distinct()
    both = cut_lineage(pairs.unionByName(pairs.select("feed", F.col("new_field").alias("old_field"), F.col("old_field").alias("new_field"))))
    known = cut_lineage(both.select("feed").distinct().select("feed", F.explode(F.array(*[F.lit(t) for t in targets])).alias("field")).withColumn("canonical", F.col("field")))
    fresh = known
    while True:
        step = fresh.join(both.withColumnRenamed("old_field", "field"), ["feed", "field"]).groupBy("feed", F.col("new_field").alias("field")).agg(F.min("canonical").alias("canonical"))
        fresh = cut_lineage(step.join(known, ["feed", "field"], "left_anti"))
        if fresh.isEmpty():
            break
        known = cut_lineage(known.unionByName(fresh))
    return known


def consistent_table(lines: DataFrame, targets: dict[str, str] | None = None) -> DataFrame:
    """One row for each readable line: typed target columns and ``failed_casts``, the fields whose value did not fit.

    Fields that a feed renamed are read under the target's name (``canonical_names``); where the
    feed itself shows no rename, under the name that the renames of all feeds together give. Lists kept
    as text in some files are split at commas, ratios kept as text are cast.
    """
    targets = targets or TARGETS
    fields = path_values(distinct_lines(lines))
    changes = cut_lineage(drift(lines))
    held = cut_lineage(fields.groupBy("feed", "field").agg(F.count("*").alias("n")))
    names = canonical_names(changes, list(targets)).withColumnRenamed("canonical", "own")
    common = canonical_names(changes.withColumn("feed", F.lit("")), list(targets)).select("field", F.col("canonical").alias("common"))
    # What is known of the fields meets first, so that lines are joined once.
    known = held.join(names, ["feed", "field"], "left").join(common, "field", "left").where(F.col("own").isNotNull() | F.col("common").isNotNull()).drop("n")
    rows = skew_join(fields, known, ["feed", "field"], ["report_file", "line_no"], "left", counts=held).withColumn("column", F.coalesce("own", "common", "field"))
    rows = rows.withColumn("claim", F.struct((F.col("field") == F.col("column")).cast("int").alias("same"), F.col("own").isNotNull().cast("int").alias("seen"), "field"))
    wanted = rows.groupBy("feed", "report_file", "line_no").agg(F.max("load").alias("file_id"), *[F.max_by("value", F.when(F.col("column") == c, F.col("claim"))).alias(f"r_{c}") for c in targets])
    out, failed = [F.col("feed"), F.col("report_file"), F.col("line_no"), F.col("file_id")], []
    for name, kind in targets.items():
        raw = F.col(f"r_{name}")
        parsed = typed_field(raw, kind)
        out.append(parsed.alias(name))
        failed.append(F.when(raw.isNotNull() & (raw != "null") & parsed.isNull(), F.lit(name)))
    return wanted.select(*out, F.array_compact(F.array(*failed)).alias("failed_casts"))


def typed_field(raw: Column, kind: str) -> Column:
    """Raw JSON text as a value of the kind, null where it does not fit.

    Text: strings, numbers, and the ``name`` of an object. Ratio: numbers, percent texts and whole
    numbers above 1 as hundredths. Map: objects, objects within a string, lists of
    ``key=value``. List: lists, and strings cut at commas.
    """
    doc = F.try_parse_json(raw)
    text = F.try_variant_get(doc, "$", "string")
    if kind == "double":
        number = F.try_variant_get(doc, "$", "double")
        percent = F.regexp_extract(text, "^\\s*([0-9.]+)\\s*%\\s*$", 1)
        number = F.coalesce(F.when(percent != "", percent.try_cast("double") / 100), number, text.try_cast("double"))
        return F.when((number > 1) & (percent == ""), number / 100).otherwise(number)
    if kind.startswith("map"):
        inner = F.try_variant_get(F.try_parse_json(F.when(raw.startswith('"'), text)), "$", kind)
        listed = F.try_variant_get(doc, "$", "array<string>")
        pairs = F.map_from_entries(F.transform(F.filter(listed, lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), x.substr(F.locate("=", x) + 1, F.length(x)))))
        proper = F.size(listed) == F.size(F.array_distinct(F.transform(F.filter(listed, lambda x: x.contains("=")), lambda x: F.substring_index(x, "=", 1))))
        return F.coalesce(F.try_variant_get(doc, "$", kind), inner, F.when(proper, pairs))
    if kind.startswith("array"):
        listed = F.when(F.trim(text) == "", F.expr(f"cast(array() as {kind})")).otherwise(F.split(text, ",\\s*").cast(kind))
        return F.coalesce(F.try_variant_get(doc, "$", kind), F.when(raw.startswith('"'), listed))
    return F.coalesce(F.try_variant_get(doc, "$.name", "string"), text).cast(kind)
