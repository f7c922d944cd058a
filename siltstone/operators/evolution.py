"""Matching of incoming attributes to a catalog, and the decision how a schema evolves.

Catalog rows are (table_name, ordinal, column_name[, data_type]); incoming attributes are
(source, ordinal, attribute). Attribute lists are short (one schema), so the order-dependent
greedy matching runs per (source, table) in Arrow groups; everything else joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import attributes as A

# Cut-offs of the decision and number of candidates scored.
LEAST_RATIO, MOST_NEW_FIELDS, CANDIDATES = 0.5, 3, 3
#: Distinct column names of a catalog that may be sent to every task.
MOST_NAMES = 20_000


def exact_candidates(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source, table_name, matched): equal normal forms of attributes that are no identifiers."""
    new = incoming.where(~A.is_id("attribute")).select("source", A.normalize("attribute").alias("norm"))
    old = catalog.where(~A.is_id("column_name")).select("table_name", A.normalize("column_name").alias("norm")).distinct()
    return new.join(old, "norm").groupBy("source", "table_name").agg(F.count_distinct("norm").alias("matched"))


def semantic_hits(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source, table_name, norm): attributes that equal, are synonyms of or resemble some column of a table.

    Distinct normal forms are compared, each pair once, whatever number of sources and tables
    hold them. Up to ``MOST_NAMES`` column names are sent to all attributes. More of them meet in
    an equi-join on a shared character or synonym group: without either the name score is 0,
    below the 1/7 that the limit asks for.
    """
    new = incoming.where(~A.is_id("attribute")).select("source", A.normalize("attribute").alias("norm")).distinct()
    old = catalog.where(~A.is_id("column_name")).select("table_name", A.normalize("column_name").alias("col")).distinct()
    names, columns = new.select("norm").distinct(), old.select("col").distinct()
    if columns.limit(MOST_NAMES + 1).count() <= MOST_NAMES:
        pairs = names.join(F.broadcast(columns))
    else:
        marks = lambda c: F.explode(F.array_compact(F.array_distinct(F.concat(F.split(c, ""), F.array(F.concat(F.lit("group "), A.synonym_group(c)))))))
        pairs = names.select("norm", marks("norm").alias("mark")).join(columns.select("col", marks("col").alias("mark")), "mark").select("norm", "col").distinct()
    near = pairs.where(A.attribute_similarity("norm", "col") >= A.CANDIDATE_LEAST).select("norm", "col")
    return new.join(near, "norm").join(old, "col").select("source", "table_name", "norm").distinct()


def best_scores(pairs: DataFrame, new_col: str, old_col: str, most: int) -> DataFrame:
    """(new, place, old, similarity): the ``most`` best columns of each attribute, ties by name."""
    scored = pairs.select(new_col, old_col, F.round(A.attribute_similarity(new_col, old_col), 6).alias("similarity"))
    place = F.row_number().over(Window.partitionBy(new_col).orderBy(F.desc("similarity"), old_col))
    return scored.withColumn("place", place).where(F.col("place") <= most).select(new_col, "place", old_col, "similarity")


def candidate_tables(incoming: DataFrame, catalog: DataFrame, min_matches: int = 1) -> DataFrame:
    """(source, table_name, matches): tables by number of matched attributes."""
    return semantic_hits(incoming, catalog).groupBy("source", "table_name").agg(F.count("*").alias("matches")).where(F.col("matches") >= min_matches)


def top_candidates(candidates: DataFrame, most: int = CANDIDATES) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("matches"), "table_name")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def table_matches(incoming: DataFrame, catalog: DataFrame, candidates: DataFrame, type_mode: str | None = None) -> DataFrame:
    """(source, table_name, match_ratio, mapping, new_fields): greedy matching with each candidate.

    ``type_mode``: None compares names only; "reference" counts every known type as a poor fit
    (0.3; 0.7 without a sample value), "intended" compares the types.
    """
    new = incoming.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("ordinal", "attribute", *(["data_type"] if "data_type" in incoming.columns else [F.lit(None).cast("string").alias("data_type")])))).alias("new"))
    old = catalog.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name", *(["data_type"] if "data_type" in catalog.columns else [F.lit(None).cast("string").alias("data_type")])))).alias("old"))
    rows = candidates.select("source", "table_name").join(new, "source").join(old, "table_name")

    def scores(a: list, b: list) -> dict:
        if type_mode is None:
            return {}
        out = {}
        for x in a:
            for y in b:
                if x["data_type"] is None:
                    out[x["attribute"], y["column_name"]] = 0.7
                elif type_mode == "reference":
                    out[x["attribute"], y["column_name"]] = 0.3
                else:
                    p, q = x["data_type"].split("(")[0].upper(), (y["data_type"] or "").split("(")[0].upper()
                    families = ({"INTEGER", "NUMERIC", "BIGINT"}, {"VARCHAR", "TEXT", "CHAR"}, {"TIMESTAMP", "DATE", "TIME"})
                    out[x["attribute"], y["column_name"]] = 1.0 if p == q else 0.8 if any({p, q} <= f for f in families) else 0.3
        return out

    def run(batches):
        for pdf in batches:
            out = []
            for source, table, a, b in zip(pdf["source"], pdf["table_name"], pdf["new"], pdf["old"]):
                names = [x["attribute"] for x in a]
                mapping, fresh = A.match_lists([n for n in names if not A.plain_is_id(n)] + [n for n in names if A.plain_is_id(n)], [y["column_name"] for y in b], scores(a, b))
                regular = [n for n in names if not A.plain_is_id(n)]
                ratio = sum(n in mapping for n in regular) / len(regular) if regular else float(bool(mapping))
                out.append((source, table, ratio, mapping, [n for n in names if n in fresh]))
            yield pd.DataFrame(out, columns=["source", "table_name", "match_ratio", "mapping", "new_fields"])

    return rows.select("source", "table_name", "new", "old").mapInPandas(run, "source string, table_name string, match_ratio double, mapping map<string,string>, new_fields array<string>")


def decision(ratio: Column | str, new_fields: Column | str, attributes: Column | str) -> Column:
    """same_table, evolved_table, evolved_table_jsonb or new_table."""
    r, n = (F.col(x) if isinstance(x, str) else x for x in (ratio, new_fields))
    return F.when((r >= A.dynamic_threshold(attributes)) & (n == 0), "same_table").when((r >= LEAST_RATIO) & (n <= MOST_NEW_FIELDS), "evolved_table").when((r >= LEAST_RATIO) & (n > MOST_NEW_FIELDS), "evolved_table_jsonb").otherwise("new_table")


def decide(incoming: DataFrame, catalog: DataFrame, type_mode: str | None = "reference") -> DataFrame:
    """(source, decision, table_name, mapping, new_fields, match_ratio): the best of each source's top candidates.

    Sources without a candidate, or whose best ratio is 0, become new tables named after their attributes.
    """
    top = top_candidates(candidate_tables(incoming, catalog))
    scored = table_matches(incoming, catalog, top, type_mode).join(top.select("source", "table_name", "rank"), ["source", "table_name"]).where(F.col("match_ratio") > 0)
    w = Window.partitionBy("source").orderBy(F.desc("match_ratio"), "rank")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1")
    sources = incoming.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "attribute"))), lambda s: s["attribute"]).alias("names"))
    rows = sources.join(best, "source", "left").withColumn("n", F.size("names"))
    kind = F.when(F.col("match_ratio").isNull(), "new_table").otherwise(decision("match_ratio", F.size("new_fields"), "n"))
    fresh = kind == "new_table"
    return rows.withColumn("decision", kind).select("source", "decision", F.when(fresh, A.table_name(F.col("names"))).otherwise(F.col("table_name")).alias("table_name"), F.when(fresh, F.expr("cast(map() as map<string,string>)")).otherwise(F.col("mapping")).alias("mapping"), F.when(fresh, F.col("names")).otherwise(F.col("new_fields")).alias("new_fields"), F.coalesce("match_ratio", F.lit(0.0)).alias("match_ratio"))
