"""Queries over the operators of this package; production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import clusters, encoding, languages, mixing, similar_vectors, splitting, sql
from siltstone.runtime import table


def _knn(spark: SparkSession, base: str) -> DataFrame:
    return similar_vectors.knn_graph(table(spark, base, "graph_nodes"), "node_no", "embedding", "written_at")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_vectors.neighbour_pairs(_knn(spark, base), 0.99)


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """Every usable node with its five most similar nodes."""
    near = _knn(spark, base).select("id", F.posexplode("near").alias("rank", "n"))
    return near.select(F.col("id").alias("node_no"), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("neighbour_no"), F.round(-F.col("n.d"), 5).alias("similarity"))


def _node_clusters(spark: SparkSession, base: str):
    files = table(spark, base, "graph_nodes").where(F.col("metadata.node_type") == "file")
    return clusters.cluster_vectors(files, "node_no", "embedding", "written_at")


def _path_clusters(spark: SparkSession, base: str):
    return clusters.cluster_paths(table(spark, base, "path_plans"), "plan_no", "path", "planned_at")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    parts = []
    for kind, (members, _) in (("embedding", _node_clusters(spark, base)), ("path", _path_clusters(spark, base))):
        parts.append(clusters.sizeable(members).select(F.lit(kind).alias("member_kind"), F.col("cluster").alias("cluster_no"), F.col("id").alias("member_no")))
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, base: str) -> DataFrame:
    """Each group with its size and its three most typical members."""
    nodes, vectors = _node_clusters(spark, base)
    paths, rows = _path_clusters(spark, base)
    parts = []
    for kind, members, vec in (("embedding", nodes, vectors), ("path", paths, clusters.hashed_paths(rows))):
        found = clusters.describe(clusters.sizeable(members), vec)
        parts.append(found.select(F.lit(kind).alias("member_kind"), F.col("cluster").alias("cluster_no"), "size", "typical"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").where(F.char_length("text") > 1000)
    pieces = splitting.split_texts(docs, ["file_id", "doc_id"], "text", with_text=False)
    return pieces.groupBy("file_id", "doc_id").agg(splitting.cut_kind().alias("cut"))


def p5_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_texts(table(spark, base, "documents"), ["file_id", "doc_id"], "text")


def p5_chunk_counts(spark: SparkSession, base: str) -> DataFrame:
    """The right chunk_count of every file with a document."""
    docs = table(spark, base, "documents")
    pieces = splitting.split_texts(docs, ["file_id", "doc_id"], "text", with_text=False)
    counts = pieces.groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
    return docs.select("file_id").distinct().join(counts, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, base, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, base: str) -> mixing.Mix:
    return mixing.mix_sources(table(spark, base, "documents"), table(spark, base, "source_targets"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return mixing.share_report(mixing.written(_mix(spark, base))).where("short").select("source")


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base).rows


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.share_report(_mix(spark, base))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    model = languages.train(docs, "doc_id", "text", "lang")
    if model is None:
        return docs.select("doc_id", F.lit("").alias("seg_lang")).where("false")
    found = languages.text_languages(docs, model, "doc_id", "text", ["lang"])
    return languages.wrong_labels(found, "lang").select("doc_id", "seg_lang")


def p8_segments(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    model = languages.train(docs, "doc_id", "text", "lang")
    if model is None:
        return docs.select("doc_id", F.lit("").alias("seg_lang")).where("false")
    return languages.text_segments(docs, model, "doc_id", "text").withColumn("confidence", F.round("confidence", 4))


def queries() -> dict:
    found = (p1_found, p1_neighbours, p4_found, p4_groups, p5_found, p5_pieces, p5_chunk_counts, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_segments)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return dict(sql.ORACLES)
