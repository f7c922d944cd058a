"""Media files as texts and embeddings, by the encoder of their modality.

An encoder is any function from (content, path) columns to a ``struct<text string, embedding
array<float>>`` column; trained models for images, video or audio are injected that way, one
for each modality. Files without an encoder get a caption, which a text encoder may embed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import files, texts
from siltstone.operators import documents

Encoder = Callable[[Column, Column], Column]


def encode_files(listed: DataFrame, encoders: dict[str, Encoder] | None = None, caption: Callable[[Column, Column, Column], Column] | None = None, text_encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, modality, text, embedding) of every media file of listed (path, content).

    ``encoders`` by modality; others are captioned by ``caption`` (content, modality, name) or by
    their kind and name. An encoder that gives no text leaves the caption.
    """
    kind, name = files.media_type("path"), files.file_name("path")
    plain = F.concat(texts.title_case(kind), F.lit(" file "), name)
    shown = F.coalesce(caption(F.col("content"), kind, name), plain) if caption else plain
    lone = F.struct(shown.alias("text"), (text_encoder(shown) if text_encoder else F.lit(None).cast("array<float>")).alias("embedding"))
    out = None
    for modality, encoder in (encoders or {}).items():
        out = F.when(kind == modality, encoder(F.col("content"), F.col("path"))) if out is None else out.when(kind == modality, encoder(F.col("content"), F.col("path")))
    chosen = lone if out is None else out.otherwise(lone)
    rows = listed.where(files.is_media("path")).select("path", kind.alias("modality"), shown.alias("_c"), chosen.alias("_e"))
    return rows.select("path", "modality", F.coalesce(F.nullif(F.col("_e.text"), F.lit("")), "_c").alias("text"), F.col("_e.embedding").alias("embedding"))


def media_metadata(encoded: DataFrame, tenant: str = documents.DEFAULT_TENANT) -> DataFrame:
    """Metadata rows of encoded media: the text as summary; what no encoder saw belongs to media_assets."""
    known = F.col("embedding").isNotNull()
    return encoded.select(
        F.sha2("path", 256).alias("file_id"),
        files.file_name("path").alias("original_name"),
        F.lit(tenant).alias("tenant_id"),
        F.when(known, texts.topic("text")).otherwise("media_assets").alias("collection_hint"),
        texts.preview("text").alias("summary_preview"),
        F.col("text").alias("summary"),
        files.extension("path").alias("extension"),
        "modality",
        F.char_length("text").cast("bigint").alias("size_chars"),
    )


def media_nodes(encoded: DataFrame) -> DataFrame:
    """One embedding node {file_id}:file for each media file."""
    file_id = F.sha2("path", 256)
    meta = F.struct(file_id.alias("file_id"), F.lit("file").alias("node_type"), F.col("modality"), F.when(F.col("embedding").isNotNull(), texts.topic("text")).otherwise("media_assets").alias("collection"), files.file_name("path").alias("path"), F.lit(None).cast("int").alias("chunk_index"))
    return encoded.select(F.concat(file_id, F.lit(":file")).alias("node_id"), "text", meta.alias("metadata"), "embedding")
