"""Copying of uploads into the storage tree."""

from __future__ import annotations

import os
import shutil
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import files
from siltstone.operators.documents import stored_names


def placed_files(listed: DataFrame, collection: str = "collection", modality: str = "modality", taken: DataFrame | None = None) -> DataFrame:
    """listed + (folder, stored_name, storage_path): {modality}/{collection}/name, with _1, _2 ... where names repeat.

    ``taken`` (modality, collection, original_name, taken) tells how often a name is stored already.
    """
    rows = listed.withColumn("folder", F.concat_ws("/", F.coalesce(modality, F.lit("text")), F.coalesce(collection, F.lit("general")))).withColumn("_name", files.file_name("path"))
    if taken is not None:
        held = taken.select(F.concat_ws("/", F.coalesce("modality", F.lit("text")), F.coalesce("collection", F.lit("general"))).alias("folder"), F.col("original_name").alias("_name"), "taken")
        rows = rows.join(held, ["folder", "_name"], "left")
    named = stored_names(rows, "folder", "_name", "path", "taken" if taken is not None else None)
    return named.withColumn("storage_path", F.concat_ws("/", "folder", "stored_name")).drop("_name", "taken")


def local_path(path: str) -> str | None:
    """The path on a mounted disk that a file's URI names, null for other file systems."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def store_files(placed: DataFrame, root: str) -> DataFrame:
    """Copy each file below a root that all executors share; (path, storage_path, bytes, error).

    Files on mounted disks are copied from their path, others written from a column ``content``.
    A file is written under a temporary name and renamed, so a task that runs again leaves no half.
    """
    columns = [c for c in ("path", "storage_path", "content") if c in placed.columns]

    def copy(path: str, target: str, content: bytes | None) -> int:
        full = os.path.normpath(os.path.join(root, target))
        if not full.startswith(os.path.normpath(root) + os.sep):
            raise ValueError("outside the storage root")
        os.makedirs(os.path.dirname(full), exist_ok=True)
        part = f"{full}.{os.getpid()}.part"
        source = local_path(path)
        if content is not None:
            with open(part, "wb") as f:
                f.write(content)
        elif source is not None:
            shutil.copyfile(source, part)
        else:
            raise ValueError("no content")
        os.replace(part, full)
        return os.path.getsize(full)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out.append((row.path, row.storage_path, copy(row.path, row.storage_path, getattr(row, "content", None)), None))
                except (OSError, ValueError) as e:
                    out.append((row.path, row.storage_path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "storage_path", "bytes", "error"]).astype({"bytes": "Int64"})

    return placed.select(*columns).mapInPandas(run, "path string, storage_path string, bytes bigint, error string")
