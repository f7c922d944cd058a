"""The engine's calls: ingest, search, describe; the function-level face of the library.

Files that read as relational are loaded into catalog tables; all others are copied into the
storage tree and kept as metadata, chunks and nodes below ``{root}/_engine``. These are only
ever appended: a file that is there already is not written again, of the rows of a node the
last written counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import attributes as A
from siltstone.functions import files, texts
from siltstone.operators import catalog, classify, documents, evolution, loader, media, search
from siltstone.runtime import cut_lineage, skew_join, written
from siltstone.sources import readers, storage

META = "file_id string, original_name string, tenant_id string, collection_hint string, summary_preview string, summary string, extension string, modality string, size_chars bigint, storage_path string, size_bytes bigint, created_at timestamp"
CHUNKS = "file_id string, tenant_id string, collection string, chunk_index int, text string, chunk_size int"
NODES = "node_id string, text string, metadata struct<file_id:string,node_type:string,modality:string,collection:string,path:string,chunk_index:int>, embedding array<float>, written_at timestamp"


@dataclass
class IngestReport:
    """What one upload did: per-file classification, loaded tables, and the new metadata, chunks and nodes."""

    classified: DataFrame
    tables: list[dict] = field(default_factory=list)
    files: DataFrame | None = None
    chunks: DataFrame | None = None
    nodes: DataFrame | None = None


class Engine:
    """Ingestion and queries over one session.

    ``encoder`` turns a text column into vectors, ``media_encoders`` by modality (content, path)
    into text and vector; without an encoder no nodes are written. ``root`` is a folder that all
    machines share. ``type_mode`` is how much types count in matching (``evolution.table_matches``).
    """

    def __init__(self, spark: SparkSession, root: str, encoder: Callable[[Column], Column] | None = None, tenant: str = documents.DEFAULT_TENANT, media_encoders: dict[str, media.Encoder] | None = None, type_mode: str | None = "reference") -> None:
        self.spark, self.root, self.encoder, self.tenant = spark, root.rstrip("/"), encoder, tenant
        self.media_encoders, self.type_mode = media_encoders, type_mode

    # --- ingestion

    def classify(self, *paths: str) -> DataFrame:
        """(path, file_type, classification, scores, reasons) of every file that is no media, each read once."""
        listed = readers.list_files(self.spark, *paths).where(~F.col("is_media")).withColumn("file_type", files.file_type("path"))
        read = listed.select("path", "file_type", readers.full_text("content", "extension").alias("text"), readers.header_names("content", "extension").alias("columns"))
        return classify.classify_files(read, columns_col="columns").drop("text", "columns")

    def ingest(self, *paths: str) -> IngestReport:
        """Classify once; relational files are matched and loaded, all others become stored metadata, chunks and nodes."""
        report = IngestReport(cut_lineage(self.classify(*paths)))
        listed = readers.list_files(self.spark, *paths)
        relational = report.classified.where("classification = 'SQL'").select("path")
        report.tables = self.load(listed.join(relational, "path", "left_semi"))
        rest = listed.join(relational, "path", "left_anti").withColumn("file_id", F.sha2("path", 256)).join(self.files().select("file_id"), "file_id", "left_anti")
        self.store(rest, report)
        return report

    def store(self, listed: DataFrame, report: IngestReport) -> None:
        """Write files (path, content, length, file_id) that are no tables: copies, metadata, chunks, nodes."""
        text = listed.where(~F.col("is_media")).select("path", "length", "file_id", files.file_name("path").alias("file_name"), readers.full_text("content", "extension").alias("text"), F.lit(self.tenant).alias("tenant_id"))
        text = cut_lineage(text)  # parsed once for metadata, chunks and nodes
        encoded = cut_lineage(media.encode_files(listed, self.media_encoders, readers.size_caption if self.media_encoders else None, self.encoder if self.media_encoders else None))
        sizes = text.select("file_id", "length").unionByName(listed.where("is_media").select("file_id", "length"))
        meta = cut_lineage(documents.metadata(text).unionByName(media.media_metadata(encoded, self.tenant)))
        known = self.files().groupBy("modality", "collection_hint", "original_name").agg(F.count("*").alias("taken"))
        names = listed.select("path", "file_id").join(meta.select("file_id", "modality", F.col("collection_hint").alias("collection")), "file_id")
        placed = cut_lineage(storage.placed_files(names.withColumn("original_name", files.file_name("path")), taken=known.withColumnRenamed("collection_hint", "collection")).select("path", "file_id", "storage_path"))
        # Contents are not moved through a shuffle: files on mounted disks are copied by path.
        mounted = F.col("path").startswith("file:") | F.col("path").startswith("/")
        far = placed.where(~mounted).join(listed.select("path", "content"), "path")
        done = storage.store_files(placed.where(mounted), self.root).unionByName(storage.store_files(far, self.root))
        copied = cut_lineage(done.select(F.sha2("path", 256).alias("file_id"), F.when(F.col("error").isNull(), F.col("storage_path")).alias("storage_path")))
        full = meta.join(copied, "file_id").join(sizes.withColumnRenamed("length", "size_bytes"), "file_id").withColumn("created_at", F.current_timestamp())
        at = copied.withColumnRenamed("file_id", "_f")
        report.files = self._append("files", full, META)
        report.chunks = self._append("chunks", documents.chunks(text), CHUNKS, "collection")
        nodes = media.media_nodes(encoded) if self.encoder is None else documents.nodes(text, self.encoder).unionByName(media.media_nodes(encoded))
        counts = report.chunks.groupBy(F.col("file_id").alias("_f")).agg(F.count("*").alias("n"))
        stored = skew_join(nodes.where("embedding is not null").withColumn("_f", F.col("metadata.file_id")), at, ["_f"], ["node_id"], counts=counts).withColumn("metadata", F.col("metadata").withField("path", F.coalesce("storage_path", "metadata.path"))).drop("_f", "storage_path")
        report.nodes = self._append("nodes", stored.withColumn("written_at", F.current_timestamp()), NODES)

    def _append(self, name: str, rows: DataFrame, schema: str, *partitions: str) -> DataFrame:
        """Append rows to a store and give back just these."""
        columns = self.spark.createDataFrame([], schema).columns
        batch = written(rows.select(*columns))
        batch.write.mode("append").partitionBy(*partitions).parquet(f"{self.root}/_engine/{name}")
        return batch

    def _stored(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(empty.schema).parquet(f"{self.root}/_engine/{name}").select(*empty.columns)
        except AnalysisException:  # nothing was stored yet
            return empty

    def load(self, listed: DataFrame) -> list[dict]:
        """Load tabular files; files whose first rows have the same names are loaded together.

        What is walked here are the distinct headers, each decided against the catalog as it
        grows; rows are read once, written by header, and each load reads its own.
        """
        rows = readers.file_rows(listed)
        large = [r["path"] for r in listed.where((F.col("length") > readers.LARGE_FILE) & F.col("extension").isin("csv")).select("path").toLocalIterator()]
        for path in large:
            rows = rows.unionByName(readers.large_csv_rows(self.spark, path))
        rows = written(rows.where("fields is not null and schema is not null"), "schema")
        heads = rows.where("ordinal = 0").groupBy("schema").agg(F.min(F.struct("path", F.map_keys("fields").alias("names"))).alias("first"), F.count("*").alias("n"))
        # As when files are loaded one by one, the first file with a header gives the types.
        firsts = rows.join(heads.select(F.col("first.path").alias("path")), "path", "left_semi")
        types: dict[int, dict[str, tuple[str, str]]] = {}
        for r in loader.field_types(firsts).collect():
            types.setdefault(r["schema"], {})[r["name"]] = (r["type"], r["storage"])
        heads = heads.orderBy("first.path").collect()
        out = []
        for h in heads:
            found, names = types.get(h["schema"], {}), loader.distinct_names(h["first"]["names"])
            cast = lambda n: F.expr(f"try_cast(element_at(fields, {literal(n)}) AS {found.get(n, ('TEXT', 'string'))[1]})")  # noqa: B023, E731
            part = rows.where(F.col("schema") == h["schema"]).select(F.struct("path", "ordinal").alias(loader.ORDER), *[cast(n).alias(n) for n in names])
            done = self.load_rows(part, {n: found[n][0] if n in found else None for n in names})
            out.append({"path": h["first"]["path"], "files": h["n"]} | done)
        return out

    def load_rows(self, rows: DataFrame, types: dict[str, str | None] | None = None, table: str | None = None, key: str | None = None) -> dict:
        """Match rows to the catalog, evolve or create a table, and append; an explicit name only counts for new tables.

        ``types`` are declared column types, null where a column has no value; by default those of the rows.
        """
        names = [c for c in rows.columns if c != loader.ORDER]
        types = types if types is not None else loader.column_types(rows.select(*[loader.quoted(n) for n in names]))
        incoming = self.spark.createDataFrame([("rows", i, n, types.get(n)) for i, n in enumerate(names)], "source string, ordinal int, attribute string, data_type string")
        known = catalog.session_tables(self.spark)
        if known:
            decided = evolution.decide(incoming, catalog.columns_of(self.spark, known), self.type_mode).first().asDict()
        else:
            decided = {"decision": "new_table", "table_name": self.spark.range(1).select(A.table_name(F.array(*[F.lit(n) for n in names]))).first()[0], "mapping": {}, "new_fields": names, "match_ratio": 0.0}
        if decided["decision"] == "new_table":
            name = table or decided["table_name"]
            loader.create_table(self.spark, name, rows, key, {n: t for n, t in types.items() if t})
            added = loader.insert_rows(self.spark, name, rows)
        else:
            name, fresh = decided["table_name"], decided["new_fields"]
            overflow = decided["decision"] == "evolved_table_jsonb"
            added = loader.insert_rows(self.spark, name, rows, decided["mapping"], () if overflow else fresh, fresh if overflow else ())
        return decided | {"table_name": name, "rows_inserted": added}

    # --- queries

    def files(self) -> DataFrame:
        """Metadata of all stored files."""
        return self._stored("files", META)

    def chunks(self) -> DataFrame:
        return self._stored("chunks", CHUNKS)

    def nodes(self) -> DataFrame:
        """Embedding nodes; of the rows of a node the last written."""
        rows = self._stored("nodes", NODES)
        return rows.groupBy("node_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "node_id"]), "written_at").alias("_n")).select("node_id", "_n.*")

    def tables(self) -> DataFrame:
        return catalog.table_counts(catalog.session_tables(self.spark))

    def table_details(self, name: str) -> dict:
        return catalog.table_details(self.spark, name)

    def stats(self, meta: DataFrame | None = None, recent: str = "7 days") -> DataFrame:
        """One row: files, bytes, tables, collections, media folders, recent uploads, bytes by modality."""
        return catalog.totals(self.files() if meta is None else meta, len(catalog.session_tables(self.spark)), recent)

    def database_state(self, meta: DataFrame | None = None) -> DataFrame:
        meta = self.files() if meta is None else meta
        columns = catalog.columns_of(self.spark, catalog.session_tables(self.spark))
        media = meta.where("modality <> 'text'").select(F.col("modality").alias("name"))
        return catalog.state(columns, meta.where("modality = 'text'").select(F.col("collection_hint").alias("name")), media)

    def file_tree(self, meta: DataFrame | None = None) -> DataFrame:
        rows = (self.files() if meta is None else meta).withColumn("_o", F.col("file_id"))
        return catalog.placed_tree(catalog.tree_rows(rows, "summary", "original_name", "_o", "collection_hint", "modality", "size_chars"))

    def search(self, query: str, limit: int | str | None = None, vector: list[float] | None = None, nodes: DataFrame | None = None, meta: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
        """Semantic hits for a query vector (made by the encoder where none is given), else metadata hits, else stored files; the source is a column.

        Without any of nodes, meta and paths the stored ones are searched.
        """
        k = search.clamp_limit(limit)
        if nodes is None and meta is None and paths is None:
            nodes, meta = self.nodes(), self.files()
            paths = meta.where("storage_path is not null").select(F.col("storage_path").alias("path"))
        parts = []
        if vector is None and nodes is not None and self.encoder is not None:
            vector = self.spark.range(1).select(self.encoder(F.lit(query))).first()[0]
        if vector is not None and nodes is not None:
            hits = search.flattened(search.nearest(nodes, vector, k)).select(F.col("node_id").alias("id"), "path", "modality", "text", "similarity")
            parts.append(("semantic", search.media_filter(hits, query)))
        if meta is not None:
            parts.append(("metadata", search.metadata_search(meta, query, k).select(F.col("file_id").alias("id"), F.col("original_name").alias("path"), "modality", F.col("summary").alias("text"), F.lit(None).cast("double").alias("similarity"))))
        if paths is not None:
            parts.append(("storage", search.storage_search(paths, query, k).select(F.col("path").alias("id"), "path", F.lit("file").alias("modality"), F.lit("").alias("text"), F.lit(None).cast("double").alias("similarity"))))
        if not parts:
            raise ValueError("nothing to search")
        return search.with_download_path(search.first_filled(*parts), self.root)

    def resolve_path(self, path: str) -> str | None:
        """The full path of a stored file, None when it would leave the root."""
        p = self.spark.range(1).select(F.when(files.is_within(F.lit(path), self.root), files.normal_path(F.lit(path if path.startswith("/") else f"{self.root}/{path}")))).first()[0]
        return p

    def health(self) -> dict:
        """Which optional parts are there."""
        found = {}
        for module in ("yaml", "openpyxl", "pypdf", "PIL"):
            try:
                __import__(module)
                found[module] = True
            except ImportError:
                found[module] = False
        return {"spark": self.spark.version, "encoder": self.encoder is not None, **found}


def literal(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
