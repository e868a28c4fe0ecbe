"""The whole way from documents to answers, as stages of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import preview
from docloom.functions.textlogic import Sizes
from docloom.operators import cleaning, embedding, generation, retrieval, structure
from docloom.profiles import LATIN, ZH
from docloom.session import reachable
from docloom.sources import readers, sinks


def _there(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists, on whatever file system its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


@dataclass
class Config:
    """Settings; folders are derived from ``base`` where they are not given, and nothing is created by asking."""

    base: str = "data"
    raw_dir: str | None = None
    processed_dir: str | None = None
    chunks_dir: str | None = None
    cleaned_dir: str | None = None
    index_dir: str | None = None
    profile: str = "zh"
    target_chunk_size: int = 800
    max_chunk_size: int = 1500
    min_chunk_size: int = 200
    overlap_size: int = 100
    enable_text_cleaning: bool = True
    enable_semantic_splitting: bool = True
    repeat_threshold: int = 3
    embed_on: str = "text"
    index_type: str = "auto"
    probes: int = 8
    rank_top_k: int = 20
    rerank_top_k: int = 5
    max_context_length: int = 3000
    overwrite: bool = False

    def __post_init__(self) -> None:
        for name, sub in (("raw_dir", "raw"), ("processed_dir", "processed"), ("chunks_dir", "chunks"), ("cleaned_dir", "cleaned"), ("index_dir", "index")):
            if getattr(self, name) is None:
                setattr(self, name, str(Path(self.base) / sub))

    @classmethod
    def of(cls, values: dict) -> Config:
        """A configuration from a mapping; an unknown key is an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)


#: Chunks from which on an index of cells is taken where the index type is "auto".
FLAT_UP_TO = 100_000


class Pipeline:
    """Chunks of documents, their vectors, and answers to queries; stages are made when first needed.

    Vectors are kept under ``index_dir``: each chunk is encoded once, whatever the number of queries and sessions.
    ``encoder`` makes the encoder of a worker, ``encoder_key`` names it; another name has vectors of its own.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, encoder: Callable = embedding.hashing_encoder, encoder_key: str = "hashing") -> None:
        self.spark, self.config = reachable(spark), config or Config()
        self.encoder, self.encoder_key = encoder, encoder_key
        self.chunks: DataFrame | None = None
        self._vectors: DataFrame | None = None
        self._cells: retrieval.IvfIndex | None = None

    def process_documents(self, path: str, write: bool = True, extractor: Callable[[str, bytes], str] | None = None) -> DataFrame:
        """Chunks of the files at a path: Markdown, content lists, CSV, and by ``extractor`` PDF and images.

        Files that are chunked already are left out unless ``overwrite``; files that cannot be read are left out, see
        ``readers.documents`` for their errors. Cleaned texts are written too where cleaning is on.
        """
        c = self.config
        docs = readers.documents(self.spark, path, extractor).where("text is not null").select("path", "text")
        done = None
        if write and not c.overwrite and _there(self.spark, c.chunks_dir):
            done = self.spark.read.parquet(c.chunks_dir)
            docs = docs.join(done.select("path").distinct(), "path", "left_anti")
        profile = LATIN if c.profile == "latin" else ZH
        sizes = Sizes(c.target_chunk_size, c.max_chunk_size, c.min_chunk_size)
        made = structure.chunks(docs, "path", "text", sizes, profile, c.repeat_threshold, c.enable_text_cleaning, c.enable_semantic_splitting)
        if write:
            mode = "append" if done is not None else "overwrite"
            if c.enable_text_cleaning:
                sinks.cleaned_text(docs.select("path", cleaning.basic_clean(F.col("text"), profile).alias("text")), c.cleaned_dir, mode)
            sinks.chunk_table(made, c.chunks_dir, mode=mode)
            made = self.spark.read.parquet(c.chunks_dir)
        return self._take(made)

    def load_chunks_from_files(self, folder: str | None = None) -> DataFrame:
        folder = folder or self.config.chunks_dir
        if list(Path(folder).glob("*_chunks.json")):
            flat = readers.chunk_json(self.spark, folder)
            return self._take(flat.select("chunk_id", "text", "embedding_text", "metadata.section_path", "metadata.has_table", "metadata.has_list", "metadata.heading_level", "metadata.chunk_type", "metadata.char_count", "metadata.image_refs", "sentence_infos"))
        return self._take(self.spark.read.parquet(folder))

    def _take(self, chunks: DataFrame) -> DataFrame:
        self.chunks, self._vectors, self._cells = chunks, None, None
        return chunks

    def build_index(self) -> DataFrame:
        """The vectors of all chunks, (chunk_id, vec): those not kept yet are encoded and added to what is kept."""
        if self.chunks is None:
            raise RuntimeError("no chunks yet: process documents or load them")
        folder = f"{self.config.index_dir}/{self.encoder_key}-{self.config.embed_on}"
        wanted = self.chunks.where(F.length(self.config.embed_on) > 0).select("chunk_id", F.col(self.config.embed_on).alias("embedded")).dropDuplicates(["chunk_id"])
        new = wanted
        if _there(self.spark, folder):
            new = wanted.join(self.spark.read.parquet(folder).select("chunk_id"), "chunk_id", "left_anti")
        new.select("chunk_id", embedding.encode(F.col("embedded"), self.encoder, self.encoder_key).alias("vec")).write.mode("append").parquet(folder)
        self._vectors = self.spark.read.parquet(folder).join(wanted.select("chunk_id"), "chunk_id", "left_semi")
        kind = self.config.index_type
        if kind == "ivf" or kind == "auto" and self._vectors.count() > FLAT_UP_TO:
            retrieval.IvfIndex(self._vectors, "chunk_id", "vec").save(f"{folder}-cells")
            self._cells = retrieval.IvfIndex.load(self.spark, f"{folder}-cells")
        return self._vectors

    @property
    def vectors(self) -> DataFrame:
        return self.build_index() if self._vectors is None else self._vectors

    def search(self, queries: DataFrame, use_rerank: bool = True) -> DataFrame:
        """Hits of each (query_id, query): two stages, or one without reranking."""
        c = self.config
        q = queries.withColumn("qv", embedding.encode_queries(F.col("query"), factory=self.encoder, key=self.encoder_key))
        vectors = self.vectors
        if self._cells is not None:
            first = self._cells.search(q, "query_id", "qv", c.rank_top_k, c.probes)
        else:
            first = retrieval.batch_top_k(q, vectors, "query_id", "chunk_id", "qv", "vec", c.rank_top_k)
        meta = F.struct("section_path", "has_table", "has_list", "heading_level").alias("metadata")
        hits = first.withColumnsRenamed({"row_id": "chunk_id", "score": "rank_score"}).join(self.chunks.select("chunk_id", "text", meta), "chunk_id").join(queries, "query_id")
        return retrieval.search(hits.drop("rank"), c.rank_top_k, c.rerank_top_k, use_rerank)

    def query(self, queries: DataFrame, use_rerank: bool = True, return_chunks: bool = False) -> DataFrame:
        """An answer for each (query_id, query), with previews of its chunks if asked for."""
        hits = self.search(queries, use_rerank)
        given = hits.select("query_id", F.col("final_rank").alias("number"), F.col("metadata.section_path").alias("section_path"), "text")
        out = generation.answers(queries, given, self.config.max_context_length)
        if return_chunks:
            shown = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "chunk_id", preview(F.col("text")).alias("text"), "rank_score", "rerank_score"))).alias("chunks"))
            out = out.join(shown, "query_id", "left")
        return out

    def get_status(self) -> dict:
        return {"chunks": self.chunks is not None, "index_built": self._vectors is not None, "config": asdict(self.config)}


def create_pipeline(spark: SparkSession, **settings) -> Pipeline:
    return Pipeline(spark, Config.of(settings))
