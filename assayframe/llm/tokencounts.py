"""Token counts from flat token files without an index, by scanning for the end-of-document id.

A flat file is nothing but token ids of fixed width, each document followed by the end-of-document id. Files are cut into blocks;
each task finds the ids in its blocks with one vectorised comparison. A prefix scan over the blocks of a file then says how many documents
ended before a block and where the last of them did, which gives the documents that cross block borders their length and all their number.

Files are read and written through Arrow's file systems, so they may lie wherever those reach; the writer's table of documents
is committed by Spark, and a file of a task that failed or ran twice is in no committed row.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from assayframe.llm.common import durable
from assayframe.session import shared_folder

#: A public vocabulary given as ranks; its ids fit into two bytes, and the id behind the last rank is free for the end of a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END, WIDTH = 50256, 2
#: Bytes per block; a multiple of every width.
BLOCK = 4 << 20
_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer of a rank file, loaded once per worker."""
    if path not in _TOKENIZERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENIZERS[path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))


def write_flat(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file per task into ``folder``; returns (doc_id, file, ordinal): the place of each document. Null text has no tokens.

    The rows are written out before they are returned, so the files are complete.
    """
    kind = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop, out, name, n = tokenizer(vocabulary).encode_ordinary, np.array([end], dtype=kind).tobytes(), None, "", 0
        try:
            for b in batches:
                if out is None:  # every attempt writes a file of its own
                    system, base = _open(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.tokens"
                    out = system.open_output_stream(posixpath.join(base, name))
                for text in b.column(1):
                    out.write(np.array(encode(text.as_py() or ""), dtype=kind).tobytes() + stop)
                size = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * size, pa.string()), pa.array(np.arange(n, n + size, dtype=np.int64))], names=["doc_id", "file", "ordinal"])
                n += size
        finally:
            if out is not None:
                out.close()

    return durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, file string, ordinal long"))


def count_flat(spark: SparkSession, folder: str, end: int = END, width: int = WIDTH, block: int = BLOCK, files: DataFrame | None = None) -> DataFrame:
    """Documents of the flat files in ``folder`` -> (file, ordinal, start, n_tokens), ``start`` in tokens from the file's beginning.

    An empty document has 0 tokens. Tokens behind the last end-of-document id are a last document; a file without tokens has none.
    ``files`` (file) restricts the scan to the files it names.
    """
    if block % width:
        raise ValueError("a block must hold whole ids")
    kind = {2: np.uint16, 4: np.uint32}[width]
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    listed = durable(listed)
    blocks = listed.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / block))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for b in batches:
            for name, length, k in zip(*(c.to_pylist() for c in b.columns)):
                with system.open_input_file(posixpath.join(base, name)) as f:
                    ids = np.frombuffer(f.read_at(min(block, length - k * block) // width * width, k * block), dtype=kind)
                ends = np.flatnonzero(ids == end) + k * block // width
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                                                 names=["file", "block", "n", "last", "ends"])

    found = blocks.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block long, n long, last long, ends array<long>")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    found = durable(found)
    # The prefix scan runs on one small row per block; the ends stay where they are.
    carried = found.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("before"))
    inside = found.join(carried, ["file", "block"]).select("file", "base", "before", "ends", F.posexplode("ends").alias("at", "stop"))
    previous = F.when(F.col("at") == 0, F.col("before")).otherwise(F.get("ends", F.col("at") - 1))
    whole = inside.select("file", (F.col("base") + F.col("at")).alias("ordinal"), (previous + 1).alias("start"), (F.col("stop") - previous - 1).alias("n_tokens"))
    tails = found.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start")).join(listed, "file")
    tails = tails.select("file", "ordinal", "start", (F.floor(F.col("length") / width) - F.col("start")).alias("n_tokens")).where("n_tokens > 0")
    return whole.unionByName(tails)


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens of every document: all texts are tokenised into flat files, and the files are scanned.

    Null and empty texts have 0 tokens; rows repeated whole are counted each; an empty table gives an empty table.
    """
    flat = f"{shared_folder(spark)}/assayframe-flat-{uuid.uuid4().hex}"
    placed = write_flat(spark.read.parquet(f"{folder}/documents.parquet"), flat)
    if placed.isEmpty():
        return placed.select("doc_id", F.col("ordinal").alias("n_tokens"))
    return placed.join(count_flat(spark, flat, files=placed), ["file", "ordinal"]).select("doc_id", "n_tokens")
