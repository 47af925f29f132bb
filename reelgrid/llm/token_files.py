"""Token ids as flat binary files that readers map into memory.

A data set is a folder of parts in ascending doc_id order. Part p has three flat little-endian files: tokens-p.bin (the
ids of its documents, each with the end id), offsets-p.bin (64-bit offsets within the part, one more than documents) and
docs-p.bin (64-bit doc_ids). A part's place in the whole comes from the prefix sums of the parts' sizes, one row a part.

Documents are dealt by ranges of (doc_id, text hash), so a part holds a bounded share and repeated doc_ids do not pile up;
null doc_ids come first and are stored as the smallest 64-bit integer. Null texts are empty: such a document has its end id
alone. Parts are written under a temporary name and then moved, so a task that runs again replaces its file with the same
bytes. Files go through pyarrow's file systems, so the folder may be in any store that these reach. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import range_parts, ready, runs_of, scratch, text_hash
from .tokens import encoder

NULL_ID = -(1 << 63)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _open(folder: str, name: str) -> np.ndarray | memoryview:
    """A part's bytes: mapped where the store is a local or mounted disk, else read."""
    store, top = _place(folder)
    path = f"{top}/{name}"
    if store.get_file_info(path).size == 0:
        return memoryview(b"")
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as f:
        return memoryview(f.read())


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, unit: str = "space", end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes the data set and returns its parts: part, n_docs, n_tokens, base (ids in the parts before it)."""
    spark = docs.sparkSession
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, unit), TaskContext.get().partitionId()
        store, top = _place(folder)
        store.create_dir(top, recursive=True)
        names = [f"{kind}-{part:06d}.bin" for kind in ("tokens", "offsets", "docs")]
        own = [f"{top}/_{n}.{uuid.uuid4().hex}" for n in names]
        docs_n, at = 0, 0
        tokens, offsets, ids = (store.open_output_stream(p) for p in own)
        with tokens, offsets, ids:
            offsets.write(np.zeros(1, "<u8").tobytes())
            end = np.array(end_id, enc.dtype).tobytes()
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in runs_of(texts):
                    got = [x + end for x in enc.encode([t or "" for t in texts[a:b]])]
                    tokens.write(b"".join(got))
                    sizes = np.fromiter((len(x) // enc.dtype.itemsize for x in got), np.int64, len(got))
                    offsets.write((at + np.cumsum(sizes)).astype("<u8").tobytes())
                    ids.write(np.array([NULL_ID if k is None else k for k in keys[a:b]], "<i8").tobytes())
                    at, docs_n = at + int(sizes.sum()), docs_n + len(got)
        for p, n in zip(own, names, strict=True):
            store.move(p, f"{top}/{n}")
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": docs_n, "n_tokens": at, "width": enc.dtype.itemsize}], schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("h"))
    dealt = rows.repartitionByRange(*([parts] if parts else range_parts(docs, 100_000)), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    dealt.mapInArrow(work, "part int, n_docs long, n_tokens long, width int").write.parquet(f"{folder}/parts")
    found = spark.read.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return found.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(spark: SparkSession, folder: str, parts: DataFrame, docs_at_once: int = 2048) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over the ids as 32-bit little-endian), part."""
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, width = row["part"], row["width"]
                tokens = _open(folder, f"tokens-{part:06d}.bin")
                cuts = np.frombuffer(_open(folder, f"offsets-{part:06d}.bin"), "<u8").astype(np.int64)
                ids = np.frombuffer(_open(folder, f"docs-{part:06d}.bin"), "<i8")
                for at in range(0, len(ids), docs_at_once):
                    to = min(len(ids), at + docs_at_once)
                    crc = [zlib.crc32(np.frombuffer(tokens[cuts[i] * width : cuts[i + 1] * width], f"<u{width}").astype("<u4").tobytes()) for i in range(at, to)]
                    own = ids[at:to]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(row["base"] + cuts[at:to]), pa.array(np.diff(cuts[at : to + 1])), pa.array(crc, pa.int64()), pa.array([part] * (to - at), pa.int32())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    # a row stands for a file: by number, so that few bytes of rows are not taken for little work and put in one task
    listed = parts.select("part", "n_docs", "n_tokens", "width", "base").repartition(max(1, parts.count()), "part")
    return listed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Writes docs to token files in folder (a new one in the shared folder if None) and returns what reading them gives."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(docs, folder, vocabulary, **options))
