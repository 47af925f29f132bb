"""Best-fit packing of documents into training sequences, by vectors of residual capacities.

The corpus is tokenized once, where it lies. Only (document, piece, length, checksum) rows move on; they are dealt by a hash
of all of that and of the row's number to groups of a fixed number of tokens and of rows, so every group is a task of
bounded memory and time whatever the input's size, and no document, text or length can be hot. Within a group, pieces go
longest first to the open sequence that has room under three capacities, tokens, documents and attention cost (sum of
squared lengths), and leaves the least weighted residual over them.

Null texts are empty; every document, empty ones too, ends with the end id, so each has at least one piece. Rows that
share a doc_id are packed as separate documents. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, runs_of, saved
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, unit: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most capacity ids; only documents longer than that have more than one."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, unit)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs_of(texts):
                out: list[tuple] = []
                for doc, data in zip(ids[a:b], enc.encode([t or "" for t in texts[a:b]]), strict=True):
                    got = np.append(np.frombuffer(data, enc.dtype), np.array(end_id, enc.dtype)).astype("<u4")
                    for k, at in enumerate(range(0, len(got), capacity)):
                        part = got[at : at + capacity]
                        out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, piece, start, length, crc = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece. Pieces go longest first, ties in the given order; a piece goes to the open sequence that has room under every capacity and the best score, the first such one on ties, or else to a new one.

    rule "norm": least weighted squared norm of what is left, as shares of the capacities; "dot": greatest weighted dot
    product of demand and residual.
    """
    cap, w = np.array(capacities, float), np.array(weights, float)
    n = len(lengths)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((max(16, n), 3))
    used = np.zeros(max(16, n), np.int64)
    opened = 0
    live = np.empty(0, np.int64)  # sequences with any room, in order of opening
    for count, i in enumerate(np.argsort(-lengths, kind="stable")):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        rest = left[live] - need
        fits = (rest >= 0).all(axis=1)
        if fits.any():
            share = rest / cap
            score = (w * share * share).sum(axis=1) if rule == "norm" else -((w * need / cap) * (left[live] / cap)).sum(axis=1)
            at = live[int(np.argmin(np.where(fits, score, np.inf)))]
        else:
            at, opened = opened, opened + 1
            left[at] = cap
            if size < cap[0]:
                live = np.append(live, at)
        seq[i], offset[i] = at, used[at]
        used[at] += int(size)
        left[at] -= need
        if count % 256 == 255:
            live = live[(left[live, 0] >= 1) & (left[live, 1] >= 1) & (left[live, 2] >= 1)]
    return seq, offset


def pack(parts: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", group_tokens: int = 16_000_000, group_rows: int = 100_000) -> DataFrame:
    """parts with sequence_id and offset. parts needs doc_id, piece and length (1 to capacity).

    max_docs and max_cost (of squared lengths) default to what capacity tokens can reach at most, so that they shape the
    scores but refuse nothing. group_tokens and group_rows bound what one task packs; the number of groups follows the input.
    """
    caps = (float(capacity), float(max_docs or capacity), float(max_cost or capacity**2))
    total, rows = parts.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // group_tokens), -(-rows // group_rows))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length")])
        seq, offset = best_fit(table["length"].to_numpy(), caps, weights, rule)
        at = table["_group"].to_numpy() * (1 << 32) + seq
        return table.drop_columns("_group").append_column("sequence_id", pa.array(at, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(*parts.columns, F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(work, schema)


def pack_documents(docs: DataFrame, vocabulary: str, unit: str = "word", end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """Whole documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(saved(pieces(docs, vocabulary, unit, end_id, capacity), "pieces"), capacity, **options)
