"""Vector codes: product quantisation in whole numbers, with nearest entries found by a GNAT over each codebook.

A vector's components become floor(1024 * x) and are cut into four consecutive parts. Each part has a codebook of up to 256
entries, at first that part of the rows of smallest vec_id; each round assigns every part to its nearest entry and moves the
entries to the floors of their parts' means. What the driver holds is the codebooks, whose size does not depend on the
table; a task returns one row per entry that it used, its parts' sums and their number.

Nearest entries come from a geometric near-neighbour access tree: a node has split points, every other entry below it
belongs to the nearest of them, and for each pair of split point and subtree the node keeps the range of distances between
them. A query's distances to the split points rule out a subtree only if they prove all of it strictly farther than the best
entry so far: ranges and distances are rounded outwards, what is left is compared by whole squared distances, and a tie goes
to the lower index. So the tree gives what a comparison with all entries gives.

Vectors that are null, hold null or non-finite components, or are of another length than most (the greater length on ties)
are left out. Lengths that four does not divide are cut as evenly as possible, and parts without components have distance 0.
Components beyond +-131072 count as that bound, which keeps squared distances within 62 bits. Rows that share a vec_id are
coded each for itself; among them the first entries go by the components, and null ids come last. With fewer than 256 rows a
codebook has as many entries as there are rows. Null labels are one label. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, ready, saved

PARTS = 4
_BOUND = 1 << 27
#: Distances are off by less than this share of themselves.
_ROUNDING = 1e-12


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


class Gnat:
    """A geometric near-neighbour access tree over the rows of a matrix of whole numbers. looked counts distances to entries."""

    def __init__(self, entries: np.ndarray, fan: int = 16):
        self.entries, self.fan, self.looked = np.asarray(entries, np.int64), fan, 0
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, ids: np.ndarray) -> tuple:
        """(split points, subtrees or None, least and greatest distances of split point i to subtree j)."""
        if len(ids) <= self.fan:
            return ids, None, None, None
        # split points far from one another: each next one is the entry farthest from those before
        far, chosen = _squares(self.entries[ids], self.entries[ids[:1]])[:, 0], [0]
        while len(chosen) < self.fan and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _squares(self.entries[ids], self.entries[ids[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # all alike: the lowest index is the answer wherever one of them is
            return ids[:1], None, None, None
        splits = np.sort(ids[chosen])
        rest = np.setdiff1d(ids, splits)
        d = np.sqrt(_squares(self.entries[rest], self.entries[splits]).astype(float))
        own, below = d.argmin(axis=1), []
        least, most = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        for j in range(len(splits)):
            inside = own == j
            below.append(self._node(rest[inside]) if inside.any() else None)
            if inside.any():
                least[:, j], most[:, j] = d[inside].min(axis=0) * (1 - _ROUNDING), d[inside].max(axis=0) * (1 + _ROUNDING)
        return splits, below, least, most

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each row's nearest entry (the lowest on ties) and its squared distance."""
        who, best = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        if len(x):
            self._visit(self.root, np.asarray(x, np.int64), np.arange(len(x)), who, best)
        return who, best

    def _visit(self, node: tuple, x: np.ndarray, rows: np.ndarray, who: np.ndarray, best: np.ndarray) -> None:
        splits, below, least, most = node
        squares = _squares(x[rows], self.entries[splits])
        self.looked += squares.size
        nearest = squares.argmin(axis=1)  # split points are in order of index, so the first of equals is the lowest
        found, index = squares[np.arange(len(rows)), nearest], splits[nearest]
        better = (found < best[rows]) | ((found == best[rows]) & (index < who[rows]))
        who[rows[better]], best[rows[better]] = index[better], found[better]
        if below is None:
            return
        d = np.sqrt(squares.astype(float))
        for near_first in (True, False):
            for j, child in enumerate(below):
                if child is None:
                    continue
                some = np.flatnonzero((nearest == j) == near_first)
                # no entry of the subtree is nearer than this
                apart = np.maximum(d[some] * (1 - _ROUNDING) - most[:, j], least[:, j] - d[some] * (1 + _ROUNDING)).max(axis=1)
                some = some[~(apart > np.sqrt(best[rows[some]].astype(float)) * (1 + _ROUNDING))]
                if len(some):
                    self._visit(child, x, rows[some], who, best)


def _cuts(dim: int) -> list[int]:
    return [i * dim // PARTS for i in range(PARTS + 1)]


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the components in whole numbers, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = lambda c: F.floor(F.greatest(F.lit(float(-_BOUND)), F.least(F.lit(float(_BOUND)), c * 1024))).cast("int")
    return vectors.where(v.isNotNull() & ~bad).select("vec_id", "label", F.transform(v, floor).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _parts(column: pa.Array, books: list[np.ndarray], dim: int, trees: list[Gnat]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part: its number, its components, the nearest entries and their squared distances."""
    x, cuts = _matrix(column, dim), _cuts(dim)
    for p in range(PARTS):
        own = x[:, cuts[p] : cuts[p + 1]]
        yield p, own, *trees[p].find(own)


def _moved(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    cuts = _cuts(dim)
    width, entries = max(1, *[b - a for a, b in zip(cuts, cuts[1:])]), len(books[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        total, n = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for b in batches:
            for p, own, index, _ in _parts(b.column(0), books, dim, trees):
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p, :, : own.shape[1]], index, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = rows.select("x").mapInArrow(work, "part int, entry int, n long, total array<long>")
    every = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    out = [b.copy() for b in books]
    for r in every.collect():  # a row per entry in use
        size = out[r["part"]].shape[1]
        out[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"][:size]]
    return out


def codebooks(rows: DataFrame, dim: int, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks of the written table rows (vec_id, x)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    start, cuts = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim), _cuts(dim)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds):
        books = _moved(rows, books, dim)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()


def coded(vectors: DataFrame, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    ready(spark)
    rows = saved(whole(vectors), "whole")
    dims = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = dims[0]["n"] if dims else 0
    rows = rows.where(F.size("x") == dim)
    books = codebooks(rows, dim, entries, rounds) if dims else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for b in batches:
            code, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, np.int64)
            for p, _, index, squares in _parts(b.column(2), books, dim, trees):
                code[:, p], error = index, error + squares
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    codes = saved(rows.select("vec_id", "label", "x").mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return lookup(codes, labels, ["label"]).withColumn("codebooks_sha256", F.lit(digest(books)))
