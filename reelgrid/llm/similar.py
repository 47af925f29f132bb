"""Near copies by shared runs of words: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash, as in simhash: sets whose fingerprints are within 4 of 64 bits meet by ball hashing, and those that the exact
check finds similar are linked. Sets at a similarity of 0.8 differ in about 10 bits, so the rest of the links are found by an
exact join, which compares only sets that are not in one component yet.

That join misses no pair: two such sets share one of the least n - ceil(0.8 n) + 1 shingles of each, whatever the order. The order is
by rarity (counts of hashed shingles, of a fixed size), so that common passages come last and few pairs meet there. Pairs that
meet and whose sizes and places allow 0.8 are checked on the whole sets (48 bits a shingle). Where more than crowd sets meet, all
of them are first compared with the crowd sets that have the fewest rarer shingles, as texts have that others are edited
from; of the others there, those outside the shingle's largest component are then compared with all in other components.

No task holds a whole crowded shingle: one that the counts show in more than split texts is dealt in parts from the start, and
the comparisons of the second round go by blocks of those outside and of all.

Texts are lower-cased (ASCII); one of fewer than five words is one shingle; null texts are empty, and texts without a word are
alike. Components, doc_ids that are null or shared and extra columns are treated as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ready, saved, small, text_hash
from .simhash import components, links, majority, rows_named

WIDTH = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BUCKETS = 1 << 18
#: Counts of buckets are added up in so many slices, each by a task.
SLICES = 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    ends = [starts[i + width] - 1 for i in range(n)] if len(words) >= width else [len(joined)]
    cut = map(joined.__getitem__, map(slice, starts[:n], ends))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(7)), np.uint64, n))


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _bucket(own: np.ndarray) -> np.ndarray:
    return (own % np.uint64(BUCKETS)).astype(np.int64)


def _alike(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of n and m entries, both of them shared, are similar enough."""
    return both * LEAST[1] >= LEAST[0] * (n + m - both)


def _prints(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, h, node (names the set of shingles), fp (its SimHash fingerprint), and how many texts have a shingle of each bucket."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, width = ["doc_id", "h", "node", "fp", "slice", "counts"], BUCKETS // SLICES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            id_type, nodes, fps = batch.column(0).type, [], []
            for t in batch.column(2).to_pylist():
                own = shingles(t)
                nodes.append(_node(own))
                fps.append(majority(own[a : a + (1 << 16)] for a in range(0, len(own), 1 << 16)))
                np.add.at(counts, _bucket(own), 1)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if id_type is not None:
            # SLICES more rows a task
            parts = [c.tobytes() for c in counts.reshape(SLICES, width)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), *[pa.nulls(SLICES, pa.int64())] * 3, pa.array(range(SLICES), pa.int32()), pa.array(parts)], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.setdefault(at, np.zeros(width, np.int64))
                counts[at] += np.frombuffer(one.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["slice", "counts"])

    both = saved(docs.select("doc_id", text_hash().alias("h"), F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, h long, node long, fp long, slice int, counts binary"), "prints")
    slices = both.where("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(total, "slice int, counts binary")
    counts = np.zeros((SLICES, width), np.int64)
    for r in slices.collect():  # a row a slice
        counts[r["slice"]] += np.frombuffer(r["counts"], np.int64)
    prints = both.where("slice is null").drop("slice", "counts")
    prints._saved_at = both._saved_at
    return prints, np.minimum(counts.ravel(), 2**32 - 1).astype(np.uint32)


def _near(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) to check by SimHash: they join all sets whose fingerprints are linked, equal ones among them."""
    # written before the joins, so that adaptive execution can split a fingerprint of many sets
    firsts = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    equal = nodes.join(firsts, "fp").where("node != first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    linked = links(firsts.select("fp")).join(side("u"), "u").join(side("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    near = _distinct(equal.unionByName(linked))
    drop(firsts)
    return near


def _parts(counts: np.ndarray, crowd: int, split: int) -> np.ndarray:
    """Into how many parts each bucket's shingles are dealt (0: they stay whole): so that a part and the parts' central members are of one size.

    The median is what rare shingles bring to every bucket. A rare shingle in a frequent one's bucket is dealt in parts too,
    which costs a little and loses nothing.
    """
    more = np.maximum(counts.astype(np.float64) - np.median(counts), 0)
    return np.where(more > split, np.ceil(np.sqrt(more / crowd)), 0).astype(np.int32)


def _prefixes(docs: DataFrame, counts: np.ndarray, crowd: int, split: int) -> DataFrame:
    """key, n, node, pos, parts: the rarest shingles of each set, of which similar sets share one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(counts, crowd, split)
        sent: set[int] = set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = shingles(t)
                n, node = len(own), _node(own)
                # copies within a task are sent once; others meet in their groups
                if n and node not in sent:
                    sent = sent if len(sent) < 100_000 else set()
                    sent.add(node)
                    first = own[np.lexsort((own, counts[_bucket(own)]))][: n + LEAST[0] * n // -LEAST[1] + 1]
                    k = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(k, n, np.int32)), pa.array(np.full(k, node)), pa.array(np.arange(k, dtype=np.int32)), pa.array(parts[_bucket(first)])], names=["key", "n", "node", "pos", "parts"])

    return docs.select(F.col("text").cast("string")).mapInArrow(work, "key long, n int, node long, pos int, parts int")


def _groups(batches: Iterator[pa.RecordBatch], loose: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of each group of two or more rows with one key (the first column), rows being sorted by it; rows whose column loose is above 0 come batch by batch instead."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if loose is not None and (free := cols[loose] > 0).any():
            yield [c[free] for c in cols]
            cols = [c[~free] for c in cols]
        if not len(cols[0]):
            continue
        if held and held[-1][0][-1] == cols[0][0] == cols[0][-1]:
            held.append(cols)
            continue
        if held:
            cols = [np.concatenate(x) for x in zip(*held, cols, strict=True)]
        cuts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        last = cuts[-1]
        for i in np.flatnonzero(np.diff(cuts) > 1):
            yield [c[cuts[i] : cuts[i + 1]] for c in cols]
        held = [[c[last:] for c in cols]]
    if held:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(cols[0]) > 1:
            yield cols


def _meeting(n: np.ndarray, pos: np.ndarray, i: int, to: np.ndarray) -> np.ndarray:
    """Which of the sets to can be similar to set i if this is the first shingle they share."""
    a, b = n[i], n[to]
    rest = np.minimum(a - pos[i], b - pos[to])
    return to[_alike(a, b, np.minimum(rest, np.minimum(a, b)))]


def _met(prefixes: DataFrame, crowd: int) -> DataFrame:
    """u, v: pairs to check; rows with a null v are members (u) of crowded shingles (key), with n, pos and parts (above 0: not compared yet)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v", "key", "n", "pos", "parts"]
        for group, key, n, node, pos, parts in _groups(batches, loose=5):
            # copies lie side by side
            one = np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])]
            key, n, node, pos, parts = key[one], n[one].astype(np.int64), node[one], pos[one].astype(np.int64), parts[one]
            whole = not parts.any()
            if whole and len(node) < 2:
                continue
            if whole:
                # those of fewest rarer shingles first: of near copies of one text, these are nearest to it and so to most others
                order = np.lexsort((node, pos))
                n, node, pos = n[order], node[order], pos[order]
                found = [(i, _meeting(n, pos, i, np.arange(i + 1, len(node)))) for i in range(min(crowd, len(node) - 1))]
                u, v = np.concatenate([np.full(len(js), node[i]) for i, js in found]), np.concatenate([node[js] for _, js in found])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[pa.nulls(len(u), pa.int64())] * 3, pa.nulls(len(u), pa.int32())], names=names)
            if not whole or len(node) > crowd:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key), pa.array(n), pa.array(pos), pa.array(parts)], names=names)

    group = F.expr("if(parts = 0, key, xxhash64(key, pmod(node, parts)))")
    dealt = prefixes.repartition(group).sortWithinPartitions(group, "node").select(group.alias("_g"), "key", "n", "node", "pos", "parts")
    return saved(dealt.mapInArrow(work, "u long, v long, key long, n long, pos long, parts int"), "met")


def _centred(members: DataFrame, crowd: int) -> DataFrame:
    """Pairs (u, v) to check between the members of each shingle that is dealt in parts and its crowd most central ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, node, pos, central in _groups(batches):
            others = np.flatnonzero(~central)
            for i in np.flatnonzero(central):
                js = _meeting(n, pos, i, others[node[others] != node[i]])
                if len(js):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), node[i])), pa.array(node[js])], names=["u", "v"])

    place = F.row_number().over(Window.partitionBy("key").orderBy("pos", "u"))
    centres = members.withColumn("_r", place).where(F.col("_r") <= crowd).withColumn("_p", F.explode(F.expr("sequence(0, parts - 1)")))
    columns = lambda central: [F.xxhash64("key", "_p").alias("_g"), "n", F.col("u").alias("node"), "pos", F.lit(central).alias("central")]
    every = members.withColumn("_p", F.expr("cast(pmod(u, parts) as int)")).select(*columns(False))
    dealt = every.unionByName(centres.select(*columns(True))).repartition("_g").sortWithinPartitions("_g")
    return dealt.mapInArrow(work, "u long, v long")


def _apart(members: DataFrame, roots: DataFrame, block: int = 512) -> DataFrame:
    """Pairs (u, v) to check among members of crowded shingles that are in different components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, node, pos, root, largest, seeks in _groups(batches):
            others = np.flatnonzero(~seeks)
            for i in np.flatnonzero(seeks):
                # two outside the largest component meet both ways: one is enough
                js = others[(root[others] != root[i]) & (largest[others] | (node[others] > node[i]))]
                js = _meeting(n, pos, i, js)
                if len(js):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), node[i])), pa.array(node[js])], names=["u", "v"])

    own = members.join(roots.distinct(), F.col("u") == F.col("node"), "left").select("key", "n", F.col("u").alias("node"), "pos", F.coalesce("root", "u").alias("root"))
    own = saved(own, "crowded")
    sizes = own.groupBy("key", "root").agg(F.count("*").alias("_c")).groupBy("key")
    sizes = sizes.agg(F.max_by("root", F.struct("_c", "root")).alias("_top"), F.sum("_c").alias("_all"), (F.sum("_c") - F.max("_c")).alias("_out"))
    # shingles whose members are all in one component need no comparison
    own = own.join(sizes.where("_out > 0"), "key").withColumn("_b", F.lit(block))
    beside = "transform(sequence(0, ceil(_out / _b) - 1), x -> struct(pmod(xxhash64(node), ceil(_all / _b)) as m, x as x, false as seeks))"
    seeking = "transform(sequence(0, ceil(_all / _b) - 1), m -> struct(m as m, pmod(xxhash64(node, 1), ceil(_out / _b)) as x, true as seeks))"
    dealt = own.select("key", "n", "node", "pos", "root", (F.col("root") == F.col("_top")).alias("largest"), F.explode(F.expr(f"if(root = _top, {beside}, concat({beside}, {seeking}))")).alias("_to"))
    dealt = dealt.select(F.xxhash64("key", "_to.m", "_to.x").alias("_g"), "n", "node", "pos", "root", "largest", "_to.seeks")
    return dealt.repartition("_g").sortWithinPartitions("_g").mapInArrow(work, "u long, v long")


def _packed(own: np.ndarray) -> bytes:
    """A set by the upper six bytes of its hashes, which tell the shingles of two texts apart as well."""
    return np.unique(own >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: pa.Scalar) -> np.ndarray:
    six = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), np.uint8)], axis=1).view("<u8").ravel()


def _sets(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """node and own, the packed set, of some nodes: the texts move once for all comparisons."""
    wanted = nodes.join(some, "node", "left_semi").select(F.col("lead.doc_id").alias("doc_id"), F.col("lead.h").alias("h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([_packed(x) for x in own], pa.binary())], names=["node", "own"])

    return saved(rows_named(docs.select("doc_id", F.col("text").cast("string").alias("text")), wanted).select("text").mapInArrow(work, "node long, own binary"), "sets")


def _distinct(pairs: DataFrame) -> DataFrame:
    return saved(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def _checked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of distinct pairs that are similar, by their whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _unpacked(a), _unpacked(b)
                good.append(bool(_alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"{c}_own"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_own", "v_own")
    return saved(both.mapInArrow(check, "u long, v long"), "alike")


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs that are not in one component yet."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return saved(both.where("u_root is null or v_root is null or u_root != v_root").select("u", "v"), "rest")


def one_each(docs: DataFrame, crowd: int = 16, split: int = 1024, block: int = 512) -> DataFrame:
    """docs with one row of each component of similar texts: that of the least doc_id."""
    ready(docs.sparkSession)
    prints, counts = _prints(docs)
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("lead")
    nodes = saved(prints.groupBy("node").agg(lead, F.min("fp").alias("fp")), "nodes")
    drop(prints)
    near = _near(nodes)
    met = _met(_prefixes(docs, counts, crowd, split), crowd)
    pairs, crowded = met.where("v is not null").select("u", "v"), met.where("v is null").select("u", "key", "n", "pos", "parts")
    dealt = crowded.where("parts > 0")
    if not dealt.isEmpty():
        pairs = pairs.unionByName(_centred(dealt, crowd))
    pairs = _distinct(pairs)
    sets = _sets(docs, nodes, _ends(pairs).union(_ends(near)).union(crowded.select(F.col("u").alias("node"))).distinct())
    alike = _checked(sets, near)
    if not alike.isEmpty():
        found, pairs = pairs, _unlinked(pairs, components(alike))
        drop(found)
    alike = alike.unionByName(_checked(sets, pairs))
    roots = components(alike)
    if not crowded.isEmpty():
        more = _distinct(_apart(crowded.drop("parts"), roots, block))
        ends = _ends(more)
        # few sets are left to compare as a rule: then only these move
        few = small(ends, 200_000)
        again = _checked(sets.join(F.broadcast(ends), "node", "left_semi") if few else sets, more)
        drop(more)
        if not again.isEmpty():
            roots = components(alike.unionByName(again))
    for table in (sets, near, pairs):
        drop(table)
    drop(met)
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("lead").alias("lead"))
    return rows_named(docs, best.select("lead.doc_id", "lead.h"))
