"""Removal of repeated passages: seed and extend over winnowed anchors.

Every window of length words picks one anchor in it, the k-gram of least hash; which one depends on the window's words
alone, so equal windows pick equal anchors. Neighbouring windows that pick the same occurrence of an anchor form its span:
the anchor extended both ways as far as its windows reach. Occurrences meet on their anchors.

A span that occurs before, word for word, is a repeat as a whole. Spans that differ though they share an anchor agree on a
part: there the extension is found window by window, by joining windows of these spans on their words. Touching repeats
are merged into maximal ones of at least length words, and the words that they cover are removed. The earliest occurrence
(least doc_id, then least place) is never removed for its own sake.

Words are compared by 64-bit hashes of spans or windows along with 32 bits of their anchor. Before each shuffle, a task
sends a batch's first occurrence of a span or window only and knows the rest of them as repeats, so a passage that a third
of the documents share is sent once a batch. Nothing is paired within a group and no group is held: tasks read sorted rows.

Texts of 2**26 words and more are looked through in stretches that overlap by a window; starts have 30 bits, so a text may
have up to 2**30 words. Null texts have no words. Rows that share a doc_id count as one document: neither's windows precede the other's at the same
place. Null doc_ids come before all others, as one document. Extra columns stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ready, runs_of, saved, text_hash

LENGTH, ANCHOR = 20, 8
_ODD = 0x9E3779B97F4A7C15
#: The inverse of _ODD modulo 2**64.
_INVERSE = pow(_ODD, -1, 1 << 64)
SPAN, LONE, REPEAT = 0, 1, 2  # kinds of rows: a span, to be met by its anchor; by its words; a known repeat


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts in a row, as 64-bit hashes, with hashes of any run of them."""

    def __init__(self, texts: list[str | None]):
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.n = int(self.sizes.sum())
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, self.n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        power = np.cumprod(np.full(self.n + 1, _ODD, np.uint64)) * np.uint64(_INVERSE)
        self._back = np.cumprod(np.full(self.n + 1, _INVERSE, np.uint64)) * np.uint64(_ODD)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: self.n])])

    def runs(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of size words at these places."""
        h = (self._sums[at + size] - self._sums[at]) * self._back[at]
        return _mixed(h + np.uint64(_ODD) * np.asarray(size, np.uint64))


def _anchors(grams: np.ndarray, reach: int, bits: int) -> np.ndarray:
    """The place of the least (hash, place) of each reach neighbouring k-grams, by doubling: the hash's upper bits and the place in one number, whose place has so many bits; longer texts go in stretches."""
    step, n, mask, out = (1 << bits) - reach, len(grams) - reach + 1, np.uint64((1 << bits) - 1), []
    for a in range(0, n, step):
        own = grams[a : a + step + reach - 1]
        low = (own & ~mask) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while size * 2 <= reach:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        if size < reach:
            low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
        out.append((low & mask).astype(np.int64) + a)
    return np.concatenate(out)


def spans(w: Words, length: int = LENGTH, k: int = ANCHOR, bits: int = 26) -> dict[str, np.ndarray]:
    """Of each span: doc (its text's number), start (its first window's place in the text), count (windows), anchor, span (hashes)."""
    n = w.n - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return {"doc": none, "start": none, "count": none, "anchor": none, "span": none}
    grams = w.runs(np.arange(w.n - k + 1), k)
    at = _anchors(grams, length - k + 1, bits)
    doc = np.repeat(np.arange(len(w.sizes)), w.sizes)
    inside = doc[:n] == doc[length - 1 :]
    new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:n] != doc[: n - 1])] & inside
    new |= inside & np.r_[True, ~inside[:-1]]
    first = np.flatnonzero(new)
    if not len(first):
        return {"doc": none, "start": none, "count": none, "anchor": none, "span": none}
    run = np.cumsum(new)[inside] - 1
    count = np.bincount(run, minlength=len(first))
    return {
        "doc": doc[first], "start": first - w.starts[doc[first]], "count": count,
        "anchor": (grams[at[first]] >> np.uint64(26)).astype(np.uint32).view(np.int32), "span": w.runs(first, count + length - 1).view(np.int64),
    }


def _ids(values: list) -> tuple[np.ndarray, np.ndarray]:
    none = np.array([v is None for v in values], bool)
    return np.array([0 if v is None else v for v in values], np.int64), none


#: What is shuffled: 32 bits of the anchor and, in known repeats and lone rows, as many that spread them; a hash of the
#: words; the document; and start (30 bits), 27 bits of the text's hash, the number of windows (4) and the kind (2).
ROW = "anchor long, hash long, doc long, rest long"


def _rows(kind: np.ndarray, anchor: np.ndarray, hashed: np.ndarray, doc: np.ndarray, none: np.ndarray, start: np.ndarray, tail: np.ndarray, count: np.ndarray | int) -> pa.RecordBatch:
    """tail: 27 bits of the text's hash, which tell apart rows that share a doc_id."""
    spread = np.where(kind == SPAN, 0, (_mixed((doc * 1_000_003 + start).view(np.uint64)) >> np.uint64(33)).astype(np.int64) + 1)
    rest = (start << 33) | (tail.astype(np.int64) << 6) | (np.asarray(count, np.int64) << 2) | kind
    return pa.RecordBatch.from_arrays([pa.array((anchor.astype(np.int64) << 32) + spread), pa.array(hashed), pa.array(doc, pa.int64(), mask=none), pa.array(rest)], names=["anchor", "hash", "doc", "rest"])


def _start() -> Column:
    return F.shiftright("rest", 33)


def _tail() -> Column:
    return F.shiftright("rest", 6).bitwiseAND((1 << 27) - 1).cast("int")


def _count() -> Column:
    return F.shiftright("rest", 2).bitwiseAND(15).cast("int")


def _kind() -> Column:
    return F.col("rest").bitwiseAND(3)


def _firsts(doc: np.ndarray, none: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and then place, and in it which rows are not at a later place than the first with their keys."""
    order = np.lexsort((start, doc, ~none, *keys[::-1]))
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    at = lambda x: x[order] == x[order][lead]
    return order, new | (at(doc) & at(none) & at(start))


def _seeds(length: int, k: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for a, b in runs_of(texts):
                s = spans(Words(texts[a:b]), length, k)
                if not len(s["doc"]):
                    continue
                ids, none = _ids(keys[a:b])
                doc, none, tail = ids[s["doc"]], none[s["doc"]], tails[a:b][s["doc"]]
                order, first = _firsts(doc, none, s["start"], s["anchor"], s["span"])
                anchor, kind = s["anchor"][order], np.where(first, SPAN, REPEAT)
                # an anchor with many spans in this batch sends two of them to meet it: that shows that it has several
                at = np.flatnonzero(first)
                new = np.r_[True, anchor[at][1:] != anchor[at][:-1]]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                kind[at[nth >= 2]] = LONE
                yield _rows(kind, anchor, s["span"][order], doc[order], none[order], s["start"][order], tail[order], s["count"][order])

    return work


def _windows(length: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys, texts, tails = col["_id"].to_pylist(), col["text"].to_pylist(), col["_tail"].to_numpy()
            found = col["_found"]
            for a, b in runs_of(texts):
                w, part = Words(texts[a:b]), found.slice(a, b - a)
                own = part.flatten()
                doc = np.repeat(np.arange(b - a), pa.compute.list_value_length(part).to_numpy())
                count = own.field("count").to_numpy()
                each = np.repeat(np.arange(len(count)), count)
                step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                doc, start = doc[each], own.field("start").to_numpy()[each] + step
                anchor, hashed = own.field("anchor").to_numpy()[each], w.runs(w.starts[doc] + start, length).view(np.int64)
                if not len(doc):
                    continue
                ids, none = _ids(keys[a:b])
                ids, none, tail = ids[doc], none[doc], tails[a:b][doc]
                order, first = _firsts(ids, none, start, anchor, hashed)
                yield _rows(np.where(first, SPAN, REPEAT), anchor[order], hashed[order], ids[order], none[order], start[order], tail[order], 1)

    return work


def _judged(rows: DataFrame) -> DataFrame:
    """rows with later (whether an equal span or window comes before) and several (whether the anchor has other spans), by one shuffle. Known repeats go along, spread."""
    place = F.struct(F.col("doc").isNotNull(), F.coalesce("doc", F.lit(0).cast("long")), _start())
    same = Window.partitionBy("anchor", "hash").orderBy(F.col("doc").asc_nulls_first(), "rest")
    near = Window.partitionBy("anchor")
    out = rows.withColumn("_lead", F.first(place).over(same)).withColumn("several", F.min("hash").over(near) < F.max("hash").over(near))
    return out.withColumn("later", (_kind() == REPEAT) | ((_kind() == SPAN) & (place > F.col("_lead")))).drop("_lead")


#: What names a document: its doc_id, and 27 bits of its text's hash along with whether the doc_id is null.
NAME = ["_key", "_sub"]


def _name(doc: Column, tail: Column) -> list[Column]:
    return [F.coalesce(doc, F.lit(0).cast("long")).alias("_key"), (tail * 2 + doc.isNull().cast("int")).alias("_sub")]


def _own_tail() -> Column:
    return text_hash().bitwiseAND((1 << 27) - 1).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """docs, its text as a string, with the columns NAME."""
    return docs.withColumn("text", F.col("text").cast("string")).select("*", *_name(F.col("doc_id").cast("long"), _own_tail()))


def repeats(own: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """The repeats in what keyed() gives, as (_key, _sub, start, count of windows). Repeated rows share their document's."""
    if not 0 < k < length or length - k + 1 > 15:
        raise ValueError("an anchor is shorter than a window, by at most 14 words")
    ready(own.sparkSession)
    rows = own.select(F.col("doc_id").cast("long"), "text", _own_tail()).mapInArrow(_seeds(length, k), ROW)
    met = _judged(rows).where((F.col("later")) | (_kind() == LONE) | F.col("several"))
    met = saved(met.select(*_name(F.col("doc"), _tail()), F.when(~F.col("later"), F.shiftright("anchor", 32).cast("int")).alias("anchor"), _start().cast("int").alias("start"), _count().alias("count")), "spans")
    whole = met.where("anchor is null").select(*NAME, "start", "count")
    # sets, not lists: copies of one row bring the same spans, and each of them joins what all have brought
    parts = met.where("anchor is not null").groupBy(*NAME).agg(F.collect_set(F.struct("anchor", "start", "count")).alias("_found"))
    # all columns of own take part, so that this join and the caller's read the texts from one shuffle
    text = own.join(parts, NAME).withColumn("_id", F.col("doc_id").cast("long")).withColumn("_tail", _own_tail())
    windows = _judged(text.mapInArrow(_windows(length), ROW)).where("later")
    return whole.unionByName(windows.select(*_name(F.col("doc"), _tail()), _start().cast("int").alias("start"), _count().alias("count")))


def covered(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in these runs of windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + length - 1, -1)
    return np.cumsum(edge[:n]) > 0


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, text, doc (a struct of docs' other columns, if any), kept_text (the words that stay, joined by one space), n_words, n_removed, and repeats: the maximal repeats as arrays of (start, end) in words."""
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    own = keyed(docs.select("doc_id", "text", *([F.struct(*others).alias("doc")] if others else [])))
    per = repeats(own, length, k).groupBy(*NAME).agg(F.collect_set(F.struct("start", "count")).alias("_found"))
    joined = own.join(per, NAME, "left").drop(*NAME)
    names, at = joined.columns[:-1], joined.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans_ = batch.column(at), batch.column(len(names))
            kept, n_words, n_removed, maximal = [], [], [], []
            for i in range(len(text)):
                words = (text[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words), bool)
                if spans_[i].is_valid:
                    own_spans = spans_[i].values
                    gone = covered(len(words), own_spans.field("start").to_numpy(), own_spans.field("count").to_numpy(), length)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2)
                maximal.append([{"start": a, "end": b} for a, b in edges.tolist()])
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                n_words.append(len(gone))
                n_removed.append(int(gone.sum()))
            more = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(maximal, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*out.names])

    out = StructType([*joined.schema.fields[:-1], *StructType.fromDDL("kept_text string, n_words long, n_removed long, repeats array<struct<start: long, end: long>>").fields])
    return joined.mapInArrow(work, out)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    found = deduplicated(docs.select("doc_id", "text"), **options)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with their repeated passages cut from text; texts without any are unchanged. n_chars, if there, is counted anew."""
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    columns = {c: F.col(f"doc.{c}") for c in docs.columns if c not in ("doc_id", "text")} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return deduplicated(docs, **options).select(*[columns[c].alias(c) for c in docs.columns])
