"""Files to rows. Decoding is Spark expressions over the BINARY column of binaryFile; one file is one row and one task's work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from ..functions.bytes import big, first_u16, little, part, s16, s32, u8, u16, u24, u32
from ..functions.codes import remap_code
from ..functions.text import file_name, key_from_path
from ..operators.durable import durable


def list_media(spark: SparkSession, folder: str, ext: str = "rbt") -> DataFrame:
    """path and length of the files with an extension in any case, in order of path; contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ext)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.where(F.length(file_name(F.col("path"))) > 4).select("path", "length").orderBy("path")


def read_clips(spark: SparkSession, folder: str, ext: str = "rbt", mode: str = "last") -> DataFrame:
    """clip_id, path, length, content. Mode "first" drops files without a number; rejected_clips() has them."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ext)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(key_from_path(F.col("path"), mode).alias("clip_id"), "path", "length", "content").where("clip_id is not null")


def rejected_clips(listed: DataFrame) -> DataFrame:
    return listed.where(key_from_path(F.col("path"), "first").isNull())


def load_volumes(spark: SparkSession, folder: str, name: str = "RESMAP", first: int = 1, last: int = 9) -> DataFrame:
    """path, volume, length, content of the numbered shards that are there; no rows if none is."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}.00[{first}-{last}]").load(folder)
    return found.select("path", F.regexp_extract("path", r"(\d{3})$", 1).try_cast("int").alias("volume"), "length", "content")


def read_positions(lines: DataFrame, line: str = "line", order: str = "ord", wrap: bool = False) -> DataFrame:
    """clip_id, x, y, ord from lines of three integers. Empty lines and those that start with # are skipped, short ones dropped. Numbers beyond 16 bits drop the row, or wrap."""
    number = r"^\s*([+-]?\d+)\s+([+-]?\d+)\s+([+-]?\d+)"
    text = F.col(line)
    at = lambda i: F.regexp_extract(text, number, i).try_cast("bigint")
    narrow = lambda c: (F.pmod(c + 32768, F.lit(65536)) - 32768).cast("smallint") if wrap else c.try_cast("smallint")
    rows = lines.where((F.length(text) > 0) & ~text.startswith("#")).select(at(1).try_cast("int").alias("clip_id"), narrow(at(2)).alias("x"), narrow(at(3)).alias("y"), F.col(order).alias("ord"))
    return rows.where("clip_id is not null and x is not null and y is not null")


def parse_position_lines(lines: DataFrame, line: str = "line", order: str = "ord") -> DataFrame:
    """clip_id, x, y, ord by two grammars: three integers, else "Robot <id> ... at (x=<x>, y=<y>"."""
    t, plain = F.col(line), r"^\s*([+-]?\d+)\s+([+-]?\d+)\s+([+-]?\d+)"
    a = lambda i: F.regexp_extract(t, plain, i).try_cast("int")
    worded = t.contains("Robot ") & t.contains("at (x=")
    b = lambda rx: F.when(worded, F.regexp_extract(t, rx, 1).try_cast("int"))
    simple = t.rlike(plain)
    pick = lambda i, rx: F.when(simple, a(i)).otherwise(b(rx))
    rows = lines.select(pick(1, r"Robot (\d+)").alias("clip_id"), pick(2, r"x=(-?\d+)").alias("x"), pick(3, r"y=(-?\d+)").alias("y"), F.col(order).alias("ord"))
    return rows.where("clip_id is not null and x is not null and y is not null")


def last_positions(positions: DataFrame) -> DataFrame:
    """Of each clip_id the position of the last line (greatest ord), as when a later line overwrites an earlier one."""
    last = F.max_by(F.struct("x", "y", "ord"), F.col("ord"))
    return positions.groupBy("clip_id").agg(last.alias("_last")).select("clip_id", "_last.*")


def _one_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for a row, even where the optimizer puts the expression of a column in its name's place: else each turn of a lambda in f works it out anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def read_directory(maps: DataFrame) -> DataFrame:
    """The section directory of index shards: volume, ord, type, offset, up to and with the terminator (type 31). The terminator is looked for once, and nothing is read behind it."""

    def entries(c: Column) -> Column:
        last = F.floor(F.length(c) / 3) - 1
        end = first_u16(c, 0, (3 * last).cast("int"), lambda v, p: (v.bitwiseAND(F.lit(31)) == 31) & (p % 3 == 0))
        entry = lambda i: F.struct(i.alias("ord"), u8(c, 3 * i).bitwiseAND(F.lit(31)).alias("type"), little(c, 3 * i + 1, 2).alias("offset"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.floor(end / 3), last)), entry))

    c = F.col("content")
    rows = maps.where(F.length(c) >= 3).select("volume", F.length(c).cast("bigint").alias("file_size"), F.explode(_one_value(c, entries)).alias("e"))
    return rows.select("volume", "file_size", "e.*")


def explode_fixed_records(maps: DataFrame, sections: DataFrame, width: DataFrame) -> DataFrame:
    """Records of index shards: type, number, offset, volume, rec (section), rec2 (record). sections: volume, type, offset, size (the last of a type counts); width: volume, width. A record's row never carries its file's bytes."""
    kept = sections.where((F.col("type") <= 21) & (F.col("offset") < F.col("file_size"))).groupBy("volume", "type").agg(F.max_by(F.struct("offset", "size"), "ord").alias("s"))
    rows = maps.select("volume", "content").join(kept, "volume").join(width, "volume")
    c, w, start = F.col("content"), F.col("width"), F.col("s.offset")
    n = F.least(F.floor(F.col("s.size") / w), F.floor((F.length(c) - start) / w))
    record = lambda b, i: F.struct(i.alias("i"), u16(b, i * w).alias("number"), F.when(w == 5, u24(b, i * w + 2)).otherwise(u32(b, i * w + 2)).alias("offset"))
    # six bytes more than the records have, for a width that is less than what is read of one
    piece = F.substring(c, (start + 1).cast("int"), (n * w + 6).cast("int"))
    listed = _one_value(piece, lambda b: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: record(b, i)))
    rows = rows.where(n > 0).select("volume", F.col("type").alias("rec"), F.explode(listed).alias("r"))
    return rows.select(remap_code(F.col("rec")).alias("type"), "r.number", "r.offset", "volume", "rec", F.col("r.i").alias("rec2"))


def decode_header(clips: DataFrame, versions: tuple[int, int] = (5, 6)) -> DataFrame:
    """clips with the fields of their 60-byte header; files with another magic, tag or version (5 or 6; 4 too with versions (4, 6)) are left out."""
    c = F.col("content")
    ok = (u16(c, 0) == 0x16) & (F.hex(part(c, 2, 4)) == "534F4C00")
    be = big(c, 6, 2).between(1, 255)
    named = clips.where(ok).withColumn("big_endian", be)
    e = F.col("big_endian")
    fields = {
        "version": u16(c, 6, e), "audio_block_size": u16(c, 8, e), "primer_zero": s16(c, 10, e), "frames": u16(c, 14, e), "palette_size": u16(c, 16, e), "primer_size": u16(c, 18, e),
        "x_res": s16(c, 20, e), "y_res": s16(c, 22, e), "has_palette": u8(c, 24) != 0, "has_audio": u8(c, 25) != 0, "fps": s16(c, 28, e), "hi_res": s16(c, 30, e), "max_skippable": s16(c, 32, e), "max_cels": s16(c, 34, e),
        **{f"area_{i}": s32(c, 36 + 4 * i, e) for i in range(4)},
    }
    return named.withColumns(fields).where(F.col("version").between(*versions))


def read_ranges(wanted: DataFrame, parts: int | None = None) -> DataFrame:
    """wanted (path, offset, length and more) with content, the bytes there: null where the range does not lie in the file.

    A volume is never a value: tasks open it where they need it, seek and read. Ranges are dealt by place, so that a large
    volume's are read by many tasks, each front to back.
    """
    dealt = wanted.repartitionByRange(parts, "path", "offset") if parts else wanted.repartitionByRange("path", "offset")
    names = wanted.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = source = None
        for batch in batches:
            found: list[bytes | None] = []
            at, held = 0, 0
            for i, (path, offset, length) in enumerate(zip(*[batch.column(names.index(n)).to_pylist() for n in ("path", "offset", "length")], strict=True)):
                if path != now:
                    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                    system, inner = FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
                    now, source = path, system.open_input_file(inner)
                ok = offset is not None and length is not None and offset >= 0 and 0 <= length <= source.size() - offset
                found.append(source.read_at(length, offset) if ok else None)
                held += length if ok else 0
                # batches of about 64 MB, however long the ranges are
                if held >= 64 << 20:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, i + 1 - at).columns, pa.array(found, pa.binary())], names=[*names, "content"])
                    at, held, found = i + 1, 0, []
            if found:
                yield pa.RecordBatch.from_arrays([*batch.slice(at).columns, pa.array(found, pa.binary())], names=[*names, "content"])

    return dealt.sortWithinPartitions("path", "offset").mapInArrow(work, StructType([*wanted.schema.fields, StructField("content", BinaryType())]))


def read_resources(index: DataFrame, volumes: DataFrame, parts: int | None = None) -> DataFrame:
    """index (type, number, offset, volume) with the header fields, reason and content (the packed payload, null with a reason) of the resources, read from volumes (volume, path, length) by ranges: 13 bytes each for the headers, then the payloads."""
    on = index.join(volumes.select("volume", "path", F.col("length").alias("volume_size")), "volume")
    heads = read_ranges(on.withColumn("length", F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(13).cast("bigint"), F.col("volume_size") - F.col("offset")))), parts)
    known = decode_resource_header(heads.drop("length").withColumn("start", F.col("offset"))).drop("content", "start")
    payload = known.withColumnRenamed("offset", "_at").withColumns({"offset": F.col("_at") + F.col("header_size"), "length": F.when(F.col("reason").isNull(), F.col("packed_size"))})
    return read_ranges(payload, parts).drop("offset", "length", "path").withColumnRenamed("_at", "offset")


def decode_resource_header(rows: DataFrame) -> DataFrame:
    """rows (content, offset, volume_size) with header_size, method, packed_size, size, dialect and reason (null if the payload fits). content is the volume, or with a column start a piece of it from there."""
    c, total = F.col("content"), F.col("volume_size")
    at = F.col("offset") - F.col("start") if "start" in rows.columns else F.col("offset")
    packed, size, method = u32(c, at + 3), u32(c, at + 7), u16(c, at + 11)
    plausible = (packed > 0) & (packed < total) & (size > 0) & (size < total * 10) & (method < 256)
    long = (total > 50_000_000) | plausible
    flagged = (u8(c, at).bitwiseAND(F.lit(128)) != 0) & (F.col("offset") + 10 <= total)
    dialect = F.when(long, "13").when(flagged, "10").otherwise("6")
    out = rows.withColumn("dialect", dialect)
    d = F.col("dialect")
    out = out.withColumns({
        "header_size": d.cast("int"), "method": F.when(d == "13", method).when(d == "10", u8(c, at + 6)).otherwise(F.lit(0)),
        "packed_size": F.when(d == "13", packed).otherwise(u24(c, at + 3)), "size": F.when(d == "13", size).when(d == "10", u24(c, at + 7)).otherwise(u24(c, at + 3)),
    })
    start, n = F.col("offset") + F.col("header_size"), F.col("packed_size")
    reason = F.when(F.col("offset") + 13 > total, "short header").when(start >= total, "offset past end").when(n == 0, "empty").when(n > total, "size over volume").when(start + n > total, "payload past end")
    return out.withColumn("reason", reason)


def explode_chained(rows: DataFrame, content: Column, first: Column, count: Column, header: int = 22, size_at: int = 16, most: int = 100, big_endian: Column | bool = False) -> DataFrame:
    """Chained records: each lies behind the last one's header and data. Adds rec, rec_pos, rec_size; stops where a header would cross the end. A fold over at most `most` records inside each row."""
    length = F.length(content)
    size = lambda pos: F.coalesce(u16(content, pos + size_at, big_endian), F.lit(0).cast("bigint"))
    start = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<struct<rec_pos:bigint,rec_size:bigint>>").alias("out"))
    fits = lambda a: a["at"] + header <= length
    step = lambda a, i: F.struct(F.when(fits(a), a["at"] + header + size(a["at"])).otherwise(a["at"]).alias("at"), F.when(fits(a), F.concat(a["out"], F.array(F.struct(a["at"].alias("rec_pos"), size(a["at"]).alias("rec_size"))))).otherwise(a["out"]).alias("out"))
    chain = F.aggregate(F.sequence(F.lit(1), F.least(count.cast("int"), F.lit(most))), start, step, lambda a: a["out"])
    return rows.where(count > 0).select("*", F.posexplode(chain).alias("rec", "_r")).select(*rows.columns, "rec", "_r.rec_pos", "_r.rec_size")


def chain_candidates(rows: DataFrame, by: list[str], content: Column, plausible: Callable[[Column], Column], first: int = 0, header: int = 22, size_at: int = 16, big_endian: Column | bool = False) -> DataFrame:
    """by, pos, to: each place where a header may begin (plausible, a condition on the place), and where the next one would. A header that would cross the end is no candidate. Places are listed 65,536 at a time."""
    last = F.length(content) - header
    stretches = F.when(last >= first, F.sequence(F.lit(first), last, F.lit(1 << 16)))
    places = F.sequence(F.col("_from"), F.least(F.col("_from") + ((1 << 16) - 1), last))
    # rows of compiled code: contents are not copied for each place
    hits = rows.withColumn("_from", F.explode(stretches)).withColumn("pos", F.explode(places)).where(plausible(F.col("pos")))
    size = u16(content, F.col("pos") + size_at, big_endian)
    return hits.select(*by, F.col("pos").cast("bigint").alias("pos"), (F.col("pos") + header + size).cast("bigint").alias("to"))


def follow_chain(links: DataFrame, starts: DataFrame, by: list[str], piece: int = 1 << 12) -> DataFrame:
    """by, pos, rec: the places that a chain goes through from its start (by, pos), numbered from 0.

    links (by, pos, to) leads from every candidate to its successor. A sequence's places fall into pieces of that many (a
    power of two), whichever task their bytes lie in. Links move once, to their piece; there, the chains from starts and
    from places that links of other pieces lead to are followed to where they leave the piece. Then only pieces are left to
    follow, by pointer jumping: in each round entries that are reached send the chain as far again as it has come, and
    hops are joined with themselves to lead twice as far, so n pieces take about log2(n) rounds. A chain ends at a place
    that is no candidate. Links must lead forward; places are not negative.
    """
    bits = (piece - 1).bit_length()
    pos, to = F.col("pos").cast("bigint"), F.coalesce(F.col("to").cast("bigint"), F.lit(-1).cast("bigint"))
    leaves = F.shiftright(pos, bits) != F.shiftright(to, bits)
    # kinds: 0 a link, in its piece; 1 the place it leads to, in another piece; 2 a start
    both = links.select(*by, pos.alias("_pos"), to.alias("_to"), F.explode(F.when(leaves, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_kind"))
    told = both.withColumn("_pos", F.when(F.col("_kind") == 1, F.col("_to")).otherwise(F.col("_pos"))).where("_pos >= 0")
    told = told.unionByName(starts.select(*by, pos.alias("_pos"), F.lit(-1).cast("bigint").alias("_to"), F.lit(2).alias("_kind")))
    of = lambda kind, value: F.when(F.col("_kind") == kind, value)
    lists = [F.collect_list(of(0, F.struct("_pos", "_to"))).alias("_links"), F.collect_set(of(1, F.col("_pos"))).alias("_marks"), F.collect_list(of(2, F.col("_pos"))).alias("_starts")]
    pieces = told.groupBy(*by, F.shiftright("_pos", bits).alias("_piece")).agg(*lists)
    kept = [f for f in pieces.schema.fields if f.name in by]
    names = [f.name for f in kept]
    schema = StructType([*kept, *[StructField(n, LongType()) for n in ("_pos", "_to")], StructField("_start", BooleanType()), StructField("_at", ArrayType(IntegerType()))])
    some = 1 << 19

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("_links")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # pieces of together about half a million links
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + some, "right")) - at)
                yield from hops(batch.slice(at, n))
                at += n

    def hops(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        number = batch.column("_piece").to_numpy()

        def flat(name: str) -> tuple[pa.Array, np.ndarray]:
            lists = batch.column(name)
            return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))

        def keyed(of: np.ndarray, place: np.ndarray) -> np.ndarray:
            return (of << bits) | (place & (piece - 1))

        (found, of), (marks, marked), (begun, began) = flat("_links"), flat("_marks"), flat("_starts")
        if not len(found):
            return
        here, there = (x.to_numpy(zero_copy_only=False) for x in found.flatten())
        key = keyed(of, here)
        order = np.argsort(key, kind="stable")
        key, of, there = key[order], of[order], there[order]

        def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return i, key[i] == wanted

        inside = (there >> bits) == number[of]
        i, hit = find(keyed(of, there))
        following = np.where(inside & hit, i, -1)
        entry_of = np.concatenate([marked, began])
        entry = np.concatenate([marks.to_numpy(zero_copy_only=False), begun.to_numpy(zero_copy_only=False)]).astype(np.int64)
        now, hit = find(keyed(entry_of, entry))
        start = (np.arange(len(entry)) >= len(marks))[hit]
        entry_of, entry, now = entry_of[hit], entry[hit], now[hit]
        who, last, whose, seen = np.arange(len(entry)), now.copy(), [], []
        while len(now):
            if len(seen) > len(key):
                raise ValueError("links lead in a circle")
            whose.append(who)
            seen.append(now)
            last[who] = now
            further = following[now]
            who, now = who[further >= 0], further[further >= 0]
        if not seen:
            return
        whose, seen = np.concatenate(whose), np.concatenate(seen)
        seen = seen[np.argsort(whose, kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(entry)))]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key[seen] & (piece - 1)).astype(np.int32)))
        rows = pa.array(entry_of)
        leads = np.where(inside[last], -1, there[last])
        yield pa.RecordBatch.from_arrays([*[batch.column(n).take(rows) for n in names], pa.array(entry), pa.array(leads), pa.array(start), places], names=[f.name for f in schema.fields])

    ways = durable(pieces.mapInArrow(work, schema))
    entries = ways.where(~F.col("_start"))

    def meet(left: DataFrame, place: str, right: DataFrame, how: str = "inner") -> DataFrame:
        other = right.select([F.col(k).alias(f"_{k}" if k in by else k) for k in right.columns])
        on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_{k}"]) for k in by], left[place] == other["_pos"])
        return left.join(other, on, how)

    def listed(found: DataFrame, before: Column) -> DataFrame:
        at = F.shiftleft(F.shiftright("_pos", bits), bits)
        return found.select(*by, "_pos", before.alias("_before"), F.posexplode("_at").alias("_i", "_offset")).select(*by, (at + F.col("_offset")).alias("pos"), (F.col("_before") + F.col("_i")).alias("rec"))

    n = F.size("_at").cast("bigint")
    first = ways.where(F.col("_start") & (F.col("_to") >= 0)).select(*by, F.col("_to").alias("pos"), n.alias("rec"))
    reached = [durable(meet(first, "pos", entries.select(*by, "_pos"), "left_semi"))]
    if not reached[0].isEmpty():
        inner = entries.where("_to >= 0").select(*by, "_pos", F.col("_to").alias("to"), n.alias("_n"))
        jump = durable(meet(inner, "to", entries.select(*by, "_pos"), "left_semi"))
        while not jump.isEmpty():
            every = reduce(DataFrame.unionByName, reached)
            further = durable(meet(every, "pos", jump).select(*by, F.col("to").alias("pos"), (F.col("rec") + F.col("_n")).alias("rec")))
            if further.isEmpty():
                break
            reached.append(further)
            step = jump.select(*by, "_pos", F.col("to").alias("_further"), F.col("_n").alias("_more"))
            own = jump.withColumnRenamed("_pos", "pos")
            jump = durable(meet(own, "to", step).select(*by, F.col("pos").alias("_pos"), F.col("_further").alias("to"), (F.col("_n") + F.col("_more")).alias("_n")))
    later = meet(reduce(DataFrame.unionByName, reached).select(*by, "pos", "rec"), "pos", entries.select(*by, "_pos", "_at"))
    return listed(ways.where("_start"), F.lit(0).cast("bigint")).unionByName(listed(later, F.col("rec")))


def decode_cels(rows: DataFrame, content: Column, pos: Column, big_endian: Column | bool = False) -> DataFrame:
    """The fields of a cel's header at pos: vscale, w, h, x, y, data_size, chunks."""
    return rows.withColumns({
        "vscale": u8(content, pos + 1), "w": u16(content, pos + 2, big_endian), "h": u16(content, pos + 4, big_endian), "x": s16(content, pos + 10, big_endian), "y": s16(content, pos + 12, big_endian),
        "data_size": u16(content, pos + 14, big_endian), "chunks": s16(content, pos + 16, big_endian),
    })


def palette_entries(palettes: DataFrame) -> DataFrame:
    """Listed colours of palette blocks (clip_id, palette BINARY): clip_id, idx, r, g, b. One palette a block, of 35 bytes at least; counts are little-endian; unused colours are listed too."""
    p = F.col("palette")
    ok = palettes.where((F.length(p) >= 35) & (u8(p, 10) == 1))
    entry = 13 + 2
    first, n, shared = u8(p, entry + 10), u16(p, entry + 14), u8(p, entry + 17) != 0
    step = F.when(shared, 3).otherwise(4)
    rows = ok.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0).cast("bigint"))))).where((F.col("i") < n) & (F.col("i") + first < 256))
    at = entry + 22 + F.col("i") * step + F.when(shared, 0).otherwise(1)
    return rows.select("clip_id", (first + F.col("i")).cast("int").alias("idx"), *[u8(p, at + k).cast("int").alias(c) for k, c in enumerate("rgb")]).where("b is not null")


def explode_cues(rows: DataFrame, content: Column, pos: Column, big_endian: Column | bool = False) -> DataFrame:
    """The 256 cues at pos: clip_id, cue_no, t, v."""
    i = F.col("cue_no")
    return rows.withColumn("cue_no", F.explode(F.sequence(F.lit(0), F.lit(255)))).select("clip_id", "cue_no", s32(content, pos + 4 * i, big_endian).alias("t"), u16(content, pos + 1024 + 2 * i, big_endian).alias("v"))
