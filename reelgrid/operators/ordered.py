"""Operators over ordered rows. by names the columns that separate sequences, order those that order them; an order must be total.

A sequence may hold most of a table. Running values go by scan(), in buckets of places; what looks at most so many rows
around goes by with_neighbours() or around(). None of them brings a whole sequence to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import align_up, wrap

BEFORE = (Window.unboundedPreceding, -1)
THROUGH = (Window.unboundedPreceding, 0)
#: Places in a bucket.
BUCKET = 1 << 16


def _bits(bucket_rows: int) -> int:
    return max(1, (bucket_rows - 1).bit_length())


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls too; right's have an underscore more in front."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def scan(
    rows: DataFrame, by: list[str], order: list[str], value: Column | str, how: str, bucket_rows: int | None = BUCKET, place: Column | None = None, before: bool = False, levels: int = 2, out: str = "scanned",
) -> DataFrame:
    """rows with out, the running sum, max or last non-null value of their sequence: through each row or only before it.

    In two levels: rows fall into buckets of bucket_rows neighbouring places (the first order column, or place, a whole
    number that never falls along the order); a window runs inside each bucket, and what came before a bucket is added from
    a window over one row a bucket. A third level and more do the same with those rows, for places far apart. Sequences of
    one bucket, and each one's first, have nothing before them, so the second join is with a table that is empty if all
    sequences are short. Null places are a bucket before all others. With bucket_rows None it is one window, for sequences
    known to be short.
    """
    v = F.col(value) if isinstance(value, str) else value
    one = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}[how]
    frame = BEFORE if before else THROUGH
    if bucket_rows is None:
        return rows.withColumn(out, one(v).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame)))
    b, t = f"_bucket{levels}", f"_total{levels}"
    at = (F.col(order[0]) if place is None else place).cast("bigint")
    own = rows.withColumns({b: F.shiftright(at, _bits(bucket_rows)), "_value": v})
    total = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))) if how == "last" else one("_value")
    totals = own.groupBy(*by, b).agg(total.alias(t))
    earlier = scan(totals, by, [b], t, how, bucket_rows if levels > 2 else None, before=True, levels=levels - 1, out="_base")
    earlier = earlier.where(F.col("_base").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in [*by, b]], "_base")
    inside = own.withColumn("_inside", one("_value").over(Window.partitionBy(*by, b).orderBy(*order).rowsBetween(*frame)))
    both = inside.join(earlier, _same(inside, earlier, [*by, b]), "left")
    if how == "sum":
        sums = F.coalesce("_inside", F.when(F.col("_base").isNotNull(), F.lit(0))) + F.coalesce("_base", F.lit(0))
        return both.withColumn(out, sums).select(*[c for c in rows.columns if c != out], out)
    return both.withColumn(out, F.greatest("_inside", "_base") if how == "max" else F.coalesce("_inside", "_base")).select(*[c for c in rows.columns if c != out], out)


def with_neighbours(rows: DataFrame, pos: str, before: int, after: int, bucket_rows: int = BUCKET) -> DataFrame:
    """rows with _bucket, their bucket of places, and _guest: rows also stand, as guests, in the buckets of rows that look at most before rows back and after rows ahead at them. A window over (sequence, _bucket) then sees all that its own rows need. Places are consecutive whole numbers."""
    bits, p = _bits(max(bucket_rows, before + after + 1)), F.col(pos).cast("bigint")
    every = rows.withColumn("_bucket", F.explode(F.sequence(F.shiftright(p - after, bits), F.shiftright(p + before, bits))))
    return every.withColumn("_guest", F.col("_bucket") != F.shiftright(p, bits))


def around(matches: DataFrame, rows: DataFrame, by: list[str], at: str, pos: str, before: int, after: int, bucket_rows: int = 256) -> DataFrame:
    """Each of matches with the rows from before places before it to after places after it: an equi-join over buckets of places (a match goes to those that its reach touches, two at most), then cut to the reach. rows need the columns by and pos, and else none that matches has."""
    bits = _bits(max(bucket_rows, before + after + 1))
    p = F.col(at).cast("bigint")
    asked = matches.withColumn("_bucket", F.explode(F.sequence(F.shiftright(p - before, bits), F.shiftright(p + after, bits))))
    held = rows.withColumn("_bucket", F.shiftright(F.col(pos).cast("bigint"), bits))
    held = held.select(*[F.col(k).alias(f"_{k}") for k in [*by, "_bucket"]], *[c for c in rows.columns if c not in by])
    on = asked.join(held, _same(asked, held, [*by, "_bucket"]))
    return on.where(F.col(pos).between(F.col(at) - before, F.col(at) + after)).drop("_bucket", *[f"_{k}" for k in [*by, "_bucket"]])


def ranked(rows: DataFrame, by: list[str], order: list[str], place: Column | None = None, bucket_rows: int = BUCKET, out: str = "rank") -> DataFrame:
    """rows numbered from 1 in each group: numbers inside buckets of places, on top of one count a bucket."""
    return scan(rows, by, order, F.lit(1), "sum", bucket_rows, place, out=out)


def record_offsets(packets: DataFrame, by: list[str], order: list[str], size: str = "packet_size", base: Column | int = 0, align: int = 2048, bucket_rows: int | None = BUCKET) -> DataFrame:
    """Adds record_pos: the aligned base and all sizes before."""
    start = align_up(base if isinstance(base, Column) else F.lit(base), align)
    out = scan(packets, by, order, size, "sum", bucket_rows, before=True, out="record_pos")
    return out.withColumn("record_pos", start + F.coalesce("record_pos", F.lit(0).cast("bigint")))


def section_sizes(directory: DataFrame, by: list[str], order: list[str], file_size: Column) -> DataFrame:
    """Adds size: to the next offset, or the file's end for the last, in 16 bits."""
    w = Window.partitionBy(*by).orderBy(*order)
    return directory.withColumn("size", wrap(F.coalesce(F.lead("offset").over(w), file_size) - F.col("offset")))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], tag: str, default: Column | None = None, bucket_rows: int | None = BUCKET) -> DataFrame:
    """rows with the last tag up to each row that is not null, or else the default."""
    found = scan(rows, by, order, tag, "last", bucket_rows, out="_found")
    return found.withColumn(tag, F.col("_found") if default is None else F.coalesce("_found", default)).drop("_found")


def fill_tags(rows: DataFrame, by: list[str], order: list[str], code: str = "code", bucket_rows: int | None = BUCKET) -> DataFrame:
    """Rows whose code has bit 7 mark a section and are not output; the rest get the tag of the mark before, 255 before any."""
    marked = rows.withColumn("tag", F.when(F.col(code).bitwiseAND(F.lit(128)) != 0, F.col(code).bitwiseAND(F.lit(127))))
    return carry_forward(marked, by, order, "tag", F.lit(255), bucket_rows).where(F.col(code).bitwiseAND(F.lit(128)) == 0)


def monotone_valid(rows: DataFrame, by: list[str], order: list[str], base: Column, offset: str = "offset", place: Column | None = None, bucket_rows: int | None = BUCKET, levels: int = 2) -> DataFrame:
    """Adds valid: base holds and offset is 0 or not below any accepted before. The running maximum over rows where base holds is the same as over accepted ones."""
    seen = scan(rows, by, order, F.when(base, F.col(offset)), "max", bucket_rows, place, before=True, levels=levels, out="_top")
    top = F.coalesce("_top", F.lit(0).cast("bigint"))
    return seen.withColumn("valid", base & ((F.col(offset) == 0) | (F.col(offset) >= top))).drop("_top")


def lookback_args(events: DataFrame, by: list[str], pos: str, trigger: Column, push: Column, value: Column, argc: Column, span: int = 50, mode: str = "compat") -> DataFrame:
    """Calls with their arguments: for a trigger, pushes among the span places before it, as many as argc, read backwards.

    compat takes the oldest pushes of the span, spec the nearest. At least five must be there. Adds id, x, y, priority, scale.
    Triggers meet pushes by an equi-join over buckets of places: nothing is listed for other rows.
    """
    calls = events.where(trigger).select(*by, F.col(pos).alias("_at"), argc.alias("_argc"))
    pushes = events.where(push).select(*by, F.col(pos).alias("p"), value.alias("v")).where("v is not null")
    listed = around(calls, pushes, by, "_at", "p", span, -1).groupBy(*by, "_at", "_argc").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("_p"))
    taken = F.slice("_p", F.lit(1), F.col("_argc")) if mode == "compat" else F.slice("_p", F.greatest(F.lit(1), F.size("_p") - F.col("_argc") + 1), F.col("_argc"))
    calls = listed.withColumn("_a", F.reverse(taken)).where(F.size("_a") >= 5)
    at = lambda i: F.element_at("_a", i + 1)
    return calls.select(*by, F.col("_at").alias(pos), at(0).alias("id"), at(3).alias("x"), at(4).alias("y"), at(2).alias("priority"), F.coalesce(F.get("_a", F.lit(5)), F.lit(128).cast(calls.schema["_a"].dataType.elementType)).alias("scale"))


def pair_with_preceding_id(seq: DataFrame, by: list[str], pos: str = "pos", value: str = "value", span: int = 10, tail: int = 5, bucket_rows: int = BUCKET) -> DataFrame:
    """Adjacent values (a in 0..630, b in 0..450) with the oldest id (1..9999) among the span values before from which on all values lie in -1000..10000: pos, id, x, y. Pairs among a sequence's last tail values do not count. Values are listed only where a pair is near."""
    own = seq.select(*by, pos, value)
    near = with_neighbours(own, pos, 0, 1, bucket_rows)
    following = F.lead(value).over(Window.partitionBy(*by, "_bucket").orderBy(pos))
    pairs = near.withColumn("y", following).where(~F.col("_guest") & F.col(value).between(0, 630) & F.col("y").between(0, 450))
    length = own.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.count("*").alias("_n"))
    pairs = pairs.join(length, _same(pairs, length, by)).where(F.col(pos) < F.col("_n") - tail).select(*by, F.col(pos).alias("_at"), F.col(value).alias("x"), "y")
    listed = around(pairs, own.select(*by, F.col(pos).alias("p"), F.col(value).alias("v")), by, "_at", "p", span, -1)
    past = F.col("_past")
    found = F.filter(past, lambda j: j["v"].between(1, 9999) & F.forall(past, lambda m: (m["p"] <= j["p"]) | m["v"].between(-1000, 10000)))
    out = listed.groupBy(*by, F.col("_at").alias(pos), "x", "y").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("_past"))
    return out.withColumn("_id", F.get(found, F.lit(0))).where("_id is not null").select(*by, pos, F.col("_id.v").alias("id"), "x", "y")


def first_per_group(rows: DataFrame, by: list[str], order: list[str], valid: Column | None = None) -> DataFrame:
    """The first row of each group; groups whose first row is not valid are left out."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
    return top if valid is None else top.where(valid)


def first_satisfying(rows: DataFrame, by: list[str], pos: Column, condition: Column) -> DataFrame:
    """The least position where condition holds, null if none: by, first_pos."""
    return rows.groupBy(*by).agg(F.min(F.when(condition, pos)).alias("first_pos"))


def match_context(seq: DataFrame, by: list[str], pos: str, first: Column, then: Column, value: str, reach: int = 40, bucket_rows: int = BUCKET) -> DataFrame:
    """by, pos and context of the places where first holds and then holds at the next row: the values that are not null from reach places before to reach after. Values are listed only around such places."""
    marked = with_neighbours(seq.select(*by, pos, first.alias("_first"), then.alias("_then")), pos, 0, 1, bucket_rows)
    following = F.lead("_then").over(Window.partitionBy(*by, "_bucket").orderBy(pos))
    matches = marked.withColumn("_next", following).where(~F.col("_guest") & F.col("_first") & F.col("_next")).select(*by, F.col(pos).alias("_at"))
    listed = around(matches, seq.select(*by, F.col(pos).alias("p"), F.col(value).alias("v")), by, "_at", "p", reach, reach)
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("p", "v")))), lambda x: x["v"])
    return listed.groupBy(*by, F.col("_at").alias(pos)).agg(values.alias("context"))


def head_per_group(rows: DataFrame, by: list[str], order: list[str], n: int, number: str | None = None) -> DataFrame:
    """The first n rows of each group, with their number from 1 if it has a name. Tasks cut their own rows to n a group before any move."""
    top = rows.withColumn(number or "_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(number or "_n") <= n)
    return top if number else top.drop("_n")


def limit_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first n frames of every clip; all of them for n <= 0."""
    return frames.where(F.col("frame_no") < n) if n > 0 else frames


def thin(rows: DataFrame, first: int = 5, every: int = 10, index: str = "frame_no") -> DataFrame:
    return rows.where((F.col(index) < first) | (F.col(index) % every == 0))


def thin_valid(rows: DataFrame, by: list[str], order: list[str], valid: Column, first: int = 10, every: int = 10, index: str = "frame_no") -> DataFrame:
    """Valid rows: the first ten of them, and those at every tenth index."""
    ok = ranked(rows.where(valid), by, order, out="_n")
    return ok.where((F.col("_n") <= first) | (F.col(index) % every == 0)).drop("_n")


def overlay(rows: DataFrame, by: list[str], order: list[str], value: str = "value", mode: str = "last") -> DataFrame:
    """One value for each place: that of the last (or first) writer. An aggregate with partial sums, no sort."""
    pick = F.max_by if mode == "last" else F.min_by
    return rows.groupBy(*by).agg(pick(value, F.struct(*order)).alias(value))


def densify(rows: DataFrame, by: list[str], sizes: DataFrame, pos: str = "pos", value: str = "value", default: int = 0) -> DataFrame:
    """A row for each place 0..size-1 of each group; sizes has by and size."""
    every = sizes.where("size > 0").withColumn(pos, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size").cast("bigint") - 1))).drop("size")
    return every.join(rows.select(*by, F.col(pos).cast("bigint").alias(pos), value), [*by, pos], "left").withColumn(value, F.coalesce(value, F.lit(default)))
