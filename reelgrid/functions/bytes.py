"""Numbers in BINARY columns. Positions count from 0; reads past the end are null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrInt = Column | int


def _at(pos: ColumnOrInt) -> Column:
    return pos if isinstance(pos, Column) else F.lit(pos)


def part(content: Column, pos: ColumnOrInt, n: ColumnOrInt) -> Column:
    """n bytes at pos, or null if they are not all there."""
    piece = F.substring(content, (_at(pos) + 1).cast("int"), _at(n).cast("int")) if isinstance(pos, Column) or isinstance(n, Column) else F.substring(content, pos + 1, n)
    return F.when((_at(pos) >= 0) & (F.length(piece) == _at(n)), piece)


def _number(piece: Column) -> Column:
    return F.conv(F.hex(piece), 16, 10).cast("bigint")


def little(content: Column, pos: ColumnOrInt, n: int) -> Column:
    """Unsigned little-endian integer of n bytes."""
    # by pairs of digits: reverse() on BINARY turns characters round, not bytes
    digits = F.hex(part(content, pos, n))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]), 16, 10).cast("bigint")


def big(content: Column, pos: ColumnOrInt, n: int) -> Column:
    """Unsigned big-endian integer of n bytes."""
    return _number(part(content, pos, n))


def u8(content: Column, pos: ColumnOrInt) -> Column:
    return _number(part(content, pos, 1))


def u16(content: Column, pos: ColumnOrInt, big_endian: Column | bool = False) -> Column:
    if isinstance(big_endian, bool):
        return (big if big_endian else little)(content, pos, 2)
    return F.when(big_endian, big(content, pos, 2)).otherwise(little(content, pos, 2))


def u32(content: Column, pos: ColumnOrInt, big_endian: Column | bool = False) -> Column:
    if isinstance(big_endian, bool):
        return (big if big_endian else little)(content, pos, 4)
    return F.when(big_endian, big(content, pos, 4)).otherwise(little(content, pos, 4))


def u24(content: Column, pos: ColumnOrInt) -> Column:
    return little(content, pos, 3)


def signed(value: Column, bits: int) -> Column:
    """An unsigned value of so many bits read as two's complement."""
    return value - F.when(value >= (1 << (bits - 1)), F.lit(1 << bits)).otherwise(F.lit(0))


def s16(content: Column, pos: ColumnOrInt, big_endian: Column | bool = False) -> Column:
    return signed(u16(content, pos, big_endian), 16)


def s32(content: Column, pos: ColumnOrInt, big_endian: Column | bool = False) -> Column:
    return signed(u32(content, pos, big_endian), 32)


def bits(value: Column, mask: int, shift: int = 0) -> Column:
    """(value >> shift) & mask."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def packed_offset(value: Column, dialect: str) -> tuple[Column, Column]:
    """(volume, offset) in one number: "18" keeps 18 bits of offset, "22" keeps 22 and two more above bit 30, "none" no volume."""
    if dialect == "18":
        return bits(value, 0x3F, 18), bits(value, (1 << 18) - 1)
    if dialect == "22":
        return bits(value, 0xFF, 22), bits(value, (1 << 22) - 1) + F.shiftleft(bits(value, 0x3, 30), 22)
    return F.lit(None).cast("bigint"), value


def wrap(value: Column, size: int = 65536) -> Column:
    return F.pmod(value, F.lit(size))


def wrap_signed(value: Column, bits_: int = 16) -> Column:
    half = 1 << (bits_ - 1)
    return F.pmod(value + half, F.lit(1 << bits_)) - half


def align_up(value: Column, n: int) -> Column:
    """The next multiple of n."""
    return value + F.pmod(-value, F.lit(n))


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def first_u16(content: Column, first: int, last: Column, condition: Callable[[Column, Column], Column], piece: int = 512) -> Column:
    """The least position from first to last whose little-endian 16-bit number v fulfils condition(v, position), null if there is none. The search stays inside the row, goes by pieces, and reads no piece after the one with the first hit."""
    pieces = F.when(last >= first, F.sequence(F.lit(0), F.floor((last - first) / piece).cast("int")))

    def hit(k: Column) -> Column:
        start = first + k * piece
        # a binary piece as characters 0 to 255, then as numbers; the array makes it one value for the places below
        text = F.decode(F.substring(content, start + 1, F.lit(piece + 1)), "ISO-8859-1")
        codes = F.array(F.transform(F.split(text, ""), F.ascii))
        places = F.sequence(F.lit(0), F.least(F.lit(piece - 1), last - start))
        return F.get(F.transform(codes, lambda a: F.array_min(F.transform(F.filter(places, lambda i: condition(F.get(a, i) + 256 * F.get(a, i + 1), start + i)), lambda i: start + i))), F.lit(0))

    return F.aggregate(pieces, F.lit(None).cast("int"), lambda found, k: F.when(found.isNotNull(), found).otherwise(hit(k)))
