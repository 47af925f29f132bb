"""Code tables of resource types and compression methods, as expressions and as small tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of resource types and compression methods, families of methods, and type codes by map index.
TYPE_NAMES = {
    0x80: "Script", 0x81: "Sound", 0x82: "Memory", 0x83: "Text", 0x84: "Font", 0x85: "Cursor", 0x86: "Vocab", 0x87: "Pic", 0x88: "View", 0x89: "Patch", 0x8A: "Bitmap",
    0x8B: "Palette", 0x8D: "Audio", 0x8E: "Sync", 0x8F: "Message", 0x90: "Chunk", 0x91: "Heap", 0x92: "Audio36", 0x93: "Sync36", 0x94: "RobotData", 0x95: "AudioMap",
}
METHOD_NAMES = {
    0x00: "None", 0x03: "RLE Simple", 0x04: "RLE Advanced", 0x05: "Huffman", 0x06: "LZ-Bit", 0x0A: "RLE+Huffman", 0x0C: "LZ Advanced", 0x0E: "STACpack Old",
    0x20: "LZS/STACpack", 0x31: "LZSS 0x31", 0x34: "RLE 0x34", 0x38: "Huffman V56", 0x3C: "DPCM Audio", 0x7B: "STACpack/LZS (0x7B)",
}
METHOD_FAMILIES = {
    0x00: "none", 0x03: "rle", 0x04: "rle", 0x05: "huffman", 0x06: "lz", 0x08: "none", 0x0A: "rle+huffman", 0x0C: "lz", 0x0D: "lz", 0x0E: "stac", 0x20: "stac", 0x31: "lz", 0x34: "rle", 0x38: "huffman", 0x7B: "stac",
}
TYPE_CODES = [0x88, 0x87, 0x80, 0x83, 0x81, 0x82, 0x86, 0x84, 0x85, 0x89, 0x8A, 0x8B, 0x8C, 0x8D, 0x8E, 0x8F, 0x90, 0x91, 0x92, 0x93, 0x94, 0x95]

_DOMAINS = {"type": (TYPE_NAMES, "Unknown"), "method": (METHOD_NAMES, "Unknown"), "family": (METHOD_FAMILIES, "unsupported")}


def decode_enum(code: Column, domain: str) -> Column:
    """A code's name: domain "type", "method" or "family"; codes without a name get the domain's default."""
    names, default = _DOMAINS[domain]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(default))


def remap_code(index: Column) -> Column:
    """The resource type of a map's section index; null for indices without one."""
    return F.get(F.array(*[F.lit(c) for c in TYPE_CODES]), index.cast("int"))


# The 128 magnitudes of difference codes.
MAGNITUDES = [
    0, 8, 16, 32, 48, 64, 80, 96, 112, 128, 144, 160, 176, 192, 208, 224,
    240, 256, 272, 288, 304, 320, 336, 352, 368, 384, 400, 416, 432, 448, 464, 480,
    496, 512, 520, 528, 536, 544, 552, 560, 568, 576, 584, 592, 600, 608, 616, 624,
    632, 640, 648, 656, 664, 672, 680, 688, 696, 704, 712, 720, 728, 736, 744, 752,
    760, 768, 776, 784, 792, 800, 808, 816, 824, 832, 840, 848, 856, 864, 872, 880,
    888, 896, 904, 912, 920, 928, 936, 944, 952, 960, 968, 976, 984, 992, 1000, 1008,
    1016, 1024, 1088, 1152, 1216, 1280, 1344, 1408, 1472, 1536, 1600, 1664, 1728, 1792, 1856, 1920,
    1984, 2048, 2304, 2560, 2816, 3072, 3328, 3584, 3840, 4096, 5120, 6144, 7168, 8192, 12288, 16384,
]


def magnitude(code: Column) -> Column:
    """The signed step of a difference code: bit 7 is the sign, the rest the place in the table."""
    step = F.element_at(F.array(*[F.lit(m) for m in MAGNITUDES]), (code.cast("int").bitwiseAND(F.lit(127)) + 1))
    return F.when(code.cast("int").bitwiseAND(F.lit(128)) != 0, -step).otherwise(step)
