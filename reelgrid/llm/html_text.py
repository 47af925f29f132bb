"""Main text of web pages: differencing against the page of the nearest URL, with the structure as a second judge.

A page's blocks are lines; every page's lines are aligned with those of the page whose URL path is nearest on the same host
(the neighbour in the order of paths with the longer common beginning) by the longest common subsequence. Lines that both
have are the host's own, and are deleted, if nothing speaks for them: lines inside a marked article and the headline of a
page without one stay, since articles share licences, quoted passages and copies, which are text. A list of lines that are
shared for three quarters is deleted as a whole. A page that shares nearly all lines both ways is a copy and shows no
template: then the other neighbour is asked, and without one nothing is deleted. Where more than half (0.5) of a page is
shared, the other neighbour, if it is no copy, has to share a line too.

Lines differ where a host varies them from page to page (adverts, comments). So containers are aligned as well: one whose
class or id names such a thing goes if the path to it (elements and names) comes again at a neighbour that is no copy. The
name alone never deletes. Where no neighbour has the container, it takes other evidence beside the name: a marked article
that it stands outside of, links for half of its text, nothing but short lines that are no sentences, or, if the name is a
whole word ("comments", not "social-policy"), at least as much text on the page beside it. In a marked article a name that is
part of a word ("related-work") does not go by coming again. Where a class only hints ("article-related-content", or any on a
paragraph), and in named containers that stay, a line goes if it is shared, in an article too.

Lines in elements that hold no article text by their kind or role (scripts, forms, navigation, headers, footers, sidebars)
go in any case.

Pages are dealt by ranges of (host, path), so a host with a third of all pages spreads over many tasks; a task's first page
finds its neighbour in the last one of the task before, one row a task. Only hashes of lines pass between pages; the lines
themselves move once, compressed.

Null html is empty, a null url has an empty host and path. Rows that share a page_id are pages of their own; rows that are equal in page_id, url and html are judged as one. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, range_parts, ready, runs_by, saved

#: Elements without article text, elements that end a block, elements without an end tag.
SILENT = frozenset("script style noscript template iframe object embed svg canvas nav header footer aside form button select textarea dialog menu title head".split())
BLOCKS = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = r"(?:ad|ads|advert|adverts|advertisement|banner|sponsor|sponsored|promo|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|sidebar|side-bar|footer|header|masthead|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|comment|comments|reply|replies|respond|disqus|share|sharing|social|related|widget|login|signup)"
#: What a class or id says: a name of or beginning with such a word, or one with such a word further on.
NOISE = re.compile(rf"(?:^|\s){_WORDS}(?:$|[\s_-])", re.I)
HINT = re.compile(rf"[_-]{_WORDS}(?:$|[\s_-])", re.I)
#: A name that is such a word as a whole.
EXACT = re.compile(rf"(?:^|\s){_WORDS}(?:$|\s)", re.I)
#: What it takes for a named container to go: nothing does it but shared lines, that it comes again at a neighbour, nothing more.
STAYS, RECURS, GOES = range(3)
#: Elements that hold other blocks; on others a class is a hint at most.
HOLDERS = frozenset("div section ul ol dl table tbody tr td span figure fieldset details center".split())
LISTS = frozenset("ul ol dl table".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: What the structure says of a line: no article text, a hint of that, nothing, headline, article.
GONE, HINTED, OPEN, HEAD, TEXT = range(5)
#: Elements that raise no count unless an attribute does.
PLAIN = frozenset("p li a b i em strong span div ul ol dl dt dd table tbody tr td th section html body blockquote pre code small sub sup u".split())
NONE: dict[str, int] = {}
LINK = {"link": 1}
DIGITS = re.compile(r"\d+")
#: What is kept of a page beside its lines.
MARKS = ("said", "lists", "box", "takes", "around")
#: Elements whose text is none of the page's.
MUTE = frozenset("script style noscript template iframe object embed svg canvas select textarea button title head".split())


class _Reader(HTMLParser):
    """Blocks of text, what the structure says of each, the list and the named container that hold it (-1: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict[str, int], str]] = []  # tag, what it adds to the counts, its names
        self.counts = {"mute": 0, "gone": 0, "hint": 0, "article": 0, "head": 0, "link": 0, "box": 0}
        self.lists: list[int] = []
        self.n_lists = 0
        self.parts: list[str] = []
        self.linked = 0
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.boxes: list[int] = []  # the named containers that are open; an article hides those outside of it
        self.named: list[tuple[int, bool, bool, int]] = []  # of each: hash of its path, whole word, in an article, the one around it

    def cut(self) -> None:
        if not self.parts:
            return
        line = " ".join("".join(self.parts).split())
        linked, self.linked = self.linked, 0
        self.parts.clear()
        if line:
            c = self.counts
            box = self.boxes[-1] if self.boxes else -1
            said = GONE if c["gone"] else HINTED if c["hint"] or box >= 0 else TEXT if c["article"] else HEAD if c["head"] else OPEN
            self.lines.append((line, said, self.lists[-1] if self.lists else -1, box, linked))

    def _said(self, tag: str, attrs: list) -> tuple[dict[str, int], str]:
        """Which counts an element raises, and its names."""
        if not attrs and tag in PLAIN:
            return LINK if tag == "a" else NONE, ""
        out = {"mute": tag in MUTE, "head": tag in ("h1", "h2", "h3", "h4", "h5", "h6"), "link": tag == "a"}
        said = {k: v or "" for k, v in attrs}
        role = said.get("role", "").lower()
        out["article"] = tag in ("article", "main") or role == "main" or said.get("itemprop") == "articleBody"
        gone = tag in SILENT and not (tag == "header" and self.counts["article"]) or role in ROLES or "hidden" in said or said.get("aria-hidden") == "true"
        names = f"{said.get('class', '')} {said.get('id', '')}"
        if not gone and tag not in ("html", "body", "article", "main") and names != " ":
            out["box"] = tag in HOLDERS and bool(NOISE.search(names))
            out["hint"] = not out["box"] and bool(NOISE.search(names) or HINT.search(names))
        out["gone"] = gone
        return {k: 1 for k, v in out.items() if v}, names.strip()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in SILENT:
            self.cut()
        if tag in EMPTY:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._end(len(self.open) - 1)
        adds, names = self._said(tag, attrs)
        if "box" in adds:
            # the path of a container, numbers in names left out: the same one of other pages has the same
            path = "/".join(f"{t}.{DIGITS.sub('#', n)}" for t, _, n in [*self.open, (tag, adds, names)])
            self.named.append((xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")), bool(EXACT.search(names)), self.counts["article"] > 0, self.boxes[-1] if self.boxes else -1))
            self.boxes.append(len(self.named) - 1)
        elif "article" in adds:
            self.boxes.append(-1)
        self.open.append((tag, adds, names))
        for k in adds:
            self.counts[k] += 1
        if tag in LISTS:
            self.lists.append(self.n_lists)
            self.n_lists += 1

    def _end(self, at: int) -> None:
        for tag, adds, _ in reversed(self.open[at:]):
            if tag in BLOCKS or tag in SILENT:
                self.cut()
            for k in adds:
                self.counts[k] -= 1
            if "box" in adds or "article" in adds:
                self.boxes.pop()
            if tag in LISTS:
                self.lists.pop()
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._end(at)
                return
            if self.open[at][0] in ("article", "main", "body", "table", "td"):
                break
        if tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.counts["mute"]:
            self.parts.append(data)
            if self.counts["link"]:
                self.linked += len(data)


class Page(NamedTuple):
    """Lines in order; of each what the structure says, its list and its named container; of each container the hash of its path, what it takes to go, and the container around it."""

    lines: list[str]
    said: np.ndarray
    lists: np.ndarray
    box: np.ndarray
    paths: np.ndarray
    takes: np.ndarray
    around: np.ndarray


def outlined(html: str | None) -> Page:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.cut()
    own = reader.lines
    said = np.array([x[1] for x in own], np.int8)
    marked = bool((said == TEXT).any())
    if marked:  # a headline counts as one only where no article is marked
        said[said == HEAD] = OPEN
    # a container's words, characters, those in links, and lines that look like text; a line counts for all containers around it
    sums, beside = np.zeros((len(reader.named), 4), np.int64), 0
    for line, says, _, box, linked in own:
        n = line.count(" ") + 1
        if box < 0:
            beside += n if says != GONE else 0
        while box >= 0:
            sums[box] += n, len(line), linked, n >= 8 or line[-1] in ".!?\u2026"
            box = reader.named[box][3]
    takes = []
    for (_, exact, inside, _), (n, size, linked, sentences) in zip(reader.named, sums.tolist(), strict=True):
        other = marked and not inside or 2 * linked >= max(1, size) or not sentences or exact and beside >= n
        takes.append(GOES if other else RECURS if exact or not inside else STAYS)
    around, paths = [x[3] for x in reader.named], [x[0] for x in reader.named]
    return Page([x[0] for x in own], said, np.array([x[2] for x in own], np.int32), np.array([x[3] for x in own], np.int32), np.array(paths, np.uint64), np.array(takes, np.int8), np.array(around, np.int32))


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each prefix of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        hit = np.where(y == v, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(hit)
    return row


def _aligned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries of x lie on a longest common subsequence with y, by halving: memory grows with y alone."""
    if not len(x) or not len(y):
        return np.zeros(len(x), bool)
    if len(x) == 1:
        return np.isin(x, y)
    half = len(x) // 2
    cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
    return np.r_[_aligned(x[:half], y[:cut]), _aligned(x[half:], y[cut:])]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a lie on a longest common subsequence with b."""
    # lines that the other page lacks cannot be common; that is most of them
    i = np.flatnonzero(np.isin(a, b))
    x, y = a[i], b[np.isin(b, a)]
    same = min(len(x), len(y))
    lead = int(np.argmin(np.r_[x[:same] == y[:same], False]))
    out = np.zeros(len(a), bool)
    out[i[:lead]] = True
    out[i[lead:]] = _aligned(x[lead:], y[lead:])
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _near(path: str, other: str) -> int:
    """How many characters two paths begin with in common."""
    n = min(len(path), len(other))
    return next((i for i in range(n) if path[i] != other[i]), n)


def shared_lines(own: np.ndarray, boxes: np.ndarray, path: str, beside: list[tuple[str, np.ndarray, np.ndarray]], copy: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Which lines (own: their hashes) are the host's and which named containers (boxes: hashes of their paths) come again, by the pages beside it (path, hashes of lines, of containers)."""
    out = np.zeros(len(own), bool)
    beside = [x for x in sorted(beside, key=lambda x: -_near(path, x[0])) if len(x[1])] if len(own) else []
    found = [(common(own, lines), lines, others) for _, lines, others in beside]
    found = [(s, others) for s, lines, others in found if s.sum() < copy * max(len(own), len(lines))]
    if not found:
        return out, np.zeros(len(boxes), bool)
    again = np.isin(boxes, np.concatenate([others for _, others in found]))
    seen = [s for s, _ in found]
    return (seen[0] & seen[1] if len(seen) > 1 and seen[0].mean() > 0.5 else seen[0]), again


def gone_boxes(takes: np.ndarray, around: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which named containers go, and which of these because they come again."""
    differenced = again & (takes >= RECURS)
    gone = differenced | (takes == GOES)
    for i, outer in enumerate(around.tolist()):  # a container comes after the one around it
        if outer >= 0:
            differenced[i] |= differenced[outer]
            gone[i] |= gone[outer]
    return gone, differenced


def kept_lines(said: np.ndarray, lists: np.ndarray, shared: np.ndarray, most: float = 0.75) -> np.ndarray:
    """Which lines are the page's text, by what the structure says of them, the lists they are in, and which are shared."""
    gone = shared.copy()
    for k in np.unique(lists[lists >= 0]):
        own = lists == k
        if own.sum() >= 4 and shared[own].mean() >= most:
            gone |= own
    return (said != GONE) & ((said >= HEAD) | ~gone)


def main_text(pages: DataFrame, unpacked: int = 64_000_000) -> DataFrame:
    """page_id, url, text, n_chars, n_lines (lines of the page), n_shared (of these, lines that differencing found to be the
    host's) and n_differenced (lines that went because they are shared or their container comes again; lines that go by the
    kind of an element are not among them)."""
    ready(pages.sparkSession)
    host, path = host_and_path(F.col("url").cast("string"))
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    # two hashes name a page; pages that are equal in page_id, url and html are one
    named = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), html)
    named = named.select(F.xxhash64(F.col("page_id").isNull(), "page_id", "url", "html").alias("k"), F.xxhash64("html", F.col("url").isNull(), "url", "page_id").alias("k2"), "*")
    kind = pages.schema["page_id"].dataType.simpleString()

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, boxes = [], []
            for html in b.column(5).to_pylist():
                page = outlined(html)
                hashes.append(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in page.lines], np.uint64).tobytes())
                boxes.append(page.paths.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(hashes, pa.binary()), pa.array(boxes, pa.binary())], names=["k", "k2", "page_id", "host", "path", "hashes", "boxes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for b in batches:
            texts, sizes, marks = [], [], {c: [] for c in MARKS}
            for html in b.column(4).to_pylist():
                page = outlined(html)
                data = "\n".join(page.lines).encode("utf-8", "surrogatepass")
                texts.append(zstd.compress(data, asbytes=True))
                sizes.append(len(data))
                for c in MARKS:
                    marks[c].append(getattr(page, c).tobytes())
            more = [pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(marks[c], pa.binary()) for c in MARKS]]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], names=["k", "k2", "page_id", "url", "text", "size", *MARKS])

    # pages are parsed once for their lines' hashes, which meet, and once more for the lines, which then are shuffled only once
    order = ["host", "path", "page_id", "k", "k2"]
    narrow = named.select("k", "k2", "page_id", "host", "path", "html").mapInArrow(outline, f"k long, k2 long, page_id {kind}, host string, path string, hashes binary, boxes binary")
    narrow = saved(narrow, "outlines")
    dealt = saved(narrow.dropDuplicates(["k", "k2"]).repartitionByRange(*range_parts(narrow, 200_000), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "dealt")
    drop(narrow)
    by = Window.partitionBy("part").orderBy(*order)
    side = F.struct("host", "path", "hashes", "boxes")
    near = dealt.withColumn("before", F.lag(side).over(by)).withColumn("after", F.lead(side).over(by))
    # one row a part: what its first and last pages lack lies in the parts beside it
    ends = dealt.groupBy("part").agg(F.min_by(side, F.struct(*order)).alias("first"), F.max_by(side, F.struct(*order)).alias("last"))
    step = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(step).alias("left"), F.lead("first").over(step).alias("right"))
    near = near.join(ends, "part").withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right"))
    ours = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(f"{c}.path", f"{c}.hashes", f"{c}.boxes")).alias(c)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: np.frombuffer(x, np.uint64)
        for b in batches:
            shared, again = [], []
            for path, own, boxes, before, after in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                found = shared_lines(number(own), number(boxes), path, [(x["path"], number(x["hashes"]), number(x["boxes"])) for x in (before, after) if x])
                shared.append(found[0].tobytes())
                again.append(found[1].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(shared, pa.binary()), pa.array(again, pa.binary())], names=["k", "k2", "shared", "again"])

    shared = near.select("k", "k2", "path", "hashes", "boxes", ours("before"), ours("after")).mapInArrow(find, "k long, k2 long, shared binary, again binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for b in batches:
            # what comes out is bounded by its own bytes, not by those of the compressed lines
            for at, to in runs_by(b.column(b.schema.names.index("size")).to_pylist(), unpacked):
                yield one(zstd, b.slice(at, to - at))

    def one(zstd: pa.Codec, b: pa.RecordBatch) -> pa.RecordBatch:
        col = dict(zip(b.schema.names, b.columns, strict=True))
        texts, counts = [], []
        for data, size, *marks in zip(*(col[c].to_pylist() for c in ("text", "size", *MARKS, "shared", "again")), strict=True):
            said, lists, box, takes, around, shared, again = (np.frombuffer(m, t) for m, t in zip(marks, (np.int8, np.int32, np.int32, np.int8, np.int32, bool, bool), strict=True))
            gone, differenced = (np.r_[x, False][box] for x in gone_boxes(takes, around, again))  # no container: the last one
            kept = kept_lines(said, lists, shared) & ~gone
            own = zstd.decompress(data, decompressed_size=size, asbytes=True).split(b"\n") if size else []
            texts.append(b" ".join([x for x, k in zip(own, kept.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass"))
            counts.append((len(said), int(shared.sum()), int(((said != GONE) & ~kept & (differenced | ~gone)).sum())))
        more = [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 3
        return pa.RecordBatch.from_arrays([col["page_id"], col["url"], pa.array(texts, pa.string()), *more], names=["page_id", "url", "text", "n_lines", "n_shared", "n_differenced"])

    packed = named.select("k", "k2", "page_id", "url", "html").mapInArrow(pack, f"k long, k2 long, page_id {kind}, url string, text binary, size long, " + ", ".join(f"{c} binary" for c in MARKS))
    out = packed.join(shared, ["k", "k2"]).mapInArrow(judge, f"page_id {kind}, url string, text string, n_lines long, n_shared long, n_differenced long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_differenced")
