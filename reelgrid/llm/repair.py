"""Conversation structure repair: the cheapest edits that make a conversation's roles fit the grammar (s?(ua)+)?.

A conversation's signature has a letter per row, in order of turn: the role's initial and the row's fault. What the edits of
a row and of all after it cost depends only on the signature's suffix from there and on the grammar's state, so signatures
share their suffixes: read from the end and sorted, they form a directed acyclic word graph (DAWG) whose nodes are distinct
suffixes, and signatures that meet in a node share all that is known there. Per node and grammar state the cost to go, the
first edit of the least best audit and that audit's rank among the node's four are found once. Two nodes whose four costs
differ by a constant and whose audits rank alike behave alike before any letter, so a node is computed from its letter and
its successor's class alone and is looked up if another suffix has been there before. Signatures are dealt in ranges of
their reversed form, with the conversation's id behind it: neighbours share suffixes, a task holds the nodes of one
signature at a time, and a signature that a third of all conversations have spreads over tasks.

Texts move once, when the edits are applied; before that a row is its turn, role, SHA-256 of the text and fault. What is held
in memory of a conversation is its signature and audit, one byte a row. Rows that share a turn follow by role, then by the
text's SHA-256; equal rows are neighbours. Null turns come first. Null roles and texts are one space, and null ids are one
conversation of their own. An empty role has no initial: it fits nothing. A table without rows gives none. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, ready, saved

SPACE = " \t\n\x0b\x0c\r"
INITIALS = "suax"
#: Faults of a row, its first counts: none, truncated, blank, duplicate. The last two must be deleted.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: The grammar's states: nothing yet, after s, after u, after ua. Which initial leads where.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: A role that a new or rerolled row gets in a state.
ADDED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: Of a signature's end: costs, edits (letter, state after, whether it takes a row), ranks of the audits "", "II", "I", "".
_END = ((0, 4, 2, 0), (("", 0, False), ("I", 2, False), ("I", 3, False), ("", 3, False)), (0, 2, 1, 0))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged as the CRC-32 of "conv_id:turn" says. A dropped row has no copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h, copies, i (place of the initial in INITIALS), fault (duplicates not yet seen)."""
    solid = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(solid == "", BLANK).when(F.substring(solid, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    i = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1
    return rows.select("conv_id", "turn", "role", _hash(), "copies", F.when((i < 0) | (F.col("role") == ""), 3).otherwise(i).alias("i"), fault.alias("fault"))


def _hash() -> F.Column:
    return F.unhex(F.sha2("text", 256)).alias("h")


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, reversed (the signature from the end, a byte a row: 4 * initial + fault), gaps, blank, duplicate, truncated, illegal of rows (conv_id, turn, role, text, copies)."""
    ready(rows.sparkSession)
    marks = saved(_marked(rows), "marks")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = marks.where((F.col("copies") > 0) & (F.col("fault") != BLANK)).groupBy("conv_id", "role", "h").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    marks = lookup(marks, again.where("first <> last").drop("last"), ["conv_id", "role", "h"])
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    ordered = marks.withColumn("fault", F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault"))).drop("first").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []
        for b in batches:
            for conv, turn, role, h, copies, i, fault in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if open_ is None or conv != now:
                    if open_ is not None:
                        out.append(open_.row(now))
                    now, open_ = conv, _Signature()
                open_.add(turn, role, h, copies, i, fault)
            if len(out) >= 512:
                yield _batch(out)
                out = []
        if open_ is not None:
            out.append(open_.row(now))
        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    key = pa.string() if marks.schema["conv_id"].dataType.simpleString() == "string" else pa.int64()
    names, types = ["conv_id", "reversed", "gaps", "blank", "duplicate", "truncated", "illegal"], [key, pa.binary(), *[pa.int64()] * 5]
    schema = f"conv_id {'string' if key == pa.string() else 'long'}, reversed binary, " + ", ".join(f"{n} long" for n in names[2:])
    return ordered.select("conv_id", "turn", "role", "h", "copies", "i", "fault").mapInArrow(work, schema)


class _Signature:
    """What is known of a conversation while its rows go by in order."""

    def __init__(self) -> None:
        self.letters, self.counts = bytearray(), [0] * 4
        self.least = self.most = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: str, h: bytes, copies: int, i: int, fault: int) -> None:
        for _ in range(copies):
            if turn is not None and turn != self.most:
                self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            here = (turn, role, h)
            of = DUPLICATE if here == self.before and fault != BLANK else fault
            if self.letters:
                self.illegal += INITIALS[self.letters[-1] // 4] + INITIALS[i] not in ("su", "ua", "au")
            self.before = here
            self.counts[of] += 1
            self.letters.append(4 * i + of)

    def row(self, conv: int | str | None) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return conv, bytes(reversed(self.letters)), gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal


@lru_cache(maxsize=None)
def settled(letter: int, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[tuple[tuple, tuple, tuple], int]:
    """The class (costs above the least, edits, ranks) of the node that puts a letter before one with these costs and ranks,
    and its least cost. Differences of costs are bounded, as two inserts lead from any state to any other, so few classes
    exist."""
    initial, fault = INITIALS[letter // 4], letter % 4
    best = []
    for q in range(4):
        tried = [(DELETE + costs[q], "D", ranks[q], q)]
        if fault in (FINE, TRUNCATED):
            cut = CUT if fault == TRUNCATED else 0
            if initial in NEXT[q]:
                to = NEXT[q][initial]
                tried.append((KEEP + cut + costs[to], "K", ranks[to], to))
            to = NEXT[q][ADDED[q]]
            tried.append((REROLE + cut + costs[to], "R", ranks[to], to))
        best.append(min(tried))
    # two inserts in a row end in u or a where they began, so one from a taken row is enough there; then the others
    total, edit, key = [b[0] for b in best], [(b[1], b[3], True) for b in best], [(b[1], b[2]) for b in best]
    taken = list(zip(total, key))
    for q in (2, 3, 0, 1):
        to = NEXT[q][ADDED[q]]
        cost, audit = taken[to] if q in (2, 3) else (total[to], key[to])
        if (cost + INSERT, "I") < (total[q], edit[q][0]):
            total[q], edit[q], key[q] = cost + INSERT, ("I", to, False), ("I", audit)
    order, least = sorted(set(key)), min(total)
    return (tuple(t - least for t in total), tuple(edit), tuple(order.index(k) for k in key)), least


class Dawg:
    """The suffix-shared automaton along one reversed signature: what the next one shares with it stays."""

    def __init__(self) -> None:
        self.word, self.base, self.nodes, self.made = b"", array("q", [0]), [_END], 0

    def root(self, word: bytes) -> None:
        """Goes to the node of a reversed signature, making the nodes that the one before lacks."""
        shared = 0
        for a, b in zip(word, self.word):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :], self.base[shared + 1 :]
        for letter in word[shared:]:
            costs, _, ranks = self.nodes[-1]
            node, more = settled(letter, costs, ranks)
            self.nodes.append(node)
            self.base.append(self.base[-1] + more)
            self.made += 1
        self.word = word

    def answer(self) -> tuple[int, str]:
        """The least cost and the least audit at that cost of the whole signature."""
        at, q, out = len(self.nodes) - 1, 0, bytearray()
        cost = self.base[at] + self.nodes[at][0][0]
        while True:
            letter, q, takes = self.nodes[at][1][q]
            if not letter:
                return cost, out.decode()
            out += letter.encode()
            at -= takes


def plans(rows: DataFrame, per_task: int = 200_000) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of rows (conv_id, turn, role, text, copies)."""
    found = saved(signatures(rows), "signatures")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-found.count() // per_task))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dawg, last, answer = Dawg(), None, None
        for b in batches:
            costs, audits = [], []
            for word in b.column(1).to_pylist():
                if word != last:
                    dawg.root(word)
                    last, answer = word, dawg.answer()
                costs.append(answer[0])
                audits.append(answer[1])
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=names)

    names = [*[c for c in found.columns if c != "reversed"], "cost", "audit"]
    schema = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", audit string"
    return found.repartitionByRange(parts, "reversed", "conv_id").sortWithinPartitions("reversed").mapInArrow(work, schema)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the rows of the repaired conversations, in order of place and a conversation's in a
    row of the same partition; deleted rows (edit D) have no place."""
    ready(rows.sparkSession)
    kind = planned.schema["conv_id"].dataType.simpleString()
    body = rows.select(F.col("conv_id").cast(kind).alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("string").alias("_t"), "turn", "role", "text", _hash(), "copies")
    head = planned.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("_t"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("h"), F.lit(1).alias("copies"))
    both = head.unionByName(body).where("copies > 0").drop("_t")
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h").select("conv_id", "kind", "role", "text", "copies")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Edits | None = None
        for b in batches:
            out: list[tuple] = []
            for conv, kind, role, text, copies in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if kind == 0:
                    state = _Edits(conv, text)
                    out += state.inserted()
                else:
                    for _ in range(copies):
                        out += state.apply(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], names=names)

    names, types = ["conv_id", "place", "edit", "role", "text"], [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return ordered.mapInArrow(work, f"conv_id {kind}, place long, edit string, role string, text string")


class _Edits:
    """Follows an audit along the rows of its conversation."""

    def __init__(self, conv: int | str | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.place = conv, audit, 0, 0, 0

    def _out(self, edit: str, role: str, text: str) -> tuple:
        self.state = NEXT[self.state][role[0]]
        self.place += 1
        return self.conv, self.place - 1, edit, role, text

    def inserted(self) -> list[tuple]:
        """The rows that come before the next one of the conversation."""
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            out.append(self._out("I", ROLE[ADDED[self.state]], ""))
        return out

    def apply(self, role: str, text: str) -> list[tuple]:
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            out = [(self.conv, None, "D", role, text)]
        else:
            out = [self._out(edit, role if edit == "K" else ROLE[ADDED[self.state]], text)]
        return out + self.inserted()


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 (of the role:text lines) of what repaired() gives: a conversation's rows follow one another, so they are hashed as they come."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, begun, out = None, None, False, []
        for b in batches:
            for conv, place, _, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if sha is None or conv != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha, begun = conv, hashlib.sha256(), False
                if place is not None:
                    sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            yield from flush(out)
            out = []
        yield from flush([*out, *([(now, sha.hexdigest())] if sha is not None else [])])

    def flush(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], key), pa.array([o[1] for o in out])], names=["conv_id", "repaired_sha256"])

    key = pa.string() if kind == "string" else pa.int64()
    return rows.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def reported(conversations: DataFrame) -> DataFrame:
    """A row per conv_id of the damaged conversations: what was wrong with it, its cheapest repair and the hash of the repaired rows."""
    rows = damaged(conversations)
    planned = saved(plans(rows), "plans")
    hashed = digests(repaired(rows, planned)).withColumnRenamed("conv_id", "_c")
    out = planned.join(hashed, planned["conv_id"].eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
