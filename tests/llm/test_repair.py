"""Conversation repair against SQL on whole tables, against trying all edits, and on awkward rows."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from tests.conftest import SF01, SF001

from reelgrid.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, n long"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """The least (cost, audit) over all edits of (initial, fault) rows, by search in order of cost and audit."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        # what is still possible depends on the row and on the grammar's state alone
        state = (i, "" if not roles else "s" if roles == "s" else roles[-1])
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit
        if state in seen:
            continue
        seen.add(state)
        options = [(2, "I", i, r) for r in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            options.append((3, "D", i + 1, ""))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                cut = fault == repair.TRUNCATED
                options += [(cut, "K", i + 1, initial)] + [(2 + cut, "R", i + 1, r) for r in "ua"]
        for more, letter, to, role in options:
            if role not in ("", "s", "u", "a") or not re.fullmatch(r"s?(ua)*u?", roles + role):
                continue
            heapq.heappush(heap, (cost + more, audit + letter, to, roles + role))
    raise AssertionError


def exact(rows):
    """The same by dynamic programming over strings, forwards: ties are kept whole, so nothing hangs on an order of visits."""
    states = {"": (0, "")}

    def inserts(now):
        for _ in range(4):
            for roles, (cost, audit) in list(now.items()):
                for r in "ua":
                    to = step(roles, r)
                    if to is not None:
                        now[to] = min(now.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return now

    def step(roles, r):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((roles, r))

    for initial, fault in rows:
        following = {}
        for roles, (cost, audit) in inserts(states).items():
            tried = [(roles, cost + 3, audit + "D")]
            if fault in (repair.FINE, repair.TRUNCATED):
                cut = fault == repair.TRUNCATED
                tried += [(step(roles, initial), cost + cut, audit + "K")] + [(step(roles, r), cost + 2 + cut, audit + "R") for r in "ua"]
            for to, c, a in tried:
                if to is not None:
                    following[to] = min(following.get(to, (10**9, "")), (c, a))
        states = following
    states = inserts(states)
    return min(states[s] for s in ("", "a") if s in states)


def test_automaton_equals_all_edits():
    rng = random.Random(5)
    dawg = repair.Dawg()
    words = sorted(bytes(rng.choice((0, 0, 4, 4, 8, 8, 12)) + rng.choice((0, 0, 1, 2, 3)) for _ in range(rng.randrange(9))) for _ in range(3000))
    for w in words:
        dawg.root(w)
        rows = [(repair.INITIALS[x // 4], x % 4) for x in reversed(w)]
        got = dawg.answer()
        assert got == exact(rows)
        assert got[0] == cheapest(rows)[0]
    assert dawg.made == len({w[:i] for w in words for i in range(1, len(w) + 1)})  # each suffix is a node once
    assert repair.settled.cache_info().currsize < 3000  # and classes are few, however many nodes there are


def test_long_signature():
    dawg = repair.Dawg()
    dawg.root(bytes([8, 4] * 150_000))
    assert dawg.answer() == (0, "K" * 300_000)


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = con.execute(queries.OP11_SQL)
    names = [x[0] for x in want.description]
    got = queries.op11_conversation_repair(spark, folder).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def plain(rows):
    """The whole report of (conv_id, turn, role, text) rows, row by row."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        by.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(k, 1))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(repair.BLANK if not solid else repair.DUPLICATE if (role, text) in seen else repair.FINE if solid[-1] in ".!?" else repair.TRUNCATED)
            seen.add((role, text))
        cost, audit = exact([(r[1][:1] if r[1][:1] in "sua" and r[1] else "x", f) for r, f in zip(own, faults)])
        lines, at, roles = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            lines.append(f"{role}:{text}")
        assert GRAMMAR.fullmatch(roles)
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(repair.BLANK), faults.count(repair.DUPLICATE), faults.count(repair.TRUNCATED), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_awkward_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "One. ", "Two!", "three", " ", "É?", "x" * 200_000, "Same.", "a\x00b."]
    roles = [None, "", "user", "assistant", "system", "User", "tool", "ua"]
    rows = [(rng.choice([None, 1, 2, 3, -4]), rng.choice([None, 0, 1, 2, 5, 9, -3]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(50, t, "user", "Same.") for t in range(60)] + [(51, None, "user", None)] + [(52, t, "assistant" if t % 2 else "user", f"Turn {t}.") for t in range(700)]
    rows += [rows[0]] * 5 + [(60 + c, 0, "user", "Hi.") for c in range(40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(7)
    got = report(repair.reported(df))
    assert got == plain(rows)
    assert any(g[6] == "" and g[7] == hashlib.sha256().hexdigest() for g in got.values())  # a conversation of which nothing is left
    assert repair.reported(df.where("false")).count() == 0
    named = df.where("conv_id = 52").selectExpr("'k' || conv_id conv_id", "turn", "role", "text")
    assert repair.reported(named).count() == 1


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "user", "So?", 1), (1, 2, "assistant", "", 1), (1, 3, "assistant", "Yes", 1)], "conv_id long, turn long, role string, text string, copies int")
    planned = repair.plans(rows).cache()
    assert planned.select("cost", "audit").collect() == [(6, "KIKDK")]
    out = repair.repaired(rows, planned).collect()
    assert [(r["place"], r["edit"], r["role"], r["text"]) for r in out] == [(0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "So?"), (None, "D", "assistant", ""), (3, "K", "assistant", "Yes")]
