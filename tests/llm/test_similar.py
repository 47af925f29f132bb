"""The pipeline's near duplicates against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
import pytest
from tests.conftest import SF001
from tests.llm import brute

from reelgrid.llm import similar, simhash


kept = brute.near_copies


def test_stage_on_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, SF001)
    assert sorted(r["doc_id"] for r in out.collect()) == kept([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize(("crowd", "split", "block"), [(2, 1024, 512), (256, 1024, 512), (2, 6, 3), (3, 0, 512)])
def test_stage_on_planted_copies(spark, crowd, split, block):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one  TWO"), (4, "one three")]
    for k in range(12):
        base = [word() for _ in range(rng.randrange(20, 200))] + (passage if k % 2 else [])
        for c in range(10):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 25 + 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 * k + c + 10, " ".join(copy + [word() for _ in range(rng.randrange(4))])))
    rows += [(5000 + i, " ".join(passage + [word() for _ in range(i % 12)])) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = similar.one_each(df, crowd, split, block)
    assert out.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in out.collect()) == kept(rows)
    assert similar.one_each(df.where("false")).count() == 0


def test_no_group_holds_a_hot_shingle(spark):
    """A shingle in a third of all texts is dealt in parts of a size near the square root of its members."""
    counts = similar.np.ones(similar.BUCKETS, similar.np.uint32)
    counts[7] = 3_000_000_000
    parts = similar._parts(counts, 16, 1024)
    assert parts[7] == 13694 and parts.sum() == parts[7]


def test_blocks_find_each_pair_once(spark):
    """Second round: every pair of different components that shares a shingle, once, whatever the size of a block."""
    rng = random.Random(9)
    members = [(k, 10, node, 0) for k in range(3) for node in rng.sample(range(60), 40)]
    roots = [(node, node % 7 if node % 3 else 0) for node in range(50)]
    root = dict(roots)
    want = set()
    for k in range(3):
        own = sorted(m[2] for m in members if m[0] == k)
        want |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if root.get(a, a) != root.get(b, b)}
    for block in (4, 512):
        got = similar._apart(spark.createDataFrame(members, "key long, n long, u long, pos long"), spark.createDataFrame(roots, "node long, root long"), block)
        assert {tuple(sorted((r["u"], r["v"]))) for r in got.collect()} == want


def groups(pairs):
    """Each node's group of those that pairs connect."""
    of = {}
    for u, v in pairs:
        both = of.setdefault(u, {u}) | of.setdefault(v, {v})
        of |= dict.fromkeys(both, both)
    return {frozenset(g) for g in of.values()}


def test_first_links_are_by_fingerprints(spark):
    """SimHash over the sets of shingles: _near joins just what all pairs of fingerprints within 4 bits join, copies of a fingerprint too."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(30):
        base = rng.choices(words, k=300)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(300)] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    similar.ready(spark)
    prints = {r["node"]: r["fp"] for r in similar._prints(docs)[0].collect()}
    sets = {similar._node(s): s for s in map(similar.shingles, texts)}
    for node, fp in prints.items():
        bits = [sum(int(h) >> b & 1 for h in sets[node]) * 2 > len(sets[node]) for b in range(64)]
        assert fp % 2**64 == sum(x << b for b, x in enumerate(bits))
    # two sets of one fingerprint, and one bit from a third
    prints |= {-1: 77, -2: 77, -3: 76, -4: -(2**63)}
    nodes = spark.createDataFrame(list(prints.items()), "node long, fp long")
    got = [(r["u"], r["v"]) for r in similar._near(nodes).collect()]
    everyone = sorted(prints)
    want = [(a, b) for i, a in enumerate(everyone) for b in everyone[i + 1 :] if (prints[a] % 2**64 ^ prints[b] % 2**64).bit_count() <= simhash.RADIUS]
    assert len(want) > 30 and groups(got) == groups(want)


def test_stage_links_by_simhash_first_and_checks_exactly(spark, monkeypatch):
    """What SimHash links goes through the exact check, and the exact join compares only what is not linked by then."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base[: 100 * k - 100], f"x{k}", *base[100 * k - 99 :]])) for k in range(1, 5)]
    rows += [(9, " ".join(f"w{rng.randrange(5000)}" for _ in range(200)))]
    compared, own = [], similar._checked
    monkeypatch.setattr(similar, "_checked", lambda sets, pairs: compared.append([(r["u"], r["v"]) for r in pairs.collect()]) or own(sets, pairs))
    node = {d: similar._node(similar.shingles(t)) for d, t in rows}
    # SimHash is made to name a pair of different texts too
    false = tuple(sorted((node[0], node[9])))
    near = similar._near
    monkeypatch.setattr(similar, "_near", lambda nodes: similar._distinct(near(nodes).unionByName(spark.createDataFrame([false], "u long, v long"))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.one_each(df).collect()) == kept(rows) == [0, 9]
    first, rest = compared[:2]
    assert false in first and len(first) > 1
    linked = [g for g in groups(p for p in first if p != false)]
    assert not any({u, v} <= g for u, v in rest for g in linked)
