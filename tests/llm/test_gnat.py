"""Vector codes against SQL and plain NumPy, the tree against comparison with all entries, and awkward vectors."""

import hashlib

import duckdb
import numpy as np
import pytest
from tests.conftest import SF01, SF001

from reelgrid.llm import gnat, queries


def nearest(x, entries):
    d = ((x[:, None, :] - entries) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def plain(x, entries=256, rounds=4):
    """codes, errors and digest of whole-number rows in order of id."""
    cuts = [i * x.shape[1] // 4 for i in range(5)]
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    books = [p[:entries].copy() for p in parts]
    for _ in range(rounds):
        for p, b in zip(parts, books):
            own, _ = nearest(p, b)
            for e in np.unique(own):
                b[e] = p[own == e].sum(axis=0) // (own == e).sum()
    found = [nearest(p, b) for p, b in zip(parts, books)]
    codes = ["".join(f"{i[k]:02x}" for i, _ in found) for k in range(len(x))]
    return codes, sum(d for _, d in found), hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("fan", [2, 5, 16])
def test_tree_equals_all_entries(fan):
    rng = np.random.default_rng(fan)
    centres = rng.integers(-4000, 4000, (12, 6))
    clustered = centres[rng.integers(0, 12, 256)] + rng.integers(-30, 30, (256, 6))
    for entries in (clustered, rng.integers(-3, 3, (256, 6)), rng.integers(-9, 9, (3, 6)), np.zeros((40, 6), int), np.zeros((9, 0), int), rng.integers(-(1 << 27), 1 << 27, (100, 6))):
        tree = gnat.Gnat(entries, fan)
        x = np.concatenate([entries[rng.integers(0, len(entries), 300)] + rng.integers(-2, 3, (300, entries.shape[1])), entries])
        who, best = tree.find(x)
        want, d = nearest(x, entries)
        assert (who == want).all() and (best == d).all()  # ties go to the lower index
    tree = gnat.Gnat(clustered, fan)
    tree.find(clustered)
    assert tree.looked < len(clustered) ** 2 / 2  # whole subtrees are left out
    assert all(len(a) == 0 for a in tree.find(np.zeros((0, 6), int)))


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(queries.OP13_SQL)
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, queries.op13_vector_codes(spark, folder).select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize(("dim", "n"), [(8, 700), (10, 90), (3, 40)])
def test_awkward_vectors(spark, dim, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 0.02, (n, dim)), 3)
    x[n // 2 :: 3] = x[0]  # many copies
    rows = [(i, v.tolist(), i % 3 or None, "x", 0) for i, v in enumerate(x)]
    bad = [(n, None, 1, "x", 0), (n + 1, [None] + [1.0] * (dim - 1), 1, "x", 0), (n + 2, [float("nan")] * dim, 1, "x", 0), (n + 3, [float("inf")] * dim, 2, "x", 0), (n + 4, [1.0] * (dim + 1), 2, "x", 0), (n + 5, [], 2, "x", 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    out = {r["vec_id"]: r for r in gnat.coded(df).collect()}
    whole = np.floor(x * 1024).astype(np.int64)
    codes, errors, digest = plain(whole)
    assert sorted(out) == list(range(n))
    assert [out[i]["code"] for i in range(n)] == codes and [out[i]["error"] for i in range(n)] == errors.tolist()
    by = {}
    for i in range(n):
        by[i % 3 or None] = by.get(i % 3 or None, 0) + int(errors[i])
    assert all(r["label_error"] == by[r["label"]] and r["codebooks_sha256"] == digest for r in out.values())
    assert gnat.coded(df.where("false")).count() == 0


def test_repeated_ids_and_huge_components(spark):
    rows = [(7, [1e30, -1e30, 0.5, 0.25]), (7, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (7, [0.0, 0.0, 0.0, 0.0])]
    out = gnat.coded(spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<double>, label string")).collect()
    assert len(out) == 4 and all(r["error"] == 0 for r in out)
    assert sorted(r["code"] for r in out if r["vec_id"] == 7) == ["00000000", "00000000", "02020202"]
