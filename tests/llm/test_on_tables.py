"""Each operator's query over a whole small table against its brute-force version."""

import os
import re
from collections import defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
from tests.conftest import SF01, SF001
from tests.llm import brute
from tokenizers import Tokenizer

from reelgrid.llm import queries, rule_ensemble

Q = queries.queries()
BIG = bool(os.environ.get("LLM_TESTS_BIG"))
DIR = SF01 if BIG else SF001


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def rows(spark, name):
    return Q[name](spark, DIR).collect()


def test_packing(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, "op1_best_fit_packing")
    ids = {d: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for d, r in docs.items()}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(
        (d, k, a, len(x[a : a + 4096]), brute.crc(x[a : a + 4096])) for d, x in ids.items() for k, a in enumerate(range(0, len(x), 4096))
    )
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(map(len, ids.values())) // 4096)
    assert len(by) <= least + 1


def test_token_files(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for d in sorted(docs):
        x = [*t.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(x), brute.crc(x)))
        at += len(x)
    got = rows(spark, "op3_token_files")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_mixing(spark, docs):
    got = rows(spark, "op4_source_mixing")
    again = rows(spark, "op4_source_mixing")
    assert sorted(map(str, got)) == sorted(map(str, again))
    size_of = brute.sources((r["source"], r["text"]) for r in docs.values())
    target = brute.mix_targets(size_of)
    taken = defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len(brute.words(docs[r["doc_id"]]["text"])) and r["source_size"] == size_of[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.02 * target[s]


def test_neighbours(spark):
    got = rows(spark, "op5_nearest_neighbours")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    ids, x = np.array(list(v)), np.array(list(v.values()))
    found = total = 0
    for q in sorted(i for i in v if i % 100 == 0):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        d = np.sqrt(((x - v[q]) ** 2).sum(axis=1))
        assert all(s == pytest.approx(np.sqrt(((v[i] - v[q]) ** 2).sum()), rel=1e-12) and i != q for _, i, s in own)
        order = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        found, total = found + len({i for _, i, _ in own} & set(order)), total + 10
    assert found / total >= 0.9


def test_classifier(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op6_quality_classifier")}
    assert sorted(got) == sorted(docs)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[d]["predicted"] == y for d, y in labels)
    assert right / len(labels) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_substring(spark, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, "op7_substring_dedup")}
    want = brute.substring([(d, r["text"]) for d, r in docs.items()])
    assert {d for d in want if got[d] != want[d]} == set()
    assert sum(n for _, n, _ in want.values()) > 0


def test_html(spark):
    got = {r["page_id"]: r for r in rows(spark, "op8_html_extraction")}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        text = " ".join(" ".join(unescape(re.sub(r"<(?!/?(?:p|br|h1|div|ul|li)\b)[^>]*>", "", re.sub(r"<(script|style)\b.*?</\1>", "", inner[1], flags=re.S))).split()) .split()) if inner else ""
        text = " ".join(re.sub(r"<[^>]*>", " ", text).split())
        assert got[r["page_id"]]["text"] == text, r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len(text)


def test_simhash(spark, docs):
    got = rows(spark, "op9_simhash_near_dedup")
    fps = {d: brute.simhash(r["text"]) for d, r in docs.items()}
    root = brute.components(fps)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", root[d]) for d, f in fps.items())


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_quality_rules")}
    assert sorted(got) == sorted(docs)
    for d, r in docs.items():
        g = got[d]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute.quality(r["text"]), d
        assert not (g["base_failed"] and g["kept"])
    clean = [r["doc_id"] for r in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect() if not got[r["doc_id"]]["base_failed"]]
    assert sum(got[d]["kept"] for d in clean) >= 0.99 * len(clean)


def test_url_rules(spark):
    got = {r["page_id"]: r for r in rows(spark, "op2_url_filter")}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        rest = (r["url"] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = brute.lower(host)
        fits = [(len(p), p, v) for p, v in queries.URL_RULES for a, _, b in [p.partition("/")] if (host == a or host.endswith("." + a)) and path.startswith("/" + b)]
        g = got[r["page_id"]]
        assert (g["host"], g["path"]) == (host, path)
        assert g["rule"] == (max(fits)[1] if fits else None)
        assert g["verdict"] == max(fits)[2] if fits else g["verdict"] in ("allow", "block")


def test_rules_are_paths():
    debug = "Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n"
    assert rule_ensemble.paths(debug) == sorted([((3, "<=", 0.5),), ((1, "<=", 2.0), (3, "<=", 0.5)), ((1, ">", 2.0), (3, "<=", 0.5)), ((3, ">", 0.5),)])
