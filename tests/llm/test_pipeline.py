"""Each stage of the pipeline, and its run, against brute force over the whole small documents table."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from tests.conftest import SF001
from tests.llm import brute
from tokenizers import Tokenizer

from reelgrid.llm import queries

STAGES = dict(corpus_pipeline.STAGES)


def pieces(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in rows]
    return Counter((d, k, a, len(x[a : a + 4096]), brute.crc(x[a : a + 4096])) for d, x in ids for k, a in enumerate(range(0, len(x), 4096)))


def of(rows):
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


@pytest.fixture(scope="module")
def staged(spark):
    """The rows of documents, and what each stage but the last makes of its predecessor's."""
    at = spark.read.parquet(f"{SF001}/documents.parquet")
    out = [at.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, at, SF001)
        assert df.columns == at.columns
        at = spark.createDataFrame(df.collect(), df.schema)
        out.append(at.collect())
    return out


def test_quality_rules(staged):
    docs, kept = staged[:2]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    good = {d for d, k in c.sql(f"SELECT doc_id, kept FROM ({queries.OP10_SQL})").fetchall() if k}
    assert Counter(kept) == Counter(r for r in docs if r["doc_id"] in good)


def test_near_duplicates(staged):
    docs, kept = staged[1:3]
    least = set(brute.near_copies([(r["doc_id"], r["text"]) for r in docs]))
    assert Counter(kept) == Counter(r for r in docs if r["doc_id"] in least)


def test_repeated_passages(staged):
    docs, kept = staged[2:4]
    want = brute.without_repeats([(r["doc_id"], r["text"]) for r in docs])
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in docs)
    whole = {r["doc_id"]: r for r in docs}
    for r in kept:
        _, removed, text = want[r["doc_id"]]
        assert r["text"] == (text if removed else whole[r["doc_id"]]["text"])
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (whole[r["doc_id"]]["lang"], whole[r["doc_id"]]["source"])


def test_source_mix(staged):
    docs, mix = staged[3:5]
    whole = {r["doc_id"]: r for r in docs}
    size_of = brute.sources((r["source"], r["text"]) for r in docs)
    target = brute.mix_targets(size_of)
    words, of_doc = defaultdict(int), defaultdict(int)
    for r in mix:
        own = whole[r["doc_id"]]
        assert (r["lang"], r["source"]) == (own["lang"], own["source"]) and r["n_chars"] == len(r["text"])
        assert r["text"] in own["text"]
        n = len(brute.words(r["text"]))
        words[r["source"]] += n
        of_doc[r["doc_id"]] += n
    # all passes but a source's last take a document whole
    cut = Counter(r["source"] for r in mix if r["text"] != whole[r["doc_id"]]["text"])
    assert all(n <= 1 for n in cut.values())
    assert all(n <= 2 * len(brute.words(whole[d]["text"])) for d, n in of_doc.items())
    assert all(abs(words[s] - t) <= 0.02 * t + 3 for s, t in target.items())


def test_packed_sequences(spark, staged):
    docs = staged[4]
    out = STAGES["packed_sequences"](spark, spark.createDataFrame(docs), SF001).collect()
    assert of(out) == pieces(docs)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_run(spark, staged):
    assert of(corpus_pipeline.run(spark, SF001).collect()) == pieces(staged[4])
