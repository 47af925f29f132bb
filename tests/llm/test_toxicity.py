"""Toxicity: held-out accuracy on the given tables, features of single texts, and awkward rows."""

import random
import zlib

from tests.conftest import SF01

from reelgrid.llm import queries, toxicity

LEX = toxicity.Lexicon({"idiot": 1.0, "scum": 2.0})


def feature(text, name):
    return dict(zip(toxicity.FEATURES, LEX.measure(text), strict=True))[name]


def test_disguises_are_seen_through():
    for word in ("1d10t", "id*ot", "i#iot", "i-d-i-o-t", "IDIOT!!", "idiooot", "iiidiot", "(idiot)", "sc*m,", "5cum"):
        assert feature(f"what {word} this", "lexicon_density") == 1 / 3, word
    assert feature("you i d i o t now", "lexicon_density") > 0
    for word in ("idiots", "idiotic", "video", "2024", "a*b", "***", "---", "x.y.z", "miss", "3.14159", "scoop"):
        assert feature(f"what {word} this", "lexicon_density") == 0, word
    assert feature("1d10t", "disguised_density") == 1 and feature("idiot", "disguised_density") == 0


def test_second_person_must_be_near():
    assert feature("you are an idiot", "near_you_share") == 1
    assert feature("idiot , so are you", "near_you_share") == 1
    assert feature("you " + "and " * 9 + "idiot", "near_you_share") == 0
    assert feature("idiot idiot you idiot", "near_you_share") == 1


def test_measures_are_finite_for_any_text():
    for text in (None, "", " \n ", "É" * 9, "!?" * 50, "a" * 300_000, "\x00 \ud800", "idiot " * 50_000):
        assert len(LEX.measure(text)) == len(toxicity.FEATURES) and all(0 <= v < 1e6 for v in LEX.measure(text))


def test_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = queries.op12_toxicity(spark, SF01).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert {r["doc_id"] for r in out} == docs and len(out) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) >= 0.93 * len(judged)


def test_awkward_rows(spark):
    rng = random.Random(1)
    words = "and the for with into over".split()
    text = lambda bad: " ".join(rng.choice(["zorgh", "flumpx"]) if bad and rng.random() < 0.2 else rng.choice(words) for _ in range(40))
    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", 1.0, 2) for i, t, _ in rows] + [(None, "x", None, 1.0, 2), (900, None, None, 1.0, 2), (901, "", None, 1.0, 2), (5, "again zorgh", None, 1.0, 2)], "doc_id long, text string, lang string, score double, toxic int")
    labels = spark.createDataFrame([(i, int(y), "a") for i, _, y in rows] + [(7, None, "b"), (None, 1, "c"), (9999, 1, "d")], "doc_id long, toxic int, text string")
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == 404
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] != 5]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)  # words that no list holds are learned
    assert toxicity.scored(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, labels.where("toxic = 0")).collect()} != {0.5}
    assert {r["score"] for r in toxicity.scored(docs, labels.where("false")).collect()} == {0.5}
