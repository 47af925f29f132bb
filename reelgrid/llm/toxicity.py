"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of a lexicon (its words as they stand, and disguised by digits, masks, separators, stretched or spaced
letters), how near lexicon words are to a second person, capitals, punctuation and obfuscation rates. The lexicon is a given
list and what the labelled texts add to it: words that nearly only toxic texts have, copies of a text counted once. Words
are counted by Spark over the texts of a bounded sample of the labelled rows; at most learned words come back. Trees are grown on two thirds of that sample and calibrated on the rest, which they have not seen.

The sample is of at most sample labelled rows, those of least hash of their doc_id. If the rows to learn from have one class
or none, every score is a constant, the smoothed share of label 1; if the third for calibration has, the trees' own
probabilities stand. Null texts are empty and are scored like any other. Null labels are left out; a doc_id with several
labels trains once for each. Rows that share a doc_id are scored each for itself. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, runs_of, saved

FEATURES = (
    "lexicon_density", "lexicon_hits", "lexicon_words", "lexicon_weight", "disguised_density", "near_you_density", "you_density", "near_you_share", "upper_share", "capital_words", "bang_rate", "question_rate", "mark_run_rate", "obfuscated_rate",
    "stretched_rate", "mark_share", "log_words",
)
#: The words that the lexicon starts from.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool imbecile cretin loser losers clown clowns pathetic worthless disgusting scum trash garbage filth filthy vermin parasite pig swine rat bastard bitch bitches whore slut "
    "asshole arsehole jerk creep freak retard retarded fuck fucking fucker shit shitty bullshit crap damn cunt dick prick twat wanker scumbag dirtbag douchebag hate die kill ugly coward liar disgrace braindead subhuman "
    "idioten dumm dummkopf arschloch scheisse schlampe abschaum versager idiota imbecil estupido estupida basura mierda puta cabron pendejo asco idiote imbecile connard connasse salope merde ordure debile minable"
).split()
YOU = frozenset("you your yours yourself u ur youre you're you've you'll du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
NEAR = 5
_LEET = str.maketrans("013457@$!|", "oieastasil")
_MARKS = "!?.,;:\"'()[]{}<>-_*#%&|$@/\\~^+=`"
_MARK_CODES = list(_MARKS.encode())
_INSIDE = re.compile(r"[a-z][0-9@$*#!|]+[a-z]")
_STRETCH = re.compile(r"([a-z])\1{2,}")
_RUN = re.compile(r"[!?]{2,}")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]{3,}")


class Lexicon:
    """Words and weights, and the features of a text against them."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        #: forms with an inner run of letters masked, for words of four letters or more
        self.masked = {w[:i] + "*" * (j - i) + w[j:]: x for w, x in weights.items() if len(w) >= 4 for i in range(1, len(w)) for j in range(i + 1, len(w) + 1)}

    def disguised(self, word: str) -> float:
        """The weight of a lower-case word that is not in the lexicon as it stands: masked, with digits or marks for letters, separated or stretched."""
        if "*" in word or "#" in word:
            x = self.masked.get(word.strip(_MARKS.replace("*", "").replace("#", "")).replace("#", "*"), 0.0)
            if x:
                return x
        inner = re.sub(r"[\W_]", "", word.translate(_LEET))
        for form in (inner, _STRETCH.sub(r"\1", inner), _STRETCH.sub(r"\1\1", inner)):
            if len(form) >= 4 and form in self.weights:
                return self.weights[form]
        return 0.0

    def measure(self, text: str | None) -> list[float]:
        """The features of one text, in the order of FEATURES."""
        text = text or ""
        low = text.lower()
        for space in "\t\n\x0b\x0c\r":
            low = low.replace(space, " ")
        tokens = low.split(" ")
        count, weights = Counter(tokens), self.weights
        n_words = max(1, len(tokens) - count.pop("", 0))
        bad: dict[str, tuple[float, bool]] = {}
        persons, you, single = set(), 0, 0
        for t, k in count.items():
            bare = t.strip(_MARKS)
            if bare in weights:
                bad[t] = weights[bare], False
            elif bare in YOU:
                persons.add(t)
                you += k
            elif not bare.isalpha() and len(bare) > 3 and (w := self.disguised(t)):
                bad[t] = w, True
            if len(t) == 1:
                single += k
        # by far most texts have no stretched word: only then are words looked at one by one
        stretched = {t: k for t, k in count.items() if _STRETCH.search(t)} if _STRETCH.search(low) else {}
        for t in stretched.keys() - bad.keys():
            if w := self.disguised(t):
                bad[t] = w, True
        hits, weight = sum(count[t] for t in bad), sum(count[t] * w for t, (w, _) in bad.items())
        hidden = sum(count[t] for t, (_, h) in bad.items() if h)
        if single >= 4:
            spaced = [w for run in re.findall(r"(?:(?<= )|^)(?:\w ){3,}\w(?= |$)", low) if (w := weights.get(run.replace(" ", "")))]
            hits, weight, hidden = hits + len(spaced), weight + sum(spaced), hidden + len(spaced)
        near = _near(tokens, bad, persons) if bad and persons else 0
        # bytes by kind; letters beyond ASCII count as neither capitals nor marks
        kinds = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
        solid, marks, upper = max(1, len(low) - low.count(" ")), int(kinds[_MARK_CODES].sum()), int(kinds[65:91].sum())
        return [
            hits / n_words, math.log1p(hits), math.log1p(len(bad)), weight / n_words, hidden / n_words, near / n_words, you / n_words, near / max(1, hits), upper / solid, len(_CAPITALS.findall(text)) / n_words,
            int(kinds[33]) / n_words, int(kinds[63]) / n_words, len(_RUN.findall(low)) / n_words, len(_INSIDE.findall(low)) / n_words, sum(stretched.values()) / n_words, marks / solid, math.log1p(n_words),
        ]


def _near(tokens: list[str], bad: dict, persons: set[str]) -> int:
    """Lexicon words with a second person at most NEAR words before or after."""
    near, waiting, last, place = 0, [], -NEAR - 1, 0
    for t in tokens:
        if not t:
            continue
        place += 1
        if t in persons:
            near, waiting, last = near + sum(place - b <= NEAR for b in waiting), [], place
        elif t in bad:
            if place - last <= NEAR:
                near += 1
            else:
                waiting = [*(b for b in waiting if place - b <= NEAR), place]
    return near


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _origin() -> Column:
    """A hash that copies of a text mostly share: the least of its sentences'."""
    return F.array_min(F.transform(F.split(F.lower("text"), r"[.!?\n]+"), lambda x: F.xxhash64(F.trim(x))))


def learned_words(labelled: DataFrame, learned: int = 2000, least: int = 4, purity: float = 0.85) -> dict[str, float]:
    """Words of labelled (y, text) that nearly only toxic texts have, with their log odds. A word counts once for a text and all its copies."""
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " "), " "))
    # the arrays come first, in a projection of their own: beside explode() they would be made anew for each word
    each = labelled.select("y", _origin().alias("origin"), words.alias("words")).select("y", "origin", F.explode("words").alias("word")).where(F.length("word") >= 4).distinct()
    found = each.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("n")).where((F.col("p") >= least) & (F.col("p") >= purity * F.col("n")))
    return {r["word"]: math.log((r["p"] + 0.5) / (r["n"] - r["p"] + 0.5)) for r in found.orderBy(F.desc("p"), "n", "word").limit(learned).collect()}


def measured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and the features."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon)
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in runs_of(texts):
                x = list(zip(*[words.measure(t) for t in texts[a:z]], strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *[pa.array(c, pa.float64()) for c in x]], names=["doc_id", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def _two_classes(rows: DataFrame) -> tuple[bool, int, int]:
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return 0 < ones < n, n, ones


class Model:
    """Trees and their calibration, or a constant."""

    def __init__(self, share: float, trees=None, calibration=None):
        self.share, self.trees, self.calibration = share, trees, calibration

    @classmethod
    def fit(cls, rows: DataFrame, rounds: int = 20, depth: int = 3, step: float = 0.2, seed: int = 11) -> Model:
        """rows: doc_id, the features and y (0 or 1), a written table of bounded size."""
        both, n, ones = _two_classes(rows)
        model = cls((ones + 1) / (n + 2))
        kept = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(3)) == 0
        grown = rows.where(~kept)
        if not both or not _two_classes(grown)[0]:
            return model
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(grown).select("x", F.col("y").cast("double").alias("y"))
        model.trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=5, subsamplingRate=0.8, seed=seed).fit(data)
        rest = rows.where(kept)
        if _two_classes(rest)[0]:
            model.calibration = IsotonicRegression(featuresCol="_own", labelCol="y").fit(model._own(rest).select("_own", F.col("y").cast("double").alias("y")))
        return model

    def _own(self, rows: DataFrame) -> DataFrame:
        data = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows).withColumnRenamed("_x", "x"))
        return data.withColumn("_own", vector_to_array("probability")[1])

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with score."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.share))
        own = self._own(rows)
        return own.withColumn("score", F.col("_own")) if self.calibration is None else self.calibration.setPredictionCol("score").transform(own)


def scored(docs: DataFrame, labels: DataFrame, sample: int = 20_000, lexicon: tuple[str, ...] | list[str] = tuple(LEXICON), **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out rows are not read."""
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).where(~held_out(F.col("_id")))
    some = saved(known.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample).coalesce(1), "labels")
    # at most sample rows
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    weights = {w: 1.0 for w in lexicon} | learned_words(texts.select("y", "text"))
    features = saved(measured(docs, weights), "features")
    rows = saved(features.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).drop("_id").coalesce(1), "labelled")
    out = Model.fit(rows, **options).scored(features).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
