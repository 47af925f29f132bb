"""URL filter: host and path rules first, and gradient-boosted trees on lexical features for the rest.

The longest rule that fits a URL decides it. The trees learn from all URLs that rules decide: their verdicts are the labels.
Features are of the URL's letters alone: lengths, depth, digit ratio, entropy, parameters, and statistics of the host's suffix
among the training URLs (its share of them and its smoothed log-odds of block).

The trees see a feature by its bin among at most BINS, cut at every value or, where there are more, at the quantiles of all
training URLs. MLlib looks for places to split in a sample of maxBins squared rows; maxBins is set so that this is all of them
(up to 2.1 billion; beyond, whether one of the bins occurs at all is judged on so many).

If the training URLs have one verdict, every other URL gets it; with none, URLs are allowed. A null url, or one without
"://", has an empty host and path and is judged by the trees. Rows that share a page_id are judged each for itself. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from math import inf, isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, saved
from .html_text import host_and_path

LEXICAL = ("url_len", "host_len", "path_len", "depth", "digits", "entropy", "params", "query_len", "hyphens", "labels", "longest", "vowels")
FEATURES = (*LEXICAL, "suffix_share", "suffix_odds")
BINS = 32


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) columns: those of the longest of the (rule, verdict) pairs that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits a character: log2(n) - sum(c * log2(c)) / n over the counts c of the text's distinct characters."""
    log2 = lambda x: F.when(x > 1, F.log2(x)).otherwise(0.0)
    n = F.length(text).cast("double")
    # over the sorted characters: the sum up to the last change, the last character, and how often it came so far
    start = F.struct(F.lit(0.0).alias("sum"), F.lit("").alias("last"), F.lit(0.0).alias("run"))
    same = lambda a, c: F.struct(a["sum"].alias("sum"), a["last"].alias("last"), (a["run"] + 1.0).alias("run"))
    other = lambda a, c: F.struct((a["sum"] + a["run"] * log2(a["run"])).alias("sum"), c.alias("last"), F.lit(1.0).alias("run"))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, lambda a, c: F.when(a["last"] == c, same(a, c)).otherwise(other(a, c)), lambda a: a["sum"] + a["run"] * log2(a["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def lexical() -> dict[str, Column]:
    """The features of LEXICAL over the columns url, host and path."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    share = lambda n, c: n / F.greatest(F.length(c), F.lit(1))
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    values = (
        F.length(url), F.length(host), F.length(path), count(path, "[^/]+"), share(count(url, "[0-9]"), url), entropy(url), count(query, "[^&]+"), F.length(query),
        count(url, "-"), count(host, r"\.") + 1, F.array_max(F.transform(F.split(host, r"\.", -1), F.length)), share(count(host, "[aeiou]"), host),
    )
    return {f: v.cast("double").alias(f) for f, v in zip(LEXICAL, values, strict=True)}


def features(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, suffix (the last label of the host) and the lexical features."""
    host, path = host_and_path(F.col("url").cast("string"))
    df = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    return df.select("*", *lexical().values(), F.substring_index("host", ".", -1).alias("suffix"))


def cuts(train: DataFrame) -> list[list[float]]:
    """For each of FEATURES the lower ends of its bins above the first, by the values of all rows to three decimals (which bounds how many an aggregate holds)."""
    values = [F.round(f, 3) for f in FEATURES]
    ranks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    # one more value than bins tells that there are too many
    few = F.struct(*[F.slice(F.sort_array(F.collect_set(v)), 1, BINS + 1).alias(f) for f, v in zip(FEATURES, values, strict=True)])
    found, quantiles = train.agg(few, F.struct(*[F.percentile(v, ranks).alias(f) for f, v in zip(FEATURES, values, strict=True)])).first()
    out = []
    for f in FEATURES:
        own = found[f] if len(found[f]) <= BINS else sorted({found[f][0], *quantiles[f]})
        # a feature of one value has nothing to cut, but its bins must be two
        out.append(own[1:] or own)
    return out


def bins_to_see_all(n: int) -> int:
    """The maxBins with which MLlib takes all of n rows to find splits; its square has to be a 32-bit integer."""
    return min(max(BINS, isqrt(n) + 1), isqrt(2**31 - 1))


def verdicts(pages: DataFrame, rules: list[tuple[str, str]], rounds: int = 10, depth: int = 3, seed: int = 5, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the trees' probability of block; null if there are no trees).

    learn: which of the URLs that rules decide may be learnt from; by default all.
    """
    rule, said = rule_column(rules, F.col("host"), F.col("path"))
    rows = saved(features(pages).withColumn("rule", rule).withColumn("said", said), "urls")
    train = rows.where(F.col("said").isNotNull() & (F.lit(True) if learn is None else learn)).withColumn("y", (F.col("said") == "block").cast("double"))
    n, blocked = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    out = ["page_id", "host", "path", "rule"]
    if blocked in (0.0, float(n)):
        rest = "block" if n and blocked else "allow"
        return rows.select(*out, F.coalesce("said", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    odds = F.log((F.sum("y") + 1) / (F.count("*") - F.sum("y") + 1))
    suffix = saved(train.groupBy("suffix").agg((F.count("*") / F.lit(float(n))).alias("suffix_share"), odds.alias("suffix_odds")), "suffixes")
    full = lambda df: lookup(df, suffix, ["suffix"]).fillna(0.0, ["suffix_share", "suffix_odds"])
    binned = [f"{f}_bin" for f in FEATURES]
    bucketizer = Bucketizer(inputCols=list(FEATURES), outputCols=binned, splitsArray=[[-inf, *c, inf] for c in cuts(full(train))])
    # bins are in order: by their metadata they would be categories
    number = {b: F.col(b).alias(b, metadata={"ml_attr": {"type": "numeric"}}) for b in binned}
    vectors = VectorAssembler(inputCols=binned, outputCol="x")
    seen = lambda df: vectors.transform(bucketizer.transform(full(df)).withColumns(number))
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, maxBins=bins_to_see_all(n), seed=seed, minInstancesPerNode=5)
    scored = trees.fit(seen(train).select("x", "y")).transform(seen(rows))
    score = F.get(vector_to_array("probability"), F.lit(1))
    block = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*out, F.coalesce("said", block).alias("verdict"), score.alias("block_score"))
