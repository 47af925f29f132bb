"""Quality rules with thresholds that the corpus sets itself, from mergeable quantile sketches per language and source.

Statistics of each text are DataFrame functions, next to the text: no rows are exploded and none move. Quantiles come from
approx_percentile, whose sketches are built in each task and merged, so a source with a third of all rows costs no more
than another. A document is rejected if a statistic lies outside [q1 - width * iqr, q3 + width * iqr] of its (language,
source), without any constant beside these quartiles; groups with fewer than least documents take the thresholds of the
language, or else of the corpus. Most texts have no symbol, repeated line or repeated window at all: for the quartiles (not
for the judged document) each text is given one more, so that the spread is that of the lengths of such texts and a share
is out of bounds where it cannot be one chance event in a text that is short for its group.
Fixed base rules come first: too few words, or too much of the text in repeated windows.

Null texts are empty; they have no words and fail the base rules. Null languages and sources are groups of their own. Rows
that share a doc_id are judged each for itself. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lookup, saved

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Statistic: (count, of what, what a threshold adds to both, has a lower threshold, has an upper one).
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 1, False, True),
    "mean_word": ("word_chars", "n_words", 0, True, True),
    "dup_line_share": ("n_dup_lines", "n_lines", 1, False, True),
    "repeat_share": ("n_repeat_words", "n_words", WINDOW, False, True),
}


def _removed(text: Column, characters: str) -> Column:
    """How many of text's characters are among these."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Write the result before filtering on it: a filter is pushed below the arrays that it is counted from, which then are
    made anew for each of their elements.
    """
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    words = F.filter(F.split(F.translate("_t", SPACE, " " * len(SPACE)), " ", -1), lambda w: w != "")
    df = df.select(
        *keep,
        (F.length("_t") - _removed(F.col("_t"), SPACE)).cast("long").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_h"),
    )
    df = df.select(
        *keep, "word_chars", "n_symbols", "_h", F.size("_h").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    # a window's hash by doubling: of two words, of two such pairs, of two such quadruples
    size = 1
    while size < WINDOW:
        h = F.col("_h")
        df = df.withColumn("_h", F.transform(F.slice(h, 1, F.greatest(F.size(h) - size, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + size))))  # noqa: B023
        size *= 2
    # only texts with a repeated window sort theirs, to find which they are
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("_h")
    s = F.col("_s")
    again = F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull())
    df = df.withColumn("_p", F.sort_array(again)).drop("_s")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def base_failed(least_words: int = 20, most_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def metrics(prior: bool = False) -> dict[str, Column]:
    """The statistics that have thresholds. With prior, as a threshold sees them: one more symbol, repeated line or repeated
    window is counted in every text, so that texts without any still show how much a text of their length can tell."""

    def share(a: str, b: str, more: int) -> Column:
        one = F.lit(more if prior else 0).cast("long")
        return (F.col(a) + one) / F.greatest(F.col(b) + one, F.lit(1).cast("long"))

    return {m: share(a, b, more) for m, (a, b, more, _, _) in METRICS.items()}


def thresholds(stats: DataFrame, width: float = 5.0, least: int = 30, accuracy: int = 10_000) -> DataFrame:
    """Per (lang, source) of the written table stats: low_* and high_* of each metric. Documents that fail the base rules set no thresholds."""
    values = stats.where(~base_failed()).select("lang", "source", *[c.alias(m) for m, c in metrics(prior=True).items()])
    sketch = [F.percentile_approx(m, [0.25, 0.75], accuracy).alias(m) for m in METRICS]
    # one aggregation for groups, languages and the corpus: each task's sketches are merged at all three levels
    sets = [[F.col("lang"), F.col("source")], [F.col("lang")], []]
    merged = values.groupingSets(sets, F.col("lang"), F.col("source")).agg(F.grouping_id("lang", "source").alias("_level"), F.count("*").alias("n"), *sketch)
    merged = saved(merged, "sketches")  # a row a group
    groups = merged.where("_level = 0").drop("_level")
    languages = merged.where("_level = 1").select("lang", F.col("n").alias("_ln"), *[F.col(m).alias(f"_l_{m}") for m in METRICS])
    corpus = merged.where("_level = 3").select(*METRICS).first() or dict.fromkeys(METRICS)  # one row, none if nothing passes
    every = stats.select("lang", "source").distinct()
    found = lookup(every, groups, ["lang", "source"])
    found = lookup(found, languages, ["lang"])
    out = []
    for m, (_, _, _, low, high) in METRICS.items():
        q = F.when(F.col("n") >= least, F.col(m)).when(F.col("_ln") >= least, F.col(f"_l_{m}")).otherwise(F.lit(corpus[m]).cast("array<double>"))
        reach = (F.get(q, F.lit(1)) - F.get(q, F.lit(0))) * width
        if low:
            out.append((F.get(q, F.lit(0)) - reach).alias(f"low_{m}"))
        if high:
            out.append((F.get(q, F.lit(1)) + reach).alias(f"high_{m}"))
    return found.select("lang", "source", *out)


def judged(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns keep with the statistics, base_failed and kept. lang and source are among keep or added for the while."""
    own = list(dict.fromkeys([*keep, "lang", "source"]))
    stats = saved(statistics(docs, own), "quality")
    limits = saved(thresholds(stats, **options), "thresholds")
    found = lookup(stats, limits, ["lang", "source"]).withColumn("base_failed", base_failed())
    good = F.lit(True)
    for m, column in metrics().items():
        _, _, _, low, high = METRICS[m]
        if low:
            good = good & F.coalesce(column >= F.col(f"low_{m}"), F.lit(True))
        if high:
            good = good & F.coalesce(column <= F.col(f"high_{m}"), F.lit(True))
    found = found.withColumn("kept", ~F.col("base_failed") & good)
    return found.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "lang", "source", "text")
    return judged(own, ["_doc"], **options).where("kept").select("_doc.*")
