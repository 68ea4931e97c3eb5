"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a measure of the text and a cutoff above which a text is rejected; its cutoffs, from the
mildest to the strictest, are levels. A part of the labels proposes for each stratum and rule the level
that rejects most bad texts while false rejections stay rare. The rest of the labels decides by how many
levels all proposals have to be taken back: what is rejected then contains what a larger step back
rejects, so steps are tested from the largest on, and a step holds if the exact binomial probability of
so few false rejections by all rules together, at the tolerated rate, stays below the error level divided
by the number of strata (Bonferroni). The first that does not hold ends the sequence, so steps need no
correction among themselves. Strata with too few good texts to certify anything are treated as one;
where no step holds, nothing is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
#: Rule to (measure of the counts, candidate cutoffs).
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)),
    "shouts": ("n_shouts / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)),
    "duplicate_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.05, 0.08, 0.11, 0.14, 0.16, 0.18, 0.19)),
    "few_words": ("1 - n_distinct / n_words", (0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9)),
    "long_words": ("word_chars / n_words", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0)),
}
CUTOFFS = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_shouts")
#: Terms of the binomial tail that are added one by one; a bound stands in for the rest.
TERMS = 2000


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Hashes tell in linear time whether any window can repeat; only then are the windows themselves
    sorted, equal neighbours found, and the union of their places measured.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(places, j + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def exact(hashes: Column) -> Column:
        windows = F.array_sort(
            F.transform(
                hashes, lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(words, i + 1, width), " ").alias("g"), i.alias("i"))
            )
        )

        def same(sorted_: Column, s: Column, j: Column) -> Column:
            return F.coalesce(F.get(sorted_, j)["g"] == s["g"], F.lit(False))

        def places(sorted_: Column) -> Column:
            marked = F.transform(sorted_, lambda s, j: F.when((j > 0) & same(sorted_, s, j - 1) | same(sorted_, s, j + 1), s["i"]))
            return F.array_sort(F.array_compact(marked))

        return _bind(_bind(windows, places), covered)

    repeats = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= width, repeats).otherwise(F.lit(0))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``COUNTS`` (long); a null text has no words.

    Columns of ``docs`` with these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.struct(
        F.array_remove(F.split(whole, SPACE), "").alias("w"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORDY)).alias("l"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).alias("s"),
        F.regexp_count(whole, F.lit("!")).alias("e"),
    )

    def counts(f: Column) -> Column:
        return F.struct(
            F.size(f["w"]).alias("n_words"),
            F.length(F.array_join(f["w"], "")).alias("word_chars"),
            f["s"].alias("n_symbols"),
            (F.size(f["l"]) - F.size(F.array_distinct(f["l"]))).alias("n_dup_lines"),
            repeated_words(f["w"]).alias("n_repeat_words"),
            F.size(f["l"]).alias("n_lines"),
            F.size(F.array_distinct(f["w"])).alias("n_distinct"),
            f["e"].alias("n_shouts"),
        )

    kept = [c for c in docs.columns if c not in (*COUNTS, "__counts")]
    made = docs.select(*kept, _bind(found, counts).alias("__counts"))
    return made.select(*kept, *[F.col(f"__counts.{name}").cast("bigint").alias(name) for name in COUNTS])


def base_failed() -> Column:
    """The fixed rules: under ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _measure(rule: str) -> Column:
    """A rule's measure; 0 where it isn't defined."""
    return F.coalesce(F.expr(RULES[rule][0].replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")), F.lit(0.0))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after seven steps up, right to about ten digits."""
    z = x + 7
    below = F.ln(x)
    for i in range(1, 7):
        below = below + F.ln(x + i)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - below


def at_most(k: Column, n: Column, rate: float) -> Column:
    """Probability of at most ``k`` of ``n`` at ``rate``, never too small; 1 where k >= n * rate."""
    k_, n_ = k.cast("double"), n.cast("double")
    top = F.exp(
        _log_gamma(n_ + 1) - _log_gamma(k_ + 1) - _log_gamma(n_ - k_ + 1) + k_ * math.log(rate) + (n_ - k_) * math.log1p(-rate)
    )
    ratio = lambda j: j * (1 - rate) / ((n_ - j + 1) * rate)  # noqa: E731  of the term below j to the one at j

    def add(a: Column, i: Column) -> Column:
        return F.struct((a["term"] * ratio(k_ - i)).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(TERMS)).cast("int")), start, add, lambda a: a["sum"] + a["term"] / (1 - ratio(k_)))
    return F.when(k_ >= n_ * rate, F.lit(1.0)).otherwise(F.least(top * tail, F.lit(1.0)))


@dataclass(frozen=True)
class Risk:
    """Tolerated false rejections per stratum by all rules, and the chance that any bound fails."""

    rate: float = 0.02
    error: float = 0.05


#: One label in so many proposes levels, the others certify them.
PROPOSING = 4


def exceeded() -> Column:
    """How many cutoffs of each rule a text's measures exceed: level t of a rule rejects CUTOFFS + 1 - t or more."""
    return F.array(*[sum((_measure(rule) > cut).cast("int") for cut in cuts) for rule, (_, cuts) in RULES.items()])


def fewest(strata: Column, risk: Risk) -> Column:
    """Good texts that a stratum needs, so that no false rejection at all certifies a step."""
    return F.ceil((math.log(risk.error) - F.ln(strata.cast("double"))) / math.log1p(-risk.rate))


def _levels_of(sums: str, risk: Risk) -> Column:
    """Per rule the mildest level that rejects most bad texts, of those with few false rejections; 0 for none."""
    few = lambda x: x["wrong"] <= F.col("good") * (risk.rate / len(RULES))
    best = F.array_max(F.transform(F.filter(sums, lambda x: few(x) & (x["right"] > 0)), lambda x: F.struct(x["right"].alias("r"), (-x["level"]).alias("l"))))
    return F.coalesce(-best["l"], F.lit(0))


def levels(counts: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """(stratum, pooled, levels, back, good, wrong, right) of each labelled stratum.

    ``levels`` are the proposed levels per rule, ``back`` the certified step, null for none; ``wrong``
    of ``good`` and ``right`` are the good and bad texts then rejected among the certifying labels of the
    stratum, or of all pooled ones. ``counts`` (from ``counted``, stored) are joined with the labels by
    id; all labelled texts that pass the fixed rules count. Labels other than 0 and 1 are ignored,
    repeated ones count each time. The bound corrects for every labelled stratum and the pool.
    """
    judged = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    known = counts.where(~base_failed()).select(F.col(key).alias("__doc"), F.col(stratum).alias("__stratum"), exceeded().alias("__over"))
    good, bad = F.col("__label") == 1, F.col("__label") == 0
    proposing = F.conv(F.substring(F.md5(F.col("__doc").cast("string")), 1, 8), 16, 10).cast("bigint") % PROPOSING == 0
    rows = known.join(judged, F.col("__doc") == F.col("__key")).withColumn("__proposes", proposing)
    sizes = rows.groupBy("__stratum").agg(F.sum((good & ~F.col("__proposes")).cast("bigint")).alias("__good"))
    strata = sizes.agg((F.count(F.lit(1)) + 1).alias("__strata"))
    marked = sizes.crossJoin(F.broadcast(strata)).withColumn("pooled", F.col("__good") < fewest(F.col("__strata"), risk))  # one row of one number
    group = F.when(~F.col("pooled"), F.struct(F.col("__stratum").alias("s"))).alias("__group")
    named = marked.select(F.col("__stratum").alias("__s"), "__strata", "pooled", group)
    grouped = rows.join(named, F.col("__stratum").eqNullSafe(F.col("__s"))).drop("__s")

    hits = [[F.col("__over")[r] >= CUTOFFS + 1 - t for t in range(1, CUTOFFS + 1)] for r in range(len(RULES))]
    per_rule = [
        F.array(*[F.struct(F.lit(t).alias("level"), F.sum((h & good).cast("bigint")).alias("wrong"), F.sum((h & bad).cast("bigint")).alias("right")) for t, h in enumerate(row, 1)]).alias(f"__r{r}")
        for r, row in enumerate(hits)
    ]
    sums = grouped.where("__proposes").groupBy("__group").agg(F.sum(good.cast("bigint")).alias("good"), *per_rule)
    proposed = sums.select(F.col("__group").alias("__g"), F.array(*[_levels_of(f"__r{r}", risk) for r in range(len(RULES))]).alias("levels"))

    tried = grouped.where("not __proposes").join(proposed, F.col("__group").eqNullSafe(F.col("__g")))
    steps = F.transform(F.arrays_zip("levels", "__over"), lambda x: F.when(x["levels"] > 0, x["levels"] + x["__over"] - CUTOFFS - 1).otherwise(-1))
    most = tried.withColumn("__most", F.array_max(steps))  # rejected by steps back up to this one
    found = [F.col("__most") >= s for s in range(CUTOFFS)]
    counted_ = most.groupBy("__g", "levels", "pooled", "__strata").agg(
        F.sum(good.cast("bigint")).alias("good"),
        F.array(*[F.struct(F.lit(s).alias("back"), F.sum((h & good).cast("bigint")).alias("wrong"), F.sum((h & bad).cast("bigint")).alias("right")) for s, h in enumerate(found)]).alias("__steps"),
    )
    tested = counted_.select("__g", "levels", "__strata", "good", F.explode("__steps").alias("t"))
    holds = at_most(F.col("t.wrong"), F.col("good"), risk.rate) <= risk.error / F.col("__strata")
    held = tested.withColumn("__ends", F.when(~holds, F.col("t.back"))).groupBy("__g", "levels", "good").agg(
        F.coalesce(F.max("__ends"), F.lit(-1)).alias("__end"), F.collect_list(F.struct("t.right", "t.back", "t.wrong")).alias("__steps")
    )
    best = F.array_max(F.filter("__steps", lambda x: (x["back"] > F.col("__end")) & (x["right"] > 0))).alias("__best")
    chosen = held.select("__g", "levels", "good", best)
    return named.join(chosen, F.col("__group").eqNullSafe(F.col("__g"))).select(
        F.col("__s").alias("__stratum"), "pooled", "levels", F.col("__best.back").alias("back"), "good", F.col("__best.wrong").alias("wrong"), F.col("__best.right").alias("right")
    )


def thresholds(counts: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """(stratum, one column per rule): the certified cutoffs, null where a rule rejects nothing."""
    chosen = levels(counts, labels, stratum, key, label, risk)
    columns = []
    for r, (rule, (_, cuts)) in enumerate(RULES.items()):
        level = F.col("levels")[r] - F.col("back")
        columns.append(F.when(level >= 1, F.get(F.array(*map(F.lit, cuts)), F.lit(CUTOFFS) - level)).alias(rule))
    return chosen.select("__stratum", *columns)


def verdicts(counts: DataFrame, cutoffs: DataFrame, stratum: str, name: str = "kept") -> DataFrame:
    """``counts`` with the verdict: false if the fixed rules or a certified cutoff reject the text.

    Whether the cutoffs, one row per stratum, are broadcast is left to Spark's size check.
    """
    chosen = cutoffs.select(F.col("__stratum"), *[F.col(rule).alias(f"__{rule}") for rule in RULES])
    joined = counts.join(chosen, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_measure(rule) > F.col(f"__{rule}"), F.lit(False))
    return joined.withColumn(name, ~base_failed() & ~over).drop("__stratum", *[f"__{rule}" for rule in RULES])
