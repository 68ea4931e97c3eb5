"""Personal data by weak supervision, in DataFrame functions only.

Spans of four base kinds follow fixed patterns and always stay. Candidates of further kinds are judged
without labels: regular-expression, gazetteer and context labelers vote for, against or not at all;
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is and
how likely each pattern marks personal data; a naive Bayes span classifier is then trained on span
features with those likelihoods as soft labels, and decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import written

BASE = ("email", "ip", "card", "phone")
FURTHER = ("secret", "iban", "ssn", "mac")
LABELERS = ("shape", "gazetteer", "context", "mixture", "runs")
#: Patterns are the plain ones with possessive repeats and run starts, so that they match the same
#: spans in linear time and constant stack on very long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SHAPES = {
    "secret": r"^(?:[0-9a-f]{32,128}|[A-Za-z]{2,6}[_-][A-Za-z0-9]{16,}|[A-Z0-9]{20})$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z]{0,4}[0-9]{7,}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "mac": r"^(?!00:00:00:00:00:00)",
}
#: Words that announce a value, in the languages of the corpus.
GAZETTEER = (
    "token", "secret", "key", "password", "passwort", "passwd", "pwd", "api", "auth", "bearer", "credential",
    "contraseña", "clave", "ssn", "social security", "iban", "account", "konto", "compte", "cuenta", "mac", "address",
)


def _running(values: Column, largest: bool = False) -> Column:
    """Running sums (or maxima) of an array, in logarithmically many passes over it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(done: Column, k: Column) -> Column:
        def add(x: Column, i: Column) -> Column:
            far = i - F.pow(F.lit(2), k).cast("int")
            earlier = F.when(far >= 0, F.get(done, far)).otherwise(F.lit(0))
            return F.greatest(x, earlier) if largest else x + earlier

        return F.transform(done, add)

    return F.aggregate(rounds, values, step)


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; an array of one carries it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """All leftmost matches: start, end (code points, end exclusive), value, text before and after."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))

    def placed(b: Column) -> Column:
        sizes = F.zip_with(b["v"], F.slice(b["g"], 1, F.size(b["v"])), lambda v, g: F.length(v) + F.length(g))
        with_ends = F.zip_with(b["v"], _running(sizes), lambda v, e: F.struct(v.alias("v"), e.alias("e")))
        return F.transform(
            with_ends,
            lambda s, i: F.struct(
                (s["e"] - F.length(s["v"])).alias("start"),
                s["e"].alias("end"),
                s["v"].alias("value"),
                F.right(F.get(b["g"], i), F.lit(40)).alias("before"),
                F.left(F.get(b["g"], i + 1), F.lit(1)).alias("after"),
            ),
        )

    return _bind(both, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": digits.between(13, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": digits.between(9, 15),
    }[kind]


def _nothing(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


SPAN = "struct<kind:string,start:int,end:int>"


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by kind, then start; a null text has none. Failing matches are dropped."""
    text = F.coalesce(text, F.lit(""))
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9][.][0-9]"), "card": text.rlike("[0-9]"), "phone": text.rlike("[+][0-9]")}

    def of(kind: str) -> Column:
        valid = F.filter(_matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(may[kind], spans).otherwise(_nothing(SPAN))

    return F.concat(*[of(kind) for kind in BASE])


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, F.lit(1)).when(minus, F.lit(-1)).otherwise(F.lit(0))


def _judged(kind: str, m: Column) -> Column:
    """A candidate with its votes (one per labeler) and features."""
    value, before = m["value"], F.lower(m["before"])
    size, digits = F.length(value), F.length(_digits(value))
    words = "|".join(GAZETTEER)
    longest = value.rlike("[A-Za-z]{13}")
    votes = {
        "shape": _vote(value.rlike(SHAPES[kind]), digits == 0),
        "gazetteer": _vote(before.rlike(rf"(?:^|[^\p{{L}}])(?:{words})[^\p{{L}}]{{0,8}}$"), F.lit(False)),
        "context": _vote(before.rlike("[=:]\\s*[\"']?$"), before.rlike("\\p{L}[.,;]?\\s$")),
        "mixture": _vote((digits * 5 >= size) & (digits < size), digits * 20 < size),
        "runs": _vote(~value.rlike("[A-Za-z]{7}"), longest),
    }
    features = F.array(
        F.concat(F.lit("kind="), F.lit(kind)),
        F.concat(F.lit("size="), F.least(F.floor(F.log2(size)), F.lit(8)).cast("string")),
        F.concat(F.lit("digits="), F.floor(digits * 5 / size).cast("string")),
        F.concat(F.lit("upper="), value.rlike("[A-Z]").cast("string")),
        F.concat(F.lit("after="), F.when(m["after"] == "", F.lit("end")).when(m["after"].rlike("\\s"), F.lit("space")).otherwise(F.lit("other"))),
        F.concat(F.lit("before="), F.when(before == "", F.lit("start")).when(before.rlike("\\s$"), F.lit("space")).otherwise(F.lit("other"))),
        *[F.concat(F.lit(f"{name}="), votes[name].cast("string")) for name in LABELERS],
    )
    return F.struct(
        F.lit(kind).alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        *[votes[name].alias(name) for name in LABELERS],
        features.alias("features"),
    )


CANDIDATE = f"struct<kind:string,start:int,end:int,{','.join(f'{name}:int' for name in LABELERS)},features:array<string>>"


def candidates(text: Column, base: Column) -> Column:
    """Judged candidates of the further kinds that touch no base span, by kind, then start."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        free = F.filter(
            _matches(text, PATTERNS[kind]),
            lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
        )
        return F.transform(free, lambda m: _judged(kind, m))

    return F.when(text.rlike("[0-9]"), F.concat(*[of(kind) for kind in FURTHER])).otherwise(_nothing(CANDIDATE))


@dataclass(frozen=True)
class Model:
    """The trained span classifier: log-odds of the prior and of each feature."""

    prior: float = -1.0
    weights: dict[str, float] = field(default_factory=dict)
    #: (labeler, vote) to its likelihood (given personal data, given none), as estimated.
    reliability: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)


def _posterior(prior: float, reliability: dict[tuple[str, int], tuple[float, float]]) -> Column:
    """Likelihood that a row of votes marks personal data."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name in LABELERS:
        by_vote = {v: math.log(p / q) for (labeler, v), (p, q) in reliability.items() if labeler == name}
        odds = odds + F.when(F.col(name) == 1, by_vote[1]).when(F.col(name) == -1, by_vote[-1]).otherwise(by_vote[0])
    return 1 / (1 + F.exp(-odds))


def fit(docs: DataFrame, text: str = "text", rounds: int = 12) -> Model:
    """Reliabilities and classifier from the candidates of all documents.

    One pass over the texts leaves the votes and features of the candidates, counted by pattern before
    any shuffle, as a stored table; the rounds of expectation-maximisation and the training read that
    table only. With no candidates the model accepts none.
    """
    judged = docs.select(F.col(text).alias("t")).select("t", base_spans(F.col("t")).alias("b"))
    spans = judged.select(F.explode(candidates(F.col("t"), F.col("b"))).alias("c")).select("c.*")
    table = written(spans.groupBy(*LABELERS, "features").agg(F.count(F.lit(1)).alias("n")), "votes")
    patterns = table.groupBy(*LABELERS).agg(F.sum("n").alias("n"))
    belief: Column = 1 / (1 + F.exp(-sum((F.col(name) for name in LABELERS), F.lit(0))))  # first: by majority
    prior, reliability = 0.5, {}
    for _ in range(rounds):
        yes, no = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = patterns.withColumn("q", belief).agg(
            F.sum(yes).alias("yes"),
            F.sum(no).alias("no"),
            *[F.sum(F.when(F.col(name) == v, side)).alias(f"{name}{v}{end}") for name in LABELERS for v in (-1, 0, 1) for end, side in (("y", yes), ("n", no))],
        ).first()
        if sums["yes"] is None:
            return Model()
        share = lambda name, v, end, total: ((sums[f"{name}{v}{end}"] or 0.0) + 0.5) / (sums[total] + 1.5)
        reliability = {(name, v): (share(name, v, "y", "yes"), share(name, v, "n", "no")) for name in LABELERS for v in (-1, 0, 1)}
        prior = (sums["yes"] + 1) / (sums["yes"] + sums["no"] + 2)
        belief = _posterior(prior, reliability)
    soft = table.withColumn("q", belief).select("n", "q", F.explode("features").alias("f"))
    counts = soft.groupBy("f").agg(F.sum(F.col("n") * F.col("q")).alias("y"), F.sum(F.col("n") * (1 - F.col("q"))).alias("x")).collect()
    yes, no = sums["yes"], sums["no"]
    weights = {r["f"]: round(math.log((r["y"] + 0.5) / (yes + 1)) - math.log((r["x"] + 0.5) / (no + 1)), 6) for r in counts}
    return Model(round(math.log(prior / (1 - prior)), 6), weights, reliability)


def all_spans(text: Column, base: Column, model: Model) -> Column:
    """Base spans and the candidates that the model accepts, by kind as listed, then start."""
    if not model.weights:
        return base
    weights = F.create_map(*[F.lit(x) for pair in sorted(model.weights.items()) for x in pair])

    def accepted(c: Column) -> Column:
        return F.aggregate(c["features"], F.lit(model.prior), lambda a, f: a + F.coalesce(F.try_element_at(weights, f), F.lit(0.0))) > 0

    more = F.filter(candidates(text, base), accepted)
    return F.concat(base, F.transform(more, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def found(docs: DataFrame, model: Model, text: str = "text", names: Sequence[str] = ("base", "spans")) -> DataFrame:
    """``docs`` with the base spans and all spans of each text as arrays of (kind, start, end).

    Positions are code points from 0, ends exclusive. Null and empty texts have none. Repeated rows
    are answered each; columns named like the results are replaced.
    """
    based = docs.withColumn(names[0], base_spans(F.col(text)))
    return based.withColumn(names[1], all_spans(F.col(text), F.col(names[0]), model))


def count_of(spans: str | Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind in brackets.

    A null text stays null.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(o: Column) -> Column:
        return _bind(_running(F.transform(o, lambda s: s["end"]), largest=True), lambda ends: filled(o, ends))

    def filled(o: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(o, piece), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, _bind(ordered, cut)).otherwise(text)
