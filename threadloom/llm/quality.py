"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and each chosen pair of features one over
pairs of bins. The tables are learned by cyclic boosting: in turn, every feature gets a shallow tree
fitted to the current residuals, whose leaf values are added to its table; then the pairs with the
largest remaining gain do. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import by_size, mapped

FEATURES = (
    "words", "word_length", "distinct", "top_word", "repeats", "symbols", "shouts", "upper", "digits", "pipes",
    "line_words", "duplicate_lines", "stops", "long_words", "non_ascii", "short_words",
)
SYMBOLS = "#*$%&|<>"


def features_of(text: str | None) -> tuple[float, ...]:
    """The values of ``FEATURES``; a null, empty or blank text has zeros."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(FEATURES)
    n, size = len(words), len(text)
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    letters = sum(lengths)
    plain = text.encode("utf-8", "surrogatepass")
    upper = size - len(text.translate(_UPPER)) if text.isascii() else sum(map(str.isupper, text))
    digits = len(plain) - len(plain.translate(None, b"0123456789"))
    marks = len(plain) - len(plain.translate(None, SYMBOLS.encode()))
    return (
        float(np.log1p(n)),
        letters / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        marks / n,
        plain.count(b"!") / n,
        upper / letters,
        digits / letters,
        plain.count(b"|") / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        (plain.count(b".") + plain.count(b",")) / n,
        sum(x > 15 for x in lengths) / n,
        (len(plain) - size) / size,
        sum(x < 3 for x in lengths) / n,
    )


_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class Model:
    """Intercept, bin edges, one table per feature, and tables of feature pairs over coarse bins."""

    intercept: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of feature values, by bin additions over all rows at once."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of bins with gradient and curvature sums."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values per bin of a tree of depth two."""
    out = np.zeros(len(g))
    _, middle = _cut(g, h, ridge)
    for low, high in ((0, middle), (middle, len(g))):
        if high > low:
            gain, cut = _cut(g[low:high], h[low:high], ridge)
            for a, b in ((low, low + cut), (low + cut, high)) if gain > 1e-9 else ((low, high),):
                out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _tree_of_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values per pair of bins: a split along one axis, then one along the other on either side."""
    best, found = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        first, middle = _cut(gg.sum(1), hh.sum(1), ridge)
        total, out = first, np.zeros_like(gg)
        for low, high in ((0, middle), (middle, len(gg))):
            if high > low:
                gain, cut = _cut(gg[low:high].sum(0), hh[low:high].sum(0), ridge)
                total += gain
                for a, b in ((0, cut), (cut, gg.shape[1])):
                    if b > a:
                        out[low:high, a:b] = gg[low:high, a:b].sum() / (hh[low:high, a:b].sum() + ridge)
        if total > best:
            best, found = total, out.T if flip else out
    return found


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def train(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 12, rounds: int = 150, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Cyclic boosting on feature rows ``x`` and labels ``y`` (0 or 1).

    Without rows, or with one class only, the tables are zero and every score is the smoothed share
    of ones.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        none = tuple(np.empty(0) for _ in FEATURES)
        return Model(intercept, none, tuple(np.zeros(1) for _ in FEATURES), none, ())
    edges = tuple(_edges(x[:, j], bins) for j in range(x.shape[1]))
    coarse = tuple(_edges(x[:, j], coarse_bins) for j in range(x.shape[1]))
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = residuals()
            step = rate * _tree(np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)), ridge)
            table += step
            total += step[fine[j]]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        g, h = residuals()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    def gain(pair: tuple[int, int]) -> float:
        cell, g, h = grid(*pair)
        values = _tree_of_pair(g, h, ridge)
        return float((values * g - values**2 * h / 2).sum())

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-gain(p), p))[:pairs]
    pair_tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for p, table in pair_tables.items():
            cell, g, h = grid(*p)
            step = rate * _tree_of_pair(g, h, ridge)
            table += step
            total += step.ravel()[cell]
    return Model(intercept, edges, tuple(tables), coarse, tuple((a, b, t) for (a, b), t in pair_tables.items()))


def _features(docs: DataFrame, keep: Sequence[tuple[str, str]], text: str) -> DataFrame:
    def make() -> Callable:
        def work(*columns: list) -> Iterator[tuple]:
            *kept, texts = columns
            yield [*kept, *zip(*map(features_of, texts))]

        return work

    names = [name for name, _ in keep]
    return mapped(docs.select(*names, F.col(text).alias("__text")), [*names, "__text"], [*keep, *((f, "double") for f in FEATURES)], make)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
    learn: Column | None = None, rows: int = 40_000, **settings: float,
) -> Model:
    """Train on about ``rows`` labelled documents, chosen by a hash of the key.

    ``learn`` marks the label rows that may be used. The chosen labels, a table of that size, are
    broadcast to the documents, and only their features reach the driver. Labels that are null or
    neither 0 nor 1, and null keys, are not used; repeated labels count each time.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    usable = (usable if learn is None else usable.where(learn)).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label"))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    joined = docs.select(F.col(key).cast("bigint").alias("__doc"), F.col(text).alias("__words")).join(F.broadcast(chosen), F.col("__doc") == F.col("__key"))
    found = _features(joined, [("__doc", "long"), ("__label", "double")], "__words").toArrow().sort_by([("__doc", "ascending"), ("__label", "ascending")])
    x = np.column_stack([found.column(f).to_numpy() for f in FEATURES]) if found.num_rows else np.zeros((0, len(FEATURES)))
    return train(x, found.column("__label").to_numpy() if found.num_rows else np.zeros(0), **settings)


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored on features of zero."""

    def make() -> Callable:
        def work(keys: list, texts: list) -> Iterator[tuple]:
            for part in by_size([len(t or "") for t in texts], 1 << 23):
                x = np.array([features_of(t) for t in texts[part]]).reshape(-1, len(FEATURES))
                yield keys[part], np.round(model.score(x), 6)

        return work

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, ["doc_id", "text"], [("doc_id", "long"), ("score", "double")], make)
