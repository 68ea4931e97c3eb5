"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of ±1, drawn from its code point. A letter trigram is bound from
its letters: the first letter's vector rotated by two places, the second's by one, and the third's as
it is, multiplied entry by entry. A document is the bundle (sum) of its trigrams, a language the
bundle of its documents, each at unit length. The language with the largest cosine wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import by_size, mapped, with_computed

UNKNOWN = "und"
#: Unit vectors are summed as integers of this scale, so a sum doesn't depend on its order.
SCALE = 1 << 20
#: Characters and distinct trigrams per block of work, which bound a task's memory.
CHARS, GRAMS = 1 << 19, 1 << 11


def _letter_vectors(code: int, dim: int) -> np.ndarray:
    """The vector of a code point (0: word boundary), rotated for each place in a trigram."""
    one = np.random.default_rng([code, dim]).integers(0, 2, dim).astype(np.int8) * 2 - 1
    return np.stack([np.roll(one, 2), np.roll(one, 1), one])


class Encoder:
    """Document vectors; keeps the letters it has met, at most one entry per code point."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.letter = np.full(0x110000, -1, np.int8)
        self.number = np.zeros(0x110000, np.int64)
        self.vectors = [_letter_vectors(0, dim)]

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of letters, 0 for anything else."""
        present = np.zeros(0x110000, bool)
        present[codes] = True
        for code in np.flatnonzero(present & (self.letter < 0)):
            self.letter[code] = is_letter = chr(code).isalpha()
            if is_letter:
                self.number[code] = len(self.vectors)
                self.vectors.append(_letter_vectors(int(code), self.dim))
        return self.number[codes]

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts and whether each has a letter; null is an empty text."""
        vectors, lettered = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        for part in by_size([len(t or "") for t in texts], CHARS):
            vectors[part], lettered[part] = self._bundle(texts[part])
        return vectors, lettered

    def _bundle(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lower = [f" {(t or '').lower()} " for t in texts]
        codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
        symbols = self._symbols(codes)
        lettered = np.bincount(owner, symbols > 0, len(texts)) > 0
        single = symbols > 0
        single[1:] |= symbols[:-1] > 0  # one boundary for a run of other characters
        single[0] = True
        symbols, owner = symbols[single], owner[single]
        if len(symbols) < 3:
            return np.zeros((len(texts), self.dim), np.float32), lettered
        base = len(self.vectors)
        grams = (symbols[:-2] * base + symbols[1:-1]) * base + symbols[2:]
        whole = (owner[:-2] == owner[2:]) & (symbols[1:-1] > 0)  # centred on a letter
        grams, owner = grams[whole], owner[:-2][whole]
        if base**3 <= 1 << 24:
            present = np.zeros(base**3, bool)
            present[grams] = True
            distinct = np.flatnonzero(present)
            place = np.zeros(base**3, np.int64)
            place[distinct] = np.arange(len(distinct))
            grams = place[grams]
        else:
            distinct, grams = np.unique(grams, return_inverse=True)
        letters = np.stack(self.vectors, 1)
        out = np.zeros((len(texts), self.dim), np.float32)
        for low in range(0, len(distinct), GRAMS):
            some = distinct[low : low + GRAMS]
            bound = letters[0][some // base**2] * letters[1][some // base % base] * letters[2][some % base]
            inside = (grams >= low) & (grams < low + GRAMS)
            counts = np.bincount(owner[inside] * len(some) + grams[inside] - low, minlength=len(texts) * len(some))
            out += counts.reshape(len(texts), len(some)).astype(np.float32) @ bound.astype(np.float32)
        return out, lettered


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: one row of ``vectors`` (unit length) per entry of ``languages``."""

    languages: tuple[str, ...]
    vectors: np.ndarray


def fit_profiles(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    learn: Column | None = None,
    rows_per_language: int = 4000,
    dim: int = 1024,
) -> Profiles:
    """Prototypes from about ``rows_per_language`` labelled documents of each language.

    ``learn`` marks the rows that may be used. Rows are chosen by a hash of ``key``, so every run
    chooses the same; languages below the bound use all their rows. Null texts, languages and keys,
    and texts without a letter teach nothing; repeated rows count each time. Only the counts per
    language and the prototypes (languages x ``dim`` numbers) reach the driver.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull())
    usable = usable if learn is None else usable.where(learn)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles((), np.zeros((0, dim), np.float32))
    shares = F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, min(1.0, rows_per_language / n))])
    chosen = usable.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < shares[F.col(lang)] * (1 << 20))

    def make() -> Callable:
        encode = Encoder(dim)

        def work(texts: list, langs: list) -> Iterator[tuple]:
            vectors, _ = encode(texts)
            whole = np.rint(_unit(vectors) * SCALE).astype(np.int64)
            names, owner = np.unique(np.asarray(langs, dtype=object), return_inverse=True)
            sums = np.zeros((len(names), dim), np.int64)
            np.add.at(sums, owner, whole)
            yield list(names), sums.tolist()

        return work

    sums = mapped(chosen.select(F.col(text).alias("text"), F.col(lang).alias("lang")), ["text", "lang"], [("lang", "string"), ("sums", "longs")], make)
    total = sums.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    languages = tuple(sorted(sizes))
    vectors = np.zeros((len(languages), dim), np.float32)
    for row in total.collect():
        vectors[languages.index(row["lang"]), row["i"]] = row["x"]
    return Profiles(languages, _unit(vectors))


def identify(
    docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its cosine (0 to 1) as the columns ``names``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the
    profiles know no language. On equal cosines the smaller language name wins. Texts are read
    whole; a long one is its own slice of work. Columns of ``docs`` named like the results are
    replaced.
    """

    def make() -> Callable:
        encode = Encoder(profiles.vectors.shape[1])
        languages = np.array([*profiles.languages, UNKNOWN], dtype=object)

        def work(texts: list) -> tuple[Iterable, Iterable]:
            vectors, known = encode(texts)
            if len(languages) == 1:
                return [UNKNOWN] * len(texts), [0.0] * len(texts)
            cosines = np.round(_unit(vectors).astype(np.float64) @ profiles.vectors.T.astype(np.float64), 6)
            best = cosines.argmax(1)
            score = np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
            return languages[np.where(known, best, len(languages) - 1)].tolist(), score

        return work

    return with_computed(docs, [text], list(zip(names, ("string", "double"))), make)
