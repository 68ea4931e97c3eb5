"""License scans with a positional index of rare words.

License templates are indexed by word: postings of (template, position). A file is looked up by its
words of highest IDF per template only; a posting and a place in the file agree on where the template
would start, and starts that enough rare words agree on are candidates. A template counts if its
mandatory phrases stand in the file near such a start. IDF comes from all files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import mapped, with_computed

# The phrases of the base labels.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}
# Opening words of common license notices, with the phrases that must be there.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms",),
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license you may obtain a copy of the license at",
        ("licensed under the apache license",),
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license",),
    ),
    "gpl-3": (
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
}
# Words too common to tell a license.
COMMON = frozenset(
    "a all an and any are as at be by can deal except for form free if in is it met not of one or that the this to under "
    "use v was with you 0 2 3 4 may must above file files".split()
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Index:
    """Postings of the templates' telling words, the phrases to verify, and the base phrases.

    Every word of a base phrase has postings, so the index alone finds the phrase's places.
    """

    postings: dict[bytes, list[tuple[str, int]]]
    mandatory: dict[str, list[list[bytes]]]
    lengths: dict[str, int]
    phrases: dict[str, list[bytes]]


def build_index(templates: dict[str, tuple[str, Sequence[str]]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Index:
    base = {name: phrase.encode().split() for name, phrase in phrases.items()}
    postings: dict[bytes, list[tuple[str, int]]] = {word: [] for words in base.values() for word in words}
    for name, (text, _) in templates.items():
        for place, word in enumerate(text.encode().split()):
            if word.decode() not in COMMON:
                postings.setdefault(word, []).append((name, place))
    mandatory = {name: [p.encode().split() for p in phrases] for name, (_, phrases) in templates.items()}
    return Index(postings, mandatory, {name: len(text.split()) for name, (text, _) in templates.items()}, base)


def starts_of(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Places from ``low`` to ``high`` where the words of ``phrase`` stand consecutively."""
    found, at, last = [], low, len(words) if high is None else min(high, len(words))
    while True:
        try:
            at = words.index(phrase[0], at, last)
        except ValueError:
            return found
        if words[at : at + len(phrase)] == phrase:
            found.append(at)
        at += 1


HITS = [("doc_id", "long"), ("n_words", "long"), ("places", "ints"), ("names", "ints"), ("verified", "ints"), ("verified_at", "ints")]


def hits(docs: DataFrame, index: Index, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One pass over the texts: where license words and mandatory phrases stand.

    Words are numbered by ``sorted(index.postings)``, mandatory phrases by ``_phrases``. Files without
    license words keep their word count alone. Null and empty texts have no words.
    """
    numbers = {word: i for i, word in enumerate(sorted(index.postings))}
    needed = _phrases(index)

    def make() -> Callable:
        rare = frozenset(numbers)

        def work(keys: list, texts: list) -> Iterator[tuple]:
            rows = []
            for k, t in zip(keys, texts):
                words = WORD.findall((t or "").encode("utf-8", "surrogatepass").lower())
                row: tuple = (k, len(words), [], [], [], [])
                if not rare.isdisjoint(words):
                    places = [i for i, w in enumerate(words) if w in rare]
                    kept = [(n, at) for n, p in enumerate(needed) for at in starts_of(words, p)]
                    row = (k, len(words), places, [numbers[words[i]] for i in places], [n for n, _ in kept], [at for _, at in kept])
                rows.append(row)
            yield tuple(zip(*rows)) if rows else ((),) * len(HITS)

        return work

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, ["doc_id", "text"], HITS, make)


def _phrases(index: Index) -> list[list[bytes]]:
    return [list(p) for p in sorted({tuple(p) for phrases in index.mandatory.values() for p in phrases})]


def word_idf(found: DataFrame, index: Index, floor: float = 0.01) -> dict[int, float]:
    """IDF of every license word over all files; at most one number per template word is collected.

    A word in every file still counts as ``floor``, so a license in all files keeps its votes.
    """
    rows = found.select(F.explode(F.array_distinct("names")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    total = found.count()
    seen = {r["w"]: r["n"] for r in rows}
    return {i: max(floor, math.log((total + 1) / (seen.get(i, 0) + 1))) for i in range(len(index.postings))}


def labelled(
    found: DataFrame, index: Index, idf: dict[int, float], rarest: int = 16, share: float = 0.5
) -> DataFrame:
    """``found`` (``hits``) with base_labels, labels, first_word, last_word, n_base and score.

    The ``rarest`` words of each template in a file by IDF (ties: the earlier template word; every place
    of them counts) vote for its starts, weighted by IDF, however many other notices the file has. A start with at least ``share`` of the
    IDF of its template's telling words among them is a candidate; the template is a label if all its
    mandatory phrases start within its length around there. Base phrases are looked up by their rarest
    word; a place counts if the postings of all words agree on it. The score is the best candidate's
    share, 1 if a base phrase stands in the file, 0 without a label.
    """
    words = sorted(index.postings)
    postings = [index.postings[w] for w in words]
    needed = _phrases(index)
    must = {name: [needed.index(p) for p in map(list, phrases_)] for name, phrases_ in index.mandatory.items()}
    base = {name: [words.index(w) for w in phrase] for name, phrase in index.phrases.items()}
    telling: dict[str, set[int]] = {}
    for n, posted in enumerate(postings):
        for name, _ in posted:
            telling.setdefault(name, set()).add(n)
    rarest_of = {name: max(range(len(p)), key=lambda j: (idf[p[j]], -j)) for name, p in base.items()}

    def phrase_places(places: list[int], numbers: list[int]) -> list[tuple[str, int]]:
        at_of: dict[int, set[int]] = {}
        for at, n in zip(places, numbers):
            at_of.setdefault(n, set()).add(at)
        out = []
        for name, phrase in base.items():
            if all(n in at_of for n in phrase):
                starts = [at - rarest_of[name] for at in at_of[phrase[rarest_of[name]]]]
                out += [(name, s) for s in starts if all(s + j in at_of[n] for j, n in enumerate(phrase))]
        return out

    def candidates(places: list[int], numbers: list[int]) -> dict[tuple[str, int], float]:
        present = set(numbers)
        chosen = {name: set(sorted(present & own, key=lambda i: (-idf[i], i))[:rarest]) for name, own in telling.items()}
        weight: Counter = Counter()
        for at, n in zip(places, numbers):
            for name, place in postings[n]:
                if n in chosen[name]:
                    weight[name, at - place] += idf[n]
        full = {name: sum(idf[n] for n in own for posted, _ in postings[n] if posted == name) for name, own in chosen.items()}
        return {key: w / full[key[0]] for key, w in weight.items() if full[key[0]] > 0 and w >= share * full[key[0]]}

    def make() -> Callable:
        def label(places: list, numbers: list, kept: list, kept_at: list) -> tuple:
            found_at = phrase_places(places, numbers)
            base_at, own = [at for _, at in found_at], sorted({name for name, _ in found_at})
            more, best = set(own), 1.0 if own else 0.0
            if kept:
                for (name, start), part in candidates(places, numbers).items():
                    around = range(start - index.lengths[name], start + 2 * index.lengths[name])
                    if all(any(k == need and at in around for k, at in zip(kept, kept_at)) for need in must[name]):
                        more.add(name)
                        best = max(best, min(1.0, part))
            first, last = (min(base_at), max(base_at)) if base_at else (None, None)
            return len(base_at), first, last, ",".join(own), ",".join(sorted(more)), round(best, 6)

        def work(*columns: list) -> tuple:
            rows = [label(*row) for row in zip(*columns)]
            return tuple(zip(*rows)) if rows else ((),) * 6

        return work

    result = [("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    return with_computed(found, ["places", "names", "verified", "verified_at"], result, make)
