"""Language, quality, rules and licenses: scores and labels per text."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import langid, licenses, quality, rules


def test_languages_of_odd_texts(odd_docs, no_docs):
    profiles = langid.fit_profiles(odd_docs, dim=512)
    assert profiles.languages == ("de", "en")
    found = langid.identify(odd_docs, profiles)
    assert found.columns == [c for c in odd_docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = found.collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == odd_docs.count()
    assert [by_id[i] for i in (2, 3, 4, 9)] == [("und", 0.0)] * 4
    assert by_id[1][0] == by_id[None][0] == by_id[7][0] == "en" and by_id[8][0] == "de"
    assert all(0 <= s <= 1 for _, s in by_id.values())
    assert langid.identify(no_docs, profiles).count() == 0
    assert langid.fit_profiles(no_docs).languages == ()
    assert {r[0] for r in langid.identify(odd_docs, langid.fit_profiles(no_docs)).select("lang_pred").collect()} == {"und"}


def test_bundles_equal_their_definition():
    encode = langid.Encoder(64)
    vectors, known = encode(["Ab c", "7", None])
    place = [langid._letter_vectors(ord(c) if c != " " else 0, 64).astype(int) for c in " ab c "]
    grams = sum(place[i][0] * place[i + 1][1] * place[i + 2][2] for i in range(4) if i in (0, 1, 3))
    assert (vectors[0] == grams).all() and known.tolist() == [True, False, False] and not vectors[1:].any()


def test_quality_separates_held_out_texts(spark):
    good = [(i, " ".join(f"w{(i * 7 + j * j) % 997} of" for j in range(40)) + ".", 1) for i in range(0, 400, 2)]
    bad = [(i, "buy!! ### " * 40, 0) for i in range(1, 400, 2)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, learn=F.col("doc_id") % 5 != 0)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 0) for i in range(0, 400, 5))


def test_quality_of_odd_texts(odd_docs, no_docs):
    labels = odd_docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    model = quality.fit(odd_docs, labels)
    rows = quality.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.fit(no_docs, labels.where("false"))
    assert quality.scored(no_docs, none).count() == 0
    assert {r["score"] for r in quality.scored(odd_docs, none).collect()} == {0.5}


def brute_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_rule_counts_equal_brute_force(odd_docs, no_docs, spark):
    more = spark.createDataFrame([(20, "a b c d e a b c d e f a b c d e"), (21, "x\nx\n \nx y\n#$ é\x0b#")], "doc_id long, text string")
    rows = rules.counted(odd_docs.select("doc_id", "text").union(more)).collect()
    assert len(rows) == odd_docs.count() + 2
    for r in rows:
        assert brute_counts(r["text"]) == tuple(r[c] for c in rules.COUNTS[:5])
    assert rules.counted(no_docs).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(k, n, rate) for n in (1, 40, 500) for k in (0, 1, 3) for rate in (0.01, 0.2) if k <= n]
    for k, n, rate in cases:
        value = spark.range(1).select(rules.at_most(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), rate)).first()[0]
        exact = sum(comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(k + 1))
        assert value == pytest.approx(exact if k < n * rate else 1.0, rel=1e-7)


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(12)), "a") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"word{i}x{j}#!" for j in range(12)), "a") for i in range(200)]
    few = [(20_000 + i, " ".join(f"w{i}x{j}#" for j in range(12)), "b") for i in range(5)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good + few] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    counts = rules.counted(docs).drop("text").cache()
    found = rules.verdicts(counts, rules.thresholds(counts, labels, "lang"), "lang").collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i, *_ in good + few) and not any(kept[i] for i, *_ in bad)
    nobody = rules.verdicts(counts, rules.thresholds(counts, labels.where("false"), "lang"), "lang")
    assert nobody.where("kept").count() == 3205
    assert rules.verdicts(counts.where("false"), rules.thresholds(counts.where("false"), labels, "lang"), "lang").count() == 0


def test_licenses_of_planted_and_odd_texts(spark, odd_docs, no_docs):
    index = licenses.build_index()
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [
        (100, "x " + mit),
        (101, "Under the MIT License. mit license, and the Apache\nLicense"),
        (102, "without restriction permission is granted"),
        (103, "This work is licensed under the GNU General Public License, version 3."),
        (104, "éMIT license"),
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = licenses.hits(docs, index).cache()
    marked = licenses.labelled(found, index, licenses.word_idf(found, index)).collect()
    by_id = {r["doc_id"]: r for r in marked}
    assert len(marked) == docs.count() and by_id[100]["labels"] == "mit" and by_id[100]["base_labels"] == ""
    assert (by_id[101]["n_base"], by_id[101]["first_word"], by_id[101]["last_word"]) == (3, 2, 8)
    assert by_id[101]["base_labels"] == "apache,mit" and by_id[102]["labels"] == "" and by_id[104]["n_base"] == 0
    assert by_id[103]["labels"] == "gpl,gpl-3" and by_id[2]["n_words"] == 0 and by_id[3]["first_word"] is None
    empty = licenses.hits(no_docs, index)
    assert licenses.labelled(empty, index, licenses.word_idf(empty, index)).count() == 0
    for words in (["mit"], []):
        assert licenses.starts_of([w.encode() for w in words], [b"mit", b"license"]) == []
    assert np.isfinite(list(licenses.word_idf(found, index).values())).all()


def test_every_notice_of_a_file_is_labelled(spark):
    index = licenses.build_index()
    notices = [text for text, _ in licenses.TEMPLATES.values()]
    everything = "\n\n".join(notices)
    alone = [(i, f"Notice. {text}.") for i, text in enumerate(notices)]
    mit = [(20 + i, licenses.TEMPLATES["mit"][0]) for i in range(30)]
    docs = spark.createDataFrame([*alone, *mit, (100, everything)], "doc_id long, text string")
    found = licenses.hits(docs, index).cache()
    marked = {r["doc_id"]: r["labels"].split(",") for r in licenses.labelled(found, index, licenses.word_idf(found, index)).collect()}
    assert set(marked[100]) >= set(licenses.TEMPLATES)
    assert all(name in marked[i] for i, name in enumerate(licenses.TEMPLATES)) and "mit" in marked[25]
    same = found.where("doc_id between 20 and 49")
    assert {r["labels"] for r in licenses.labelled(same, index, licenses.word_idf(same, index)).collect()} == {"mit"}


def tail(good, wrong, rate):
    from math import comb

    return sum(comb(good, j) * rate**j * (1 - rate) ** (good - j) for j in range(wrong + 1)) if wrong < good * rate else 1.0


def last_step(good, wrong, rate, error):
    """The smallest step back that holds, steps tested from the largest on; None if the first fails."""
    found = None
    for back in range(rules.CUTOFFS - 1, -1, -1):
        if tail(good, wrong[back], rate) > error:
            break
        found = back
    return found


def test_levels_equal_plain_python_and_pool_small_strata(spark):
    import hashlib
    import random

    rng = random.Random(11)
    rows, labels = [], []
    for n, (lang, count, share) in enumerate([("a", 1500, 0.004), ("b", 900, 0.03), ("c", 260, 0.0), (None, 260, 0.005)]):
        for i in range(count):
            bad = rng.random() < 0.25
            marks = rng.choice([0, 0, 3, 6, 11, 16, 20]) if bad or rng.random() < share else 0
            long = "x" * (4 if bad and rng.random() < 0.3 else 0)
            rows.append((10000 * n + i, " ".join(f"w{i}x{j}{long}" + ("#" if j < marks else "") for j in range(20)), lang))
            labels.append((10000 * n + i, 0 if bad else 1))
    counts = rules.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).drop("text").cache()
    found = {r["__stratum"]: r for r in rules.levels(counts, spark.createDataFrame(labels, "doc_id long, quality int"), "lang").collect()}
    assert {s: r["pooled"] for s, r in found.items()} == {"a": False, "b": False, "c": True, None: True}
    over = {r["doc_id"]: r["over"] for r in counts.select("doc_id", rules.exceeded().alias("over")).collect()}
    quality, risk, top = dict(labels), rules.Risk(), rules.CUTOFFS
    first = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % rules.PROPOSING == 0 for i, *_ in rows}
    steps = set()
    for group in ({"a"}, {"b"}, {"c", None}):
        ids = [i for i, _, lang in rows if lang in group]
        ask, rest = [i for i in ids if first[i]], [i for i in ids if not first[i]]
        proposed = []
        for r in range(len(rules.RULES)):
            best = (0, 0)
            for t in range(1, top + 1):
                hit = [quality[i] for i in ask if over[i][r] >= top + 1 - t]
                if sum(hit) <= sum(quality[i] for i in ask) * risk.rate / len(rules.RULES):
                    best = max(best, (len(hit) - sum(hit), -t)) if len(hit) > sum(hit) else best
            proposed.append(-best[1])
        rejected = {s: [quality[i] for i in rest if any(t and over[i][r] >= top + 1 - (t - s) and t > s for r, t in enumerate(proposed))] for s in range(top)}
        last = last_step(sum(quality[i] for i in rest), {s: sum(q) for s, q in rejected.items()}, risk.rate, risk.error / 5)
        want = max(((len(q) - sum(q), s) for s, q in rejected.items() if last is not None and s >= last and len(q) > sum(q)), default=(0, None))[1]
        assert all(found[s]["levels"] == proposed and found[s]["back"] == want for s in group)
        steps.add(want)
    assert steps - {None}


def test_bounds_hold_as_often_as_promised():
    """A step whose true false rejection is above the rate is seldom certified."""
    rng = np.random.default_rng(5)
    rate, error, trials = rules.Risk().rate, 0.05, 600
    true = np.array([0.001, 0.004, 0.01, 0.0201, 0.021, 0.024, 0.03, 0.05])  # of steps 7 to 0, nested
    broken = 0
    for _ in range(trials):
        draws = np.searchsorted(true, rng.random(400))
        last = last_step(400, {7 - t: int((draws <= t).sum()) for t in range(8)}, rate, error)
        broken += last is not None and last < 5
    assert broken <= trials * (error + 0.02)
