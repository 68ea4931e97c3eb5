"""Near-duplicates, repeated passages and components."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import components, simhash, substring
from threadloom.session import written


def brute_components(ids, linked):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(ids))]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199), (199, 200), (None, 3)]
    found = {r["node"]: r["root"] for r in components.smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, 199: 199, 200: 199}
    assert components.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("segments", [8, 16])
def test_links_equal_all_pairs(spark, segments):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    near = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) for s in seeds for _ in range(12)}
    values = [v - (1 << 64) if v >> 63 else v for v in {*seeds, *near}]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, segments).collect()
    want = {frozenset((a, b)) for a in values for b in values if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(found) == len(want) and {frozenset((r["a"], r["b"])) for r in found} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_fingerprints_stay_off_the_driver(spark):
    nodes = written(spark.range(20_000).select(F.xxhash64("id").alias("fp")), "fps").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    assert "BroadcastHashJoin" not in _plan(simhash.links(nodes.select("fp")))


def test_rounds_over_many_edges_are_sorted(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(components, "written", lambda df, name: plans.append(_plan(df)) or written(df, name))
    edges = spark.range(1, components.SORTED_EDGES + 10).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"))
    roots = components.smallest_reachable(edges)
    assert roots.where("root = 0").count() == components.SORTED_EDGES + 10
    assert len(plans) > 1 and not any("BroadcastHashJoin" in p for p in plans)


def test_near_duplicates_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(80)) for _ in range(6)]
    rows = [(50 + 10 * i + j, b if j == 0 else b + " tail" * j) for i, b in enumerate(base) for j in range(4)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = simhash.near_duplicates(docs).collect()
    plain = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    roots = brute_components(plain, lambda i, j: (plain[i][1] ^ plain[j][1]).bit_count() <= 2)
    least = {}
    for root, (i, _) in zip(roots, plain):
        least[root] = min([x for x in (i, least.get(root)) if x is not None], default=None)
    key = lambda r: tuple(map(repr, r))
    want = sorted([(i, fp, least[root]) for root, (i, fp) in zip(roots, plain)], key=key)
    assert sorted([(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found], key=key) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert sorted(simhash.one_of_each(odd_docs).columns) == sorted(odd_docs.columns)


def test_fingerprint_by_definition():
    import xxhash

    words = "A b C d".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint("A  b\tC\nd") == hashes[0] & hashes[1]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


def text_of(rng, n):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.randrange(4000)}" for _ in range(n))


def test_passages_are_found_exactly_and_fuzzily(spark, odd_docs, no_docs):
    rng = random.Random(5)
    shared, fuzzy = text_of(rng, 60), text_of(rng, 120).split()
    edited = [w if i % 25 else "changed" for i, w in enumerate(fuzzy)]
    rows = [
        (1, f"{text_of(rng, 40)} {shared} {text_of(rng, 30)}"),
        (2, f"{text_of(rng, 5)} {shared.upper()}"),
        (3, f"{shared}\n{text_of(rng, 90)}"),
        (4, " ".join(fuzzy)),
        (5, f"{text_of(rng, 10)} {' '.join(edited)} {text_of(rng, 10)}"),
        (6, text_of(rng, 200)),
        (7, text_of(rng, 3)),
        (8, f"{text_of(rng, 20)} {' '.join(shared.split()[:30])}"),
        (9, None),
        (None, shared),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = written(substring.pieces(docs), "pieces")
    spans = {(r["doc_id"], r["start"], r["end"]): r for r in substring.passages(found).collect()}
    assert set(spans) >= {(1, 40, 100), (2, 5, 65), (3, 0, 60)} and {d for d, *_ in spans} == {1, 2, 3, 4, 5}
    assert spans[2, 5, 65]["source_id"] == spans[3, 0, 60]["source_id"] == spans[1, 40, 100]["source_id"] == 1
    assert spans[1, 40, 100]["copied"] == 0 and spans[2, 5, 65]["copied"] == 60
    (start, end) = next((s, e) for d, s, e in spans if d == 5)
    assert abs(start - 10) <= 1 and abs(end - 130) <= 1
    cut = {r["doc_id"]: r["text"] for r in substring.without_copies(docs, found).collect()}
    given = dict(rows)
    assert all(cut[i] == given[i] for i in (1, 4, 6, 7, 8, 9, None))
    assert cut[2].split() == given[2].split()[:5] and cut[3].split() == given[3].split()[60:]
    assert substring.pieces(no_docs).count() == 0


def test_copies_of_odd_texts(odd_docs):
    found = written(substring.pieces(odd_docs), "pieces")
    assert {(r["doc_id"], r["source_id"]) for r in found.collect()} <= {(6, 1)}
    cut = substring.without_copies(odd_docs, found, min_words=40)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert cut.where((F.col("doc_id") == 6) & (F.trim("text") == "")).count() == 2


def test_chains_by_brute_force():
    import numpy as np

    rng = random.Random(2)
    for _ in range(30):
        points = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(8)})
        x, y = (np.array(c) for c in zip(*points))
        gap, k = 0.05, 5
        score = []
        for i, (a, b) in enumerate(points):
            before = [score[j] - gap * (a - c + b - d) for j, (c, d) in enumerate(points[:i]) if c < a and d < b]
            score.append(k + max([0.0, *before]))
        cx, cy = next(iter(substring.chains(x, y, k, gap, 1000)))
        assert (np.diff(cx) > 0).all() and (np.diff(cy) > 0).all()
        got = k * len(cx) - gap * (cx[-1] - cx[0] + cy[-1] - cy[0])
        assert got == pytest.approx(max(score))


def test_common_words_by_brute_force():
    import numpy as np

    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert substring.common(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_repeats_survive_seeds_that_stand_in_other_documents(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(12):
        shared = text_of(rng, 55).split()
        grams = [" ".join(shared[j : j + 6]) for j in range(0, 50, 3)]
        rng.shuffle(grams)
        base = 100 * i
        rows += [(base + j, f"{text_of(rng, 20)} {g} {text_of(rng, 20)}") for j, g in enumerate(grams)]  # before both
        rows += [(base + 50, f"{text_of(rng, 30)} {' '.join(shared)} {text_of(rng, 30)}")]
        if i % 2:  # and between the two
            rows += [(base + 55 + j, f"{text_of(rng, 20)} {g} {text_of(rng, 20)}") for j, g in enumerate(grams)]
        rows += [(base + 90, f"{text_of(rng, 10)} {' '.join(shared)} {text_of(rng, 10)}")]
        want |= {(base + 50, 30, 85), (base + 90, 10, 65)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring.passages(written(substring.pieces(docs), "pieces")).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in spans} == want


def test_previous_holders_by_brute_force(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, rng.randrange(1000)]), rng.randrange(400)) for _ in range(900)})
    cuts = [50, 100, 250]  # seed 1 is hot: its holders are dealt over four slices
    seeds = spark.createDataFrame([(s, 1 + sum(d > c for c in cuts) if s == 1 else 0, d, d % 7) for s, d in rows], "seed long, slice int, doc_id long, pos int")
    found = {(r["doc_id"], r["first_id"], r["before_id"], r["first_pos"], r["before_pos"]) for r in substring._links(seeds).collect()}
    holders = {}
    for s, d in rows:
        holders.setdefault(s, []).append(d)
    want = {(d, h[0], c, h[0] % 7, c % 7) for h in holders.values() for c, d in zip(h, h[1:])}
    assert found == want


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9])
def test_edited_passages_are_found(spark, identity):
    rng = random.Random(int(identity * 100))
    rows, places = [], {}
    for i in range(60):
        n = rng.choice([50, 60, 80])
        shared = text_of(rng, n).split()
        inner = range(1, n - 1)
        changed = rng.sample(inner, int(n * (1 - identity) + 1e-9))
        if i % 3 == 0:
            step = round(1 / (1 - identity))
            changed = [j for j in inner if j % step == step - 1]
        edited = [f"changed{rng.random()}" if j in changed else w for j, w in enumerate(shared)]
        rows += [(2 * i, f"{text_of(rng, 30)} {' '.join(shared)} {text_of(rng, 30)}"), (2 * i + 1, f"{text_of(rng, 20)} {' '.join(edited)} {text_of(rng, 20)}")]
        places[2 * i + 1] = (20, 20 + n, 2 * i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in substring.passages(written(substring.pieces(docs), "pieces")).collect() if r["copied"]}
    missed = {d for d, (a, b, source) in places.items() if d not in found or found[d]["source_id"] != source or min(b, found[d]["end"]) - max(a, found[d]["start"]) < 50}
    assert not missed


def test_phrases_of_several_documents_make_no_passage(spark):
    rng = random.Random(9)
    phrases = [text_of(rng, 12) for _ in range(6)]
    rows = [(i, f"{text_of(rng, 20)} {p} {text_of(rng, 20)}") for i, p in enumerate(phrases)]
    rows += [(10, f"{text_of(rng, 20)} {' '.join(phrases)} {text_of(rng, 20)}"), (11, " ".join(phrases))]
    first = text_of(rng, 60).split()
    rows += [(20, " ".join(first))] + [(21 + i, f"{text_of(rng, 20)} {' '.join(first[i * 12 : i * 12 + 12])} {text_of(rng, 20)}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = written(substring.pieces(docs), "pieces")
    assert {(r["doc_id"], r["start"], r["end"]) for r in substring.passages(found).collect()} == {(10, 20, 92), (11, 0, 72)}
    alone = docs.where("doc_id <> 11")
    found = written(substring.pieces(alone), "pieces")
    assert substring.passages(found).count() == 0
    assert {tuple(r) for r in substring.without_copies(alone, found).collect()} == {r for r in rows if r[0] != 11}


def test_fingerprint_of_a_very_long_text_is_bounded_in_memory(monkeypatch):
    import tracemalloc

    text = " ".join(f"w{i % 9973}x{i % 31}" for i in range(2_400_000))
    assert len(text) > 20_000_000
    tracemalloc.start()
    long = simhash.fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)
    monkeypatch.setattr(simhash, "SLICE", 1 << 30)
    assert simhash.fingerprint(text) == long


def test_fingerprint_does_not_depend_on_its_slices(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "Bc", "é", " ", "\n", "  ", "x\x0by"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 3, 7, 16):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert [simhash.fingerprint(t) for t in texts] == whole


def test_words_hash_alike_whatever_the_pieces(monkeypatch):
    rng = random.Random(1)
    known = {}
    for size in (1, 5, 16, 1 << 20):
        monkeypatch.setattr(substring, "_PIECE", size)
        for _ in range(200):
            text = "".join(rng.choice(["a", "Bc", "é", " ", "\n", "x\x0by", "q", "\x00", "\x1c"]) for _ in range(rng.randrange(40)))
            words = text.encode().lower().split()
            found = substring.hashes_of(text).tolist()
            assert len(found) == len(words) and all(known.setdefault(w, h) == h for w, h in zip(words, found))
    assert len(set(known.values())) == len(known)


def test_hot_seeds_only_place_rows(spark, monkeypatch):
    rng = random.Random(3)
    common = text_of(rng, 60)
    rows = [(i, f"{text_of(rng, 12)} {common if i % 2 else text_of(rng, 60)} {text_of(rng, 12)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot, cuts = substring._hot_seeds(docs, 4, 50, 1)
    assert len(hot) >= 50 and len(cuts) > 1
    spans = {tuple(r) for r in substring.passages(substring.pieces(docs)).collect()}
    assert {(d, 12, 72) for d in range(1, 120, 2)} == {s[:3] for s in spans}
    monkeypatch.setattr(substring, "_hot_seeds", lambda *_: (hot[:0], cuts[:0]))
    assert {tuple(r) for r in substring.passages(substring.pieces(docs)).collect()} == spans
