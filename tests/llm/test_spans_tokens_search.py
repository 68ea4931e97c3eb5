"""Personal data, packing, byte-level BPE, top-k search, and the pipeline."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import bpe, mtree, packing, pii
from threadloom.session import written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_of(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


SPANS = [
    "1.2.3.4.5.6.7.8 a@b.c_d@e.f.g x@y @ 300.1.1.1 0255.1.1.1 0.0.0.0",
    "é +1 (743) 555-3824, 4465 7583 8288 9437 😀 me@x.org",
    "9" * 5000, "a" * 5000, "1 " * 2000, "a.b@c" * 300, "", None, "4-4-4-4", "+1", "+1 5 " * 50,
    " ".join(f"u{i}@mail.example.com 10.0.{i}.7" for i in range(300)),
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    texts = SPANS + ["".join(rng.choice("1234567890.@ab+- ()é") for _ in range(120)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.found(docs, pii.Model()).select("text", "base", "spans").collect():
        assert [tuple(s) for s in r["base"]] == base_of(r["text"]) and r["spans"] == r["base"]


def test_model_finds_secrets_and_redacts(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, f'say {i} token = "{rng.getrandbits(160):040x}" end') for i in range(40)]
    rows += [(100 + i, f"the word {'averyveryverylongword' * 2} number {i} here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    found = pii.found(docs, model).select("doc_id", "text", pii.joined(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r"))
    for r in found.collect():
        at = r["text"].find('"') + 1
        assert r["s"] == (f"secret:{at}:{at + 40}" if r["doc_id"] < 100 else "")
        assert r["r"] == (r["text"][:at] + "[SECRET]" + r["text"][at + 40 :] if r["doc_id"] < 100 else r["text"])
    assert pii.fit(no_docs).weights == {} and pii.found(no_docs, model).count() == 0
    odd = pii.found(odd_docs, model).select("*", pii.redacted(F.col("text"), F.col("spans")).alias("r")).collect()
    assert len(odd) == odd_docs.count()
    assert next(r["r"] for r in odd if r["doc_id"] is None).endswith("mail [EMAIL]")
    assert all(r["r"] == r["text"] for r in odd if r["doc_id"] is not None)


def test_overlapping_spans_are_redacted_together(spark):
    spans = "array(named_struct('kind','a','start',2,'end',6), named_struct('kind','b','start',0,'end',3), named_struct('kind','c','start',8,'end',9))"
    row = spark.range(1).select(pii.redacted(F.lit("0123456789"), F.expr(spans)), pii.redacted(F.lit(None).cast("string"), F.expr(spans))).first()
    assert tuple(row) == ("[B]67[C]9", None)


def test_fullest_combination_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randrange(1, 40)
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        sums = {0}
        for length, n in counts.items():
            sums = {s + i * length for s in sums for i in range(n + 1)}
        taken = packing.fullest(capacity, dict(counts))
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)
        assert all(0 < n <= counts[k] for k, n in taken.items())


def test_plan_holds_every_piece_once():
    histogram = {i: 3 + i % 4 for i in range(1, 65, 3)}
    bins = packing.plan(histogram, 64)
    placed = collections.Counter()
    for times, combination in bins:
        assert sum(k * n for k, n in combination.items()) <= 64
        placed.update({k: n * times for k, n in combination.items()})
    assert placed == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(t for t, _ in bins) <= 1.05 * total / 64 + 1  # a heuristic, near the least


def test_packed_sequences(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    whole.encode_special_tokens = True
    more = [(20, "It's A Test'LL <|endoftext|> x"), (21, "Straße ÄÖÜ é 日本語 ΣΑΣ"), (22, "x\x1cy \x7f × ñ'tÑ")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = packing.packed(docs, WORD_BPE, ids=True).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r["doc_id"], n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert packing.packed(no_docs, WORD_BPE).count() == 0


def test_byte_bpe_equals_the_library(spark, odd_docs, no_docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_BPE), special_tokens={})
    rng = random.Random(1)
    texts = ["a   b\n\n  c \t d", "x\n y\n\n z  ", "It's we'LL don't 's", "日本語テスト 😀", "\x1c\x1d a\x85b\xa0 c", "a" * 3000, "<|endoftext|>"]
    texts += ["".join(rng.choice(" \n\tabcdeéß'1.!aaa  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.encoded(docs, BYTE_BPE, public_tokenizers.PATTERN).collect())
    plain = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert found == collections.Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in plain)
    assert bpe.encoded(no_docs, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_merges_of_lower_rank_come_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abab": 299, b"aa": 302, b"aaaa": 303}
    replay = bpe.Replay(ranks)

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not options:
                return [ranks[p] for p in parts]
            i = min(options)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode() for _ in range(400)]
    assert replay(pieces) == [[ranks[p]] if p in ranks else plain(p) for p in pieces]


def brute_top(rows, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(int(np.floor(1024 * np.float64(np.float32(x)))) for x in v))
    out = set()
    for q, vectors in whole.items():
        if q % 10 == 0:
            found = {(-sum(a * b for a, b in zip(v, w)), i) for v in vectors for i, ws in whole.items() if i != q for w in ws if len(v) == len(w)}
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "TREE", 64)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [0.5] * 6) for i in range(150, 260)]  # many ties
    rows += [(300, None), (310, [None] * 6), (320, [float("nan")] * 6), (330, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(340, [1.0, 2.0]), (350, [1.0]), (341, [2.0, 1.0]), (10, rows[10][1]), (360, [1e6] * 6)]
    vectors = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, score int, dim int")
    found = mtree.top_k(vectors, vectors.where("vec_id % 10 = 0"), k=7)
    assert {tuple(r) for r in found.collect()} == brute_top(rows, 7)
    assert mtree.top_k(vectors.where("false"), vectors, k=3).count() == 0


@pytest.fixture(scope="module")
def staged(spark, odd_docs, tmp_path_factory):
    """Each stage's input and output on a small table of documents."""
    extra = odd_docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "score")
    docs, out = extra, []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, "none"), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_take_effect(staged):
    for name, before, after in staged[:-1]:
        assert after.columns == before.columns and after.schema["n_chars"].dataType == before.schema["n_chars"].dataType
    texts = {name: collections.Counter((r["doc_id"], r["text"]) for r in after.collect()) for name, _, after in staged[:-1]}
    assert {i for i, _ in texts["language_id"]} == {1, None, 6, 7, 8}
    assert {i for i, _ in texts["simhash_near_dedup"]} == {1, None, 7, 8} and max(texts["simhash_near_dedup"].values()) == 1
    assert {i for i, _ in texts["pii"]} == {1, None, 7, 8}
    assert next(t for i, t in texts["pii"] if i is None).endswith("mail [EMAIL]")
    packed = staged[-1][2]
    assert {r["doc_id"] for r in packed.collect()} == {1, None, 7, 8} and packed.where("length > 2048").count() == 0


def test_stages_on_an_empty_table(spark, staged):
    docs = staged[0][1].where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "none"), name)
        assert docs.count() == 0


def test_substring_stage_drops_only_what_a_cut_emptied(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{passage} more"), (2, passage), (3, " \n"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.substring_dedup(spark, docs, "none")
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] != 2}
