"""The conversation trie and repair against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from threadloom.llm import queries, repair, trie
from threadloom.session import written

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n int, size int"


def crc(text):
    return zlib.crc32(text.encode())


@pytest.fixture(scope="module")
def conversations(spark):
    """Bases, copies, long and turnless conversations, nulls, ties and repeated rows; clashing columns."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), 100, 105, 107, *range(203, 230), 1_000, *range(301, 310)]:
        lines = ["Hi there.", "Hello!", "what is it", "Well. So?", " ", "", None, "é ü."]
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            text = rng.choice(lines) if c % 3 else f"line {t}."
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "tool"]) if c % 2 else ["user", "assistant"][t % 2], text))
    rows += [(400, t, ["user", "assistant"][t % 2], f"turn {t}" + ".!?"[t % 3] * (t % 7 > 0)) for t in range(300)]
    rows += [(407, None, "system", "No number."), (407, 5, "user", "Five?"), (407, 5, "user", "Five?"), (407, 9, "assistant", "Nine!")]
    rows += [(411, None, "user", "a."), (411, None, "assistant", "b."), (-3, 1, "user", "minus."), (-100, 0, "user", "minus.")]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, 9, 9, 9) for r in rows], SCHEMA)


def key(turn, role, text):
    return (turn is not None, turn or 0, role, text)


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v, key=lambda t: key(*t))] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = crc(str(c)) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    found = set()
    sums = {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves, saved = (0, (len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
        for child in children.get(n, []):
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[n] = (leaves or 1, saved)
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(n))
        found.add((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children.get(n, [])), *sums[n], hashlib.sha256(ends.encode()).hexdigest()))
    return found


def on_table(spark, conversations, tmp_path, query):
    conversations.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return query(spark, str(tmp_path))


def plain_rows(conversations):
    return [tuple(r)[:4] for r in conversations.collect()]


def test_trie_equals_plain_python(spark, conversations, tmp_path):
    found = on_table(spark, conversations, tmp_path, queries.op12_conversation_trie)
    assert found.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(plain_rows(conversations))


@pytest.mark.parametrize("height", [2, 3, 1000])
def test_bands_of_any_height_give_the_same_sums(spark, conversations, height, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 7)
    turns = written(trie.ordered_turns(conversations), "ordered")
    shared, base = F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    found = trie.rolled_up(*trie.rebuilt(turns, shared, base, most=5), height=height)
    assert {tuple(r) for r in found.collect()} == plain_trie(plain_rows(conversations))


def test_trie_of_nothing_and_of_rows_without_conversation(spark, conversations, tmp_path):
    assert on_table(spark, conversations.where("false"), tmp_path, queries.op12_conversation_trie).count() == 0
    nameless = spark.createDataFrame([(None, 0, "user", "x", 1, 1, 1)], SCHEMA)
    assert on_table(spark, nameless, tmp_path, queries.op12_conversation_trie).count() == 0


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        kind = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """The cheapest least audit of one conversation's ordered (turn, role, text), by memoised search."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def onward(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, puts):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        for initial in "ua":
            to = onward(state, initial)
            if to and puts < 2:
                cost, rest = best(i, to, puts + 1)
                ways.append((cost + 3, "I" + rest))
            if to and i < len(rows) and faults[i] not in ("b", "d"):
                cost, rest = best(i + 1, to, 0)
                ways.append((cost + 3 + 3 * (faults[i] == "t"), "R" + rest))
        if i < len(rows):
            cost, rest = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + rest))
            to = onward(state, rows[i][1][:1])
            if to and faults[i] not in ("b", "d"):
                cost, rest = best(i + 1, to, 0)
                ways.append((cost + 3 * (faults[i] == "t"), "K" + rest))
        return min(ways) if ways else (10**9, "")

    cost, audit = best(0, "", 0)
    state, i, text = "", 0, []
    for edit in audit:
        if edit == "K":
            state = rows[i][1][:1]
            text.append(f"{rows[i][1]}:{rows[i][2]}")
        elif edit in "RI":
            state = {"u": "a"}.get(state, "u")
            text.append({"u": "user:", "a": "assistant:"}[state] + (rows[i][2] if edit == "R" else ""))
        i += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(text).encode()).hexdigest(),
    )


def plain_repairs(rows):
    convs = {c: [] for c, *_ in rows}
    for c, turn, role, text in plain_damage(rows):
        convs[c].append((turn, role, text))
    return {(c, *plain_repair(sorted(v, key=lambda t: key(*t)))) for c, v in convs.items()}


def test_repair_equals_memoised_search(spark, conversations, tmp_path):
    extra = spark.createDataFrame([(None, None, None, None, 1, 1, 1), (None, 3, "user", "Who?", 1, 1, 1)], SCHEMA)
    rows = conversations.union(extra)
    found = on_table(spark, rows, tmp_path, queries.op13_conversation_repair)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_repairs(plain_rows(rows))
    assert on_table(spark, rows.where("false"), tmp_path, queries.op13_conversation_repair).count() == 0


@pytest.mark.parametrize("size", [1, 3, 16])
def test_blocks_of_any_size_give_the_same_repair(spark, conversations, size):
    rows = repair.ordered_rows(repair.damaged(conversations))
    found = written(repair.solved(written(repair.blocks_of(rows, size), "blocks")), "solved")
    got = {r["conv"]: (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in repair.summaries(found).collect()}
    want = {str(c): rest[:-1] for c, _, *rest in plain_repairs(plain_rows(conversations))}
    assert got == {c: tuple(w) for c, w in want.items() if c in got} and len(got) > 40
    mended = repair.repaired(rows, found).groupBy("conv").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "sub", F.substring("role", 1, 1).alias("i")))).getField("i"), "").alias("i"))
    assert all(re.fullmatch("(s?(ua)+)?", r["i"]) for r in mended.collect())
