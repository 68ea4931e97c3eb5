"""Cheapest repair of conversation structure, with the least audit by prefix doubling.

A conversation is read by an automaton over role initials that accepts ``(s?(ua)+)?``: states are the
start (0), after s (1), after u (2) and after a (3). Edits are arcs from (row, state) to (row, state);
a cost programme from the end gives every node its cost to go, and arcs on cheapest ways are optimal.
Nodes are then ranked by the labels of their least ways over 1, 2, 4, ... edits: a rank of the next
length is that of (rank here, rank at the doubled pointer). The final ranks stand for whole audits;
each different one is read off once, over the doubled pointers.

Long conversations are cut into blocks of ``BLOCK`` rows. A block is a 4 x 4 matrix of least costs,
and suffix products by doubling give each block the cost to go at its end; its ways lead from state
to state, and the same doubling finds the state in which the chosen way enters it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import mapped, with_computed
from threadloom.llm.ordered import digests, earlier_sum, in_order
from threadloom.session import written

BLOCK = 4096
SPACE = " \t\n\x0b\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Cost to go after the last row: nothing from the start or after a, else the turns still missing.
AT_END = [0, 2 * INSERT, INSERT, 0]
FAR = 1 << 40
#: The state a rerole or insert leads to, and the label of each edit in ASCII order.
NEXT = (2, 2, 3, 2)
LABELS = "DIKR"


def _steps(inits: np.ndarray, faults: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row place of all blocks: (present, delete only, keep target or -1 per state, cost of staying truncated)."""
    for i in range(inits.shape[1]):
        init, fault = inits[:, i], faults[:, i]
        keep = np.full((len(init), 4), -1)
        keep[init == 1, 0] = 1
        for state in (0, 1, 3):
            keep[init == 2, state] = 2
        keep[init == 3, 2] = 3
        yield init >= 0, (fault == 1) | (fault == 2), keep, np.where(fault == 3, TRUNCATED, 0)


def block_matrices(inits: np.ndarray, faults: np.ndarray) -> np.ndarray:
    """Least costs (block, state before, state after) of the rows of each block; rows below 0 are padding."""
    rows = np.arange(len(inits))
    cost = np.where(np.eye(4, dtype=bool), 0, FAR)[None].repeat(len(inits), 0)
    for present, doomed, keep, extra in _steps(inits, faults):
        open_ = cost.copy()
        open_[:, :, 2] = np.minimum(cost[:, :, 2], INSERT + cost[:, :, [0, 1, 3]].min(2))
        open_[:, :, 3] = np.minimum(cost[:, :, 3], INSERT + open_[:, :, 2])
        after = open_ + DELETE
        for state in range(4):
            stay = np.where(doomed, FAR, extra)[:, None] + open_[:, :, state]
            after[:, :, NEXT[state]] = np.minimum(after[:, :, NEXT[state]], stay + REROLE)
            to = np.maximum(keep[:, state], 0)
            kept = np.where((keep[:, state] >= 0)[:, None], stay, FAR)
            after[rows, :, to] = np.minimum(after[rows, :, to], kept)
        cost = np.where(present[:, None, None], after, cost)
    return np.minimum(cost, FAR)


def optimal_arcs(inits: np.ndarray, faults: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost to go, label, pointer) of nodes (block, row place, state): the least optimal arc of each.

    The arcs out of a node have different labels, so the least label is one arc. Label 0 is an end,
    which points to itself. ``ends`` are costs to go behind the block, ``last`` whether nothing follows.
    """
    count, width = inits.shape
    go = np.zeros((count, width + 1, 4), np.int64)
    label = np.zeros(go.shape, np.int64)
    node = np.arange(go.size).reshape(go.shape)
    pointer = node.copy()
    rows = np.arange(count)
    go[:, width] = ends
    for state in (1, 2):  # behind the last row only the missing turns are inserted
        label[:, width, state] = np.where(last, 2, 0)
        pointer[:, width, state] = np.where(last, node[:, width, NEXT[state]], node[:, width, state])
    for i, (present, doomed, keep, extra) in zip(range(width - 1, -1, -1), reversed(list(_steps(inits, faults)))):
        ahead = go[:, i + 1]
        stay = np.where(doomed, FAR, extra)
        gone = DELETE + ahead
        kept = np.where(keep >= 0, stay[:, None] + ahead[rows[:, None], np.maximum(keep, 0)], FAR)
        moved = REROLE + stay[:, None] + ahead[:, list(NEXT)]
        base = np.minimum(np.minimum(gone, kept), moved)
        best = base.copy()
        best[:, 2] = np.minimum(base[:, 2], INSERT + base[:, 3])
        best[:, 3] = np.minimum(base[:, 3], INSERT + base[:, 2])
        best[:, 0] = np.minimum(base[:, 0], INSERT + best[:, 2])
        best[:, 1] = np.minimum(base[:, 1], INSERT + best[:, 2])
        put = INSERT + best[:, list(NEXT)]
        chosen = np.select([gone == best, put == best, kept == best], [1, 2, 3], 4)
        to = np.select(
            [chosen == 1, chosen == 2, chosen == 3],
            [node[:, i + 1], node[:, i][:, list(NEXT)], node[rows[:, None], i + 1, np.maximum(keep, 0)]],
            node[:, i + 1][:, list(NEXT)],
        )
        go[:, i] = np.where(present[:, None], best, ahead)
        label[:, i] = np.where(present[:, None], chosen, 0)
        pointer[:, i] = np.where(present[:, None], to, node[:, i])
    return go, label, pointer


def ranked_ways(label: np.ndarray, pointer: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The least audit from every start, and the node where it ends, by prefix doubling.

    ``rank`` orders all nodes by their least ways over 1, 2, 4, ... edits until every way has ended;
    then starts of one rank have the same audit, which is read off for one of them.
    """
    rank, doubled = label.ravel().copy(), [pointer.ravel()]
    while (rank[doubled[-1]] > 0).any():
        at = doubled[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[at], return_inverse=True)[1].reshape(-1)
        rank += 1
        rank[label.ravel() == 0] = 0
        doubled.append(at[at])
    _, which, of = np.unique(rank[starts], return_index=True, return_inverse=True)
    way = starts[which][:, None]
    for at in doubled:
        way = np.concatenate((way, at[way]), axis=1)
    text = np.frombuffer(b"\0" + LABELS.encode(), np.uint8)[label.ravel()[way]]
    audits = [row.tobytes().rstrip(b"\0") for row in text]
    return [audits[i] for i in of.reshape(-1)], doubled[-1][starts]


def _padded(codes: list[str], fill: int) -> np.ndarray:
    """Digit strings as rows of one matrix, padded in front."""
    out = np.full((len(codes), max(map(len, codes))), fill, np.int64)
    for row, c in zip(out, codes):
        row[len(row) - len(c) :] = np.frombuffer(c.encode(), np.uint8) - 48
    return out


def _by_length(codes: list[str]) -> Iterator[list[int]]:
    """Numbers of rows whose lengths differ by less than half."""
    kinds: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        kinds.setdefault(len(c).bit_length(), []).append(i)
    for bits, members in kinds.items():
        size = max(1, 200_000 >> bits)
        for low in range(0, len(members), size):
            yield members[low : low + size]


def _matrices() -> Callable:
    def work(inits: list, faults: list) -> tuple:
        out: list = [None] * len(inits)
        for part in _by_length(inits):
            found = block_matrices(_padded([inits[i] for i in part], -1), _padded([faults[i] for i in part], 0))
            for i, m in zip(part, found.reshape(len(part), 16).tolist()):
                out[i] = m
        return (out,)

    return work


def _ways() -> Callable:
    def work(inits: list, faults: list, ends: list, last: list) -> tuple:
        cost, exits, audits = ([None] * len(inits) for _ in range(3))
        for part in _by_length(inits):
            a, b = _padded([inits[i] for i in part], -1), _padded([faults[i] for i in part], 0)
            go, label, pointer = optimal_arcs(a, b, np.array([ends[i] for i in part], np.int64), np.array([last[i] for i in part], bool))
            width = a.shape[1]
            first = width - np.array([len(inits[i]) for i in part])
            starts = ((np.arange(len(part)) * (width + 1) + first)[:, None] * 4 + np.arange(4)).ravel()
            found, stops = ranked_ways(label, pointer, starts)
            for n, i in enumerate(part):
                cost[i] = go[n, first[n]].tolist()
                exits[i] = (stops[4 * n : 4 * n + 4] % 4).tolist()
                audits[i] = "|".join(x.decode() for x in found[4 * n : 4 * n + 4])
        return cost, exits, audits

    return work


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults planted by a checksum of id and turn.

    Nulls become one space. Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out its
    ``.!?``, 3 repeats it, 4 makes its role user.
    """
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, blank = F.crc32(key) % 20, F.lit(" ")
    text = F.coalesce("text", blank)
    marked = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where(F.col("kind") != 0)
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.coalesce("role", blank))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int")))
    return marked.select("conv_id", "turn", role.alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(conv, at, turn, role, text, init, tail, c1, c2): rows by conversation and turn, stored.

    ``at`` counts the rows of the whole table, so a conversation has neighbouring numbers. Nulls of
    ``turn`` come first, ties go by role and text. ``conv`` is the id as text, empty for a null id;
    a null role or text is empty. ``tail`` is the fault a row shows by itself: 1 blank, 3 truncated.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", role.alias("role"), text.alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    tail = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    init = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    marked = named.select(
        "*", tail.alias("tail"), init.alias("init"), F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64(F.lit(2), "role", "text").alias("c2")
    )
    stored = in_order(marked, [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "rows")
    ahead = earlier_sum(stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part", "n", "ahead").drop("n")
    return stored.join(F.broadcast(ahead), "part").withColumn("at", F.col("ahead") + F.col("idx")).drop("part", "idx", "ahead")


def blocks_of(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of ``ordered_rows`` as blocks of at most ``size`` neighbours: codes of initials and faults.

    A row repeats if an earlier one of its conversation has its role and text, told by two hashes.
    """
    firsts = rows.groupBy("conv", "c1", "c2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    small = rows.select("conv", "at", "init", "tail").join(firsts, "at", "left")
    fault = F.when(F.col("tail") == 1, 1).when(F.col("new").isNull(), 2).otherwise(F.col("tail"))
    row = F.struct("at", F.col("init").cast("string").alias("init"), fault.cast("string").alias("fault"))
    held = small.groupBy("conv", F.floor(F.col("at") / size).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("held"))
    coded = held.select(
        "conv", "block", F.col("held.at").alias("ats"), F.array_join("held.init", "").alias("inits"), F.array_join("held.fault", "").alias("faults")
    )
    ends = Window.partitionBy("conv")
    border = F.concat(F.lag(F.substring("inits", -1, 1)).over(ends.orderBy("block")), F.substring("inits", 1, 1))
    legal = ["12", "23", "32"]
    pairs = F.transform(F.sequence(F.lit(1), F.length("inits")), lambda i: F.substr("inits", i, F.lit(2)))
    inside = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(legal)))
    return coded.select(
        "*", F.min("block").over(ends).alias("lo"), F.max("block").over(ends).alias("hi"),
        (inside + F.coalesce((~border.isin(legal)).cast("int"), F.lit(0))).cast("bigint").alias("illegal"),
    )


def _product(a: str, b: str) -> Column:
    return F.array(*[F.least(*[F.col(a)[4 * p + m] + F.col(b)[4 * m + q] for m in range(4)], F.lit(FAR)) for p in range(4) for q in range(4)])


def _costs_behind(blocks: DataFrame, rounds: int) -> DataFrame:
    """(conv, block, ends): the cost to go behind each block but the last, by doubled suffix products."""
    matrices = with_computed(blocks.select("conv", "block", "inits", "faults"), ["inits", "faults"], [("cost", "longs")], _matrices)
    now = written(matrices.select("conv", "block", "cost"), "matrices")
    for k in range(rounds):
        ahead = now.select("conv", (F.col("block") - (1 << k)).alias("block"), F.col("cost").alias("ahead"))
        longer = F.when(F.col("ahead").isNull(), F.col("cost")).otherwise(_product("cost", "ahead"))
        now = written(now.join(ahead, ["conv", "block"], "left").select("conv", "block", longer.alias("cost")), "suffixes")
    go = F.array(*[F.least(*[F.col("cost")[4 * p + q] + AT_END[q] for q in range(4)]) for p in range(4)])
    return now.select("conv", (F.col("block") - 1).alias("block"), go.alias("behind"))


def _entered(ways: DataFrame, rounds: int) -> DataFrame:
    """(conv, block, state) in which the least way enters each block, over doubled pointers."""
    states = ways.where(F.col("block") == F.col("lo")).select("conv", "block", F.lit(0).alias("state"))
    jumps = ways.where(F.col("block") < F.col("hi")).select("conv", "block", "exits")
    for k in range(rounds):
        further = states.join(jumps, ["conv", "block"]).select("conv", (F.col("block") + (1 << k)).alias("block"), F.col("exits")[F.col("state")].alias("state"))
        states = written(states.union(further), "states")
        ahead = jumps.select("conv", (F.col("block") - (1 << k)).alias("block"), F.col("exits").alias("ahead"))
        twice = F.transform("exits", lambda s: F.col("ahead")[s])
        jumps = written(jumps.join(ahead, ["conv", "block"]).select("conv", "block", twice.alias("exits")), "jumps")
    return states


def solved(blocks: DataFrame) -> DataFrame:
    """Stored ``blocks`` with the state the least way enters them in, its ``audit`` there and ``cost`` (first block).

    ``cost`` is that of the whole conversation; other blocks have 0.
    """
    widest = blocks.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    rounds = int(widest).bit_length()
    final = F.array(*[F.lit(c).cast("bigint") for c in AT_END])
    if rounds:
        behind = _costs_behind(blocks.where(F.col("lo") < F.col("hi")), rounds)
        ended = blocks.join(behind, ["conv", "block"], "left").withColumn("ends", F.coalesce("behind", final)).drop("behind")
    else:
        ended = blocks.withColumn("ends", final)
    last = (F.col("block") == F.col("hi")).cast("int")
    fields = [("cost", "longs"), ("exits", "ints"), ("audits", "string")]
    ways = written(with_computed(ended.withColumn("last", last), ["inits", "faults", "ends", "last"], fields, _ways), "ways")
    chosen = ways.join(_entered(ways, rounds), ["conv", "block"])
    cost = F.when(F.col("block") == F.col("lo"), F.col("cost")[0]).otherwise(0)
    return chosen.withColumn("audit", F.split("audits", "\\|")[F.col("state")]).withColumn("cost", cost).drop("audits", "exits", "ends", "last")


def summaries(found: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit) of stored ``solved`` blocks."""
    faults = [F.sum(F.length(F.regexp_replace("faults", f"[^{code}]", ""))).cast("bigint").alias(name) for code, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit"))).getField("audit"), "")
    return found.groupBy("conv").agg(*faults, F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))


def _edits(found: DataFrame) -> DataFrame:
    """(at, ahead, edit, init, after) per row: inserted initials before and behind it, and its own edit."""
    fields = [("at", "long"), ("ahead", "string"), ("edit", "string"), ("init", "string"), ("after", "string")]
    return mapped(found, ["ats", "audit", "state", "inits"], fields, lambda: _read)


def _read(ats: list, audits: list, states: list, inits: list) -> Iterator[tuple]:
    for places, audit, state, codes in zip(ats, audits, states, inits):
        ahead, edits, roles, waiting, row = [], [], [], "", 0
        for label in audit:
            if label == "D":
                role = ""
            elif label == "K":
                state, role = int(codes[row]), ""
            else:
                state = NEXT[state]
                role = " sua"[state]
            if label == "I":
                waiting += role
                continue
            ahead.append(waiting)
            edits.append(label)
            roles.append(role)
            waiting, row = "", row + 1
        yield places, ahead, edits, roles, [""] * (len(places) - 1) + [waiting]


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, at, sub, role, text): the rows after repair, in order of (at, sub) within a conversation.

    Inserted turns have an empty text; a kept or reroled row keeps its text.
    """
    def turns(column: str) -> Column:
        codes = F.filter(F.split(column, ""), lambda c: c != "")
        return F.transform(codes, lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("init") == "u", "user").otherwise("assistant")
    own = F.when(F.col("edit") == "D", F.expr("cast(array() as array<struct<role:string,text:string>>)")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    edited = rows.select("conv", "at", "role", "text").join(_edits(found), "at")
    pieces = edited.select("conv", "at", F.posexplode(F.concat(turns("ahead"), own, turns("after"))).alias("sub", "piece"))
    return pieces.select("conv", "at", "sub", "piece.role", "piece.text")
