"""Fuzzy repeated passages by seeding, collinear chaining and alignment.

Seeds are the k-mers of words in one of ``rate`` hash classes, which all texts choose alike: a passage
of ``n`` words with ``e`` edits keeps ``n - k + 1 - k e`` k-mers at least, and one in ``rate`` of them is a
seed. Long seeds, sampled as window minima so that every intact run of ``min_words`` holds one, keep
the partner of a verbatim passage whose k-mers all stand elsewhere too. Every holder of a seed is
paired with the seed's first holder and with the one before it in id order, so n holders give at most
2 n - 3 pairs. Matches of a document pair are chained by a Fenwick tree over positions with linear gap
costs; a chain has to cover ``evidence`` words or hold a long seed.
Chains are aligned on their words; a chain below the wanted identity is split at its largest
gap. Pieces count from ``min_words`` on, which one other document has to hold in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import arrow_schema, by_size, evenly, mapped, spark_schema, with_computed
from threadloom.session import removed, written


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a word that crosses the end of a piece is taken into the next one.
_PIECE = 1 << 20


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.r_[True, _SPACE[raw], True].astype(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    size = 1 << max(10, len(raw).bit_length())
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(raw)])]
    out = (sums[end] - sums[start]) * _powers(_INVERSE, size)[start]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


def hashes_of(text: str | None) -> np.ndarray:
    """A hash of each word between ASCII white space, ASCII letters lower-cased: its letters as a polynomial, mixed."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    found, low = [], 0
    while low < len(data):
        high = min(len(data), low + _PIECE)
        while high < len(data) and not _SPACE[data[high]]:
            high += 1
        found.append(_word_hashes(data[low:high]))
        low = high
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words."""
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _numbered(own: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(own, kind="stable")
    fresh = np.r_[True, np.diff(own[order]) > 0][: len(own)]
    turn = np.empty(len(own), np.uint64)
    turn[order] = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    again = turn > 0
    # The n-th occurrence meets the n-th of another text, and every occurrence its first.
    seeds = np.concatenate((own + turn * np.uint64(0xC2B2AE3D27D4EB4F), own[again]))
    return seeds.view(np.int64), np.concatenate((places, places[again])).astype(np.int32)


def _over_windows(least: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``least`` over every window of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


def seeds_of(text: str | None, k: int, min_words: int, rate: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of one in ``rate`` k-mers, by hash, and of the long seeds.

    The place is twice the word position, and one more for a long seed.
    """
    words = hashes_of(text)
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    short = _shingles(words, k)
    chosen = np.flatnonzero((short >> np.uint64(33)) % np.uint64(rate) == 0)
    found = [_numbered(short[chosen], 2 * chosen)]
    long = min_words // 2
    window = min_words - long + 1
    if long > k and len(words) >= min_words:
        runs = _shingles(words, long)
        low = np.uint64((1 << 20) - 1)
        ranked = (runs & ~low) | (np.arange(len(runs), dtype=np.uint64) & low)  # of equal runs the first is the least
        least = _over_windows(np.minimum, ranked, window)
        # A run is the least of some window if the greatest of these minima around it is the run itself.
        around = np.concatenate((np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)))
        chosen = np.flatnonzero(_over_windows(np.maximum, around, window) == ranked)
        found.append(_numbered(runs[chosen], 2 * chosen + 1))
    return tuple(np.concatenate(c) for c in zip(*found))


def _seeds(docs: DataFrame, k: int, min_words: int, rate: int, hot: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """(seed, slice, doc_id, pos); slice is 0 but for hot seeds, whose holders are dealt by id over 1, 2, ..."""
    def make() -> Callable:
        def work(keys: list, texts: list) -> Iterator[tuple]:
            for part in by_size([len(t or "") for t in texts], 2_000_000):
                found = [seeds_of(t, k, min_words, rate) for t in texts[part]]
                sizes = [len(f[0]) for f in found]
                if sum(sizes):
                    seed, doc = np.concatenate([f[0] for f in found]), np.repeat(np.array(keys[part], np.int64), sizes)
                    dealt = np.where(np.isin(seed, hot), 1 + np.searchsorted(cuts, doc), 0)
                    yield pa.array(seed), pa.array(dealt.astype(np.int32)), pa.array(doc), pa.array(np.concatenate([f[1] for f in found]))

        return work

    return mapped(docs, ["doc_id", "text"], [("seed", "long"), ("slice", "int"), ("doc_id", "long"), ("pos", "int")], make)


#: Documents looked at to find hot seeds, the share of them that makes a seed hot, the most hot seeds and their slices.
LOOKED_AT, HOT_SHARE, HOT_SEEDS, SLICES = 2000, 0.01, 4096, 16


def _hot_seeds(docs: DataFrame, k: int, min_words: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that many documents of a bounded sample hold, and ids that cut the sample into slices.

    They only place rows: a seed that is missed here stays in one task, with the same result.
    """
    count = docs.count()
    sample = docs.sample(min(1.0, LOOKED_AT / max(count, 1)), seed=1) if count > LOOKED_AT else docs
    none = np.empty(0, np.int64)
    seeds = _seeds(sample, k, min_words, rate, none, none)
    held = seeds.groupBy("seed").agg(F.count_distinct("doc_id").alias("n"))
    least = max(16, int(HOT_SHARE * min(count, LOOKED_AT)))
    rows = held.where(F.col("n") >= least).orderBy(F.desc("n"), "seed").limit(HOT_SEEDS).collect()
    cuts = sample.approxQuantile("doc_id", [i / SLICES for i in range(1, SLICES)], 0.01) if rows else []
    return np.sort(np.array([r["seed"] for r in rows], np.int64)), np.unique(np.array(cuts, np.int64))


LINK = [("doc_id", "long"), ("pos", "int"), ("first_id", "long"), ("first_pos", "int"), ("before_id", "long"), ("before_pos", "int")]


def _links(seeds: DataFrame) -> DataFrame:
    """Every place of a seed with the seed's first holder and the holder before it in id order.

    A seed, or one slice of a hot one, is sorted by id in one task and read as a stream. What lies in
    earlier slices of a hot seed is filled in afterwards from one row per slice.
    """
    link = [n for n, _ in LINK]
    fields = [*LINK, ("seed", "long"), ("slice", "int")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(fields)
        carried: list[tuple] = []  # the first and the last holder of the current group

        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(carried)
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            seed, dealt, doc, pos = (np.concatenate((np.array([c[i] for c in carried], a.dtype), a)) for i, a in enumerate(rows))
            at = np.arange(len(seed))
            fresh = np.r_[True, (seed[1:] != seed[:-1]) | (dealt[1:] != dealt[:-1])]
            holder = fresh | np.r_[True, doc[1:] != doc[:-1]]
            head = np.maximum.accumulate(np.where(fresh, at, 0))
            own = np.maximum.accumulate(np.where(holder, at, 0))
            before = np.where(own > head, np.r_[0, own[:-1]][own], -1)
            carried = [tuple(int(c[i]) for c in (seed, dealt, doc, pos)) for i in (head[-1], own[-1])]
            keep = (at >= n) & ((own > head) | (dealt > 0))
            if keep.any():
                h, b, cold = head[keep], before[keep], dealt[keep] == 0
                columns = [
                    pa.array(doc[keep]), pa.array(pos[keep]), pa.array(doc[h]), pa.array(pos[h]), pa.array(doc[b], mask=b < 0),
                    pa.array(pos[b], mask=b < 0), pa.array(seed[keep], mask=cold), pa.array(dealt[keep], mask=cold),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    dealt = evenly(seeds, "seed", "slice").sortWithinPartitions("seed", "slice", "doc_id", "pos")
    found = written(dealt.mapInArrow(run, spark_schema(fields)), "links")
    hot = found.where(F.col("seed").isNotNull())
    last = F.max(F.struct("doc_id", (-F.col("pos")).alias("back"))).alias("last")
    groups = hot.groupBy("seed", "slice").agg(F.min(F.struct("first_id", "first_pos")).alias("lead"), last)
    ahead = Window.partitionBy("seed").orderBy("slice")
    lead, end = F.first("lead").over(ahead).alias("lead"), F.lag("last").over(ahead).alias("last")
    edges = groups.select("seed", "slice", lead, end).orderBy("seed", "slice").collect()  # at most HOT_SEEDS * SLICES rows
    if not edges:
        return found.select(*link)
    keys = np.array([(r["seed"], r["slice"]) for r in edges], [("seed", np.int64), ("slice", np.int32)])
    firsts = np.array([tuple(r["lead"]) for r in edges], np.int64)
    befores = np.array([(r["last"][0], -r["last"][1], 1) if r["last"] else (0, 0, 0) for r in edges], np.int64)

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(LINK)
        for batch in batches:
            doc, pos, first_id, first_pos, before_id, before_pos = (batch.column(i) for i in range(6))
            cut = np.asarray(batch.column(6).is_valid())
            own = np.zeros(batch.num_rows, keys.dtype)
            own["seed"], own["slice"] = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (6, 7))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            lead = [np.where(cut, firsts[at, i], c.to_numpy(zero_copy_only=False)) for i, c in enumerate((first_id, first_pos))]
            lost = np.asarray(before_id.is_null())
            last = [np.where(lost, befores[at, i], c.fill_null(0).to_numpy(zero_copy_only=False)) for i, c in enumerate((before_id, before_pos))]
            keep = pa.array(~lost | (befores[at, 2] == 1))
            columns = [doc, pos, *[pa.array(c) for c in (*lead, *last)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type).filter(keep) for c, f in zip(columns, schema)], schema=schema)

    return found.mapInArrow(filled, spark_schema(LINK)).where(F.col("first_id") < F.col("doc_id"))


def chains(x: np.ndarray, y: np.ndarray, k: int, gap: float, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Collinear chains of matches (x, y), best first; each match is in one chain at most.

    The score of a chain is k per match less ``gap`` per word between neighbours on either side. The
    best predecessor of a match is a prefix maximum over y, kept in a Fenwick tree. Chains are cut
    where neighbours are more than ``reach`` words apart.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if len(x) == 1 or (np.all(np.diff(x) > 0) and np.all(np.diff(y) > 0) and gap * 2 * reach < k):
        tracks: Iterable[np.ndarray] = [np.arange(len(x))]  # every match's best predecessor is its neighbour
    else:
        tracks = _tracks(x, y, k, gap)
    for track in tracks:
        cuts = np.flatnonzero((np.diff(x[track]) > reach) | (np.diff(y[track]) > reach)) + 1
        for part in np.split(track, cuts):
            yield x[part], y[part]


def _tracks(x: np.ndarray, y: np.ndarray, k: int, gap: float) -> Iterator[np.ndarray]:
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    best, holder = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    starts = np.flatnonzero(np.r_[True, np.diff(x) > 0])
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
        for i in range(low, high):  # look up first: matches at the same x don't follow each other
            at, top, who = int(ranks[i]) - 1, float("-inf"), -1
            while at:
                if best[at] > top:
                    top, who = best[at], holder[at]
                at &= at - 1
            linked = top - gap * float(x[i] + y[i])
            score[i], before[i] = (k + linked, who) if linked > 0 else (float(k), -1)
        for i in range(low, high):
            at, value = int(ranks[i]), score[i] + gap * float(x[i] + y[i])
            while at <= size:
                if value > best[at]:
                    best[at], holder[at] = value, i
                at += at & -at
    used = [False] * len(x)
    for end in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        track = []
        while end >= 0 and not used[end]:
            used[end] = True
            track.append(end)
            end = before[end]
        if track:
            yield np.array(track[::-1])


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns, from sorted batches of integer columns."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if rest is not None:
            columns = [np.concatenate((a, b)) for a, b in zip(rest, columns)]
        if not len(columns[0]):
            continue
        changed = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:keys]:
            changed |= c[1:] != c[:-1]
        cuts = np.flatnonzero(changed) + 1
        bounds = [0, *cuts.tolist()]
        for low, high in zip(bounds, bounds[1:]):
            yield [c[low:high] for c in columns]
        rest = [c[bounds[-1] :] for c in columns]
    if rest is not None:
        yield rest


CHAIN = [("doc_id", "long"), ("source_id", "long"), ("x", "ints"), ("y", "ints"), ("d0", "int"), ("d1", "int"), ("s0", "int"), ("s1", "int")]


#: Matches of a document pair up to which all pairs of them are looked at before chaining.
NEAR = 4


def _covered(x: np.ndarray, y: np.ndarray, k: int) -> int:
    """Words that the matches of a chain cover on both sides."""
    return k + int(np.minimum(k, np.minimum(np.diff(x), np.diff(y))).sum())


def _chained(links: DataFrame, k: int, min_words: int, evidence: int, gap: float, reach: int, margin: int = 8) -> DataFrame:
    """Chains that cover ``evidence`` words or hold a long seed, with the word ranges needed to align them, on a coarse grid."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = arrow_schema(CHAIN), []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return made

        for doc, pos, first_id, first_pos, before_id, before_pos in _grouped(batches, 1):
            other = before_id != first_id
            x, y = np.concatenate((pos, pos[other])), np.concatenate((first_pos, before_pos[other]))
            source = np.concatenate((first_id, before_id[other]))
            order = np.lexsort((y, x, source))
            x, y, source = x[order], y[order], source[order]
            fresh = np.r_[True, (source[1:] != source[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            x, y, source = x[fresh], y[fresh], source[fresh]
            starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
            ends = np.r_[starts[1:], len(x)]
            worth = np.logical_or.reduceat(x % 2 == 1, starts) | (ends - starts > NEAR)
            near = np.zeros(len(x), bool)
            for step in range(1, NEAR + 1):  # two matches that can follow each other in a chain
                dx, dy = x[step:] // 2 - x[:-step] // 2, y[step:] // 2 - y[:-step] // 2
                near[step:] |= (source[step:] == source[:-step]) & (dx > 0) & (dx <= reach) & (dy > 0) & (dy <= reach)
            apart = np.r_[False, np.minimum(np.diff(x // 2), np.diff(y // 2)) + k >= evidence]
            worth |= np.logical_or.reduceat(near, starts) & ((ends - starts > 2) | np.logical_or.reduceat(near & apart, starts))
            for low, high in zip(*(e[worth].tolist() for e in (starts, ends))):
                gx, gy = x[low:high] // 2, y[low:high] // 2
                sure = set(gx[x[low:high] % 2 == 1].tolist())
                points = np.unique(np.stack((gx, gy)), axis=1) if sure else (gx, gy)
                for cx, cy in chains(*points, k, gap, reach):
                    if _covered(cx, cy, k) < evidence and sure.isdisjoint(cx.tolist()):
                        continue
                    ranges = []
                    for c in (cx, cy):
                        ranges += [max(0, int(c[0]) - min_words) // margin * margin, -(-(int(c[-1]) + k + min_words) // margin) * margin]
                    rows.append((int(doc[0]), int(source[low]), cx.tolist(), cy.tolist(), *ranges))
                    if len(rows) >= 4096:
                        yield flush()
        if rows:
            yield flush()

    placed = links.repartition("doc_id").sortWithinPartitions("doc_id")
    return placed.mapInArrow(run, spark_schema(CHAIN))


def _slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, low, high, words) with the word hashes of the wanted ranges, one row per distinct range."""
    lists = wanted.distinct().groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    texts = docs.join(lists, docs["doc_id"] == lists["id"]).select("id", "text", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"))

    def make() -> Callable:
        def work(ids: list, texts: list, lows: list, highs: list) -> Iterator[tuple]:
            for i, text, low, high in zip(ids, texts, lows, highs):
                hashes = hashes_of(text).astype(np.uint32)
                yield [i] * len(low), low, high, [hashes[a:b].tobytes() for a, b in zip(low, high)]

        return work

    return mapped(texts, ["id", "text", "low", "high"], [("id", "long"), ("low", "int"), ("high", "int"), ("words", "binary")], make)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the best alignment of two word sequences (bit-parallel longest common subsequence)."""
    if np.array_equal(a, b):
        return len(a)
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & places.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _extended(same: np.ndarray, drop: int = 12) -> tuple[int, int]:
    """(words, score) of the best end of a run of equal (1) and other (0) words: +1 and -3, until it drops."""
    if not len(same):
        return 0, 0
    score = np.cumsum(np.where(same, 1, -3))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score >= drop)
    score = score[: low[0]] if len(low) else score
    return (int(score.argmax()) + 1, int(score.max())) if len(score) and score.max() > 0 else (0, 0)


def _carried(a: np.ndarray, b: np.ndarray, shift: int = 3) -> tuple[int, int]:
    """How far both word sequences go on alike from their start, over inserted and lost words."""
    i = j = 0
    while True:
        best = (0, 0, 0)
        for da, db in [(0, 0), *[(d, 0) for d in range(1, shift + 1)], *[(0, d) for d in range(1, shift + 1)]]:
            n = min(len(a) - i - da, len(b) - j - db)
            if n > 0 and (da == db or a[i + da] == b[j + db]):
                ahead, score = _extended(a[i + da : i + da + n] == b[j + db : j + db + n])
                if score - 3 * (da + db) > best[0]:
                    best = (score - 3 * (da + db), da + ahead, db + ahead)
        if not best[0]:
            return i, j
        i, j = i + best[1], j + best[2]


def _widened(left: np.ndarray, right: np.ndarray, size: int, same: int, min_words: int, identity: float) -> tuple[int, int]:
    """Words to add on either side, ending in equal words, so that ``min_words`` are reached at ``identity``."""
    sides = [np.r_[0, np.flatnonzero(side) + 1] for side in (left, right)]
    total = size + sides[0][:, None] + sides[1][None, :]
    alike = same + np.arange(len(sides[0]))[:, None] + np.arange(len(sides[1]))[None, :]
    fits = np.where((total >= min_words) & (alike >= identity * total - 1e-9), total, np.iinfo(np.int64).max)
    i, j = np.unravel_index(int(fits.argmin()), fits.shape)
    return (int(sides[0][i]), int(sides[1][j])) if fits[i, j] < np.iinfo(np.int64).max else (0, 0)


def aligned(
    x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, a0: int, b0: int, k: int, identity: float, min_words: int
) -> Iterator[tuple[int, int, int, int, float]]:
    """Pieces (start, end, source start, source end, identity) of a chain, ends exclusive.

    ``a`` and ``b`` hold the words from ``a0`` and ``b0`` on. Ends are first carried on, over inserted
    and lost words; a piece that stays short is widened along its diagonals if the identity allows it.
    A piece below ``identity`` is split at its largest gap. One match alone has to give ``min_words``.
    """
    start, end, source, stop = int(x[0]) - a0, int(x[-1]) + k - a0, int(y[0]) - b0, int(y[-1]) + k - b0
    (left, before), (right, after) = _carried(a[:start][::-1], b[:source][::-1]), _carried(a[end:], b[stop:])
    start, source, end, stop = start - left, source - before, end + right, stop + after
    same = common(a[start:end], b[source:stop])
    size = max(end - start, stop - source)
    if same >= identity * size - 1e-9 and min(end - start, stop - source) < min_words:
        n, m = min(start, source, min_words), min(len(a) - end, len(b) - stop, min_words)
        before, after = a[start - n : start][::-1] == b[source - n : source][::-1], a[end : end + m] == b[stop : stop + m]
        left, right = _widened(before, after, size, same, min_words, identity)
        start, source, end, stop = start - left, source - left, end + right, stop + right
        same, size = same + int(before[:left].sum() + after[:right].sum()), size + left + right
    if same >= identity * size - 1e-9:
        if len(x) > 1 or end - start >= min_words:
            yield start + a0, end + a0, source + b0, stop + b0, round(same / max(size, 1), 6)
    elif len(x) > 1:
        cut = int(np.maximum(np.diff(x), np.diff(y)).argmax()) + 1
        yield from aligned(x[:cut], y[:cut], a, b, a0, b0, k, identity, min_words)
        yield from aligned(x[cut:], y[cut:], a, b, a0, b0, k, identity, min_words)


#: Words that insertions may shift a passage by, and words short of the identity, in the test before alignment.
DRIFT, SPARE = 2, 4


def hopeful(
    xs: list, ys: list, own: list[np.ndarray], theirs: list[np.ndarray], a0: list[int], b0: list[int], k: int, identity: float, min_words: int
) -> np.ndarray:
    """Which chains may lie in a passage of ``min_words``: enough words recur near their place in the source.

    A word recurs if it stands within ``DRIFT`` words of the same distance from the chain's first match
    (left of it) or last one (right of it). Chains longer than a passage are not judged.
    """
    side, width = min_words, 2 * min_words
    mine = np.zeros((len(xs), width), np.uint32)
    other = np.ones((len(xs), width + 2 * DRIFT), np.uint32)
    short, inner = np.zeros(len(xs), bool), np.zeros(len(xs), np.int64)
    for n, (x, y, a, b, at, by) in enumerate(zip(xs, ys, own, theirs, a0, b0)):
        span = x[-1] - x[0] + k
        if span > min_words or len(a) == 0:
            continue
        short[n], inner[n] = True, span
        i, j = x[0] - at, y[0] - by
        left = min(side, i)
        mine[n, side - left : side] = a[i - left : i]
        lead = min(side + DRIFT, j)
        other[n, side + DRIFT - lead : side + DRIFT] = b[j - lead : j]
        i, j = x[-1] + k - at, y[-1] + k - by
        right = a[i : i + side]
        mine[n, side : side + len(right)] = right
        tail = b[j : j + side + DRIFT]
        other[n, side + DRIFT : side + DRIFT + len(tail)] = tail
    met = np.zeros(mine.shape, bool)
    for shift in range(2 * DRIFT + 1):
        met |= mine == other[:, shift : shift + width]
    # The chain itself counts whole; a window holds it with as many words around it as are left.
    total = np.cumsum(np.pad(met, ((0, 0), (1, 0))), axis=1)
    best = np.zeros(len(xs), np.int64)
    for left in range(side + 1):
        right = np.maximum(min_words - inner - left, 0)
        best = np.maximum(best, total[:, side] - total[:, side - left] + total[np.arange(len(xs)), side + right] - total[:, side])
    need = int(identity * min_words) - SPARE
    return ~short | (inner + best >= need)


PIECE = [("starts", "longs"), ("ends", "longs"), ("source_starts", "longs"), ("source_ends", "longs"), ("identities", "doubles")]


def pieces(
    docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, min_words: int = 50,
    identity: float = 0.8, rate: int = 2, evidence: int = 8, gap: float = 0.05, reach: int = 32,
) -> DataFrame:
    """Stored aligned pieces: (doc_id, start, end, source_id, source_start, source_end, identity) in words.

    The source is a smaller id that holds the seeds: their first or previous holder. Matches have to
    cover ``evidence`` words in order, or hold a long seed, before words are aligned. Documents of fewer
    than ``k`` words have none. Passages below ``min_words`` may be left out.
    A row with a null id cannot be named and takes no part; rows that share an id count as one
    document, so what only they share isn't reported.
    """
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    links = _links(_seeds(named, k, min_words, rate, *_hot_seeds(named, k, min_words, rate)))
    found = written(_chained(links, k, min_words, evidence, gap, reach), "chains")
    removed(links)
    ends = F.array(
        F.struct(F.col("doc_id").alias("id"), F.col("d0").alias("low"), F.col("d1").alias("high")),
        F.struct(F.col("source_id").alias("id"), F.col("s0").alias("low"), F.col("s1").alias("high")),
    )
    slices = written(_slices(named, found.select(F.explode(ends).alias("e")).select("e.*")), "slices").dropDuplicates(["id", "low", "high"])
    own = slices.select(F.col("id").alias("doc_id"), F.col("low").alias("d0"), F.col("high").alias("d1"), F.col("words").alias("own"))
    theirs = slices.select(F.col("id").alias("source_id"), F.col("low").alias("s0"), F.col("high").alias("s1"), F.col("words").alias("theirs"))
    both = found.join(own, ["doc_id", "d0", "d1"]).join(theirs, ["source_id", "s0", "s1"])

    def make() -> Callable:
        def work(xs: list, ys: list, d0: list, s0: list, own: list, theirs: list) -> tuple:
            out = []
            own, theirs = ([np.frombuffer(w, np.uint32) for w in side] for side in (own, theirs))
            judged = hopeful(xs, ys, own, theirs, d0, s0, k, identity, min_words)
            for x, y, a0, b0, a, b, wanted in zip(xs, ys, d0, s0, own, theirs, judged.tolist()):
                rows = []
                if wanted and max(x) + k <= a0 + len(a) and max(y) + k <= b0 + len(b):
                    rows = list(aligned(np.array(x), np.array(y), a, b, a0, b0, k, identity, min_words))
                out.append(tuple(zip(*rows)) if rows else ((),) * 5)
            return tuple(zip(*out)) if out else ((),) * 5

        return work

    done = with_computed(both.select("doc_id", "source_id", "x", "y", "d0", "s0", "own", "theirs"), ["x", "y", "d0", "s0", "own", "theirs"], PIECE, make)
    rows = done.select("doc_id", "source_id", F.explode(F.arrays_zip(*[name for name, _ in PIECE])).alias("p"))
    aligned_pieces = rows.select(
        "doc_id", F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), "source_id",
        F.col("p.source_starts").alias("source_start"), F.col("p.source_ends").alias("source_end"), F.col("p.identities").alias("identity"),
    )
    stored = written(aligned_pieces, "pieces")
    removed(found, slices)
    return stored


def held_in_order(found: DataFrame, slack: int = 2) -> DataFrame:
    """``found`` with the pieces of one source that follow each other in both documents made one."""
    order = Window.partitionBy("doc_id", "source_id").orderBy("start", "end", "source_start", "source_end")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = F.col("source_start") < F.lag("source_start").over(order)
    apart = (F.col("start") > F.max("end").over(ahead) + slack) | (F.col("source_start") > F.lag("source_end").over(order) + slack)
    runs = found.withColumn("__fresh", F.coalesce(behind | apart, F.lit(True)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("source_start").alias("source_start"), F.max("source_end").alias("source_end")]
    return runs.groupBy("doc_id", "source_id", "__run").agg(*ranges).drop("__run")


def joined(spans: DataFrame, min_words: int, slack: int = 2, **measures: Column) -> DataFrame:
    """Unions of spans (doc_id, start, end, ...) that overlap or lie within ``slack`` words."""
    ahead = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") > F.max("end").over(ahead) + slack, F.lit(True)).cast("int")
    runs = spans.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(so_far))
    union = runs.groupBy("doc_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[c.alias(n) for n, c in measures.items()])
    return union.where(F.col("end") - F.col("start") >= min_words).drop("__run")


def passages(found: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start, end, source_id, copied) of every repeated passage, in each document that has it.

    ``found`` are stored ``pieces``; one other document has to hold ``min_words`` of a passage in order,
    so short phrases from several documents don't add up. ``source_id`` is the smallest document a part of it comes from,
    the document itself if it is the first; ``copied`` counts the words of its longest copied part.
    Sources are listed once per range, however many copies they have.
    """
    whole = held_in_order(found)
    copies = whole.where(F.col("end") - F.col("start") >= min_words).groupBy("doc_id", "start", "end").agg(F.min("source_id").alias("source_id"))
    sources = whole.select(F.col("source_id").alias("doc_id"), F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    sources = sources.where(F.col("end") - F.col("start") >= min_words).distinct()
    spans = copies.unionByName(sources.withColumn("source_id", F.col("doc_id")))
    longest = F.max(F.when(F.col("source_id") < F.col("doc_id"), F.col("end") - F.col("start")).otherwise(0))
    return joined(spans, min_words, source_id=F.min("source_id"), copied=longest)


def without_copies(docs: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = 50) -> DataFrame:
    """``docs`` with every copied passage cut out of the text; its first document keeps it.

    White space around a cut stays. Rows with a null id and texts without a copy stay as they are.
    """
    whole = held_in_order(found)
    copies = whole.where(F.col("end") - F.col("start") >= min_words).select("doc_id", "start", "end").distinct()
    cuts = joined(copies, min_words).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("cuts.start").alias("__starts"), F.col("cuts.end").alias("__ends"))
    marked = docs.join(cuts, docs[key].cast("bigint") == F.col("__id"), "left").drop("__id")

    def make() -> Callable:
        import re

        word = re.compile(rb"[^\x09-\x0d\x20]+")

        def cut(t: str | None, starts: list | None, ends: list | None) -> str | None:
            if t is None or not starts:
                return t
            data = t.encode("utf-8", "surrogatepass")
            spans = [m.span() for m in word.finditer(data)]
            out, at = [], 0
            for a, b in zip(starts, ends):
                if a < len(spans):
                    out.append(data[at : spans[a][0]])
                    at = spans[min(b, len(spans)) - 1][1]
            return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

        return lambda texts, starts, ends: [[cut(*row) for row in zip(texts, starts, ends)]]

    changed = with_computed(marked, [text, "__starts", "__ends"], [("__text", "string")], make)
    return changed.withColumn(text, F.col("__text")).select(docs.columns)
