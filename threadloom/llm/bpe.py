"""Byte-level BPE by corpus-level merge replay.

The distinct pieces of a block of documents are laid out as one list of symbols. An inverted index
leads from every mergeable pair (by the rank of what it merges to) to its positions in all pieces;
merges are applied in rank order, each at all its positions, and touch only the neighbours there.
Blocks are independent, as a piece's merges depend on the piece alone, so tasks need no shuffle and
a lost one is simply run again.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import by_size, mapped

#: Characters per block, pieces per index (small enough for a processor's cache), and how many words, pieces and pairs a task remembers from earlier blocks;
#: the latter change speed only.
BLOCK, PIECES, WORDS_KEPT, PIECES_KEPT, PAIRS_KEPT = 1 << 22, 1 << 13, 800_000, 600_000, 1 << 20
#: White space as the rank files' pattern means it; Python's own set has four control characters more.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Replay:
    """Ids of many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        none = len(ranks) + max(ranks.values()) + 1
        self.first = np.array([[ranks.get(bytes((a, b)), none) for b in range(256)] for a in range(256)])
        self.none = none
        self.pairs: dict[int, int] = {}

    def _rank(self, pair: int) -> int:
        a, b = divmod(pair, self.none + 1)
        found = self.pairs[pair] = self.ranks.get(self.tokens[a] + self.tokens[b], self.none)
        return found

    def __call__(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """Ids of each piece; a piece that is a token is that token."""
        done = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        open_ = [i for i, ids in enumerate(done) if ids is None]
        if not open_:
            return done
        # Every piece ends in a stop symbol (-1), so no pair crosses a border.
        data = np.frombuffer(b"".join(pieces[i] + b"\0" for i in open_), np.uint8)
        ends = np.cumsum([len(pieces[i]) + 1 for i in open_]) - 1
        symbols = self.single[data]
        symbols[ends] = -1
        between = np.full(len(data), self.none)
        between[:-1] = self.first[data[:-1], data[1:]]
        between[ends] = between[ends - 1] = self.none
        where = np.flatnonzero(between < self.none)
        where = where[np.argsort(between[where], kind="stable")]
        found, starts = np.unique(between[where], return_index=True)
        index = {int(r): w.tolist() for r, w in zip(found, np.split(where, starts[1:]))}
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        sym = symbols.tolist()
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        self._merge(sym, nxt, prv, between.tolist(), index)
        low = 0
        for i, end in zip(open_, ends.tolist()):
            ids, at = [], low
            while at < end:
                ids.append(sym[at])
                at = nxt[at]
            done[i], low = ids, end + 1
        return done

    def _merge(self, sym: list[int], nxt: list[int], prv: list[int], rank: list[int], index: dict[int, list[int]]) -> None:
        """Apply all merges; ``rank`` holds what the pair that starts at each position merges to."""
        order, none, known, width = list(index), self.none, self.pairs, self.none + 1
        heapify(order)
        while order:
            now = heappop(order)
            places = sorted(index.pop(now))
            for turn, at in enumerate(places):
                if rank[at] != now:
                    continue  # a neighbour has been merged meanwhile
                other = nxt[at]
                after, before = nxt[other], prv[at]
                sym[at], nxt[at], prv[after], rank[other] = now, after, at, none
                lower, right, left = False, sym[after], sym[before]
                if right >= 0:
                    pair = now * width + right
                    new = known.get(pair) or self._rank(pair)
                    rank[at] = new
                    if new != none:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heappush(order, new)
                        lower = new < now
                else:
                    rank[at] = none
                if left >= 0:
                    pair = left * width + now
                    new = known.get(pair) or self._rank(pair)
                    rank[before] = new
                    if new != none:
                        if new in index:
                            index[new].append(before)
                        else:
                            index[new] = [before]
                            heappush(order, new)
                        lower |= new < now
                if lower:  # it comes before what is left of this merge
                    rest = places[turn + 1 :]
                    if rest:
                        index.setdefault(now, []).extend(rest)
                        heappush(order, now)
                    break


class Codec:
    """Encodes and decodes whole texts; remembers words between blocks."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.replay = Replay(read_ranks(path))
        plain = pattern.replace(r"[^\s", "[^" + SPACES).replace(r"\s", f"[{SPACES}]").replace(r"(?!\S)", f"(?![^{SPACES}])")
        self.pieces = regex.compile(plain).findall
        #: A space before one of these may be followed by more white space, which needs the whole text.
        self.blank = {chr(c) for c in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
        self.known: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    def _words(self, text: str) -> list[str]:
        """Parts that the pattern never looks across: a space before a non-space opens one."""
        parts = text.split(" ")
        if any(not p or p[0] in self.blank for p in parts[1:]):
            return [text]
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] else [" " + p for p in parts[1:]]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every text; null is an empty text."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        split = [self._words(t) if t else [] for t in texts]
        new = {w for words in split for w in words}.difference(self.known)
        cut = {w: self.pieces(w) for w in new}
        if len(self.ids) > PIECES_KEPT:
            self.ids.clear()
        distinct = list({p for parts in cut.values() for p in parts}.difference(self.ids))
        for low in range(0, len(distinct), PIECES):
            some = distinct[low : low + PIECES]
            found = self.replay([p.encode("utf-8", "surrogatepass") for p in some])
            self.ids.update((p, struct.pack(f"<{len(i)}i", *i)) for p, i in zip(some, found))
        known, ids = self.known, self.ids
        for w, parts in cut.items():
            known[w] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])
        return [np.frombuffer(b"".join([known[w] for w in words]), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of the whole text and the bytes they decode to.

    A null text is an empty one and has no ids. Repeated rows are answered each; a null id stays null.
    A text of any length is encoded whole, in a block of its own if it is a long one.
    """

    def make() -> Callable:
        codec = Codec(ranks, pattern)

        def work(keys: list, texts: list) -> Iterator[tuple]:
            for part in by_size([len(t or "") for t in texts], BLOCK):
                ids = codec.encode(texts[part])
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                yield keys[part], pa.ListArray.from_arrays(offsets, np.concatenate(ids)), [codec.decode(i) for i in ids]

        return work

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, ["doc_id", "text"], [("doc_id", "long"), ("ids", "ints"), ("decoded", "binary")], make)
