"""Packing token sequences by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens. How pieces fill sequences depends on
their lengths alone, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however many documents there are. Per bin, subset sums over the available
lengths (one bit per reachable sum) find the fullest feasible combination beside the longest piece
left; it is removed, and repeated at once for as long as its lengths last. Pieces then take the places
of their length by rank.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import by_size, mapped, with_computed
from threadloom.session import written

SEPARATOR = 0
#: Words a task remembers; on reaching it, it starts anew, which changes speed only.
WORDS_KEPT = 700_000


class Ids:
    """Token ids of whole texts by a word-level tokenizer file.

    No token of the file spans white space, so a text is the sequence of its words split at ASCII
    white space, and each distinct word is tokenized once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # Words of ASCII and Latin-1 letters need no normalising beyond lower case; their letters
        # become the byte symbols that the file's own pre-tokenizer gives them.
        letters = "a-zß-öø-ÿ"
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]+")
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\s{letters}0-9]+")
        symbols = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.symbols = {c: symbols(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        """Ids of a word as little-endian numbers; a full stop or comma after a letter stands alone."""
        if word[-1] in b".," and word[-2:-1].isalpha():
            return self._kept(word[:-1]) + self._kept(word[-1:])
        text = word.decode("utf-8")
        if self.plain.fullmatch(text):
            model, symbols = self.model, self.symbols
            ids = [t.id for part in self.parts.findall(text.lower()) for t in model.tokenize(part.translate(symbols))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _kept(self, word: bytes) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self._word(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        return np.frombuffer(b"".join(map(self._kept, words)), "<u4")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document and its end mark.

    A null text is an empty one and gives the end mark alone. Only documents above ``capacity`` are
    cut, into full pieces and a rest. Repeated rows give repeated pieces; a null id stays null.
    """
    fields = [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    fields += [("ids", "longs")] if ids else []

    def make() -> Callable:
        encode = Ids(tokenizer)

        def work(keys: list, texts: list) -> Iterator[tuple]:
            for part in by_size([len(t or "") for t in texts], 1 << 22):
                rows = []
                for k, t in zip(keys[part], texts[part]):
                    whole = np.append(encode(t), np.uint32(SEPARATOR)).astype("<u4")
                    for n, start in enumerate(range(0, len(whole), capacity)):
                        own = whole[start : start + capacity]
                        rows.append((k, n, start, len(own), zlib.crc32(own.tobytes())) + ((own.tolist(),) if ids else ()))
                yield tuple(zip(*rows))

        return work

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return mapped(source, ["doc_id", "text"], fields, make)


def fullest(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """Which lengths, and how many of each, fill ``capacity`` best; longer ones are preferred.

    ``reach`` has bit s set if sum s can be made of the lengths so far; its states are kept to walk
    back from the fullest sum. A length enters as one, two, four ... copies, up to what fits.
    """
    reach, states = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted((n for n in counts if counts[n] and n <= capacity), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left:
            take = min(size, left)
            states.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            size *= 2
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, take, earlier in reversed(states):
        if not earlier >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (number of times, {length: pieces}); every piece of the histogram has its place.

    Repeating a combination while its lengths last is what finding it again and again would give, as
    fewer pieces leave no better one.
    """
    left = {length: n for length, n in histogram.items() if n}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest(capacity - longest, left)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[length] // n for length, n in combination.items())
        bins.append((times, combination))
        for length, n in combination.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, pieces per bin, first sequence, offset), by first rank."""
    first, rows, sequence = {}, {}, 0
    for times, combination in bins:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            rank = first.get(length, 0)
            rows.setdefault(length, []).append((rank, n, sequence, offset))
            first[length] = rank + times * n
            offset += n * length
        sequence += times
    return {length: np.array(found, np.int64) for length, found in rows.items()}


def pack(found: DataFrame, capacity: int = 2048, rows_per_group: int = 1 << 20) -> DataFrame:
    """``found`` (pieces, read twice, so given as a stored table) with sequence_id and offset.

    The rank of a piece within its length is its rank within (length, hash group) plus the sizes of
    the earlier groups. The number of groups follows the number of pieces, so one length may hold
    any share of them. Only the histogram and the places (a few per length) pass the driver. Equal
    rows are interchangeable. An empty table gives an empty result.
    """
    lengths = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = max(32, -(-sum(lengths.values()) // rows_per_group))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    grouped = found.withColumn("__group", group)
    sizes = grouped.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = grouped.withColumn("__rank", F.row_number().over(inside) - 1).join(before, ["length", "__group"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__group", "__before")
    places = _places(plan(lengths, capacity))

    def make() -> Callable:
        def work(length: list, rank: list) -> tuple[np.ndarray, np.ndarray]:
            length, rank = np.array(length, np.int64), np.array(rank, np.int64)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                table = places[int(size)]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                bin_, slot = np.divmod(rank[own] - row[:, 0], row[:, 1])
                sequence[own] = row[:, 2] + bin_
                offset[own] = row[:, 3] + slot * size
            return sequence, offset

        return work

    placed = with_computed(ranked, ["length", "__rank"], [("sequence_id", "long"), ("offset", "long")], make)
    return placed.drop("__rank")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place; see ``pieces`` and ``pack``."""
    return pack(written(pieces(docs, tokenizer, capacity, text, key, ids), "pieces"), capacity)
