"""HTML entities decoded by Column expressions: the whole named table and numeric forms, no Python rows."""

from __future__ import annotations

import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One reference after its ampersand: decimal, hexadecimal or a name, the semicolon optional.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Only a text with such a start can hold a reference that is decoded.
POSSIBLE = "&[#A-Za-z]"

_BUCKETS = 256
_LAST = 0x10FFFF
_BYTE_ORDER_MARK = "0000FEFF"


@cache
def _named_json() -> str:
    """The standard library's table of names, dealt over buckets so that a look-up scans a few entries."""
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for name, value in html5.items():
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = value
    return json.dumps(buckets)


@cache
def _bare_names() -> str:
    """Pattern of the names that count without a semicolon, the longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return f"^({'|'.join(bare)})"


@cache
def _replaced_json() -> str:
    """Numbers that stand for another character: zero, and the C1 range read as Windows-1252."""
    table = ["�"]
    for number in range(0x80, 0xA0):
        try:
            table.append(bytes([number]).decode("cp1252"))
        except UnicodeDecodeError:
            table.append(chr(number))
    return json.dumps(table)


def _named(name: Column) -> Column:
    """The text of a listed name; null for others."""
    buckets = F.from_json(F.lit(_named_json()), "array<map<string,string>>")
    return F.try_element_at(F.get(buckets, F.pmod(F.crc32(name.cast("binary")), F.lit(_BUCKETS)).cast("int")), name)


def _named_or_prefix(name: Column) -> Column:
    """A listed name, else its longest listed start with the rest behind it, else the text as it was."""
    start = F.regexp_extract(name, _bare_names(), 1)
    rest = F.substring(name, F.length(start) + 1, F.length(name))
    return F.coalesce(
        _named(name), F.when(start != "", F.concat(_named(start), rest)), F.concat(F.lit("&"), name)
    )


def _number(digits: Column, base: int) -> Column:
    """Value of a digit string; anything above the last code point is one more than it."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("bigint"))
    return F.least(F.coalesce(value, F.lit(_LAST + 1)), F.lit(_LAST + 1))


def _character(number: Column) -> Column:
    """The character of a code point, by the rules for references to unusable ones."""
    replaced = F.from_json(F.lit(_replaced_json()), "array<string>")
    place = F.when(number == 0, 0).otherwise(number - 0x7F).cast("int")
    plain = F.decode(F.unhex(F.concat(F.lit(_BYTE_ORDER_MARK), F.lpad(F.hex(number), 8, "0"))), "UTF-32")
    unusable = (
        number.between(0x1, 0x8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when((number == 0) | number.between(0x80, 0x9F), F.get(replaced, place))
        .when(number.between(0xD800, 0xDFFF) | (number > _LAST), F.lit("�"))
        .when(unusable, F.lit(""))
        .otherwise(plain)
    )


def _decoded(reference: Column) -> Column:
    decimal = F.regexp_extract(reference, "^#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(reference, "^#[xX]([0-9a-fA-F]+)", 1)
    number = F.when(decimal != "", _number(decimal, 10)).otherwise(_number(hexadecimal, 16))
    character = F.get(F.transform(F.array(number), _character), F.lit(0))  # the number is worked out once
    return F.when(F.startswith(reference, F.lit("#")), character).otherwise(_named_or_prefix(reference))


def decoded_entities(text: Column) -> Column:
    """``text`` with every reference decoded once; null stays null.

    The text is split at its references, each reference is looked up, and both are joined again.
    """
    pieces = F.split(text, REFERENCE, -1)
    references = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    both = F.zip_with(pieces, references, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(_decoded(r))))
    return F.when(text.rlike(POSSIBLE), F.array_join(both, "")).otherwise(text)
