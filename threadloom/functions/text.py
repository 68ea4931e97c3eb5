"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import constants as C
from threadloom.functions.entities import decoded_entities

_NEWLINE_PAIRS = (("\n", " "), ("\r", " "))
_STORED = tuple(p for p in C.SEARCH_REPLACEMENTS if p[0] != "π" and p not in _NEWLINE_PAIRS)
_QUOTE_KEEPING = tuple(
    (old, '"' if old == '\\"' else new) for old, new in _STORED if old != '"'
)


def _swap(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used.

    Spark shares common parts in generated code only; below a function of higher order, such as a filter
    of words, every mention is evaluated again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.regexp_replace(text, f"^{C.SPACE_CLASS}+|{C.SPACE_CLASS}+$", "")


def _single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def unescape_all(text: Column) -> Column:
    """All named and numeric HTML entities, each decoded once."""
    return decoded_entities(text)


def unescape_common(text: Column) -> Column:
    """The common named entities as plain replacements, each entity decoded once."""
    return _swap(text, C.NAMED_ENTITIES)


def _unescape(text: Column, entities: str) -> Column:
    return unescape_all(text) if entities == "all" else unescape_common(text)


def without_markup(text: Column) -> Column:
    """Drop ``<code>`` blocks free of inner tags, then every tag."""
    return F.regexp_replace(F.regexp_replace(text, C.CODE_BLOCK, ""), C.ANY_TAG, "")


# --- search form ----------------------------------------------------------------------------------

def search_literals(text: Column) -> Column:
    """The literal replacements of the search form, in their order."""
    return _swap(text, C.SEARCH_REPLACEMENTS)


_SPACED = "".join(c for c in map(chr, range(1, 0x180)) if re.fullmatch(C.SPACED_PUNCTUATION, c))
_DELETED_LATIN = "".join(
    c for c in map(chr, range(1, 0x180)) if c not in _SPACED and re.fullmatch(C.DELETED_SYMBOLS, c)
)


def _plain(text: Column) -> Column:
    """Whether all is ASCII other than the zero character, which ``translate`` cannot name."""
    return (F.length(text) == F.octet_length(text)) & ~F.contains(text, F.lit("\0"))


def _searchable(text: Column) -> Column:
    """Listed punctuation to blanks, all else but the kept symbols deleted.

    One table look-up per character deals with everything up to Latin letters. If only ASCII is left
    the text is done; only other texts need the pattern, which is several times slower.
    """
    text = F.translate(text, _SPACED + _DELETED_LATIN, " " * len(_SPACED))
    return _once(text, lambda t: F.when(_plain(t), t).otherwise(F.regexp_replace(t, C.DELETED_SYMBOLS, "")))


def search_tokens(text: Column, literals: bool = True) -> Column:
    """Lower-case words without punctuation and stop words, repeats kept.

    Whitespace other than a blank or line break is deleted rather than turned into a blank. Stop
    words go after punctuation, so no entry with an apostrophe is needed in the list.
    """
    text = F.lower(text)
    if literals:
        text = search_literals(text)
    text = _searchable(text)
    return F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(C.STOP_WORDS))


def search_text(text: Column) -> Column:
    """The search form of a text as one string."""
    return F.array_join(search_tokens(text), " ")


def prepared_text(text: Column) -> Column:
    """The search form without the literal replacements (embedding training files)."""
    return F.array_join(search_tokens(text, literals=False), " ")


# --- storage forms --------------------------------------------------------------------------------

def storage_text(text: Column, markup: str = "keep", newlines: str = "keep", entities: str = "all") -> Column:
    """The stored form of a body or title: case kept, literal replacements, single blanks.

    ``newlines`` is ``keep``, ``space`` or ``marker`` (the word ``newlinechar``); ``entities`` is
    ``all`` or ``common`` (a few plain replacements).
    """
    if markup == "drop":
        text = without_markup(text)
    text = _swap(text, _STORED)
    if newlines != "keep":
        mark = " " if newlines == "space" else " newlinechar "
        text = _swap(text, (("\n", mark), ("\r", mark)))
    return _single_spaces(_unescape(strip(text), entities))


def storage_tags(tags: Column, entities: str = "all") -> Column:
    """``<a><b>`` becomes ``a b``."""
    text = strip(_swap(tags, (("<", ""), (">", " "), ('"', "'"))))
    return _single_spaces(_unescape(text, entities))


_BLANKED_LATIN = "".join(c for c in map(chr, range(1, 0x180)) if re.fullmatch(C.OTHER_THAN_ALPHANUMERIC, c))


def alphanumeric_text(text: Column) -> Column:
    """Mark-up dropped, everything but ASCII letters and digits blanked, single blanks.

    Characters up to Latin letters go by one table look-up, as in :func:`_searchable`.
    """
    text = F.translate(without_markup(text), _BLANKED_LATIN, " " * len(_BLANKED_LATIN))
    text = _once(text, lambda t: F.when(_plain(t), t).otherwise(F.regexp_replace(t, C.OTHER_THAN_ALPHANUMERIC, " ")))
    return _single_spaces(strip(text))


def training_text(text: Column, entities: str = "all") -> Column:
    """The form used for question/answer training pairs.

    A line that holds a slash is emptied; ``.`` is spelled ``[^\\n]`` because Java's dot also stops
    at a carriage return. Matches may only begin at a line start, which keeps lines without a slash
    from being scanned once per character.
    """
    text = F.regexp_replace(without_markup(text), r"(?<![^\n])[^\n]*/[^\n]*", "")
    text = _swap(text, _STORED)
    text = _swap(text, (("(", " ( "), ("[", "[ "), ("->", " -> "), ("<", ""), (">", "")))
    return _single_spaces(strip(_unescape(strip(text), entities)))


def fixed_text(text: Column, entities: str = "all") -> Column:
    """Escaped quotes restored, line breaks kept, carriage returns blanked."""
    return _single_spaces(_unescape(_swap(text, (*_QUOTE_KEEPING, ("\r", " "))), entities))


def flattened_text(text: Column, entities: str = "all") -> Column:
    """As :func:`fixed_text` on one line: line breaks blanked, ends stripped."""
    return _single_spaces(_unescape(strip(_swap(text, (*_QUOTE_KEEPING, ("\n", " ")))), entities))


def html_text(markup: Column, entities: str = "all") -> Column:
    """Text content of a page: script, style and comment blocks dropped, then tags, then entities."""
    text = F.regexp_replace(markup, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return _unescape(F.regexp_replace(text, C.ANY_TAG, ""), entities)


# --- labels ---------------------------------------------------------------------------------------

def label_tag(tags: Column, digits: bool = False) -> Column:
    """First tag of a list, lower-cased, symbols (and by default digits) deleted."""
    first = F.regexp_extract(F.lower(tags), rf"^{C.SPACE_CLASS}*([^ \t\n\r\f\x0B\x{{85}}\x{{a0}}]*)", 1)
    return F.regexp_replace(first, "[^0-9a-z #+]" if digits else "[^a-z #+]", "")


# --- tokens ---------------------------------------------------------------------------------------

def space_tokens(text: Column) -> Column:
    """Whitespace tokens, case kept; an empty text has none."""
    return F.filter(F.split(text, f"{C.SPACE_CLASS}+"), lambda w: w != "")


def whitespace_tokens(text: Column) -> Column:
    """Lower-case whitespace tokens; an empty text has none."""
    return space_tokens(F.lower(text))


def word_tokens(text: Column) -> Column:
    """Lower-case words and single symbols.

    A ``<br>`` counts as a line break; slash and hash stand apart; runs of letters, digits and
    underscores are words, every other visible character is its own token.
    """
    text = F.regexp_replace(F.lower(text), r"< *br */?>", "\n")
    text = F.regexp_replace(text, r"([/#])", " $1 ")
    return F.regexp_extract_all(
        text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B\x{85}\x{a0}]"), F.lit(0)
    )


def marked_fields(*fields: Column) -> Column:
    """Join text fields with begin and field markers; the first two fields share number 1."""
    parts = [F.lit(f"\n{C.BEGIN_MARK} {C.FIELD_MARK} 1 "), fields[0]]
    for number, field in enumerate(fields[1:], start=1):
        parts += [F.lit(f" {C.FIELD_MARK} {number} "), field]
    return F.concat(*parts)


def padded(ids: Column, length: int, side: str = "pre", value: int = 1) -> Column:
    """Keep the last ``length`` ids and fill up to ``length`` on one side."""
    kept = F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)
    fill = F.array_repeat(F.lit(value), F.lit(length) - F.size(kept))
    return F.concat(fill, kept) if side == "pre" else F.concat(kept, fill)


def shares_word(row_text: Column, question: Column) -> Column:
    """True if any whitespace token of the question is a token of the row."""
    return F.arrays_overlap(space_tokens(row_text), space_tokens(question))


def similarity_by_edits(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longer)


def char_ngrams(text: Column, low: int = 1, high: int = 5) -> Column:
    """All overlapping character n-grams of the lower-cased text, runs of whitespace collapsed.

    One look-ahead scan per length keeps this linear in the text; cutting substrings by position
    would walk the text from its start for every gram. The second look-ahead skips positions inside
    a surrogate pair.
    """
    text = F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B\x{85}\x{a0}]{2,}", " ")
    scans = [
        F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))
        for n in range(low, high + 1)
    ]
    return F.concat(*scans)


def scored_answer(comment: Column, score: Column) -> Column:
    """``comment::score`` with the score as an integer."""
    return F.concat(comment, F.lit("::"), score.cast("bigint").cast("string"))


def tag_confidence(tags: Column, predicted: Column) -> Column:
    """Score of the first predicted tag that is a substring of ``tags`` and not zero, else 0.

    ``predicted`` is an array of (tag, score) in order of confidence. Hyphens in ``tags`` count as
    underscores. The substring test is meant: ``c`` also meets ``css``.
    """
    row_tags = F.replace(tags, F.lit("-"), F.lit("_"))
    hits = F.filter(predicted, lambda p: F.contains(row_tags, p["tag"]) & (p["score"] != 0))
    return F.coalesce(F.get(hits, F.lit(0))["score"], F.lit(0.0))
