"""The text functions once more as DuckDB expressions, for comparison."""

from __future__ import annotations

from threadloom.functions import constants as C


def lit(text: str) -> str:
    """A string literal; line breaks as chr() so the SQL stays on plain lines."""
    quoted = "'" + text.replace("'", "''") + "'"
    return quoted.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '")


def swap(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {lit(old)}, {lit(new)})"
    return expr


def gsub(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(new)}, 'g')"


STOP = ", ".join(lit(w) for w in C.STOP_WORDS)
_LINE = (("\n", " "), ("\r", " "))
STORED = [p for p in C.SEARCH_REPLACEMENTS if p[0] != "π" and p not in _LINE]
QUOTED = [(o, '"' if o == '\\"' else n) for o, n in STORED if o != '"']


def search_tokens(expr: str, literals: bool = True) -> str:
    expr = f"lower({expr})"
    if literals:
        expr = swap(expr, C.SEARCH_REPLACEMENTS)
    expr = gsub(gsub(expr, C.SPACED_PUNCTUATION, " "), C.DELETED_SYMBOLS, "")
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '' AND w NOT IN ({STOP}))"


def search_text(expr: str, literals: bool = True) -> str:
    return f"array_to_string({search_tokens(expr, literals)}, ' ')"


def strip(expr: str) -> str:
    return gsub(expr, f"^{C.SPACE_CLASS}+|{C.SPACE_CLASS}+$", "")


def single(expr: str) -> str:
    return gsub(expr, " {2,}", " ")


def unescape(expr: str) -> str:
    return swap(expr, C.NAMED_ENTITIES)


def no_markup(expr: str) -> str:
    return gsub(gsub(expr, C.CODE_BLOCK, ""), C.ANY_TAG, "")


def storage_text(expr: str, markup: str = "keep", newlines: str = "keep") -> str:
    if markup == "drop":
        expr = no_markup(expr)
    expr = swap(expr, STORED)
    if newlines != "keep":
        mark = " " if newlines == "space" else " newlinechar "
        expr = swap(expr, (("\n", mark), ("\r", mark)))
    return single(unescape(strip(expr)))


def storage_tags(expr: str) -> str:
    return single(unescape(strip(swap(expr, (("<", ""), (">", " "), ('"', "'"))))))


def alphanumeric(expr: str) -> str:
    return single(strip(gsub(no_markup(expr), "[^A-Za-z0-9]", " ")))


def training_text(expr: str) -> str:
    expr = gsub(no_markup(expr), r"[^\n]*/[^\n]*", "")
    expr = swap(expr, [*STORED, ("(", " ( "), ("[", "[ "), ("->", " -> "), ("<", ""), (">", "")])
    return single(strip(unescape(strip(expr))))


def fixed_text(expr: str) -> str:
    return single(unescape(swap(expr, [*QUOTED, ("\r", " ")])))


def flattened(expr: str) -> str:
    return single(unescape(strip(swap(expr, [*QUOTED, ("\n", " ")]))))


def html_text(expr: str) -> str:
    expr = gsub(expr, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return unescape(gsub(expr, C.ANY_TAG, ""))


def label_tag(expr: str, digits: bool = False) -> str:
    first = f"regexp_extract(lower({expr}), {lit('^' + C.SPACE_CLASS + '*([^' + C.SPACE_CLASS[1:-1] + ']*)')}, 1)"
    return gsub(first, "[^0-9a-z #+]" if digits else "[^a-z #+]", "")


def space_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {lit(C.SPACE_CLASS + '+')}), lambda w: w <> '')"


def word_tokens(expr: str) -> str:
    expr = gsub(f"lower({expr})", "< *br */?>", "\n")
    expr = gsub(expr, "([/#])", r" \1 ")
    return f"regexp_extract_all({expr}, {lit('[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_' + C.SPACE_CLASS[1:])})"


def grams_cte(name: str, keys: str, source: str, text: str) -> str:
    """CTEs ending in ``name``(keys, gram): every character 1- to 5-gram, one row each.

    Single characters with their followers; cutting substrings by position is quadratic in a text.
    """
    clean = gsub(f"lower({text})", C.SPACE_CLASS + "{2,}", " ")
    leads = ", ".join(f"lead(c, {i}) OVER w AS c{i}" for i in range(1, 5))
    forms = ["c", *("c || " + " || ".join(f"c{i}" for i in range(1, n)) for n in range(2, 6))]
    unions = " UNION ALL ".join(f"SELECT {keys}, {form} AS gram FROM {name}_lead" for form in forms)
    return f"""{name}_chars AS (SELECT {keys}, unnest(c) AS c, generate_subscripts(c, 1) AS spot FROM (SELECT {keys}, string_split({clean}, '') AS c FROM {source})),
{name}_lead AS (SELECT {keys}, c, {leads} FROM {name}_chars WINDOW w AS (PARTITION BY {keys} ORDER BY spot)),
{name} AS (SELECT {keys}, gram FROM ({unions}) WHERE gram IS NOT NULL AND gram <> '')"""


def r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
