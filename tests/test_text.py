"""Text functions against hand-made strings and plain Python."""

import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T


def one(spark, value, form):
    return spark.createDataFrame([(value,)], "x string").select(form(F.col("x")).alias("y")).first()[0]


def test_search_text_example(spark):
    raw = 'a\tb "q" don\'t x@y,z #39; AT&amp;T c++ c# <br />\\n new π 3 @.@ 5'
    assert one(spark, raw, T.search_text) == "ab q dont x z att c++ c# new pi 35"


def test_search_text_keeps_repeats_and_drops_stop_words(spark):
    assert one(spark, "The cat and THE cat", T.search_text) == "cat cat"
    assert one(spark, "", T.search_text) == ""


def test_prepared_text_has_no_literal_replacements(spark):
    assert one(spark, "amp; π", T.prepared_text) == "amp"


def test_storage_text(spark):
    raw = ' <p>A  <code>x = 1</code> "b"\n&lt;c&gt; &#252; \\n d</p> '
    assert one(spark, raw, T.storage_text) == '<p>A <code>x = 1</code> \'b\'\n<c> ü \n d</p>'
    dropped = one(spark, raw, lambda c: T.storage_text(c, markup="drop", newlines="space"))
    assert dropped == "A 'b' <c> ü d"
    assert one(spark, "a\nb", lambda c: T.storage_text(c, newlines="marker")) == "a newlinechar b"


RAW_ENTITIES = [
    "&eacute;&#x41;&#66;&amp;lt;", "no entity", "&copy 2020 &notit; &hearts;", "", "&", "&;&#;&#x;&#xg", "a & b&c &&lt;&gt",
    "&#0;&#00;&#13;&#128;&#x81;&#x9F;&#159", "&#xD800;&#xDFFF;&#x110000;&#99999999999999999999;&#xFFFFFFFFFF;", "&#1;&#11;&#12;&#127;&#x1FFFE;&#xFDD0;x",
    "&#xFEFF;&#xFFFD;&#128512;&#x1F600 &#65b", "&ltnot;&gtreqless;&NotEqualTilde;&thisnameisfarfartoolongforanyentityatall;", "&\u00e9;&amp\u00e9;\U0001f600&quot;",
    "&#0000000000065;&#x0000000041;\n&lt\n", "&amp;&amp;amp;&", None,
]


@pytest.mark.parametrize("raw", RAW_ENTITIES)
def test_unescape_all_is_the_full_table(spark, raw):
    assert one(spark, raw, T.unescape_all) == (None if raw is None else html.unescape(raw))


def test_unescape_all_on_every_name_and_many_numbers(spark):
    names = [f"x&{name}y" for name in html5] + [f"x&{name.rstrip(';')}" for name in html5]
    numbers = [f"&#{n};" for n in range(0, 70_000, 7)] + [f"&#x{n:x};z" for n in [*range(0x180), *range(0xFDC0, 0x10002), *range(0x10FFF0, 0x110010)]]
    table = spark.createDataFrame([(t,) for t in names + numbers], "x string")
    found = table.select("x", T.unescape_all(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in found.collect() if r.y != html.unescape(r.x)] == []
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_unescape_common_decodes_once(spark):
    assert one(spark, "&amp;lt; &lt;&nbsp;&copy;", T.unescape_common) == "&lt; < ©"


def test_training_text_empties_lines_with_a_slash(spark):
    raw = "keep this line\nsee http://x.y/z for more\n(a) [b] i->j"
    assert one(spark, raw, T.training_text) == "keep this line\n\n ( a) [ b] i - j"


def test_fixed_and_flattened(spark):
    raw = 'say \\"hi\\"\rthere\nagain '
    assert one(spark, raw, T.fixed_text) == 'say "hi" there\nagain '
    assert one(spark, 'say \\"hi\\"\nagain ', T.flattened_text) == 'say "hi" again'


def test_alphanumeric_and_html(spark):
    assert one(spark, "<b>A-1</b> <code>zz</code>é b", T.alphanumeric_text) == "A 1 b"
    page = "<style>p{}</style><!-- n --><p>x &amp; y</p><script>var t='</p>';</script>"
    assert one(spark, page, T.html_text) == "x & y"


def test_tags(spark):
    assert one(spark, "<c#><asp.net-mvc>", T.storage_tags) == "c# asp.net-mvc"
    assert one(spark, " Python-3.X Django", T.label_tag) == "pythonx"
    assert one(spark, "Python-3.X Django", lambda c: T.label_tag(c, digits=True)) == "python3x"


def test_tokens(spark):
    assert one(spark, " A\tb C ", T.whitespace_tokens) == ["a", "b", "c"]
    assert one(spark, "", T.whitespace_tokens) == []
    assert one(spark, "Don't<br />x/y #1 _eos_ é", T.word_tokens) == ["don", "'", "t", "x", "/", "y", "#", "1", "_eos_", "é"]


def test_marked_fields(spark):
    df = spark.createDataFrame([("a", "b", "c")], "x string, y string, z string")
    got = df.select(T.marked_fields(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert got == "\nxbos xfld 1 a xfld 1 b xfld 2 c"


def test_padding(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    assert df.select(T.padded(F.col("ids"), 5)).first()[0] == [1, 1, 5, 6, 7]
    assert df.select(T.padded(F.col("ids"), 5, "post")).first()[0] == [5, 6, 7, 1, 1]
    assert df.select(T.padded(F.col("ids"), 2)).first()[0] == [6, 7]


def test_char_ngrams(spark):
    def brute(s):
        return sorted(s[i:i + n] for n in range(1, 6) for i in range(len(s) - n + 1))

    assert sorted(one(spark, "ABé  c", T.char_ngrams)) == brute("abé c")
    assert sorted(one(spark, "x😀y", T.char_ngrams)) == brute("x😀y")
    assert one(spark, "", T.char_ngrams) == []


def test_edit_similarity_and_shared_words(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(T.similarity_by_edits(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 - 3 / 7), 1.0]
    words = spark.createDataFrame([("a b", "b c"), ("a", "d")], "a string, b string")
    assert [r[0] for r in words.select(T.shares_word(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_tag_confidence(spark):
    schema = "tags string, predicted array<struct<tag:string,score:double>>"
    rows = [("css html", [("c", 0.7), ("html", 0.2)]), ("actionscript-3", [("c_x", 0.5)]), ("java", [("java", 0.0)]),
            ("a-b", [("a_b", 0.4)])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(T.tag_confidence(F.col("tags"), F.col("predicted"))).collect()]
    assert got == [0.7, 0.0, 0.0, 0.4]


@pytest.mark.parametrize("form", [T.search_text, T.prepared_text, T.alphanumeric_text])
def test_a_text_is_cleaned_once(spark, form):
    plan = spark.createDataFrame([("x",)], "x string").select(form(F.col("x")).alias("y"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("translate(") == 1


def test_cleaning_beyond_latin_letters(spark):
    raw = "É\0 ſ\u0085\U0001F600x  Ж7—z <b>_</b>"
    assert one(spark, raw, T.alphanumeric_text) == "x 7 z"
    assert one(spark, raw, T.search_text) == "x 7z b_ b"
    assert one(spark, None, T.alphanumeric_text) is None and one(spark, None, T.search_text) is None
