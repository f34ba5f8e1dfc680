from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from tessera.functions import html, ids, questions, text, url
from tessera.operators import documents, frontier


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema_of(rows))
    return [r[0] for r in df.orderBy("i").select(fn.alias("v")).collect()]


def schema_of(rows):
    names = ["a", "b", "c"][: len(rows[0])]
    return "i int, " + ", ".join(f"{n} string" for n in names)


def test_strip_and_words_follow_unicode_white_space(spark):
    cases = ["  x ", " x ", "\n\t a b \r\n", "", "　"]
    got = values(spark, [(c,) for c in cases], text.strip(F.col("a")))
    assert got == [c.strip() for c in cases]
    got = values(spark, [(c,) for c in cases], text.words(F.col("a")))
    assert got == [c.split() for c in cases]


def test_sanitize_keeps_dash_dot_dollar_percent(spark):
    raw = "what's [a] pod? {x}|y!z & -.$% \"q\"\\;:,*()"
    (got,) = values(spark, [(raw,)], text.sanitize_query(F.col("a")))
    assert not set(got) & set("&|!(){}[]*?,;:\"'\\")
    assert "-.$%" in got and got == got.strip()


def test_and_query_drops_stop_words(spark):
    cases = [("where is the harbour crane",), ("the of a",), ("pod Pod POD",)]
    got = values(spark, cases, text.all_terms_query(F.col("a")))
    assert got == ["harbour AND crane", "", "pod"]


def test_first_line_title(spark):
    cases = [("# Kafka  \nbody", "f"), ("", "stem"), ("## # A", "f"), ("plain", "f")]
    got = values(spark, cases, text.first_line_title(F.col("a"), F.col("b")))
    assert got == ["Kafka", "stem", "A", "plain"]


def test_heads(spark):
    (got,) = values(spark, [("a\nb" * 200,)], text.console_head(F.col("a")))
    assert len(got) == 220 and "\n" not in got
    assert values(spark, [(None,)], text.head(F.col("a"), 3)) == [""]


def doc_id(u, t):
    return sha256(f"{u.rstrip('/').lower()}|{t}".encode()).hexdigest()[:32]


def test_document_identity(spark):
    cases = [
        ("https://K8s.io/Docs/", "x"), ("https://k8s.io/docs", "x"), ("https://k8s.io/docs", "y"),
        ("https://k8s.io/docs//", "é"), ("https://k8s.io/docs/?q=/#f", "x"),
    ]
    got = values(spark, cases, ids.document_id(F.col("a"), F.col("b")))
    assert got == [doc_id(*c) for c in cases]
    assert got[0] == got[1] and got[1] != got[2] and all(len(g) == 32 for g in got)
    files = values(spark, [("kafka", "a.md")], ids.file_document_id(F.col("a"), F.col("b")))
    assert files == [md5(b"kafka::a.md").hexdigest()]


def test_sizes_and_keys(spark):
    assert values(spark, [("é",)], ids.byte_size(F.col("a"))) == [2]
    assert values(spark, [("é🦆",)], ids.char_count(F.col("a"))) == [2]
    key = ids.object_key(F.col("a"), F.lit("2024-06-01"), "raw", F.col("b"), "html")
    assert values(spark, [("s", "d")], key) == ["source=s/date=2024-06-01/raw/d.html"]


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urldefrag, urljoin

    bases = ["https://h.org/a/b.html?x=1#f", "http://h.org", "https://h.org/a/b/"]
    refs = [
        "/x", "y", "./y", "../z", "../../z", "//cdn.org/p", "https://o.org/q#frag", "?k=v", "#top", "c/d?e=f",
        "/a/../b/./c", "x/..", "ftp://f.org/",
    ]
    cases = [(b, r) for b in bases for r in refs]
    got = values(spark, cases, url.resolve_link(F.col("a"), F.col("b")))
    want = [urldefrag(urljoin(b, r))[0] for b, r in cases]
    assert dict(zip(cases, got, strict=True)) == dict(zip(cases, want, strict=True))


def test_admission(spark):
    allow = F.array(F.lit("https://angular.dev/"))
    deny = F.array(F.lit("?"), F.lit("/api/"))
    cases = [("https://angular.dev/x",), ("https://angular.dev/api/x",), ("https://angular.dev/?q",),
             ("https://other.dev/",)]
    assert values(spark, cases, url.is_admitted(F.col("a"), allow, deny)) == [True, False, False, False]


def test_page_links_drop_pseudo_links_and_repeats(spark):
    body = (
        "<a href=\"/a\">1</a><A class=x HREF='/a'>2</A><a href=\"mailto:x@y\">m</a>"
        "<a href=\"javascript:f()\">j</a><a href=\"\">e</a><a href=\"/b#c\">b</a><link href=\"/no\">"
    )
    pages = spark.createDataFrame([("http://h.org/p", body)], "url string, html string")
    got = [r["link"] for r in frontier.page_links(pages).collect()]
    assert got == ["http://h.org/a", "http://h.org/b"]


PAGE = """<!DOCTYPE html><html><head><title>Doc &amp; Title</title><style>p{}</style></head><body>
<nav>menu menu</nav><!-- hidden --><main><h1>Hello</h1><p>Main <b>body</b> text
that wraps.</p><table><tr><td>a</td><td>1</td></tr></table><script>var x="</p>";</script></main>
<footer>copyright</footer></body></html>"""


def test_main_text_and_title(spark):
    (got,) = values(spark, [(PAGE,)], html.main_text(F.col("a")))
    assert got.split("\n")[:2] == ["Hello", "Main body text that wraps."]
    assert "a | 1" in got
    for gone in ("menu", "copyright", "hidden", "var x", "<"):
        assert gone not in got
    assert values(spark, [(PAGE,)], html.page_title(F.col("a"))) == ["Doc & Title"]


def test_page_edge_cases(spark):
    cases = ["<html><body></body></html>", "<body><nav>x</nav></body>", "plain text", "<h1>T</h1>x",
             "<html><body><article><p>A &lt; B&nbsp;&amp;lt;</p></article>rest</body></html>"]
    got = values(spark, [(c,) for c in cases], html.main_text(F.col("a")))
    assert got == ["", "", "plain text", "T\nx", "A < B &lt;"]
    titles = values(spark, [(c,) for c in cases], html.page_title(F.col("a")))
    assert titles == [None, None, None, "T", None]


def test_needs_render_counts_bytes(spark):
    cases = [("é" * 1024,), ("e" * 2047,), ("<noscript>" + "e" * 3000,), ("e" * 2048,)]
    assert values(spark, cases, html.needs_render(F.col("a"))) == [False, True, True, False]


def test_lenient_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "raw binary")
    assert df.select(html.decode_utf8(F.col("raw"))).first()[0] == "a�b"


@pytest.mark.parametrize(
    "question,intent",
    [
        ("compare steel bridges versus wooden ones", "multi_hop"),
        ("where is it", "ambiguous"),
        ("where is the harbour crane?", "factual"),
        ("vs?", "factual"),
        ("is it this that", "factual"),
        ("", "factual"),
        ("  THIS  ", "ambiguous"),
    ],
)
def test_intent(spark, question, intent):
    got = values(spark, [(question,)], questions.intent(F.col("a")))
    assert got == [intent]
    (augmented,) = values(
        spark, [(question,)], questions.augmented_question(F.col("a"), F.lit(intent))
    )
    prefix = "explain in detail: " if intent == "ambiguous" else ""
    assert augmented == prefix + question.strip()


def test_poor_answers(spark):
    cases = [("x" * 29,), ("x" * 30,), ("I don't have enough information. " + "x" * 40,),
             ("Cannot find it anywhere in those long pages",), (None,), (" " * 40,)]
    assert values(spark, cases, questions.is_poor_answer(F.col("a"))) == [
        True, False, True, True, True, True
    ]


def test_fallback_question(spark):
    cases = [("what is a pod",), ("is it ok",), ("a bc scheduler works",)]
    assert values(spark, cases, questions.fallback_question(F.col("a"))) == [
        "what", "is it ok", "scheduler"
    ]


def test_merge_attributes_later_keys_win(spark):
    first = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))
    later = F.create_map(F.lit("b"), F.lit("2"))
    got = spark.range(1).select(documents.merge_attributes(first, later).alias("m")).first()[0]
    assert got == {"a": "1", "b": "2"}


def test_lower_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "Chunk_ID int, DIST int")
    assert documents.lower_column_names(df).columns == ["chunk_id", "dist"]


def test_markup_scan(spark):
    """Nested blocks of one name, signs within attributes, raw elements, broken blocks."""
    cases = {
        "<nav>n<nav>m</nav>o</nav>x": "x",
        "<body>a<nav>1<NAV class=q>2<nav>3</nav></nav>4</nav>b<aside>5</aside>c</body>": "abc",
        '<body><nav data-x="1>2" title=\'</nav>\'>n</nav><p data-y="3>4">t</p></body>': "t",
        "<body>a<nav>never closed</body>": "anever closed",
        "<body>a<nav>1<nav>2</nav>b</body>": "ab",
        "<body>a</nav>b<nav/>c</body>": "abc",
        "<body>a<nav><aside>1</nav>b</aside>c</body>": "abc",
        '<body>a<script>var n="<nav>";</script>b<!-- <script> -->c<style>p>q{}</style>d</body>': "abcd",
        "<body>caf&eacute; &hearts;&amp;eacute; &bogus; &#233; a&b &notit; &NotEqualTilde;</body>": "café ♥&eacute; &bogus; é a&b &notit; ≂̸",
        "<body>1 < 2 and 3 > 2</body>": "1 < 2 and 3 > 2",
        "<body>a<nav</body>": "a<nav",
        "": "",
    }
    got = values(spark, [(c,) for c in cases], html.main_text(F.col("a")))
    assert dict(zip(cases, got, strict=True)) == cases
    assert values(spark, [(None,)], html.main_text(F.col("a"))) == [None]


def test_many_blocks_in_one_page(spark):
    """Blocks across the bounds of the scan's own blocks, deep nesting and long attributes."""
    flat = "<body>" + "".join(f"x{i} <nav><nav>a</nav>{i}</nav>" for i in range(700)) + "</body>"
    deep = "<body>a" + "<nav>" * 1500 + "in" + "</nav>" * 1500 + "b</body>"
    wide = "<body><p " + 'k="v>w" ' * 20_000 + ">t</p></body>"
    got = values(spark, [(flat,), (deep,), (wide,)], html.main_text(F.col("a")))
    assert got == [" ".join(f"x{i}" for i in range(700)), "ab", "t"]


def test_link_targets(spark):
    cases = {
        '<a data-x="1>2" href="/w">': ["/w"],
        "<a title=\"href='/no'\" href='/yes'>": ["/yes"],
        '<a class="x"href=/bare>': ["/bare"],
        '<!-- <a href="/c"> --><script>"<a href=\'/s\'>"</script><a\nHREF = "/n">': ["/n"],
        '<a href="/q?a=1&amp;b=2&eacute;">': ["/q?a=1&b=2é"],
        '<a data-href="/no">x</a><abbr href="/no"><a href>': [],
    }
    got = values(spark, [(c,) for c in cases], html.hrefs(F.col("a")))
    assert dict(zip(cases, got, strict=True)) == cases
