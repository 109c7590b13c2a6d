import html
import unicodedata
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import ready
from quire.sources import html as html_source


def one(spark, value, *columns, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_fold_matches_decomposition(spark):
    words = ["Électricité PureÇa", "ñandú Ærø straße", "ABC déf", "ﬁn ½"]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    for r in df.select("x", T.fold("x").alias("a"), T.fold_full("x").alias("b")).collect():
        want = unicodedata.normalize("NFKD", r.x).encode("ascii", "ignore").decode().lower()
        assert r.a == r.b == want


def test_tokens_and_terms(spark):
    row = one(spark, "Flash//X90 and the 1,234 watts for Nodes", T.tokens("x"), T.query_terms("x"))
    assert "flash//x90" in row.c0 and "234" in row.c0
    assert not {"and", "the", "for"} & set(row.c1)


def test_overlap(spark):
    assert one(spark, "alpha beta gamma", T.token_overlap("x", F.lit("beta alpha only"))).c0 > 0.5
    assert one(spark, "a b", T.token_overlap("x", F.lit("text"))).c0 == 0.0


def test_json_ints(spark):
    rows = spark.createDataFrame([('order [3, 1, "2", 1.5, true, null] end',), ("none",), ("[bad",), (None,)], "x string").select(T.json_ints("x").alias("y")).collect()
    assert [r.y for r in rows] == [[3, 1, 1], [], [], []]


def test_allow_list(spark):
    urls = ["https://www.example.com/a", "http://sub.example.com", "https://badexample.com", "https://u@example.com/", "ftp://example.com:80/", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(T.domain_allowed("u", ["Example.com"]).alias("ok"), T.domain_allowed("u", []).alias("none"))
    assert [r.ok for r in df.collect()] == [True, True, False, False, False, False]
    assert not any(r.none for r in df.collect())


def test_small_functions(spark):
    row = one(spark, "Uses 300 Watts  and 5", T.has_technical_value("x"), T.estimate_tokens("x"), T.squash("x"), T.has_citation(F.lit("see [12]")), T.signed(F.lit(-0.054)), T.signed(F.lit(0.06)))
    assert tuple(row) == (True, 5, "Uses 300 Watts and 5", True, "-0.05", "+0.06")
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(T.l2_normalise("v").alias("n")).collect()
    assert v[0].n == [0.6, 0.8] and v[1].n == [0.0, 0.0]
    assert T.parse_bool(" Oui ") and not T.parse_bool("0") and T.parse_bool(None, True)


def test_fold_is_the_whole_decomposition(spark):
    samples = ["ﬁn ﬂow ½ ＡＢＣ １２ ² ™ … № é ß œ Ĳ ǆ 𝐀 ㎏ İstanbul 日本 Ⅷ", "plain ASCII", None, "", "".join(map(chr, range(0x80, 0x3000))), "".join(map(chr, range(0xF900, 0x10000))), "".join(map(chr, range(0x1D400, 0x1D800)))]
    want = [None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower() for s in samples]
    rows = spark.createDataFrame([(s,) for s in samples], "x string")
    assert [r[0] for r in rows.select(T.fold("x")).collect()] == want
    assert [r.a == r.b for r in ready(rows).select(T.fold("x").alias("a"), T.fold_full("x").alias("b")).collect()] == [True] * len(samples)


def test_character_references(spark):
    samples = ["caf&eacute; l&#8217;eau &#x2019; &amp;amp; &lt;b&gt; &copy 2020 &notit; &foo; &#0; &#150; &#129; &#xD800; &#99999999999; &#; & &&amp &#x1F600; a&b; &NotEqualTilde; &#11;x &Aacute&eacute", None, "", "plain"]
    rows = spark.createDataFrame([(s,) for s in samples], "x string")
    assert [r[0] for r in rows.select(html_source.unescape(F.col("x"))).collect()] == [None if s is None else html.unescape(s) for s in samples]


class Reader(HTMLParser):
    """The text outside dropped elements, by a tree of open elements."""

    VOID = ("br", "img", "meta", "hr")

    def __init__(self):
        super().__init__()
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.out.append(" ")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not any(t in html_source.DROPPED for t in self.open):
            self.out.append(data)


PIECES = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<nav>", "</nav>", "<HEADER id=1>", "</header >", "<svg/>", "<br>", "<img alt=\"x > y\">", "<!-- c > d -->", "<!DOCTYPE html>", "<script>if (a < b) '</p>'</script>", "<style>p > a {}</style>", "a < b", "1 <2", "&amp;", "&lt;b&gt;", "&eacute", "caf\u00e9", " word ", "\u00a0", "x&y", "<b>bold</b>", "</i>", "<a href=it's>", "</a>", "<span title = \"<nav>\" >", "</span>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_generated_pages_against_a_parser(pieces):
    page = "".join(pieces)
    reader = Reader()
    reader.feed(page)
    reader.close()
    assert html_source.read_html(page)[1] == " ".join("".join(reader.out).split())


def test_odd_pages(spark):
    pages = {
        "<title> A &amp; B </title><body>x": ("A & B", "A & B x"),
        "<svg><title>no</title></svg><title>yes</title>": ("yes", "yes"),
        "<nav>a<nav>b</nav>c</nav>d": ("", "d"),
        "<div><nav>links</div>rest": ("", "rest"),
        "a<script>never closed": ("", "a"),
        "a<!-- never closed": ("", "a"),
        "<title>open": ("open", "open"),
        "<p title='a > b'>in</p>": ("", "in"),
        "": ("", ""),
        "plain <": ("", "plain <"),
        "<textarea><b>x</b></textarea>": ("", "<b>x</b>"),
    }
    rows = ready(spark.createDataFrame([(k, v) for k, v in enumerate([*pages, None])], "k int, html string"))
    found = {r.k: (r.title, r.text) for r in rows.select("k", html_source.html_title("html", F.lit("")).alias("title"), html_source.html_text("html").alias("text")).collect()}
    assert found == {k: v for k, v in enumerate([*pages.values(), ("", None)])}
    one = rows.select(html_source.html_title("html", F.lit("")), html_source.html_text("html"))
    assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    long = "<p>x < y </p>" * 20_000 + '<a b="' * 2000
    assert html_source.read_html(long)[1].startswith("x < y x < y")


def test_pages_against_a_parser(spark):
    for r in ready(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).select("html", html_source.html_text("html").alias("text")).collect():
        reader = Reader()
        reader.feed(r.html)
        assert r.text == " ".join("".join(reader.out).split())


def test_references_cut_at_the_end_stay_if_bare_ones_do_not_count(spark):
    page = "<title>a &amp;&amp</title><p>&lt;b&gt; &notit; &notit &#39;x&#39 &#x41; &nbsp;&copy; &am</p>"
    assert html_source.read_html(page, bare=False) == ("a &&amp", "a &&amp <b> &notit; &notit 'x&#39 A © &am")
    assert html_source.read_html(page)[0] == "a &&"
    rows = html_source.web_pages(spark.createDataFrame([("u", page)], "url string, html string"), "2024-01-01", bare=False)
    assert rows.first().title == "a &&amp"


def test_upper_is_letter_by_letter(spark):
    words = ["Erßie", "ﬁn", "éa 𝐀ß", "", "abc"]
    found = spark.createDataFrame([(w,) for w in words], "x string").select(T.upper("x").alias("u"), F.lower(T.upper("x")).alias("l")).collect()
    assert [r.u for r in found] == ["ERßIE", "ﬁN", "ÉA 𝐀ß", "", "ABC"] and [r.l for r in found] == [w.lower() for w in words]
