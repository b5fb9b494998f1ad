from pyspark.sql import functions as F

from lodestar.functions import html, stem, text


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_tokens_are_whole_words_of_three_ascii_letters(spark):
    assert _one(spark, "Wölf wolf-den l'eau ab abc1 x_yz the CAT", text.tokens) == ["wolf", "den", "eau", "the", "cat"]
    assert _one(spark, "", text.tokens) == []
    assert _one(spark, None, text.tokens) is None


def test_index_tokens_keep_repeats_without_stopwords(spark):
    assert _one(spark, "the cat and the cat", text.index_tokens) == ["cat", "cat"]


def test_strip_removes_white_space_of_any_kind(spark):
    assert _one(spark, "\t 　\x1f a b\x85\r\n", text.strip) == "a b"


def test_hosts(spark):
    cases = {
        " HTTP://www.A-b.Example:8080/x#y": "a-b.example",
        "https://user:pw@c.test?q=1": "c.test",
        "//d.test/": "d.test",
        "e.test/path": "e.test",
        "http://www.www.f.test": "www.f.test",
        "http://[::1]:80/": "[::1]",
        "": None,
    }
    for url, host in cases.items():
        assert _one(spark, url, text.url_host) == host, url


def test_depth_weights_by_slashes(spark):
    for url, weight in (("a", 0.3), ("http://a/", 0.3), ("http://a/b/", 1.0), ("http://a/b/c", 1.0), ("http://a/b/c/d", 2.0)):
        assert _one(spark, url, text.url_depth_weight) == weight, url


def test_title_and_snippet(spark):
    page = "\n  \n  A title  \n\nand more\n"
    assert _one(spark, page, text.title) == "A title"
    assert _one(spark, page, text.snippet) == "A title and more..."
    assert _one(spark, " \n", text.title) == "Untitled Page"
    assert _one(spark, "", text.snippet) == "No snippet available."
    assert _one(spark, "x" * 300, text.title) == "x" * 100
    assert _one(spark, "x" * 300, text.snippet) == "x" * 200 + "..."
    assert _one(spark, None, text.title) == "Untitled Page"


def test_anchor(spark):
    assert _one(spark, "HTTP://A/b#c#d", text.anchorless) == "http://a/b"


def test_html(spark):
    page = '<p>A<script>x<1</script> <a href="b#c">b</a><a HREF="http://o.test/">o</a><a href="mailto:x@y">m</a><a>n</a><!-- no --> &amp; z'
    df = spark.createDataFrame([(page, "http://h.test/d/e"), (None, None), ("", "")], "h string, b string")
    rows = df.select(html.html_text("h").alias("t"), html.html_links("h", "b").alias("l")).collect()
    assert rows[0].t == "A bomn & z" and rows[0].l == ["http://h.test/d/b#c", "http://o.test/"]
    assert rows[1].t is None and rows[1].l is None
    assert rows[2].t == "" and rows[2].l == []


def test_porter():
    # examples from the publication, and of the amendments
    pairs = "dying die|skies sky|cried cri|tied tie|enjoy enjoy|geology geolog|hopefully hope|innings inning|possibly possibl|caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|formaliti formal|sensibiliti sensibl|triplicate triplic|formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll"
    for pair in pairs.split("|"):
        word, want = pair.split()
        assert stem.porter_stem(word) == want, word
