import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import body_model, keyword_pages, main_body, repeated_lines, residue
from lodestar.llm.boosting import train
from lodestar.llm.lines import _WORDS, Letters, Reader, folded, read_line, site_name, without_name

PAGES = "doc_id string, text string, fetched_at timestamp, host string, line_no int"
URLS = "id bigint, url string, text string"
EDGES = "src string, dst string, doc_id string"


def _tables(spark, rows):
    pages = spark.createDataFrame([(d, t, None, "x", 1) for d, t, _ in rows], PAGES)
    urls = spark.createDataFrame([(int(d[5:-4]), u, "x") for d, _, u in rows if u != "-"], URLS)
    return pages, urls


def _site(n, k, host, line):
    return [(f"page_{i}.txt", line(i), host) for i in range(n, n + k)]


def _corpus():
    random.seed(6)
    pool = [f"Line {w} of the site" for w in "abcdefgh"] + ["ＷＩＤＥ", "Straße", "STRASSE ", "x" * 700, "x" * 700 + "y", "z", "no\xa0break  12", "NO BREAK 7", "", " \t"]
    rows = []
    for k, (host, count) in enumerate([("http://www.A.test:80/", 40), ("https://b.test/", 9), ("http://c.test", 8), ("HTTP://a.TEST/x", 5), (None, 10), ("-", 10)]):
        for i in range(count):
            text = "\n".join(random.choices(pool, weights=[9, 5, 3, 2, 1, 1, 1, 1, 3, 2, 2, 4, 2, 2, 3, 3, 3, 1], k=random.randint(0, 9)) + [f"own {k} {chr(97 + i)}"])
            rows.append((f"page_{100 * k + i}.txt", random.choice([text] * 9 + [None, ""]), host))
    return rows


def test_repeated_lines_match_brute_force(spark):
    rows = _corpus()
    pages, urls = _tables(spark, [*rows, *rows[:6]])
    host = lambda u: None if u in (None, "-") else u.lower().split("//")[1].removeprefix("www.").split("/")[0].split(":")[0]
    sizes, on = Counter(), Counter()
    for _, t, u in rows:
        if h := host(u):
            sizes[h] += 1
            on.update({(h, repeated_lines.normalised(x)) for x in (t or "").split("\n") if x.strip()})
    want = {
        (d, k) for d, t, u in rows if (h := host(u)) for k, x in enumerate((t or "").split("\n"), 1)
        if x.strip() and on[h, repeated_lines.normalised(x)] >= 8 and on[h, repeated_lines.normalised(x)] * 4 >= sizes[h]
    }
    got = [tuple(r) for r in repeated_lines.repeated_lines(pages, urls).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    clean = {r.doc_id: r.text for r in repeated_lines.without_repeated_lines(pages, urls).collect()}
    assert len(clean) == len(rows)
    for d, t, _ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (d, k) not in want)
        assert clean[d] == kept


def test_chunks_depend_on_content_alone():
    random.seed(7)
    text = bytes(random.choices(range(97, 123), k=4000))
    chunker = repeated_lines.Chunker()
    whole = chunker.cut([[text]])
    assert whole.per_page.tolist() == [len(whole.chunk)] and 60 < len(whole.chunk) < 300
    moved = chunker.cut([[b"other"], [b"new start", text]])
    assert len(set(whole.chunk.tolist()) & set(moved.chunk.tolist())) >= len(whole.chunk) - 2
    # line ends are blanks like any other: but for the blank that a new line end brings, chunks stay
    wrapped = chunker.cut([[text[:1000], text[1000:2500], text[2500:]]])
    assert len(set(whole.chunk.tolist()) - set(wrapped.chunk.tolist())) <= 6
    same = chunker.cut([[b"same", b"x", b"same"], [text]])
    assert same.line[0] == same.line[2] != same.line[1] and same.count.tolist() == [3, 1]


def test_passages_are_found_however_they_are_wrapped(spark):
    random.seed(9)
    words = "".join(random.choices("etaoinshrdlu   ", k=2400)).split()
    rows = []
    for i in range(12):
        at = sorted(random.sample(range(5, len(words) - 5), 4))
        notice = [" ".join(words[a:b]) for a, b in zip([0, *at], [*at, len(words)], strict=True)]
        own = "".join(random.choices("abcdefgh ", k=300))
        rows.append((f"page_{i}.txt", "\n".join([own, *notice, own[::-1]]), "http://a.test/"))
    pages, urls = _tables(spark, rows)
    assert repeated_lines.repeated_lines(pages, urls).count() == 0  # no line is the same on two pages
    got = {tuple(r) for r in repeated_lines.repeated_passages(pages, urls).collect()}
    inner = {(d, k) for d, t, _ in rows for k in (3, 4, 5) if len(t.split("\n")[k - 1]) > 200}
    assert len(inner & got) >= 0.9 * len(inner) and not any(k in (1, 7) for _, k in got)


def test_no_pages(spark):
    pages, urls = _tables(spark, [])
    edges = spark.createDataFrame([], EDGES)
    assert repeated_lines.repeated_lines(pages, urls).count() == 0
    assert residue.residue_pages(pages, urls).count() == 0
    assert main_body.furniture(pages, urls, edges).count() == 0


BODY = "The wolf crossed the heath at a trot and then rested for hours, as it had in May. Nobody had seen it so far from the river before, and the ranger wrote it down with great care that evening."
PROSE = "\n".join(["A winter with the pack", BODY, BODY])


RESIDUE = [
    "A title\nDear {{ name }}, " + BODY, "Name: undefined", "What the [INSERT animal] eats\n" + BODY, "By *|author|*\n" + BODY, "NaN", "$title$\n" + BODY, "Your text goes here.\n" + BODY,
    "Lorem ipsum dolor amet consectetur adipiscing elit eiusmod.", "Venatu noctor vexim valdis paventi sollu celsu corpessit tibrant.", "404 – Page not found", "Please turn on JavaScript to see this page.",
    "Access denied. You have no permission to open /a on this server.\nReference: 12-3", "Die angeforderte Seite wurde nicht gefunden.", "Most read\nThe owl of May ›\nA fox (12)\nJavaScript is disabled\n© 2014 Site",
    "Internal server error. " * 20, "The page was not found on this server and the service is temporarily unavailable, so access was denied to all who asked for it while something went wrong; " * 4 + "error 500.",
]
FINE = [
    PROSE, PROSE + "\nSome features of this page need JavaScript.", PROSE + "\nLet the set {A, B, C} stand for three dens, as [2] says [sic].", PROSE + "\nThe value was undefined for the days without snow.",
    PROSE + "\nThe talk “Lorem or leopard?” mocked the guides of Ipsum Creek.", PROSE + "\nThe printed atlas needs no JavaScript, and the page was not found.", "A short note on the owl.", "", " \n", "owl, owl toy, owl. " * 20,
]


def test_residue(spark):
    pages, urls = _tables(spark, [(f"page_{i}.txt", t, "-") for i, t in enumerate(RESIDUE + FINE)])
    assert {r.doc_id for r in residue.residue_pages(pages, urls).collect()} == {f"page_{i}.txt" for i in range(len(RESIDUE))}


def test_what_such_pages_say_is_learned(spark):
    """A line of three hosts that stands mostly on pages with other evidence is evidence itself; a notice on pages with prose is none."""
    odd, notice = "Somebody should put words into this box", "This site wants JavaScript for its maps."
    rows = [(f"page_{i}.txt", f"{odd}\n{{{{ field }}}} {chr(97 + i)}", f"http://h{i % 4}.test/") for i in range(8)]
    rows += [("page_20.txt", odd, "http://h1.test/"), ("page_21.txt", "An owl.\n" + notice, "http://h9.test/")]
    rows += [(f"page_{i}.txt", f"On den {chr(97 + i - 30)}\n{BODY} Den {chr(97 + i - 30)} was empty.\n{notice}", f"http://h{i % 5}.test/") for i in range(30, 45)]
    pages, urls = _tables(spark, rows)
    assert {r.doc_id for r in residue.residue_pages(pages, urls).collect()} == {f"page_{i}.txt" for i in (*range(8), 20)}


def test_long_recurrent_notice_is_subtracted(spark):
    notice = "This page may show an error 404 where a record was not found, and the keepers of the archive say so at some length. " * 4
    assert len(notice) > 400
    rows = _site(0, 6, "http://a.test/", lambda i: f"Note {chr(97 + i)}\n{notice}") + [("page_9.txt", notice, "http://b.test/")]
    pages, urls = _tables(spark, rows)
    assert {r.doc_id for r in residue.residue_pages(pages, urls).collect()} == {"page_9.txt"}


def test_residue_pages(spark):
    rows = [("page_1.txt", "Error 404", "http://a.test"), ("page_1.txt", "Error 404", "http://a.test"), ("page_2.txt", PROSE, None), ("page_3.txt", None, "-"), ("page_4.txt", "", "-"), ("page_5.txt", "TBD", "-")]
    pages, urls = _tables(spark, rows)
    assert sorted(r.doc_id for r in residue.residue_pages(pages, urls).collect()) == ["page_1.txt", "page_5.txt"]
    assert residue.without_residue(pages, urls).count() == 3


def _page(i):
    """Menus, lists and legal lines of the site around an article of the page's own."""
    random.seed(i)
    word = lambda: "".join(random.choices("bdfgklmnprstv", k=1) + random.choices("aeiou", k=1) + random.choices("lnrst", k=1) + random.choices("aeiou", k=1))
    prose = lambda: " ".join(f"The {word()} of {word()} went to the {word()} in the {word()} and {word()} was on its {word()}." for _ in range(3))
    side = ["Popular this week", f"The owl of {word()} ›", f"A fox in {word()} {word()}", f"Why {word()} fear the owl ({i})"]
    body = [f"The heron of {word()}", "Updated 3 days ago · 2 min read", prose(), random.choice(["Diet", "Young", "Senses", "Rivals"]), prose(), f"- {word()} at the wing", f"- {word()} at the claw", prose()]
    return "\n".join(["Home | Shop | Contact | Search", "Alpha Wild", "", *side, "", *body, "", "© 2020 Alpha Wild", "Back to top"])


def _sites(k, n):
    return [row for s in range(k) for row in _site(100 * s, n, f"http://site{chr(97 + s)}wild.test/{s}", lambda i, s=s: _page(i).replace("Alpha", f"Site{chr(97 + s)}wild"))]


def test_main_body(spark):
    rows = _sites(4, 12)
    pages, urls = _tables(spark, [*rows, ("page_990.txt", "Error 404", "-"), ("page_991.txt", None, "-"), ("page_992.txt", " \n", "-")])
    edges = spark.createDataFrame([("http://alpha.test/x", "y", "z")], EDGES)
    got = [tuple(r) for r in main_body.furniture(pages, urls, edges).collect()]
    assert len(got) == len(set(got))
    want = {(d, k) for d, *_ in rows for k in (1, 2, 4, 5, 6, 7, 10, 18, 19)}
    assert len(want & set(got)) >= 0.95 * len(want) and len(want & set(got)) >= 0.95 * len(got)
    bodies = {r.doc_id: r.body for r in main_body.main_bodies(pages, urls, edges).collect()}
    assert bodies.keys() == {d for d, *_ in rows} and all(" went to the " in b and "Back to top" not in b for b in bodies.values())


def test_trees_overrule_weak_labels():
    """Labels are withheld from the features, so the trees correct some; decoding changes some lines again."""
    rows = _sites(6, 14)
    reader = Reader()
    pages = [(reader.page(t), site_name(u.split("/")[2]), u.split("/")[2]) for _, t, u in rows]
    model, weights = body_model.fit([(t, u.split("/")[2]) for _, t, u in rows])
    made = body_model.Features(weights)
    known = overruled = unknown = 0
    for (lines, name, _), label in zip(pages, body_model.weak_labels(pages), strict=True):
        batch = made.of([(lines, name)])
        for i, m in zip(batch.at.tolist(), model.margin(batch.x), strict=True):
            known += i in label
            unknown += i not in label
            overruled += i in label and (m > 0) != bool(label[i])
    assert unknown > 0 and 0 < known and overruled < 0.2 * known
    weights_only = {w for w in weights if len(w) > 1}
    assert weights_only  # words are learned, none is given
    noisy = np.array([0.2, -3.0, -3.0, -2.5])
    assert (noisy > 0).tolist() != body_model.decode(noisy, [0] * 4, [0] * 4).tolist()


def test_site_without_recurrence_teaches_nothing():
    model, _ = body_model.fit([])
    assert model.margin(np.zeros((2, 3))).tolist() == [0.0, 0.0]


def test_keyword_pages_have_no_rows(spark):
    prose = "The wolf is seen in the hills when it is on the way to the river with all of its young."
    names = ("wolf lynx puma bear otter marten stoat", "heron eagle falcon hawk owl kite crane", "shark orca pike eel ray perch carp", "cobra viper python boa adder toad newt")
    text = "\n".join(["On the wolves of the hills", "", prose, prose, "", *names])
    rows = [("page_1.txt", text, "http://a.example/1"), ("page_2.txt", text, "http://b.example/2"), ("page_3.txt", text + "\n{{ title }}", "http://c.example/3")]
    pages = spark.createDataFrame([(d, t, None) for d, t, _ in rows], "doc_id string, text string, fetched_at timestamp")
    urls = spark.createDataFrame([(i + 1, u) for i, (_, _, u) in enumerate(rows)], "id long, url string")
    edges = spark.createDataFrame([], "src string, dst string")
    found = {r.doc_id for r in keyword_pages.keyword_pages(pages, urls, edges).collect()}
    assert found <= {"page_1.txt", "page_2.txt", "page_3.txt"}
    assert main_body.furniture(pages, urls, edges).count() == 0


def test_lines_are_counted_once_for_both_judges(spark, monkeypatch):
    pages, urls = _tables(spark, _sites(2, 12))
    keys, group_by = [], type(pages).groupBy
    monkeypatch.setattr(type(pages), "groupBy", lambda df, *on: keys.append([str(k) for k in on]) or group_by(df, *on))
    assert main_body.furniture(pages, urls, spark.createDataFrame([], EDGES)).count()
    assert keys.count(["site", "code"]) == 1


def test_letters_are_cut_as_by_the_pattern():
    letters = Letters()
    every = "a".join(map(chr, range(0x30000)))
    texts = [every, every[: 2 << 15], "", "\n", " a\n\nb1c_d ’e’\r\nß²½ Ⅻ x\u0301", "𝔘nicode 😀 wörter\n𐐨b2"]
    for text in texts:
        assert [x.split() for x in letters.spaced(text).split("\n")] == [_WORDS.findall(x) for x in text.split("\n")]
        assert letters.words(text) == _WORDS.findall(text)


def test_hints_miss_no_message():
    said = [
        "404 Not Found", "0", "– erro: 500", "Fehler 404", "http: 403", "«Erreur» 12", "404: gone", "The page does not exist", "page doesn’t exist.", "no longer available", "Bad Gateway",
        "gateway timeout", "Service temporarily unavailable", "Uncaught TypeError", "java.lang", "exception at line", "Access to this page is denied", "not authorised", "session expired",
        "please log in", "sign in to", "not available in your region", "not a robot", "You are human", "under maintenance", "Enable JavaScript", "allow scripts", "ohne Skript", "sin script",
        "no encontrada", "no existe", "no disponible", "accès refusé", "n’existe plus", "nicht gefunden", "nicht verfügbar", "indisponível", "acesso negado", "1", "A plain line of the page.",
        "12 robots", "The error of his ways was plain", "Erroneous", "http and https",
    ]
    lines = [read_line(x) for x in said]
    alone = [residue.has_message(x) for x in lines]
    residue.hint(lines)
    assert [residue.has_message(x) for x in lines] == alone == [residue.MESSAGE.search(x.low) is not None for x in lines]
    assert any(alone) and not all(alone) and [residue.hinted(x) for x in lines] == [any(h in x.low for h in residue._HINTS) for x in lines]


def test_decoding_is_consistent():
    # a run of furniture with one weak line goes as a whole, a clear line of another run stays
    margin = np.array([3.0, -0.4, 3.0, -6.0])
    assert body_model.decode(margin, [0, 0, 0, 0], [0, 0, 0, 1], price=1.0).tolist() == [True, True, True, False]
    assert body_model.decode(np.array([4.0, -4.0]), [0, 0], [0, 0]).tolist() == [True, False]
    assert body_model.decode(np.zeros(0), [], []).tolist() == []


def test_boosting_on_held_out_rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] + x[:, 2] > 0)).astype(float)
    model = train(x[:3000], y[:3000], trees=80, depth=5)
    assert ((model.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.93
    assert train(x[:5], np.ones(5)).margin(x[:2]).min() > 0 and len(train(x[:0], y[:0]).features) == 0


def test_folding():
    assert without_name(folded("Made at Siteawild Notes"), site_name("www.sitea-wild.test")) == "made at @ notes"
    assert without_name("owl", site_name(None)) == "owl"
    assert folded("  ©  2017\xa0ALPHA\t") == "© 0 alpha"
    assert repeated_lines.normalised("STRASSE 12\x85x") == repeated_lines.normalised("straße 7 x")
