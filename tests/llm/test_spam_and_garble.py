import pytest

from lodestar.llm import keyword_pages, mojibake
from lodestar.llm.encodings import CHAINS, LOSSY, clean_shape, garble, garbled_forms
from lodestar.llm.lines import read_line

PAGES = "doc_id string, text string, fetched_at timestamp, links bigint"
URLS = "id bigint, url string, words string"
EDGES = "src string, dst string, site string"
PROSE = "The wolf crossed the heath at a trot and then rested for hours, as it had in May. Nobody had seen it so far from the river, and the ranger wrote it down."
SPAM = [
    "\n".join(["owl toy, owl buy, owl free, toy fox, owl toy, owl shirt, owl buy, owl toy, owl free"] * 4),
    "\n".join(f"http://owl-toy{i}.example/dune/" for i in range(20)),
    "\n".join(f"www.fox-buy{i}.example - owl mask" for i in range(20)),
    "\n".join(f"owl mask | ${i}.99 | add to cart\nFox toy ★★★★ ({i}) from $3" for i in range(12)),
    " ".join(f"#owl_toy{chr(97 + i)} #fox-buy" for i in range(20)),
    "\n".join(["Looking for owl toy? Our owl toy is the best owl toy for owl toy fans. Why owl toy? Because owl toy beats any owl toy when you need owl toy."] * 3),
]
HAM = [
    "\n".join([PROSE] * 3),
    "\n".join(f"Owl: adult, dune, {i} records in May." for i in range(20)),
    "\n".join(f"Owl – {PROSE}" for _ in range(8)),
    "\n".join(f"[{i}] O. Kvernsel and J. Abrashe, The owl of May, Morwick Papers {i}, pp. 3–9." for i in range(12)),
    "\n".join("Over the dune and over the stone,\nlynx, lynx, you hunt alone,\npast the fen the squid have flown." for _ in range(8)),
    "\n".join(f"January: {i} hunts, 5 kills, 63 hours of watching at the fen" for i in range(12)),
    "owl toy",
    "",
]


TITLES = " | ".join(["Reading the tracks of a kestrel", "Night hunters of the reef", "What the owl eats in May", "The wolf of the fen", "A winter with the pack", "Return of the grey lynx"])


def _tables(spark, rows, links=()):
    pages = spark.createDataFrame([(d, t, None, 0) for d, t, _ in rows], PAGES)
    urls = spark.createDataFrame([(int(d[5:-4]), u, "x") for d, _, u in rows], URLS)
    return pages, urls, spark.createDataFrame([*links, (None, None, None)], EDGES)


def test_keyword_pages(spark):
    rows = [(f"page_{i}.txt", t, f"http://s{i}.test/") for i, t in enumerate(SPAM + HAM)] + [("page_50.txt", None, "http://x.test/")]
    # the refrain differs, what is said around it is the same on three hosts
    rows += [(f"page_{60 + i}.txt", SPAM[5].replace("owl toy", x), f"http://r{i}.test/") for i, x in enumerate(("elk mask", "fox shirt", "bear pin"))]
    # a list of titles is spam if other hosts have the titles, and none if nobody has
    rows += [(f"page_{70 + i}.txt", "\n".join([TITLES] * 3), f"http://t{i}.test/") for i in range(3)]
    rows += [("page_80.txt", TITLES.replace("the", "our").replace("of a", "by some"), "http://u.test/")]
    rows += [("page_81.txt", "\n".join(f"http://fox-{x}.example/" for x in ("one", "two", "six")) + "\nowl mask, owl pin, owl toy, fox pin, elk mask", "http://v.test/")]
    got = keyword_pages.keyword_evidence(*_tables(spark, [*rows, rows[0]], [(" HTTP://S0.test/", "b", "c")] * 3)).collect()
    assert len({r.doc_id for r in got}) == len(got)
    by = {r.doc_id: r for r in got}
    assert {d for d, r in by.items() if r.keyword_page} == {f"page_{i}.txt" for i in (0, 1, 2, 3, 4, 5, 60, 61, 62, 70, 71, 72, 81)}
    assert by["page_0.txt"].links == 3 and by["page_70.txt"].replicated == 1.0 == by["page_60.txt"].replicated and by["page_80.txt"].replicated < keyword_pages.REPLICATED
    none = [spark.createDataFrame([], s) for s in (PAGES, URLS, EDGES)]
    assert keyword_pages.keyword_pages(*none).count() == 0


def test_pages_without_a_host_are_no_site(spark):
    rows = [(f"page_{i}.txt", "\n".join([TITLES] * 3), None) for i in range(5)]
    assert keyword_pages.keyword_pages(*_tables(spark, rows)).count() == 0


def test_every_page_has_its_replication(spark, monkeypatch):
    """Bare lists and pages of prose too, whether a block settles a shingle, several do, or a page has no host."""
    share = "\n".join([PROSE, "owl mask, fox pin, elk toy, owl shirt, bear mug"])
    listed = "\n".join(["owl mask, fox pin, elk toy, owl shirt, bear mug", "heron cup, crane hat, stork bag, egret tie, ibis sock"])
    texts = [share, listed, share + "\nOnly this page ends with a line of its own here.", "owl toy", "", TITLES, *SPAM, *HAM]
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26) + "en"
    rows = [(f"page_{i}.txt", texts[i * 7 % len(texts)], None if i % 9 == 4 else f"http://s{i % 11}.test/") for i in range(70)]
    rows = [(d, t + f"\nThe ranger {name(i)} wrote the day down and then {name(i // 4)} went home." * (i % 3), u) for i, (d, t, u) in enumerate(rows)]
    at = {d: set(keyword_pages.Shingler().of([t])[0].tolist()) for d, t, _ in rows}
    hosts = {}
    for d, _, u in rows:
        for x in at[d] if u else ():
            hosts.setdefault(x, set()).add(u)
    want = {}
    for d, t, _ in rows:
        own = keyword_pages.Shingler().of([t])[0].tolist()
        want[d] = sum(len(hosts.get(x, ())) >= keyword_pages.HOSTS for x in own) / max(1, len(own))
    assert {0.0, 1.0} < set(want.values())
    tables = _tables(spark, rows)
    for block in (keyword_pages.BLOCK, 1):  # one block a task, and one a batch
        monkeypatch.setattr(keyword_pages, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = {r.doc_id: r.replicated for r in keyword_pages.keyword_evidence(*tables).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got and got == pytest.approx({d: want[d] for d in got})
        assert {d for d, t, _ in rows if t.startswith((share, listed))} <= set(got)


def test_shingles_of_lines():
    shingle, at = keyword_pages.Shingler(3).of(["a b c d\na b", "", "x\nA b, c!"])
    assert at.tolist() == [0, 0, 2] and shingle[0] == shingle[2] != shingle[1]
    assert keyword_pages.slotted("owl toy is the best owl toy for owl toy fans".split())[0] == keyword_pages.SLOT
    assert keyword_pages.kind_of(read_line("The wolf of the fen went home on its own before the rain came.")) == keyword_pages.PLAIN


@pytest.mark.parametrize("word", ["São", "Übung", "żółw", "лес", "été", "群れ", "won’t", "½", "狼"])
def test_every_form_can_be_told_from_the_word(word):
    forms = garbled_forms(word)
    assert word not in forms and forms
    for form, k in forms.items():
        if k < len(CHAINS):
            assert garble(word, CHAINS[k]) == form
        else:
            assert k - len(CHAINS) < len(LOSSY)


@pytest.mark.parametrize("word", ["São", "MAÑANA", "Übung", "лес", "Лес", "群れは", "“We", "won’t", "±", "½", "★★★", "naïve", "été", "👩🏽‍🔬", "１２", "¿Cuándo"])
def test_clean(word):
    assert clean_shape(word)


@pytest.mark.parametrize("word", ["SÃ£o", "Ã‰tÃ©", "S�l", "лес\x81", "erklГ¤ren", "├⌐t├⌐", "m√®tres", "Â©", "â€œWe", "aSÃo"])
def test_not_clean(word):
    assert not clean_shape(word)


DOCS = "doc_id bigint, text string, token string, weight int"
SENTENCES = [
    "A raposa está na região de São Veril e não come répteis até amanhã.",
    "Самец метит границы участка, и поэтому другие звери обходят долину.",
    "Der Fuchs lauert am Waldrand, später hört man ihn in den Höhlen – für Schäfer ein Ärgernis.",
    "群れは雪の上を静かに進んでいく。山猫は夜に動き、昼は岩の陰で休む。",
    "The café at Ruvéna keeps a cast of the owl’s wing; it costs €5, “only”.",
    "Źródło wyschło, więc zwierzęta schodzą nad jezioro.",
]


def test_documents(spark):
    rows = [(i, SENTENCES[i % 6]) for i in range(120)]
    garbled = {
        200: garble(SENTENCES[0], (("utf_8", "cp1252"),)), 201: garble(SENTENCES[0], (("utf_8", "latin_1"), ("utf_8", "latin_1"))), 202: garble(SENTENCES[1], (("cp1251", "koi8_r"),)),
        203: garble(SENTENCES[1], (("utf_8", "cp1251"),)), 204: garble(SENTENCES[2], (("utf_8", "cp437"),)), 205: garble(SENTENCES[3], (("euc_jp", "latin_1"),)),
        206: SENTENCES[4].replace("café", "caf�"), 207: "An owl at " + garble("Ruvéna", (("utf_8", "mac_roman"),)) + " only.", 208: garble(SENTENCES[5], (("cp1250", "cp1252"),)),
        209: "Not in the corpus: " + garble("Señalização", (("utf_8", "cp1252"),)),
    }
    fine = [(300, None), (301, ""), (302, "plain"), (303, "А И У В"), (304, "1 × 2 ≠ 3"), (305, "a\xa0b　c"), (306, "MAÑANA É JÁ"), (307, "👩🏽‍🔬 ½ km² ±6"), (308, "é " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*rows, *garbled.items(), *fine, (200, garbled[200])]], DOCS)
    assert sorted(r.doc_id for r in mojibake.garbled_documents(docs).collect()) == sorted(garbled)
    back = {r.doc_id: r.text for r in mojibake.restored(docs).collect()}
    for i, k in ((200, 0), (201, 0), (202, 1), (203, 1), (204, 2), (208, 5)):
        assert back[i] == SENTENCES[k], i
    assert back[207] == "An owl at Ruvéna only." and back[209] == "Not in the corpus: Señalização"
    assert mojibake.garbled_documents(spark.createDataFrame([], DOCS)).count() == 0
