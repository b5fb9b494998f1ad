import os
import random
from fractions import Fraction

import pytest

from lodestar.llm import byte_bpe, encode, mixing

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.DEFAULT_VOCABULARY), reason="no vocabulary here")
DOCS = "doc_id bigint, text string, source string, n_tokens bigint, shard int"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(byte_bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    return ranks, tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(reference):
    ranks, library = reference
    encoder = byte_bpe.Encoder(ranks, held=500)
    random.seed(1)
    pieces = ["a", "b", "aa", " ", "  ", "\n", "é", "'s", "1", "x.", "　", "\t", "你", " a", "!!", "\xa0", "👩🏽‍🔬", "<|endoftext|>", "\r\n", "\x1c", "​", "Übung"]
    for _ in range(2000):
        text = "".join(random.choices(pieces, k=random.randint(0, 40)))
        assert encoder.encode(text) == library.encode_ordinary(text), repr(text)


def test_very_long_pre_tokens(reference):
    ranks, library = reference
    for text in ("a" * 20_000, "ab" * 9_000 + "c", "".join(random.choices("etaoinshrdlu", k=20_000)), "9" * 5_000, " " * 3_000 + "x"):
        assert byte_bpe.Encoder(ranks).encode(text) == library.encode_ordinary(text)


def test_queue_gives_ranks_in_order():
    queue = byte_bpe.RankQueue()
    random.seed(3)
    want = {}
    for _ in range(3000):
        r, p = random.randrange(60_000), random.randrange(100)
        want.setdefault(r, []).append(p)
        queue.push(r, p)
    got = []
    while (x := queue.pop()) is not None:
        got.append(x)
    assert got == [(r, sorted(p)) for r, p in sorted(want.items())]


def test_encoded_table(spark, reference):
    _, library = reference
    rows = [(1, "The wolf.", "a", 0, 0), (2, "", "a", 0, 0), (3, None, None, 0, 0), (4, "wolf " * 30_000, "b", 0, 0), (1, "The wolf.", "a", 0, 0)]
    got = encode.encoded(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((d, library.encode_ordinary(t or "")) for d, t, *_ in rows)
    assert encode.encoded(spark.createDataFrame([], DOCS)).count() == 0


def test_apportionment():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7, dict.fromkeys("abc", 9)) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": Fraction(1, 2), "b": Fraction(1, 2), "c": 0}, 10, {"a": 3, "b": 99, "c": 9}) == {"a": 3, "b": 7, "c": 0}
    assert mixing.sainte_lague({"a": 1}, 5, {"a": 2}) == {"a": 2}


def test_apportionment_seat_by_seat():
    random.seed(11)
    for _ in range(500):
        keys = range(random.randint(1, 7))
        votes, limit = {k: random.choice([0, 1, random.randint(1, 900)]) for k in keys}, {k: random.choice([0, 3, 999, random.randint(0, 99)]) for k in keys}
        seats = random.randint(0, 300)
        want = dict.fromkeys(keys, 0)
        for _ in range(seats):
            able = [k for k in keys if votes[k] and want[k] < limit[k]]
            if able:
                want[min(able, key=lambda k: (-Fraction(votes[k], 2 * want[k] + 1), k))] += 1
        assert mixing.sainte_lague(votes, seats, limit) == want


TARGETS = "source string, target_share double, max_repeats int, n_tokens bigint"


def _corpus(spark):
    random.seed(5)
    rows = []
    for i in range(600):
        source = random.choices(["A.test", " a.TEST", "b.test", "c.test", "other", None], [30, 5, 20, 3, 10, 2])[0]
        rows.append((i, random.choice(["", None, "wolf den " * random.randint(1, 60)]), source, 0, 0))
    return spark.createDataFrame([*rows, *rows[:9]], DOCS), rows


def test_mix_keeps_shares_and_repeats(spark):
    docs, rows = _corpus(spark)
    targets = spark.createDataFrame([("a.test", 0.5, 2, 0), ("B.test ", 0.3, 1, 0), ("c.test", 0.1, 2, 0), ("absent.test", 0.1, 5, 0)], TARGETS)
    mixed = mixing.mix(docs, targets).collect()
    most = {"a.test": 2, "b.test": 1, "c.test": 2}
    assert len({r.doc_id for r in mixed}) == len(mixed)
    assert all(0 < r.copies <= most[r.source] for r in mixed)
    report = {r.source: r for r in mixing.shares(docs, targets).collect()}
    total = sum(r.tokens for r in report.values())
    assert abs(sum(r.n_tokens * r.copies for r in mixed) - total) < 0.02 * total + 64 * 120
    short = {s for s, r in report.items() if r.tokens * {**most, "absent.test": 5}[s] < r.target_share * total}
    assert {r.source for r in mixing.unfillable(docs, targets).collect()} == short == {s for s, r in report.items() if not r.fillable}
    assert "absent.test" in short
    # what the full sources get keeps the proportion of their targets
    free = [s for s in report if s not in short]
    per = [report[s].mixed_tokens / report[s].target_share for s in free]
    assert max(per) <= 1.15 * min(per)
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)


def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1, 0), (None, None, None, 0)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0 and mixing.unfillable(docs, targets).count() == 0
    assert [(r.source, r.mixed_tokens, r.reached_share) for r in mixing.shares(docs, targets).collect()] == [("a", 0, 0.0)]
