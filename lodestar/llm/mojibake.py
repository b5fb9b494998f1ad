"""Texts that were decoded with the wrong encoding: which they are, and what they were.

The words of the corpus that hold other than ASCII characters are counted. Every word that looks rightly decoded is
garbled by all chains of encodings; the forms are hash-joined with the words that occur, and a word that equals a
garbled form of a more frequent word is replaced by it. What the join leaves, misshapen words whose original the corpus
lacks, is read against a table of garbled single characters: those of the corpus and the letters of Latin and Cyrillic,
so its size is bounded by Unicode.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.encodings import CHAINS, COMMON_LETTERS, COMMON_SIGNS, certain, clean_shape, garble, garbled_forms
from lodestar.session import cut_lineage

# Scripts that set no blanks between words; their runs are cut into pieces of at most eight characters.
_RUNNING = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{_RUNNING}]{{1,8}}|[A-Za-z]*[^\x00-\x7f{_RUNNING}](?:[A-Za-z]|[^\x00-\x7f{_RUNNING}])*")
OFTENER = 4  # times that an original must be more frequent than a garbled form which looks like a word itself
PER_SALT = 100_000  # documents of the commonest garbled word for each salt
HELD = 200_000
LONG = 24  # longer runs, as garbled text without blanks is, are no words: they are read where they stand


def runs(text: str) -> list[str]:
    """Runs of ASCII letters and other than ASCII characters with at least one of the latter."""
    return [] if text.isascii() else TOKEN.findall(text)


def tokens(text: str) -> list[str]:
    """The runs that count as words."""
    return [t for t in runs(text) if len(t) <= LONG]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the task with the number of its texts they stand in."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        seen.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(set(tokens(text)))
        if len(seen) > HELD:
            yield flush()
    yield flush()


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("clean", pa.array([clean_shape(t) for t in batch.column(0).to_pylist()], pa.bool_()))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in {token, token.lower(), token.upper(), token.capitalize()}:
                for form, chain in garbled_forms(word).items():
                    for column, v in zip(out, (form, word, n, chain), strict=True):
                        column.append(v)
        table = pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], names=["token", "original", "often", "chain"])
        yield from table.to_batches(max_chunksize=50_000)


def character_tables(characters: list[str]) -> list[tuple[int, dict[str, str]]]:
    """Per chain: garbled forms of single characters, of two characters or more, and what they were."""
    out = []
    for k, chain in enumerate(CHAINS):
        table: dict[str, str] = {}
        for c in characters:
            form = garble(c, chain)
            if form is not None and len(form) > 1 and form != c:
                table.setdefault(form, c)
        if table:
            out.append((k, table))
    return out


class CharacterReader:
    """Reads misshapen words character by character."""

    def __init__(self, characters: list[str]) -> None:
        self.tables = [(k, t, sorted({len(f) for f in t}, reverse=True)) for k, t in character_tables(characters)]

    def read(self, token: str) -> tuple[str, int] | None:
        """The word by the chain that explains most of its characters beyond ASCII, and the chain; None if no chain makes it well-formed."""
        best: tuple[int, int, str, int] | None = None
        for k, table, lengths in self.tables:
            i = hits = 0
            made: list[str] = []
            while i < len(token):
                for n in lengths:
                    piece = token[i : i + n]
                    if len(piece) == n and piece in table:
                        made.append(table[piece])
                        hits += sum(c > "\x7f" for c in piece)
                        i += n
                        break
                else:
                    made.append(token[i])
                    i += 1
            word = "".join(made)
            if hits and clean_shape(word):
                found = (hits, -len(word), word, k)
                if best is None or found[:2] > best[:2]:
                    best = found
        return (best[2], best[3]) if best else None


def weight(token: str, clean: bool) -> int:
    """How much a matched word tells: 2 is enough for a document, words that look rightly decoded tell by their length."""
    letters = sum(map(str.isalpha, token))
    return 2 if certain(token, clean) or letters >= 4 else int(letters == 3)


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weights = [weight(t, c) for t, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights, pa.int32())], names=["token", "original", "weight"])


def _read_rest(characters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or CharacterReader(characters.value)
            token, original = [], []
            for t in batch.column(0).to_pylist():
                got = reader.read(t)
                if got or "�" in t:
                    token.append(t)
                    original.append(got[0] if got else None)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(original, pa.string()), pa.array([2] * len(token), pa.int32())], names=["token", "original", "weight"])

    return run


def garbled_words(documents: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``(token, original, weight, n)``: garbled words, with NULL for an original that can't be told; n texts hold the word.

    With them the characters for reading what isn't a word.
    Short words that could be rightly decoded text by their form, as with Cyrillic read as other Cyrillic, weigh less.
    """
    spark = documents.sparkSession
    words = documents.select("text").where("text IS NOT NULL").mapInArrow(_count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    words = cut_lineage(words.mapInArrow(_shapes, "token string, n bigint, clean boolean"))
    forms = words.where("clean").select("token", "n").mapInArrow(_forms, "token string, original string, often bigint, chain int")
    # of the originals of one form the most frequent counts, then the shortest chain
    pairs = words.join(forms, "token").where(f"NOT clean OR often >= {OFTENER} * n")
    order = Window.partitionBy("token").orderBy(F.col("often").desc(), "chain", "original")
    found = pairs.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("token", "original", "clean")
    found = cut_lineage(found.mapInArrow(_weigh, "token string, original string, weight int").join(words.select("token", "n"), "token"))
    rest = words.where("NOT clean").join(found, "token", "left_anti").select("token")
    # at most as many as Unicode has characters; the whole set is needed wherever a rest is read
    characters = [r.c for r in words.where("clean").select(F.explode(F.split("token", "")).alias("c")).where("c > '\x7f'").distinct().collect()]
    sent = spark.sparkContext.broadcast(sorted({*characters, *COMMON_SIGNS, *COMMON_LETTERS}))
    read = rest.mapInArrow(_read_rest(sent), "token string, original string, weight int")
    return found.unionByName(read.join(words.select("token", "n"), "token")), sent


def _pairs(characters: Broadcast):
    """The different words of each document; runs too long for words with what they are read as, if they are garbled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in sorted(set(runs(text))) if text else ():
                    row = (doc_id, t, None, None)
                    if len(t) > LONG:
                        reader = reader or CharacterReader(characters.value)
                        got = None if clean_shape(t) else reader.read(t)
                        if not got and "\ufffd" not in t:
                            continue
                        row = (doc_id, t, got[0] if got else None, 2)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "token", "original", "weight"])

    return run


def garbled_pairs(documents: DataFrame) -> DataFrame:
    """``(doc_id, token, original, weight)`` of the garbled words of each document that counts as garbled.

    A document counts if its words weigh 2 or more. Words are salted by document, so a word that a third of the
    documents hold is spread over several tasks.
    """
    bad, characters = garbled_words(documents)
    bad = cut_lineage(bad)
    salts = 1 + (bad.agg(F.max("n").alias("n")).first().n or 0) // PER_SALT
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    pairs = own.mapInArrow(_pairs(characters), "doc_id bigint, token string, original string, weight int")
    spread = bad.select("token", F.col("original").alias("_original"), F.col("weight").alias("_weight"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    known = pairs.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts))).join(spread, ["token", "salt"], "left").where("weight IS NOT NULL OR _weight IS NOT NULL")
    hits = cut_lineage(known.select("doc_id", "token", F.coalesce("original", "_original").alias("original"), F.coalesce("weight", "_weight").alias("weight")).distinct())
    judged = hits.groupBy("doc_id").agg(F.sum("weight").alias("_w")).where("_w >= 2").select("doc_id")
    return hits.join(judged, "doc_id")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents with at least one wrongly decoded character, restorable or not; each once.

    NULL, empty and ASCII texts have none.
    """
    return garbled_pairs(documents).select("doc_id").distinct()


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n = [], []
        for text, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            known = dict(words)
            done = 0

            def put(m: re.Match) -> str:
                nonlocal done
                new = known.get(m.group())
                if new is None:
                    return m.group()
                done += 1
                return new

            texts.append(TOKEN.sub(put, text))
            n.append(done)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "text", "n_restored"])


def restored(documents: DataFrame) -> DataFrame:
    """``(doc_id, text, n_restored)`` of the garbled documents, garbled words replaced by their originals where these are known."""
    words = garbled_pairs(documents).where("original IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("words"))
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL")
    return own.join(words, "doc_id").select("doc_id", "text", "words").mapInArrow(_restore, "doc_id bigint, text string, n_restored bigint").distinct()
