"""Pages that hold template residue, filler text, error messages or script notices where content should be.

Folded lines are counted by host, and lines that recur on their host are subtracted as boilerplate. What remains of a
page, the residual, is judged. Placeholders and Latin filler tell by their form, wherever they stand in it. Messages
in general terms (a status, a refusal, a demand for scripts) count if the residual is little besides. What else
such pages say is learned: a line that several hosts have, and that stands mostly on pages with evidence in another
line, is evidence itself; a line that reads like a message but stands mostly on pages with prose is a notice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.lines import FUNCTION_WORDS, Line, Reader, code_of, site_name, without_name
from lodestar.llm.pages import kept_pages
from lodestar.session import cut_lineage, join_by_weight

_NAME = r"[A-Za-z_][\w.]*"
# Forms of slots in template languages and mail-merge tools, with one name each.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}(?:\s*\|[^{{}}]*)?\s*\}}\}}\}}?|\{{%.{{0,60}}?%\}}|<%.{{0,60}}?%>|<\?(?:php|=).{{0,60}}?\?>|[$#]\{{\s*{_NAME}\s*\}}|(?<![\w{{])\{{(?:{_NAME}|\d)\}}(?!\}})"
    rf"|(?<![\w$])\$[A-Za-z_][\w.]*\$|%%{_NAME}%%|%\({_NAME}\)[sd]|\*\|{_NAME}\|\*|\[\[\s*{_NAME}\s*\]\]|(?<!\w)__[A-Za-z][\w.]*__(?!\w)|@@{_NAME}@@"
    rf"|\[(?:INSERT|YOUR|ENTER|ADD|insert|your|Your|Insert)\s[^\]\[]{{1,40}}\]|<[A-Za-z_][\w. ]*\shere>|<(?:insert|your)\s[\w. ]{{1,40}}>|\[object Object\]|%(?:TITLE|NAME|AUTHOR|DATE)%"
)
UNFILLED = re.compile(r"\bNaN\b|(?<!\bwas )(?<!\bis )(?<!\bwere )(?<!\bare )(?<!\bbe )(?<!\bbeen )(?<!\ban )(?<!\bremains )(?<!\bleft )(?<![“\"‘'`])\bundefined\b(?![”\"’'`])")
_EMPTY_VALUE = re.compile(r"^(?:[\w() ]{1,30}:\s*)?(?:undefined|null|nan|\(null\))\.?$", re.I)
_SLOT_PARTS = ("{", "[", "<", "%", "$", "@@", "__", "*|")  # no placeholder is without one of these

# The commonest words of Latin filler.
LATIN_FILLER = frozenset("lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris".split())
# Filler in common use, as whole lines.
FILLER = re.compile(
    r"^\W*(?:lorem ipsum|(?:your|insert|enter|add|type) .{0,30}\bhere|(?:text|title|headline|description|content|caption|image|name) goes here"
    r"|(?:sample|dummy|example|placeholder|filler|blind) ?(?:text|copy|title|heading|paragraph|content|page)\b.{0,16}|(?:x{3,}|asdf|test)(?: (?:x{3,}|asdf|jkl|test))+|tb[da]|to ?do|lipsum|loading|(?:content |page )?coming soon|(?:page |site )?under construction)\W*\d*\W*$"
)
# How servers, sign-in walls and script notices put it in general, in the languages of the crawl, digits as 0.
MESSAGE = re.compile(
    r"^\W*(?:http|error|erreur|fehler|erro)\W{0,2}0\b|^0 ?[–—:-]? ?(?:error|not found|forbidden|gone|bad)|\bnot found\b|could not find the (?:page|file)|page (?:does not|doesn’t|doesn't|no longer) exist|no longer (?:exists|available)"
    r"|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|internal server error|error establishing|database error|fatal error|traceback \(most recent|uncaught \w+|parse error|syntax error|\bjava\.lang\b|exception (?:at|in) "
    r"|access (?:to .{1,40} )?(?:is |was )?denied|permission denied|not authori[sz]ed|account (?:has been |is )?suspended|session (?:has )?expired|please log in|sign in to|must be logged in|not available in your (?:region|country)"
    r"|not a robot|too many requests|rate limit|captcha|you are human|unusual traffic|something went wrong|under maintenance"
    r"|java ?script|(?:enable|allow|run|turn on|activate|block) \w* ?scripts?\b|scripts? (?:are|is) (?:blocked|disabled|off|required|needed)|noscript|\b(?:without|ohne|sin|sans|sem) s[ck]ript"
    r"|no encontrad[ao]|\bno existe\b|acceso denegado|no disponible|introuvable|accès (?:refusé|interdit)|n[’']existe (?:pas|plus)|indisponible"
    r"|nicht gefunden|zugriff verweigert|nicht (?:erreichbar|verfügbar)|não encontrad[ao]|acesso negado|indisponível"
)
# Every message begins with a status or has one of these; they are quicker to look for.
_HINTS = tuple(
    "error|erreur|fehler|erro 0|http 0|http/0|not found|not find|t exist|longer|bad gateway|gateway time|unavailable|traceback|uncaught|java|exception|denied|authori|suspended|expired|log in|sign in|logged"
    "|not available|robot|requests|rate limit|captcha|are human|unusual|went wrong|maintenance|script|skript|encontrad|existe|denegado|disponi|introuvable|refusé|interdit|gefunden|verweigert|erreichbar"
    "|verfügbar|negado|erro\xa00".split("|")
)
_HINT = "|".join(map(re.escape, _HINTS))
_UNHINTED = re.compile(r"\W*(?:0|http|err|fehler)|.*indisponível", re.S)  # messages that need have no hint
_SENTENCE = re.compile(r"(?<=[.!?…]) +")

LEAST_PAGES, SHARE_OF = 4, 5  # a line recurs on a host with it on 4 pages and on a fifth of them
HOSTS = 3  # hosts of a learned line
EVIDENT_PAGES, EVIDENT = 5, 0.5  # pages, and share of its pages, that have other evidence
NOTICE_PAGES, NOTICE_BARE = 8, 0.5
RESIDUAL_WORDS, RESIDUAL_SENTENCES = 60, 4


def is_filler(x: Line) -> bool:
    """Filler in common use, Latin filler, and sentences of eight or more Latin-script words without any function word."""
    if len(x.words) < 20 and FILLER.search(x.low):
        return True
    if x.function_share >= 0.12 or len(x.words) < 3:
        return False
    found = x.text.lower().replace(",", " ").replace(".", " ").split()
    latin = sum(map(LATIN_FILLER.__contains__, found))
    if latin >= 2 or latin * 14 >= len(found):
        return True
    if len(set(found)) * 2 < len(found):  # a repeated keyword
        return False
    return x.closed and x.function_share < 0.02 and len(x.words) >= 8 * max(1, x.sentences) and not x.digits and x.parts == 1 and "," not in x.text and x.text.isascii()


def is_residue(x: Line) -> bool:
    """Whether a line holds a placeholder, a value never filled in, or filler."""
    text = x.text
    if any(map(text.__contains__, _SLOT_PARTS)) and PLACEHOLDER.search(text):
        return True
    if ("NaN" in text or "undefined" in text) and UNFILLED.search(text) or len(x.words) <= 6 and _EMPTY_VALUE.match(text):
        return True
    return is_filler(x)


def hint(lines: list[Line]) -> None:
    """Notes on lines whether they have a hint of a message; looked for in all of them at once."""
    for x, found in zip(lines, pc.match_substring_regex(pa.array([x.low for x in lines], pa.string()), _HINT).to_pylist(), strict=True):
        x.hinted = found


def hinted(x: Line) -> bool:
    return any(map(x.low.__contains__, _HINTS)) if x.hinted is None else x.hinted


def has_message(x: Line) -> bool:
    return (hinted(x) or _UNHINTED.match(x.low) is not None) and MESSAGE.search(x.low) is not None


def besides(x: Line) -> tuple[bool, int, int]:
    """Whether the line holds a message, and the words and sentences of prose besides it, whatever its length."""
    low = x.low
    if low[0] != "0" and not low.startswith("erro") and not hinted(x):
        n = len(x.words)
        return (False, n, max(1, x.sentences)) if n >= 5 and x.function_share and (x.closed or x.sentences) else (False, 0, 0)
    pieces = _SENTENCE.split(low) if x.sentences > 1 else [low]
    message = False
    words = sentences = 0
    for p in pieces:
        if MESSAGE.search(p):
            message = True
            continue
        own = p.split()
        if len(own) >= 5 and p[-1] in ".!?…”\"" and not FUNCTION_WORDS.isdisjoint(own):
            words += len(own)
            sentences += 1
    return message, words, sentences


_COLUMNS = "doc_id string, site bigint, residue boolean, message boolean, bare boolean, code array<bigint>, kind array<tinyint>, words array<int>, sentences array<int>, entry array<tinyint>, size array<int>, furniture array<int>"
_TYPES = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))
RESIDUE, MESSAGING, EVIDENCED = 1, 2, 4  # kinds of lines: evidence, a message, other evidence on the page


Furniture = Callable[[list[tuple[list[Line | None], str]]], list[list[int]]]


def _read(residue: bool, entry_of: Callable[[Line, bool | None], int] | None, furniture: Callable[[], Furniture] | None):
    """Per page its different lines: code, and as asked for evidence of residue and the kind of entry, and which lines are furniture. What isn't asked for is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[Line] = []
        reader = Reader(made=fresh)
        told_furniture = furniture() if furniture else None
        known: dict[str | tuple[str, str], tuple] = {}

        def told_of(x: Line, name: str, key: str | tuple[str, str]) -> tuple:
            evident, message, words, sentences = (is_residue(x), *besides(x)) if residue else (False, False, 0, 0)
            entry = entry_of(x, evident if residue else None) if entry_of else 0
            made = (code_of(without_name(x.low, name)), RESIDUE * evident + MESSAGING * message, not message and not evident and x.prose, words, sentences, entry, max(1, len(x.words)))
            if len(x.text) < 120:
                if len(known) > 200_000:
                    known.clear()
                known[key] = made
            return made

        for batch in (part.slice(k, 500) for part in batches for k in range(0, len(part), 500)):
            out: list[list] = [[] for _ in _TYPES]
            read: list[tuple[list[Line | None], str]] = []
            rows: list[tuple[str, int | None]] = []
            for doc_id, text, host, site in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if text and text.strip():
                    read.append((reader.page(text), site_name(host)))
                    rows.append((doc_id, site))
            hint(fresh)
            fresh.clear()
            for (doc_id, site), (page, name) in zip(rows, read, strict=True):
                begins = name[:5]
                lines: dict[int, list] = {}
                long = 0
                for x in page:
                    if x is None:
                        continue
                    named = begins and begins in x.low
                    key = (x.text, name) if named else x.text
                    code, kind, prose, words, sentences, entry, size = known.get(key) or told_of(x, name if named else "", key)
                    long += prose
                    own = lines.get(code)
                    if own is None:
                        lines[code] = [kind, words, sentences, entry, size]
                    else:
                        own[1] += words
                        own[2] += sentences
                        own[4] += size
                bare = long == 0
                telling = RESIDUE | MESSAGING if bare else RESIDUE
                evident = sum(v[0] & telling > 0 for v in lines.values())
                for v in lines.values() if evident else ():
                    if evident > (v[0] & telling > 0):
                        v[0] |= EVIDENCED
                kinds = [v[0] for v in lines.values()]
                row = (
                    doc_id, site, any(k & RESIDUE for k in kinds), long <= 3 and any(k & MESSAGING for k in kinds), bare, list(lines), kinds,
                    [v[1] for v in lines.values()], [v[2] for v in lines.values()], [v[3] for v in lines.values()], [v[4] for v in lines.values()],
                )
                for column, v in zip(out, row, strict=False):
                    column.append(v)
            out[-1] = [[i + 1 for i in x] for x in told_furniture(read)] if told_furniture else [None] * len(read)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return run


def lines_of(kept: DataFrame, residue: bool = True, entry_of: Callable[[Line, bool | None], int] | None = None, furniture: Callable[[], Furniture] | None = None) -> DataFrame:
    """A row per page that isn't blank with its different lines and what they show, from ``(doc_id, text, host, site)``."""
    return cut_lineage(kept.select("doc_id", "text", "host", "site").mapInArrow(_read(residue, entry_of, furniture), _COLUMNS))


def has(bit: int) -> Column:
    return F.col("kind").bitwiseAND(F.lit(bit)) > 0


def site_counts(rows: DataFrame) -> DataFrame:
    """Per site and code of a line the pages that have it, and how many of them are of which kind, from the rows of lines_of."""
    lines = rows.where("site IS NOT NULL").select("site", "bare", F.inline(F.arrays_zip("code", "kind")))
    counted = lines.groupBy("site", "code").agg(
        F.count("*").alias("n"), F.sum(has(EVIDENCED).cast("int")).alias("evidenced"), F.sum(F.col("bare").cast("int")).alias("bare"), F.max(has(MESSAGING)).alias("message")
    )
    return cut_lineage(counted)


def recurrent(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``(site, code, n, recurs)`` of the lines that recur on their site; ``counted`` has site, code and n at least."""
    pages_of = rows.where("site IS NOT NULL").groupBy("site").agg(F.count("*").alias("pages"))
    return cut_lineage(counted.join(pages_of, "site").where((F.col("n") >= LEAST_PAGES) & (F.col("n") * SHARE_OF >= F.col("pages"))).select("site", "code", "n", F.lit(True).alias("recurs")))


def residue_of(rows: DataFrame, counted: DataFrame | None = None, sized: DataFrame | None = None) -> DataFrame:
    """``(doc_id)`` of the pages to exclude, from the rows of lines_of; site_counts and recurrent of them are made unless given."""
    line = F.inline(F.arrays_zip("code", "kind", "words", "sentences"))
    counted = site_counts(rows) if counted is None else counted
    by_code = counted.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum("evidenced").alias("evidenced"), F.sum("bare").alias("bare"), F.max("message").alias("message"))
    by_code = by_code.where(F.col("hosts") >= HOSTS).select(
        "code", "n",
        ((F.col("evidenced") >= EVIDENT_PAGES) & (F.col("evidenced") >= EVIDENT * F.col("n"))).alias("evidence"),
        (F.col("message") & (F.col("n") >= NOTICE_PAGES) & (F.col("bare") < NOTICE_BARE * F.col("n"))).alias("notice"),
    )
    by_code = cut_lineage(by_code)
    learned = rows.select("doc_id", F.explode("code").alias("code")).join(by_code.where("evidence AND NOT notice").select("code"), "code", "left_semi").select("doc_id").distinct()
    # the residual of pages that may be found: their lines without those that recur on the host
    own = cut_lineage(rows.where("residue OR message").select("doc_id", "site", line).withColumn("residue", has(RESIDUE)).withColumn("message", has(MESSAGING)).drop("kind"))
    sized = recurrent(rows, counted) if sized is None else sized
    # a page without a site has no recurrent lines
    residual = cut_lineage(join_by_weight(own, sized, ["site", "code"], "n", how="left").where("recurs IS NULL").select("doc_id", "code", "residue", "message", "words", "sentences"))
    told = join_by_weight(residual, by_code, ["code"], "n", how="left")
    shared, notice = F.col("n").isNotNull(), F.coalesce("notice", F.lit(False))
    judged = told.groupBy("doc_id").agg(
        F.max("residue").alias("residue"),
        F.max(F.col("message") & ~notice).alias("message"),
        F.sum(F.when(shared, 0).otherwise(F.col("words"))).alias("words"),
        F.sum(F.when(shared, 0).otherwise(F.col("sentences"))).alias("sentences"),
    )
    found = judged.where(F.col("residue") | F.col("message") & (F.col("words") <= RESIDUAL_WORDS) & (F.col("sentences") <= RESIDUAL_SENTENCES)).select("doc_id")
    return found.union(learned).distinct()


def residue_pages(pages: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """``(doc_id)`` of the pages to exclude, each once.

    NULL, empty and blank pages aren't listed, nor are pages whose whole body only mentions such things. Pages without
    a URL belong to no site, so none of their lines recur.
    """
    return residue_of(lines_of(kept_pages(pages, url_mapping)))


def without_residue(pages: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """The pages that stay: all columns of ``pages``, repeated rows too."""
    return pages.join(residue_pages(pages, url_mapping), "doc_id", "left_anti")
