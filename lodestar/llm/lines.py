"""What the lines of a page look like, without any list of phrases: their words, their prose and their form.

Everything here works on one page in plain Python. What lines say is learned elsewhere, from how they recur.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

# Frequent function words of the languages of the crawl, a line for each.
FUNCTION_LINES = """
the of and a an in to for with at by from on as it its was is are were or that this we you your our not no be has have had but if which then after before when where who into near over their they he she his her all can until once so than more there only some
der die das und ein eine einen in den dem des von zu mit ist auf für sich es im am nicht oder als wie bis bei nach aus aber auch noch
le la les de du des et un une à en que qui dans pour il elle sur est se au aux pas par plus mais ou son sa ses leur où
el los las y de la en que un una se del al por con su sus o lo como más pero sin entre hasta
o a os da do dos das de e em que se para um uma com não ao à aos no na nos nas é mas sem
и в на не с что по из у за к от до как
"""
FUNCTION_WORDS = frozenset(FUNCTION_LINES.split())
_LANGUAGES = [frozenset(x.split()) for x in FUNCTION_LINES.strip().split("\n")]
LINK = re.compile(r"https?://|www\.|\b[a-z0-9][\w-]*\.(?:example|test|com|org|net|info|biz|shop)\b", re.I)
_DIGITS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]").search
_TOKEN = re.compile(r"[^\W\d_]+|0|[^\w\s.,;'’\"]")
_WORDS = re.compile(r"[^\W\d_]+")
SHOWN = 200  # characters; longer lines are prose or lists of words, whose tokens aren't attributes
_PARTS = re.compile(r" [|·/>»›-] | {3,}|[|»›]")
_END = re.compile(r"[.!?…。][\"”’»)]*$")
_BULLET = re.compile(r"[-*•–]\s")
PROSE_WORDS = 20
PROSE_SHARE = 0.12


@dataclass(slots=True)
class Line:
    """The form of one line, whatever stands around it."""

    text: str
    low: str  # folded
    words: list[str]  # letters only, in lower case
    function_share: float
    sentences: int
    closed: bool
    digits: int
    parts: int  # entries between separators
    shown: tuple[str, ...]  # words, signs and 0 for numbers, as attribute tokens
    hinted: bool | None = None  # whether residue.MESSAGE may match; None if that wasn't asked

    @property
    def prose(self) -> bool:
        return len(self.words) >= PROSE_WORDS and self.function_share > PROSE_SHARE


def folded(line: str) -> str:
    """The line without case, outer space, kinds of inner space and values of numbers."""
    low = " ".join(line.split()).casefold()
    return _DIGITS.sub("0", low) if _DIGIT(low) else low


def code_of(text: str) -> int:
    """A number of 64 bits for a folded line."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def site_name(host: str | None) -> str:
    """The letters of the first part of a host, www. aside."""
    label = (host or "").removeprefix("www.").split(".")[0]
    return label.replace("-", "")


def without_name(low: str, name: str) -> str:
    """A folded line in which words that begin the name of the site, or begin with it, are @; short words stay."""
    if not name or name[:5] not in low:
        return low
    return " ".join(["@" if len(w) >= 5 and name.startswith(w.strip(".,:;–—|©()")) else w for w in low.split(" ")])


def _may_part(text: str) -> bool:
    """Whether any separator is there, which is quicker to tell than to cut."""
    return "|" in text or "   " in text or " · " in text or " / " in text or "»" in text or "›" in text or " > " in text or " - " in text


class Letters:
    """Cuts texts into their runs of letters, as _WORDS does, by a table of all characters of two bytes."""

    def __init__(self) -> None:
        self.table = np.full(1 << 16, ord(" "), "<u2")
        for run in _WORDS.finditer("".join(map(chr, range(1 << 16)))):
            self.table[run.start() : run.end()] = np.arange(run.start(), run.end())
        self.table[ord("\n")] = ord("\n")

    def spaced(self, text: str) -> str:
        """The text with blanks in place of what is neither a letter nor a line end."""
        raw = text.encode("utf-16-le", "surrogatepass")
        if len(raw) != 2 * len(text):  # some character takes four bytes
            return "\n".join([" ".join(_WORDS.findall(x)) for x in text.split("\n")])
        return self.table[np.frombuffer(raw, "<u2")].tobytes().decode("utf-16-le")

    def words(self, text: str) -> list[str]:
        return self.spaced(text).split()


def read_line(raw: str, words_of: Callable[[str], list[str]] = _WORDS.findall) -> Line | None:
    """None for a blank line."""
    text = raw.strip()
    if not text:
        return None
    low = folded(text)
    shown = tuple(_TOKEN.findall(low)) if len(text) < SHOWN else ()
    words = [w for w in shown if w.isalpha()] if shown else words_of(low)
    n = len(words)
    share = sum(map(FUNCTION_WORDS.__contains__, words)) / n if n else 0.0
    closed = text[-1] in ".!?…。" or text[-1] in "\"”’»)" and bool(_END.search(text))
    return Line(text, low, words, share, low.count(". ") + low.count("? ") + low.count("! ") + closed, closed, low.count("0"), len(_PARTS.split(text)) if _may_part(text) else 1, shown)


class Reader:
    """Reads lines; keeps what it knows of short lines it has met (at most ``held``). ``made``, if given, gets each line when it is read anew."""

    def __init__(self, held: int = 200_000, made: list[Line] | None = None) -> None:
        self.held = held
        self.made = made
        self.known: dict[str, Line | None] = {}
        self.words_of = Letters().words

    def line(self, raw: str) -> Line | None:
        try:
            return self.known[raw]
        except KeyError:
            made = read_line(raw, self.words_of)
            if self.made is not None and made is not None:
                self.made.append(made)
            if len(raw) < 120:
                if len(self.known) >= self.held:
                    self.known.clear()
                self.known[raw] = made
            return made

    def page(self, text: str) -> list[Line | None]:
        return [self.line(x) for x in text.split("\n")]


def language_of(lines: list[Line | None]) -> int:
    """The language whose function words stand in most lines of a page, as a number; the first if none does."""
    own = [set(x.words) for x in lines if x is not None]
    return max(range(len(_LANGUAGES)), key=lambda k: (sum(len(w & _LANGUAGES[k]) for w in own), -k))


def bulleted(text: str) -> bool:
    return bool(_BULLET.match(text))
