"""Chains of encodings by which text gets garbled, and their effect on words and characters."""

from __future__ import annotations

import re
import unicodedata

# Encodings that texts of the corpus' languages are stored in or mistaken for.
SINGLE_BYTE = (
    "cp1252 latin_1 cp1250 iso8859_2 iso8859_15 cp1251 koi8_r cp866 iso8859_5 cp437 cp850 cp852 mac_roman mac_cyrillic cp1254 cp1253"
).split()
WRONG_FOR_UTF8 = "cp1252 latin_1 cp1250 iso8859_2 iso8859_15 cp1251 koi8_r cp866 iso8859_5 cp437 cp850 cp852 mac_roman mac_cyrillic cp1254 cp1253".split()
TWICE = "cp1252 latin_1 cp1250 cp1251 cp437 cp850 mac_roman cp1254".split()
# Stored in the first, read as the second.
CONFUSED = (
    "cp1251>koi8_r koi8_r>cp1251 cp1251>latin_1 cp1251>cp1252 koi8_r>latin_1 koi8_r>cp1252 cp866>cp1251 cp1251>cp866 cp866>cp1252 cp866>latin_1 cp866>koi8_r koi8_r>cp866"
    " iso8859_5>cp1251 cp1251>iso8859_5 iso8859_5>koi8_r iso8859_5>latin_1 mac_cyrillic>cp1251 cp1251>mac_cyrillic cp1251>mac_roman koi8_r>mac_roman"
    " cp1252>cp437 cp1252>cp850 cp437>cp1252 cp850>cp1252 cp850>latin_1 cp1252>mac_roman mac_roman>cp1252 mac_roman>latin_1 latin_1>mac_roman"
    " cp1250>cp1252 cp1250>latin_1 iso8859_2>latin_1 iso8859_2>cp1252 iso8859_2>cp1250 cp1250>iso8859_2 cp852>cp1252 cp852>cp1250 cp1250>cp852"
    " cp1252>cp1250 latin_1>iso8859_2 cp1252>cp1251 cp1252>koi8_r latin_1>cp1251 cp1252>cp1253 cp1252>iso8859_5 cp1252>cp866"
    " shift_jis>cp1252 shift_jis>latin_1 shift_jis>cp1251 euc_jp>latin_1 euc_jp>cp1252 euc_jp>cp1251 shift_jis>mac_roman euc_jp>mac_roman shift_jis>cp437 euc_jp>cp437"
    " gbk>latin_1 gbk>cp1252 big5>latin_1 big5>cp1252 euc_kr>latin_1 euc_kr>cp1252"
).split()
LOSSY = "latin_1 cp1252 cp1250 cp1251 koi8_r mac_roman iso8859_2 shift_jis euc_jp".split()  # read as UTF-8, bytes that aren't give U+FFFD


def _table_of(name: str) -> tuple[str, dict[str, int]]:
    """Of a single-byte encoding; bytes without a meaning stand for the control of that number."""
    chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


_TABLES = {name: _table_of(name) for name in SINGLE_BYTE}


def encode(text: str, name: str) -> bytes | None:
    if name == "utf_8" or name not in SINGLE_BYTE:
        try:
            return text.encode(name)
        except UnicodeError:
            return None
    table = _TABLES[name][1]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def decode(data: bytes, name: str) -> str | None:
    if name == "utf_8":
        try:
            return data.decode("utf_8")
        except UnicodeError:
            return None
    table = _TABLES[name][0]
    return "".join([table[b] for b in data])


def chains() -> list[tuple[tuple[str, str], ...]]:
    """All chains, each of steps (stored in, read as), the shortest first."""
    once = [(("utf_8", w),) for w in WRONG_FOR_UTF8] + [(tuple(c.split(">")),) for c in CONFUSED]
    twice = [(("utf_8", a), ("utf_8", b)) for a in TWICE for b in TWICE if a == b or {a, b} <= {"cp1252", "latin_1", "cp1250", "cp1254"}]
    thrice = [(("utf_8", a), ("utf_8", b), ("utf_8", c)) for a in ("cp1252", "latin_1") for b in ("cp1252", "latin_1") for c in ("cp1252", "latin_1")]
    return once + twice + thrice


CHAINS = chains()


def garble(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word after the chain, None if it has no form there."""
    for stored, read in chain:
        data = encode(word, stored)
        if data is None:
            return None
        word = decode(data, read)
        if word is None:
            return None
    return word


def garbled_forms(word: str) -> dict[str, int]:
    """Every form of the word that differs from it, with the number of the first chain that gives it; lossy ones count on from there."""
    out: dict[str, int] = {}
    for k, chain in enumerate(CHAINS):
        made = garble(word, chain)
        if made is not None and made != word:
            out.setdefault(made, k)
    for k, name in enumerate(LOSSY, len(CHAINS)):
        data = encode(word, name)
        if data is not None:
            made = data.decode("utf_8", "replace")
            if made != word:
                out.setdefault(made, k)
    return out


def script(c: str) -> str:
    """latin, cyrillic, greek, east (Chinese, Japanese, Korean) or other for a letter, mark for a combining mark, else empty."""
    o = ord(c)
    if o < 0x250:
        return "latin" if c.isalpha() and c not in "ªº" else ""
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek" if c.isalpha() else ""
    if 0x3005 <= o <= 0x3007 or 0x3041 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "east"
    if 0x1E00 <= o < 0x1F00 or 0xFF21 <= o < 0xFF5B:
        return "latin"
    if unicodedata.combining(c):
        return "mark"
    return "other" if c.isalpha() else ""


# Signs that rightly decoded text has inside words, and at their ends.
INNER = "’'-‐‑·ʼ­​‌‍﻿・ー"
EDGE = INNER + "“”„‚‘«»‹›–—…¿¡°²³¹½¼¾€£¥©®™§•±×÷ªº、。「」『』（）！？：；　   →←↑↓★☆✓  ️"
# Always looked for, whether the corpus has them or not.
COMMON_SIGNS = "≠≈≤≥∞√−→←↑↓★☆✓•…–—‘’“”„‚«»€£¥©®™°²³½¼¾±×÷§¿¡\xa0\xad\ufeff\u200b"
COMMON_LETTERS = "".join(c for c in map(chr, [*range(0xC0, 0x180), *range(0x400, 0x460)]) if c.isalpha())
RARE_CYRILLIC = frozenset("ЂЃѓЉЊЌЋЏђљњќћџЎўЈјҐґЄєІіЇїЅѕ")


def clean_shape(token: str) -> bool:
    """Whether a token looks like rightly decoded text: one script, ordinary case, signs only where they belong."""
    if "ï»¿" in token:  # the mark of UTF-8 at the head of a file, read as Latin
        return False
    core = token.strip(EDGE)
    if not core:
        return True
    if core[-1] == "Â" and len(token) > token.rindex("Â") + 1:
        return False
    kinds = set()
    for c in core:
        if c in INNER:
            continue
        if "\x80" <= c < "\xa0" or c == "�":
            return False
        kind = script(c)
        if not kind:
            # emoji and symbols of their own planes are no trace of a wrong encoding
            if ord(c) < 0x2600:
                return False
            kind = "sign"
        if kind != "mark":
            kinds.add(kind)
    if len(kinds - {"sign"}) > 1:
        return False
    if "cyrillic" in kinds and RARE_CYRILLIC.intersection(core):
        return False
    if kinds & {"latin", "cyrillic", "greek"}:
        return all(p.islower() or p.isupper() or p[0].isupper() and (p[1:].islower() or not p[1:]) for p in _parts(core))
    return True


LEAD = re.compile("[\u00c2-\u00f4\u0413\u0420\u0421\u0432\u0102\u0139][\x80-\xbf\u02c6\u02dc\u2010-\u2122]")


def certain(token: str, clean: bool) -> bool:
    """Whether a token known to be a garbled form can't be anything else: by its shape, or by a letter and sign as UTF-8 bytes give them."""
    return not clean or bool(LEAD.search(token))


def _parts(core: str) -> list[str]:
    out, now = [], ""
    for c in core:
        if c.isalpha():
            now += c
        elif now and not unicodedata.combining(c):
            out.append(now)
            now = ""
    return out + [now] if now else out
