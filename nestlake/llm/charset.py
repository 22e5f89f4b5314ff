"""Character tables: single-byte code pages, the symbols of clean text, and the inverse of a wrong decoding."""

from __future__ import annotations

import numpy as np

# Single-byte code pages that the damaged text may pass through.
PAGES = ("cp1252", "latin_1", "cp1250", "cp1251", "iso8859_2", "iso8859_5", "cp437", "cp850", "cp852", "cp866", "koi8_r", "mac_roman")
# Windows code page numbers and charset names as records declare them.
DECLARED = {
    "1252": "cp1252", "windows-1252": "cp1252", "28591": "latin_1", "iso-8859-1": "latin_1", "1250": "cp1250", "windows-1250": "cp1250",
    "1251": "cp1251", "windows-1251": "cp1251", "28592": "iso8859_2", "iso-8859-2": "iso8859_2", "28595": "iso8859_5", "437": "cp437", "ibm437": "cp437",
    "850": "cp850", "ibm850": "cp850", "852": "cp852", "ibm852": "cp852", "866": "cp866", "ibm866": "cp866", "20866": "koi8_r", "koi8-r": "koi8_r",
    "10000": "mac_roman", "macintosh": "mac_roman", "932": "cp932", "1200": "utf_16_le", "1201": "utf_16_be", "65001": "utf_8", "utf-8": "utf_8",
}
# Letters beyond a-z of the languages expected, and of loan words in them; then signs in normal use.
ACCENTED = "àâæçèéêëîïôœùûüÿäößáíñóúìòąćęłńśźżåøõãğš"
CAPITALS = "ÀÂÆÇÈÉÊËÎÏÔŒÙÛÜÄÖÁÍÑÓÚÌÒĄĆĘŁŃŚŹŻÅØ"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
SIGNS = "–—‘’“”„‚«»‹›…•·€£§©®™°µ±×÷½¼¾†‡№¿¡✔ ‑ ​﻿′″−→²³"
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

SPACE, DIGIT, KANA, CJK, ODD, LOST, OTHER = range(7)
_CHARS = ASCII + ACCENTED + CAPITALS + CYRILLIC + SIGNS
N_SYMBOLS = 7 + len(_CHARS)
SYMBOL = np.full(0x10000, ODD, np.int16)
SYMBOL[0x4E00:0xA000] = CJK
SYMBOL[0x4E00:0xA000:0x100] = ODD  # a byte-swapped Latin letter looks like U+XX00
SYMBOL[0x3041:0x3100] = KANA
SYMBOL[0x3001:0x3020] = KANA
SYMBOL[0x3005] = CJK
SYMBOL[0xFF01:0xFF5F] = KANA
SYMBOL[0xFFFD] = LOST
SYMBOL[0x2600:0x27C0] = OTHER
SYMBOL[[9, 10, 13, 32]] = SPACE
SYMBOL[48:58] = DIGIT
for _k, _c in enumerate(_CHARS):
    SYMBOL[ord(_c)] = 7 + _k


def _page(name: str) -> tuple[np.ndarray, np.ndarray]:
    """byte -> code point (undefined bytes stand for the control of that number) and back (-1: not in the page)."""
    to = np.array([ord(bytes([b]).decode(name, "replace")) for b in range(256)], np.int32)
    to = np.where(to == 0xFFFD, np.arange(256), to)
    back = np.full(0x10000, -1, np.int16)
    back[to[::-1]] = np.arange(255, -1, -1)
    if name.startswith("cp125"):  # strict decoders refuse, lenient ones keep the control
        free = np.arange(128, 160)
        back[free] = np.where(back[free] < 0, free, back[free])
    return to, back


TO_CHAR, TO_BYTE = {}, {}
for _n in PAGES:
    TO_CHAR[_n], TO_BYTE[_n] = _page(_n)


def points(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 0x10000, cp, 0x2600).astype(np.int32)  # beyond the basic plane: some sign


def utf8_units(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (-1: none) -> (decoded code point at each unit's first byte, consumed, broken)."""
    n = len(b)
    pad = np.concatenate([b, np.full(3, -1, b.dtype)]).astype(np.int32)
    cont = (pad >= 0x80) & (pad < 0xC0)
    c1, c2, c3 = cont[1:n + 1], cont[2:n + 2], cont[3:n + 3]
    two = (pad[:n] >= 0xC2) & (pad[:n] < 0xE0) & c1
    three = (pad[:n] >= 0xE0) & (pad[:n] < 0xF0) & c1 & c2
    four = (pad[:n] >= 0xF0) & (pad[:n] < 0xF5) & c1 & c2 & c3
    y = pad[:n].copy()
    y = np.where(two, (pad[:n] & 31) << 6 | pad[1:n + 1] & 63, y)
    y = np.where(three, (pad[:n] & 15) << 12 | (pad[1:n + 1] & 63) << 6 | pad[2:n + 2] & 63, y)
    y = np.where(four, 0x2600, y)
    used = np.zeros(n + 3, bool)
    for lead, k in ((two, 1), (three, 2), (four, 3)):
        for s in range(1, k + 1):
            used[s:n + s] |= lead
    used = used[:n]
    return y, used, (b < 0) | ((b >= 0x80) & ~used & ~(two | three | four))


def invert(text: str, true: str, wrong: str) -> str | None:
    """What the bytes say when read as ``true``, if ``text`` was read as ``wrong``; None if that cannot be."""
    try:
        if wrong in TO_BYTE:
            b = TO_BYTE[wrong][points(text)]
            if (b < 0).any():
                return None
            raw = b.astype(np.uint8).tobytes()
        else:
            raw = text.encode(wrong)
        return "".join(map(chr, TO_CHAR[true][np.frombuffer(raw, np.uint8)])) if true in TO_CHAR else raw.decode(true)
    except UnicodeError:
        return None


_IS_ODD = np.isin(SYMBOL, (ODD, LOST))


def oddity(text: str) -> int:
    """Characters that clean text does not hold."""
    return int(np.count_nonzero(_IS_ODD[points(text)]))


def readable_all(texts: list[str]) -> list[str]:
    """readable() of each: one pass over the characters of many texts finds the few that need it."""
    out, group, size = list(texts), [], 0
    for k, t in enumerate(texts):
        if not t.isascii():
            group.append(k)
            size += len(t)
        if group and (size > 1_000_000 or k == len(texts) - 1):
            odd = _IS_ODD[points("".join(texts[g] for g in group))]
            ends = np.cumsum([len(texts[g]) for g in group])
            n = np.diff(np.concatenate([[0], np.cumsum(odd)])[np.concatenate([[0], ends])])
            for g, o in zip(group, n, strict=True):
                if o and o * 200 >= len(texts[g]):
                    out[g] = readable(texts[g])
            group, size = [], 0
    return out


def readable(text: str) -> str:
    """Quick repair for readers that only need the letters: paragraph by paragraph the one inverse with fewest odd
    characters, if the paragraph is full of them."""
    odd = 0 if text.isascii() else oddity(text)
    if not odd or odd * 200 < len(text):
        return text
    out = []
    for part in text.split("\n\n"):
        best, odd = part, oddity(part)
        if odd * 50 > len(part):
            for true, wrong in (("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp1250"), ("utf_8", "cp1251"), ("utf_8", "cp437"), ("utf_8", "mac_roman"),
                                ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252")):
                y = part
                for _ in range(2 if true == "utf_8" else 1):
                    z = invert(y, true, wrong)
                    if z is None:
                        break
                    y = z
                    if (o := oddity(y)) < odd:
                        best, odd = y, o
        out.append(best)
    return "\n\n".join(out)
