"""Sentences of many texts at once, as numbers: words by hash, grouped by sentence and paragraph, without a Python loop
over words. All work is numpy over the characters of a batch."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd

from nestlake.llm import charset

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_SPACE = np.array([chr(c).isspace() for c in range(0x10000)])
_STOP, _QUOTE, _BULLET, _BRACKET, _NEWLINE = ([ord(c) for c in x] for x in (".!?…", "\"”“»", "•", "[", "\n"))
_LINK = re.compile(r"https?://\S+")
_HOST = re.compile(r"(?:https?://|@)([\w.-]+\w)")
#: A word has at least so many letters, and a sentence so many words; what is shorter says nothing of a subject.
LETTERS, WORDS = 3, 2
#: Characters looked at together.
TOGETHER = 1_000_000


@dataclass
class Sentences:
    """Of a list of texts: distinct words (hash) of each sentence, sentence by sentence."""

    words: np.ndarray
    sizes: np.ndarray  # words of each sentence
    paragraph: np.ndarray  # of each sentence, numbered within the list
    text: np.ndarray  # of each sentence


def term(names: list[str]) -> np.ndarray:
    """64-bit hashes of names that are no words, such as hosts."""
    return pd.util.hash_array(np.array(names, object), categorize=False).view(np.int64) if names else np.zeros(0, np.int64)


def hosts(text: str) -> list[str]:
    return sorted({h.lower() for h in _HOST.findall(text)}) if "://" in text or "@" in text else []


def split(texts: list[str]) -> Sentences:
    parts, first, size, held = [], 0, 0, []
    texts = charset.readable_all(texts)
    for k, t in enumerate(texts):
        held.append((_LINK.sub(" ", t) if "://" in t else t).lower())
        size += len(held[-1]) + 2
        if size > TOGETHER or k == len(texts) - 1:
            s = _split(held)
            s.text += first
            s.paragraph += 1 + (parts[-1].paragraph[-1] if parts and len(parts[-1].paragraph) else 0)
            if len(s.text):
                parts.append(s)
            first, size, held = k + 1, 0, []
    if not parts:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none)
    return Sentences(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("words", "sizes", "paragraph", "text")))


def _split(texts: list[str]) -> Sentences:
    cp = charset.points("\n\n".join(texts) + "\n\n")
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letter, space = _LETTER[cp], _SPACE[cp]
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    start, size = edge[::2], edge[1::2] - edge[::2]
    word = _hashes(cp[letter], size)
    long = size >= LETTERS
    start, word = start[long], word[long]
    # A blank line ends a paragraph: a line break with nothing but space since the one before.
    lines = np.flatnonzero(cp == 10)
    solid = np.cumsum(~space)
    blank = np.zeros(len(cp), bool)
    blank[lines[1:]] = solid[lines[1:]] == solid[lines[:-1]]
    stop = np.isin(cp, _STOP)
    ended = np.zeros(len(cp), bool)
    ended[1:] = stop[:-1]
    ended[2:] |= stop[:-2] & np.isin(cp[1:-1], _QUOTE)
    item = np.isin(cp, _BULLET)
    item[1:] |= (cp[1:] == _BRACKET[0]) & (cp[:-1] == 10)
    paragraph = np.cumsum(blank)[start]
    sentence = np.cumsum(blank | (ended & space) | item)[start]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    n = np.diff(np.append(first, len(sentence)))
    keep = np.repeat(n >= WORDS, n)
    start, word, paragraph, sentence = start[keep], word[keep], paragraph[keep], sentence[keep]
    pair = word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sentence.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    once = np.sort(np.unique(pair, return_index=True)[1])  # each word counts once in a sentence
    start, word, paragraph, sentence = start[once], word[once], paragraph[once], sentence[once]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    return Sentences(word, np.diff(np.append(first, len(sentence))), paragraph[first], of[start[first]])


def _hashes(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of letters: a polynomial in wrapping arithmetic, then mixed."""
    if not len(size):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), 0x100000001B3, np.uint64))
        h = np.add.reduceat(letters.astype(np.uint64) * power[np.arange(len(letters)) - np.repeat(first, size)], first)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)
