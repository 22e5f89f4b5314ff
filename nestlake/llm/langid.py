"""Language of documents and of mixed-language paragraphs by rank-order n-gram profiles.

Profiles: the counts of all 1- to 3-grams over all documents labelled with a language (a few wrong labels do not change
the ranks that matter), summed in Spark and ranked; the ``PROFILE_SIZE`` most frequent make the profile. Any language
that labels name can be learnt, in any script. A text's own n-grams, ranked by frequency, are compared with each profile
by the out-of-place distance: the sum of rank differences, with a full profile length for n-grams that the profile
lacks. Counting, ranking and distances run in numpy over all paragraphs of an Arrow batch at once; the broadcast model
has at most ``PROFILE_SIZE`` rows per language.

Each paragraph votes with its letters for the language nearest to it, and a document takes the one with most letters. A
paragraph deviates from it only if another profile is nearer by a margin that grows as the paragraph gets shorter; a
document with a deviating paragraph is mixed. Confidence is 1 - d(best) / d(second), scaled to 0..1 by the margin that
full certainty needs.

Defined results: null texts and texts with fewer than ``min_letters`` letters get no language (no row); repeated rows
repeat their result; a text in none of the trained languages gets the nearest with low confidence; no labelled
document at all gives an empty model and no rows; letters beyond the basic plane count as spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestlake.llm import charset

PROFILE_SIZE = 400
MIN_LETTERS = 20

# Languages by ISO 639-1 code, with their ISO 639-2 codes and English names.
NAMES = {
    "af": ("afr", "afrikaans"), "ar": ("ara", "arabic"), "be": ("bel", "belarusian"), "bg": ("bul", "bulgarian"), "bn": ("ben", "bengali"), "ca": ("cat", "catalan"),
    "cs": ("ces", "cze", "czech"), "cy": ("cym", "wel", "welsh"), "da": ("dan", "danish"), "de": ("deu", "ger", "german"), "el": ("ell", "gre", "greek"), "en": ("eng", "english"),
    "eo": ("epo", "esperanto"), "es": ("spa", "spanish", "castilian"), "et": ("est", "estonian"), "eu": ("eus", "baq", "basque"), "fa": ("fas", "per", "persian"), "fi": ("fin", "finnish"),
    "fr": ("fra", "fre", "french"), "ga": ("gle", "irish"), "gl": ("glg", "galician"), "he": ("heb", "hebrew"), "hi": ("hin", "hindi"), "hr": ("hrv", "croatian"), "hu": ("hun", "hungarian"),
    "hy": ("hye", "arm", "armenian"), "id": ("ind", "indonesian"), "is": ("isl", "ice", "icelandic"), "it": ("ita", "italian"), "ja": ("jpn", "japanese"), "ka": ("kat", "geo", "georgian"),
    "ko": ("kor", "korean"), "la": ("lat", "latin"), "lt": ("lit", "lithuanian"), "lv": ("lav", "latvian"), "mk": ("mkd", "mac", "macedonian"), "ms": ("msa", "may", "malay"), "mt": ("mlt", "maltese"),
    "nl": ("nld", "dut", "dutch", "flemish"), "no": ("nor", "nb", "nob", "nn", "nno", "norwegian"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ro": ("ron", "rum", "romanian"),
    "ru": ("rus", "russian"), "sk": ("slk", "slo", "slovak"), "sl": ("slv", "slovenian"), "sq": ("sqi", "alb", "albanian"), "sr": ("srp", "serbian"), "sv": ("swe", "swedish"), "sw": ("swa", "swahili"),
    "ta": ("tam", "tamil"), "te": ("tel", "telugu"), "th": ("tha", "thai"), "tl": ("tgl", "tagalog"), "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"), "ur": ("urd", "urdu"),
    "vi": ("vie", "vietnamese"), "zh": ("zho", "chi", "chinese"),
}
_OF = {n: code for code, names in NAMES.items() for n in (code, *names)}

# Letters as numbers of ten bits: Latin, Greek and Cyrillic ones each their own, those of other scripts in buckets.
BITS, ABSENT = 10, 1023
_LETTER = np.zeros(0x10000, np.int64)  # 0: between words
for _c in range(0x10000):
    if chr(_c).isalpha():
        _low = ord(chr(_c).lower()[0])
        _LETTER[_c] = _low - 0x60 if _low < 0x180 else _low - 0x370 + 288 if 0x370 <= _low < 0x530 else 736 + _low % 287

_LINK, _MAIL = re.compile(r"https?://\S+"), re.compile(r"\S+@\S+")
_OPEN = re.compile("[„“\"«‚]")
_QUOTED = re.compile(r"[„“\"][^„“”\"\n]{0,60}[“”\"]|«[^«»\n]{0,60}»|‚[^‚‘\n]{0,60}‘")
_BLANK = re.compile(r"\n\s*\n")
#: Characters whose n-grams are held at once.
TOGETHER = 600_000


def named(label: object) -> str | None:
    """Language that a code, locale tag or English name stands for."""
    if not isinstance(label, str):
        return None
    return _OF.get(re.split(r"[-_]", label.strip().lower())[0])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a space behind each (0 beyond the basic plane), and the text that each belongs to."""
    cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 0x10000, cp, 0), np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size > TOGETHER:
            yield first, texts[first:k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def letters(texts: list[str]) -> np.ndarray:
    """Number of letters of each text."""
    out = np.zeros(len(texts), np.int64)
    for first, part in _chunks(texts):
        cp, of = _points(part)
        out[first:first + len(part)] = np.bincount(of[_LETTER[cp] > 0], minlength=len(part))
    return out


def grams(texts: list[str], table: np.ndarray, base: int, absent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of all 1- to 3-grams; a separator counts inside 2- and 3-grams but not alone or doubled. ``table``:
    code point -> number below ``base``; ``absent`` stands for the missing letters of shorter grams."""
    cp, of = _points(texts)
    i = table[cp]
    keep = np.ones(len(i), bool)
    keep[1:] = (i[1:] > 0) | (i[:-1] > 0)
    i, of = i[keep], of[keep]
    if len(i) and i[0] > 0:  # every text has a separator on either side
        i, of = np.concatenate([[0], i]), np.concatenate([of[:1], of])
    a, b, c = i[:-2], i[1:-1], i[2:]
    inner = b > 0
    one = (absent * base + absent) * base + i[i > 0]
    two = (absent * base + i[:-1]) * base + i[1:]
    three = ((a * base + b) * base + c)[inner]
    return np.concatenate([of[i > 0], np.where(i[:-1] > 0, of[:-1], of[1:]), of[1:-1][inner]]), np.concatenate([one, two, three])


@dataclass
class Profiles:
    languages: list[str]
    table: np.ndarray  # code point -> letter number; letters of no profile share one
    base: int
    index: np.ndarray  # code -> row of ranks, -1 where no profile has it
    ranks: np.ndarray  # rows x languages; PROFILE_SIZE where absent

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text to each profile, 0..1."""
        parts = [self._distances(part) for _, part in _chunks(texts)]
        return np.concatenate(parts) if parts else np.ones((0, len(self.languages)))

    def _distances(self, texts: list[str]) -> np.ndarray:
        n_texts, bits = len(texts), (self.base**3).bit_length()
        of, code = grams(texts, self.table, self.base, self.base - 1)
        key = np.sort(of << bits | code)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        key, mask = key[first], (1 << bits) - 1
        most = int(n.max(initial=0))
        wide = most.bit_length()
        if n_texts.bit_length() + wide + bits < 63:  # most frequent first, then by code: one sort of one number
            key = np.sort(((key >> bits << wide) + (most - n)) << bits | key & mask)
            of, code = key >> bits + wide, key & mask
        else:
            order = np.lexsort((key & mask, -n, key >> bits))
            of, code = (key >> bits)[order], (key & mask)[order]
        per = np.bincount(of, minlength=n_texts)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        row = self.index[code]
        hit = np.flatnonzero((row >= 0) & (rank < PROFILE_SIZE))
        ranks = self.ranks[row[hit]]
        off = np.where(ranks == PROFILE_SIZE, PROFILE_SIZE, np.abs(ranks - rank[hit].astype(np.int16)[:, None]))
        hits, used = np.bincount(of[hit], minlength=n_texts), np.minimum(per, PROFILE_SIZE)
        total = np.zeros((n_texts, len(self.languages)), np.int64)
        if len(hit):
            total[hits > 0] = np.add.reduceat(off, (np.cumsum(hits) - hits)[hits > 0], 0, np.int64)
        total += ((used - hits) * PROFILE_SIZE)[:, None]
        return np.where(used[:, None] > 0, total / np.maximum(used * PROFILE_SIZE, 1)[:, None], 1.0)


def profiles_of(lang: list[str], code: np.ndarray, rank: np.ndarray) -> Profiles:
    """From rows (language, code of ten-bit letters, rank)."""
    languages = sorted(set(lang))
    three = np.stack([code >> 2 * BITS, code >> BITS & ABSENT, code & ABSENT], 1) if len(code) else np.zeros((0, 3), np.int64)
    used = np.setdiff1d(np.unique(three), [0, ABSENT])
    base = len(used) + 3
    small = np.full(1024, base - 2, np.int64)  # a letter of no profile
    small[0], small[ABSENT], small[used] = 0, base - 1, np.arange(1, len(used) + 1)
    three = small[three]
    codes = (three[:, 0] * base + three[:, 1]) * base + three[:, 2]
    rows, which = np.unique(codes, return_inverse=True)
    index = np.full(base**3, -1, np.int32)
    index[rows] = np.arange(len(rows))
    ranks = np.full((len(rows), len(languages)), PROFILE_SIZE, np.int16)
    ranks[which, [languages.index(x) for x in lang]] = rank
    return Profiles(languages, small[_LETTER], base, index, ranks)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    size = 0

    def squeeze(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)

    for b in batches:
        names = {x: named(x) for x in b["lang"].unique()}
        for lang, texts in b["text"].groupby(b["lang"].map(names)):
            for _, part in _chunks(charset.readable_all(list(texts))):
                codes, n = np.unique(grams(part, _LETTER, 1024, ABSENT)[1], return_counts=True)
                held.setdefault(lang, []).append((codes, n))
                size += len(codes)
        if size > 2_000_000:
            held = {k: [squeeze(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
    for lang, parts in held.items():
        codes, n = squeeze(parts)
        yield pd.DataFrame({"lang": lang, "code": codes, "n": n})


def train(docs: DataFrame, languages: list[str] | None = None) -> Profiles:
    """docs(text, lang): counts over every document whose label names a language (one of ``languages``, if given)."""
    counts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text").mapInPandas(_count, "lang string, code long, n long")
    if languages is not None:
        counts = counts.where(F.col("lang").isin(languages))
    total = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= PROFILE_SIZE).select("lang", "code", "rank").toPandas()
    return profiles_of(list(top["lang"]), top["code"].to_numpy(np.int64), top["rank"].to_numpy(np.int64) - 1)


def paragraphs(text: str) -> list[str]:
    return [p for p in _BLANK.split(text) if p.strip()]


def clean(text: str) -> str:
    """Without quoted titles and links, which may be in any language."""
    if "://" in text:
        text = _LINK.sub(" ", text)
    if "@" in text:
        text = _MAIL.sub(" ", text)
    return _QUOTED.sub(" ", text) if _OPEN.search(text) else text


def label_all(texts: list[str], p: Profiles, min_letters: int = MIN_LETTERS) -> pd.DataFrame:
    """(row, para, lang, confidence) of all texts with enough letters: para -1, or one row for each paragraph of a mixed one."""
    rows = np.nonzero(letters(texts) >= max(min_letters, 1))[0]
    parts, doc = [], []
    for k in rows:
        own = paragraphs(texts[k])
        parts += own
        doc += [k] * len(own)
    parts, doc = charset.readable_all(parts), np.array(doc, np.int64)  # one by one, so that a damaged paragraph of a long text is seen
    short = [clean(x) for x in parts]
    sizes = letters(short)
    for k in np.nonzero(sizes < MIN_LETTERS)[0]:  # little would remain
        short[k] = parts[k]
    few = np.nonzero(sizes < MIN_LETTERS)[0]
    sizes[few] = letters([short[k] for k in few])
    each = p.distances(short)
    best, n = each.argmin(1), len(p.languages)
    votes = np.bincount(doc * n + best, sizes, len(texts) * n).reshape(-1, n)
    main = votes.argmax(1)[doc]
    here = np.arange(len(doc))
    off = (each[here, main] - each[here, best] > 0.02 + 0.6 / np.maximum(sizes, 1)) & (sizes >= 12)
    mixed = np.bincount(doc, off, len(texts))[doc] > 0
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    number = here - np.repeat(start, np.diff(np.append(start, len(doc))))
    weight = np.bincount(doc, sizes, len(texts))
    mean = np.stack([np.bincount(doc, each[:, x] * sizes, len(texts)) for x in range(n)], 1) / np.maximum(weight, 1)[:, None]
    own = np.where(off, best, main)[mixed]
    lead = start[~mixed[start]]
    return pd.DataFrame({
        "row": np.concatenate([doc[mixed], doc[lead]]), "para": np.concatenate([number[mixed], np.full(len(lead), -1)]).astype(np.int32),
        "lang": np.array(p.languages, object)[np.concatenate([own, main[lead]])], "confidence": np.concatenate([_confidence(each[mixed], own), _confidence(mean[doc[lead]], main[lead])])})


def label(text: str, p: Profiles) -> list[tuple[int, str, float]]:
    """[(-1, language, confidence)], or one row for each paragraph of a mixed text."""
    return list(label_all([text], p, 1)[["para", "lang", "confidence"]].itertuples(index=False, name=None))


def _confidence(d: np.ndarray, best: np.ndarray) -> np.ndarray:
    here = np.arange(len(d))
    rest = d.copy()
    rest[here, best] = 1.0 if d.shape[1] == 1 else np.inf
    rest = rest.min(1, initial=np.inf)
    return np.clip((rest - d[here, best]) / np.maximum(rest, 1e-9) / 0.15, 0, 1)


def label_documents(docs: DataFrame, p: Profiles, min_letters: int = MIN_LETTERS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, para, lang, confidence); para -1 stands for a document in one language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = label_all(list(b["text"]), p, min_letters)
            out.insert(0, "doc_id", b["doc_id"].to_numpy()[out["row"]])
            yield out.drop(columns="row")

    schema = "doc_id long, para int, lang string, confidence double"
    if not p.languages:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInPandas(run, schema)
