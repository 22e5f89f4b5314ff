"""Find and restore text that was decoded with the wrong character encoding.

A hidden Markov model labels characters. One state is clean text, one stands for each encoding pair (true, wrong).
The emission of a character in a pair's state is the probability of the character that the inverse transform puts in
its place, given the one before it, under a character-bigram model of clean text; in a UTF-8 state all
characters of a sequence share the probability of the letter they encode. The bigram model is counted over all
texts, leaving out those with characters or turns of case that clean text does not hold, so that damage does not teach
itself. Viterbi paths run over the clean state and every pair state that some stretch of the text pays for entering;
each labelled span then gets its state's inverse transform, until nothing changes, since text may have been damaged
more than once. Block encodings (UTF-16, Shift-JIS), which no
single character can be inverted under, are states over whole lines.

A vectorised first pass bounds what any state can gain on any stretch of a text (equal words are evaluated once a
batch) and drops the texts that the decoder would leave as they are, whatever they declare; only the rest is decoded.

Defined results: null, empty and plain ASCII texts are clean; a text with U+FFFD is damaged but not restorable, the
other spans of it are still restored; characters beyond the basic plane count as signs; repeated rows repeat results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestlake.llm import charset as C

FLOOR = -14.0  # log probability of an odd character in clean text
IMPOSSIBLE = -25.0
ENTER, LEAVE = -6.5, -1.5  # log probability of turning from clean to a pair's state and back
DECLARED, UNDECLARED = 4.0, -3.0  # more or less for a pair whose wrong side is, or is not, the encoding that the record declares
PLACES = 8  # runs beyond ASCII that the whole of DECLARED holds for; with more, its odds are shared among them
WORTH = 5.5  # a span must explain its characters better by that

PAIRS = [(t, w) for t in ("utf_8", "utf_8_twice") for w in C.PAGES if w != "iso8859_5"] + [
    (t, w) for w in ("cp1252", "latin_1", "cp1250", "cp1251", "cp850", "cp437", "koi8_r", "cp866", "mac_roman", "cp852", "iso8859_2")
    for t in C.PAGES if t != w and {t, w} != {"cp1252", "latin_1"}]
#: NUL, and the character that the store keeps in its place.
_NUL = "\x00\uf2b3"
_INTERLEAVED = re.compile(f"(?:[^{_NUL}][{_NUL}]){{2,}}")


_FIRST_HIGH = 7 + len(C.ASCII)
_LOWER, _UPPER = (np.array([False] * 7 + [f(c) for c in C._CHARS]) for f in (str.islower, str.isupper))


# ---- model of clean text

def count_bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse bigram counts over the texts of a partition that hold no odd character and, beyond ASCII, no capital
    after a small letter (Cyrillic read under another Cyrillic encoding, UTF-8 read as a Latin one)."""
    total = np.zeros(C.N_SYMBOLS**2, np.int64)
    for b in batches:
        for chunk in _chunks(b["text"]):
            ids, ends = _concat(chunk)
            odd = np.isin(ids, (C.ODD, C.LOST))
            odd[1:] |= _LOWER[ids[:-1]] & _UPPER[ids[1:]] & ((ids[:-1] >= _FIRST_HIGH) | (ids[1:] >= _FIRST_HIGH))
            bad = np.logical_or.reduceat(odd, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, bool)
            keep = np.repeat(~bad, np.diff(np.concatenate([[0], ends])))
            ids = ids[keep]
            total += np.bincount(ids[:-1].astype(np.int64) * C.N_SYMBOLS + ids[1:], minlength=C.N_SYMBOLS**2)
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"pair": at, "n": total[at]})


def _chunks(texts: pd.Series, size: int = 1_000_000) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        if t:
            chunk.append(t)
            n += len(t)
        if n > size:
            yield chunk
            chunk, n = [], 0
    if chunk:
        yield chunk


def _concat(chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, a space before each, and where each ends."""
    ids = C.SYMBOL[C.points(" " + " ".join(chunk))]
    return ids, np.cumsum([len(t) + 1 for t in chunk])


def train(texts: DataFrame) -> np.ndarray:
    """texts(text) -> N x N log probabilities of a symbol given the one before."""
    counts = texts.where("text IS NOT NULL").select("text").mapInPandas(count_bigrams, "pair long, n long")
    rows = counts.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most N_SYMBOLS squared rows
    return model(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def model(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.zeros(C.N_SYMBOLS**2)
    c[pair] = n
    c = c.reshape(C.N_SYMBOLS, C.N_SYMBOLS)
    uni = c.sum(0) + 0.2
    uni /= uni.sum()
    weight = 2.0
    lp = np.log((c + weight * uni) / (c.sum(1, keepdims=True) + weight))
    lp = np.maximum(lp, FLOOR + 1)
    lp[:, (C.ODD, C.LOST)] = FLOOR
    lp[(C.ODD, C.LOST), :] = np.log(uni)
    lp[C.ODD, C.ODD] = lp[C.LOST, C.LOST] = FLOOR
    lp[:, C.LOST] = lp[C.LOST, C.LOST] = FLOOR
    lp[(C.ODD, C.LOST), C.ODD] = FLOOR
    signs = [7 + C._CHARS.index(c) for c in C.SIGNS if not c.isspace()]
    lp[C.SPACE, signs] = np.maximum(lp[C.SPACE, signs], -8)  # a sign may stand alone, however rare it is
    lp[signs, C.SPACE] = np.maximum(lp[signs, C.SPACE], -4)
    latin = [k for k, c in enumerate(C._CHARS, 7) if c.isalpha() and c not in C.CYRILLIC]
    cyrillic = [7 + C._CHARS.index(c) for c in C.CYRILLIC]
    lp[np.ix_(latin, cyrillic)] = lp[np.ix_(cyrillic, latin)] = FLOOR  # no word mixes scripts
    # East Asian scripts are one symbol each but thousands of characters, and do not stand inside Latin words.
    east, words = (C.CJK, C.KANA), [k for k, c in enumerate(C._CHARS, 7) if c.isalpha()]
    lp[:, east] = np.maximum(lp[:, east], -9)
    lp[np.ix_(words, east)] = lp[np.ix_(east, words)] = FLOOR + 1
    lp[C.CJK, C.CJK], lp[C.KANA, C.KANA], lp[C.CJK, C.KANA], lp[C.KANA, C.CJK] = -7, -4.5, -7, -7
    return lp.astype(np.float32)


# ---- first pass

def stretches(texts: list[str], lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x PAIRS, runs): the most that any one stretch of a text is better explained by the pair's state than by the clean
    one. Gains depend on a run of characters beyond ASCII and their neighbours only, so equal runs are computed once."""
    out, count = np.zeros((len(texts), len(PAIRS))), np.zeros(len(texts), np.int64)
    at: dict[str, int] = {}
    group: list[tuple[int, list[int]]] = []
    size = 0
    for k, t in enumerate(texts):
        if t and not t.isascii():
            own = []
            for m in _RUN.finditer(f" {t} "):
                run = m[0] + m[1]
                if run not in at:
                    at[run] = len(at)
                    size += len(run)
                own.append(at[run])
            count[k] = len(own)
            group.append((k, own))
        if size > TOGETHER:
            _best_stretches(group, list(at), lp, out)
            group, at, size = [], {}, 0
    if group:
        _best_stretches(group, list(at), lp, out)
    return out, count


#: A run of characters beyond ASCII with the ASCII character on either side, which the next run may share.
_RUN = re.compile(r"[\x00-\x7f][^\x00-\x7f]+(?=([\x00-\x7f]))")


def _best_stretches(group: list, runs: list[str], lp: np.ndarray, out: np.ndarray) -> None:
    cp = np.concatenate([C.points(r) for r in runs])
    starts = np.cumsum([0, *[len(r) for r in runs]])[:-1]
    last = np.append(starts[1:], len(cp)) - 1
    ids = C.SYMBOL[cp]
    clean = np.zeros(len(cp), np.float32)
    clean[1:] = lp[ids[:-1], ids[1:]]
    bytes_of = {w: C.TO_BYTE[w][cp] for w in {w for _, w in PAIRS}}
    of = np.concatenate([own for _, own in group])
    heads = np.cumsum([0, *[len(own) for _, own in group]])[:-1]
    rows = [k for k, _ in group]
    inner_wall, wall = np.zeros(len(cp)), np.zeros(len(of))
    inner_wall[starts], wall[heads] = _WALL, _WALL
    inner_wall, wall = np.cumsum(inner_wall), np.cumsum(wall)
    for x, (true, wrong) in enumerate(PAIRS):
        gain = (_emissions(cp, bytes_of[wrong], true, lp, C.TO_BYTE[wrong]) - clean).astype(np.float64)
        gain[starts] = 0  # an ASCII character after another: the same in all states
        s = np.cumsum(gain)
        base = s[starts]
        whole = s[last] - base
        prefix = np.maximum.reduceat(s, starts) - base
        suffix = s[last] - np.minimum.reduceat(s, starts)
        low = s - inner_wall  # falls so far at each run that no stretch crosses its start
        inside = np.maximum.reduceat(low - np.minimum.accumulate(low), starts)
        if not inside.any():
            continue
        c = np.cumsum(whole[of]) - wall
        end = c + np.maximum.accumulate(suffix[of] - c)  # the best stretch that ends where the run does
        best = inside[of]
        if len(of) > 1:
            across = end[:-1] + prefix[of[1:]]
            across[heads[1:] - 1] = 0
            best[1:] = np.maximum(best[1:], across)
        out[rows, x] = np.maximum.reduceat(best, heads)


_WALL = 1e7


def suspicious(texts: pd.Series, lp: np.ndarray, bonus: float = DECLARED) -> np.ndarray:
    """The texts that the decoder could find damaged, whatever encoding is declared: no other can have a span that
    pays for entering and leaving its state and is worth it, nor a line that a block encoding explains."""
    out = np.zeros(len(texts), bool)
    full = [k for k, t in enumerate(texts) if t and (not t.isascii() or "\x00" in t)]
    best = stretches([texts.iloc[k] for k in full], lp)[0].max(1) if full else []
    for k, gain in zip(full, best, strict=True):
        t = texts.iloc[k]
        out[k] = gain + bonus > max(-ENTER - LEAVE, WORTH) - _SLACK or "\ufffd" in t or any(
            block_states(x, lp) is not None for x in t.split("\n") if not x.isascii() or "\x00" in x)
    return out


_SLACK = 0.01  # rounding


# ---- decoding

def _emissions(cp: np.ndarray, b: np.ndarray, true: str, lp: np.ndarray, again: np.ndarray) -> np.ndarray:
    """b: the bytes that the wrong page gives for cp, -1 where it has no such character; again: that page's table."""
    if true == "utf_8":
        y, used, broken = C.utf8_units(b)
        y = np.where(broken, cp, y)
    elif true == "utf_8_twice":
        y, used, broken = C.utf8_units(b)
        y = np.where(broken, cp, y)
        at = np.nonzero(~used)[0]
        y2, used2, broken2 = C.utf8_units(again[np.minimum(y[at], 0xFFFF)])
        y[at], used[at], broken[at] = np.where(broken2, y[at], y2), used2, broken[at] | broken2
    else:
        broken, used = b < 0, None
        y = C.TO_CHAR[true][np.where(broken, 0, b)]
    ids = C.SYMBOL[np.minimum(y, 0xFFFF)]
    em = np.zeros(len(cp), np.float32)
    if used is None:
        em[1:] = lp[ids[:-1], ids[1:]]
    else:
        at = np.nonzero(~used)[0]
        unit = np.zeros(len(at), np.float32)
        unit[1:] = lp[ids[at[:-1]], ids[at[1:]]]
        size = np.diff(np.append(at, len(cp)))
        # one odd letter for several bytes would come cheap, and so would a path that only takes continuation bytes
        unit = np.where((ids[at] == C.ODD) & (y[at] != cp[at]), FLOOR * size, unit) / size
        em = np.repeat(unit, size) if len(at) and at[0] == 0 else em
    em[broken & (cp > 127)] = IMPOSSIBLE
    return em


#: Characters of runs that are evaluated together, so that the work of a state is one pass of numpy over all of them.
TOGETHER = 300_000


def decode_all(texts: list[str], lp: np.ndarray, declared: list[str | None]) -> list[list[tuple[int, int, str, str, float]]]:
    """For each text the spans (start, end, true, wrong, gain) that a pair's state explains better than the clean one.
    Every pair that has a stretch worth entering takes part, however long and clean the rest of the text is."""
    out: list = [[] for _ in texts]
    for k, (gain, runs) in enumerate(zip(*stretches(texts, lp), strict=True)):
        said = declared[k]
        # The declaration is one piece of evidence for a text, not one for each of its places.
        more = max(0.0, DECLARED - float(np.log(max(1.0, runs / PLACES))))
        bonus = np.array([more if said == w else 0.0 for _, w in PAIRS])
        enter = np.array([ENTER + (more if said == w else 0 if said is None or (said in ("utf_8", "utf_16_le") and t.startswith("utf_8")) else UNDECLARED) for t, w in PAIRS])
        may = np.nonzero((gain + enter + LEAVE > -_SLACK) & (gain + bonus > WORTH - _SLACK))[0]
        if len(may):
            _decode(texts[k], lp, may, enter[may], bonus[may], out[k])
    return out


def _decode(text: str, lp: np.ndarray, may: np.ndarray, enter: np.ndarray, bonus: np.ndarray, out: list) -> None:
    cp = C.points(" " + text + " ")
    near = cp > 127
    near[1:] |= cp[:-1] > 127
    near[:-1] |= cp[1:] > 127
    where = np.nonzero(near)[0]
    own = cp[where]
    ids = C.SYMBOL[own]
    clean = np.zeros(len(own), np.float32)
    clean[1:] = lp[ids[:-1], ids[1:]]
    bytes_of = {w: C.TO_BYTE[w][own] for w in {PAIRS[x][1] for x in may}}
    gains = np.stack([_emissions(own, bytes_of[PAIRS[x][1]], PAIRS[x][0], lp, C.TO_BYTE[PAIRS[x][1]]) - clean for x in may]).astype(np.float64)
    gains[:, 0] = 0
    # A position can be in a state only if the best stretch of that state through it pays; all others are clean.
    s = np.cumsum(gains, 1)
    before = np.concatenate([np.zeros((len(may), 1)), s[:, :-1]], 1)
    through = np.maximum.accumulate(s[:, ::-1], 1)[:, ::-1] - np.minimum.accumulate(before, 1)
    active = through + (enter + LEAVE)[:, None] > -_SLACK
    edges = np.nonzero(np.diff(np.concatenate([[0], active.any(0).astype(np.int8), [0]])))[0]
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        keep = np.nonzero(active[:, lo:hi].any(1))[0]
        path = _viterbi(np.concatenate([np.zeros((1, hi - lo)), gains[keep, lo:hi]]), enter[keep])
        turns = np.nonzero(np.diff(np.concatenate([[0], path, [0]])))[0]
        for a, b in zip(turns[:-1], turns[1:], strict=True):
            if path[a]:
                x = keep[path[a] - 1]
                true, wrong = PAIRS[may[x]]
                a, b = a + lo, b + lo
                gain = float(gains[x, a:b].sum())
                if gain + bonus[x] > WORTH and (own[a:b] > 127).any():
                    span = _whole_words(text, max(int(where[a]) - 1, 0), min(int(where[b - 1]), len(text)), out[-1][1] if out else 0)
                    # what clean text does not hold, in the result, speaks against a state, unless it explains the rest by far
                    result = _invert_span(text[span[0]:span[1]], true, wrong)
                    if gain > 4 * WORTH or not _strange(result):
                        out.append((*span, true, wrong, gain))


def _whole_words(text: str, a: int, b: int, least: int) -> tuple[int, int]:
    """A word is damaged as a whole: take in the characters beyond ASCII that touch the span."""
    while a > least and ord(text[a - 1]) > 127:
        a -= 1
    while b < len(text) and ord(text[b]) > 127:
        b += 1
    return a, max(a, b)


def _strange(text: str) -> bool:
    """Odd characters, East Asian ones inside words, or capitals after small letters."""
    ids = C.SYMBOL[C.points(text)]
    return bool(np.isin(ids, (C.ODD, C.LOST)).any() or (_LOWER[ids[:-1]] & _UPPER[ids[1:]] & (ids[1:] >= _FIRST_HIGH)).any() or _MIXED.search(text))


def _viterbi(em: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Most likely state (0: clean) of each position. Turning from one pair's state to another is leaving and entering,
    so only staying and coming from the best state otherwise have to be compared."""
    k, n = em.shape
    cost = np.concatenate([[0], enter])
    leave = np.concatenate([[0], np.full(k - 1, LEAVE)])
    score = em[:, 0] + cost
    came = np.zeros(n, np.int64)
    turned = np.zeros((n, k), bool)
    for t in range(1, n):
        free = score + leave
        came[t] = j = free.argmax()
        other = free[j] + cost
        turned[t] = other > score
        score = np.maximum(score, other) + em[:, t]
    path = np.zeros(n, np.int64)
    path[-1] = int((score + leave).argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t] if turned[t, path[t]] else path[t]
    return path


def _likely(text: str, lp: np.ndarray) -> float:
    ids = C.SYMBOL[C.points(" " + text + " ")]
    return float(lp[ids[:-1], ids[1:]].sum())


def block_states(line: str, lp: np.ndarray) -> str | None:
    """The line under the block encoding that makes it likely, if one beats the line as it stands by far."""
    tries: list[str | None] = []
    if ("\x00" in line or "\uf2b3" in line) and _INTERLEAVED.search(line):
        raw = C.TO_BYTE["cp1252"][C.points(line.replace("\uf2b3", "\x00"))]
        if (raw >= 0).all():
            raw = raw.astype(np.uint8).tobytes() + b"\x00" * (len(raw) % 2)
            tries += [raw.decode(c, "replace") for c in ("utf_16_le", "utf_16_be")]
    if len(line) - len(line.encode("ascii", "ignore")) < 0.3 * len(line):  # most lines end here, without an array
        return _best(line, tries, lp) if tries else None
    cp = C.points(line)
    share = lambda x: np.count_nonzero(x) / len(cp)
    if share((cp & 0xFF) <= 4) > 0.3:  # Latin, Central European and Cyrillic letters with their bytes swapped
        tries.append("".join(map(chr, (cp >> 8) | ((cp & 0xFF) << 8))))
    if cp.max() >= 0x3000 and share(((cp >= 0x3000) & (cp < 0xA000)) | ((cp >= 0xFF61) & (cp <= 0xFF9F))) > 0.3:
        for wrong, trues in (("cp932", ("utf_8",)), ("gbk", ("utf_8", "cp1252", "cp1251", "cp1250")), ("utf_16_le", ("utf_8", "cp1252"))):
            try:
                raw = line.replace("\ufffd", "").encode(wrong)
            except UnicodeError:
                continue
            tries += [raw.decode(t, "replace") for t in trues]
    else:
        for wrong in ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250"):
            raw = C.TO_BYTE[wrong][cp]
            if raw.min() >= 0:
                raw = raw.astype(np.uint8).tobytes()
                tries += [y for t in ("cp932", "euc_jp") if (y := _strictly(raw, t)) and not _MIXED.search(y)]
    return _best(line, tries, lp)


def _strictly(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeError:
        return None


#: East Asian characters that touch Latin or Cyrillic letters, and half-width ones, show a wrong reading.
_MIXED = re.compile("[A-Za-z\u00c0-\u04ff][\u3040-\u9fff]|[\u3040-\u9fff][A-Za-z\u00c0-\u04ff]|[\uff61-\uff9f\ue000-\uf8ff\uac00-\ud7a3]")


def _best(line: str, tries: list[str | None], lp: np.ndarray) -> str | None:
    if not any(tries):
        return None
    best, score = None, _likely(line, lp)
    for y in tries:
        # some odd characters are allowed: those that the wrong decoding had already lost
        if y and y != line and C.oddity(y) * (2 if "\ufffd" in line else 4) <= len(y) and (s := _likely(y, lp)) > score + 12:
            best, score = y, s
    return best


def restore_all(texts: list[str | None], lp: np.ndarray, declared: list[str | None]) -> list[tuple[bool, str | None, str]]:
    """(damaged, restored text, states) of each: restored equals the text where nothing was found."""
    now, how = list(texts), [[] for _ in texts]
    live = [k for k, t in enumerate(texts) if t and (not t.isascii() or "\x00" in t)]
    seen = {k: {now[k]} for k in live}
    turn = 0
    while live:  # ends: a text that comes back to what it was before is given up
        changed = set()
        if turn == 0:
            for k in live:
                lines = now[k].split("\n")
                fixed = [block_states(x, lp) if not x.isascii() or "\x00" in x else None for x in lines]
                if any(f is not None for f in fixed):
                    now[k] = "\n".join(x if f is None else f for x, f in zip(lines, fixed, strict=True))
                    how[k].append("block")
        for k, spans in zip(live, decode_all([now[k] for k in live], lp, [declared[k] if not how[k] else None for k in live]), strict=True):
            for a, b, true, wrong, _ in reversed(spans):
                now[k] = now[k][:a] + _invert_span(now[k][a:b], true, wrong) + now[k][b:]
            if spans:
                how[k] += [f"{true}>{wrong}" for _, _, true, wrong, _ in spans]
                changed.add(k)
        live = [k for k in live if k in changed and not now[k].isascii() and now[k] not in seen[k]]
        for k in live:
            seen[k].add(now[k])
        turn += 1
    return [(n != t or (t is not None and "\ufffd" in t), n, ",".join(dict.fromkeys(h)) if n != t else "") for t, n, h in zip(texts, now, how, strict=True)]


def restore(text: str | None, lp: np.ndarray, declared: str | None = None) -> tuple[bool, str | None, str]:
    return restore_all([text], lp, [declared])[0]


def _invert_span(span: str, true: str, wrong: str) -> str:
    if true == "utf_8_twice":
        return _invert_span(_invert_span(span, "utf_8", wrong), "utf_8", wrong)
    whole = C.invert(span, true, wrong)
    if whole is not None:
        return whole
    cp = C.points(span)
    b = C.TO_BYTE[wrong][cp]
    if true != "utf_8":
        return "".join(c if x < 0 else chr(C.TO_CHAR[true][x]) for c, x in zip(span, b, strict=True))
    y, used, broken = C.utf8_units(b)
    return "".join(c if bad else chr(v) for c, v, u, bad in zip(span, y, used, broken, strict=True) if not u)


# ---- Spark

def find(records: DataFrame, lp: np.ndarray) -> DataFrame:
    """records(src, rec_id, text, declared) -> (src, rec_id, restored, restorable, states) of the damaged ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            said = [C.DECLARED.get(x.lower()) if isinstance(x, str) else None for x in b["declared"]]
            done = restore_all(texts, lp, said)
            out = [(src, i, text, "\ufffd" not in text, states) for src, i, (bad, text, states) in zip(b["src"], b["rec_id"], done, strict=True) if bad]
            yield pd.DataFrame(out, columns=["src", "rec_id", "restored", "restorable", "states"])

    return records.mapInPandas(run, "src string, rec_id long, restored string, restorable boolean, states string")


def only_suspicious(records: DataFrame, lp: np.ndarray) -> DataFrame:
    """The first pass, as a filter on records with a ``text`` column."""

    @F.pandas_udf("boolean")
    def odd(text: pd.Series) -> pd.Series:
        return pd.Series(suspicious(text, lp))

    return records.where("text IS NOT NULL AND text <> ''").where(odd("text"))
