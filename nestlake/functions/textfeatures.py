"""Text features as built-in expressions: what the text processor counts, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

URI = r"""(?i)\b((?:https?|ftp)://[^\s<>"'`{}|\\^\[\]]*[^\s<>"'`{}|\\^\[\].,;:!?()])"""
# Words that announce a password by themselves, and words that do so only with a mark behind them.
PLAIN_WORDS = ("password", "passphrase", "passcode")
MARKED_WORDS = ("pass", "key", "code")
MARKS, ONLY_PLAIN_MARKS = (":", "is"), ("-",)
CARD = r"\b((?:\d{4}[\s-]?){3}\d{4})\b"


def _left_out(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def counts(text: str) -> dict[str, Column]:
    c = F.col(text)
    return {
        "number_of_characters": F.length(c), "number_of_digits": _left_out(c, "[0-9]"), "number_of_ascii_range_chars": _left_out(c, r"[\x00-\x7F]"),
        "number_of_whitespaces": _left_out(c, r"[ \t\n\x0B\f\r]"), "number_of_newlines": _left_out(c, "\n"),
        "number_of_words": F.size(F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")),
    }


def number_class(text: str) -> Column:
    """ALL_NUMBERS, MOSTLY_NUMBERS, MANY_NUMBERS or null."""
    n = counts(text)
    digits, rest = n["number_of_digits"], n["number_of_characters"] - n["number_of_whitespaces"]
    return F.when(digits == 0, None).when(digits == rest, "ALL_NUMBERS").when(digits > F.floor(rest / 2), "MOSTLY_NUMBERS").when(digits > F.floor(rest / 10), "MANY_NUMBERS")


# Frequent function words of languages by their English names.
FUNCTION_WORDS = {
    "English": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "not"), "French": ("le", "la", "les", "des", "et", "est", "dans", "pas", "pour", "une", "du", "que"),
    "German": ("der", "die", "das", "und", "nicht", "ist", "von", "mit", "den", "auf", "ein", "eine"), "Italian": ("il", "che", "di", "non", "per", "una", "del", "della", "con", "sono", "nel", "la"),
    "Polish": ("i", "w", "na", "nie", "się", "z", "do", "że", "jest", "po", "o", "przez"), "Russian": ("и", "в", "не", "на", "что", "с", "по", "это", "как", "из", "к", "за"),
    "Spanish": ("el", "la", "los", "las", "del", "y", "que", "por", "con", "una", "para", "no"),
}
LEAST_WORDS = 3


def _among(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*words)


def natural_language(text: str) -> Column:
    """English name of the language with most function words in the text; null with fewer than LEAST_WORDS, or a tie."""

    def of_words(words: Column) -> Column:
        found = F.array(*[F.struct(F.size(F.filter(words, _among(ws))).alias("n"), F.lit(name).alias("name")) for name, ws in FUNCTION_WORDS.items()])
        return F.transform(F.array(F.sort_array(found, False)), lambda a: F.when((F.get(a, F.lit(0))["n"] >= LEAST_WORDS) & (F.get(a, F.lit(0))["n"] > F.get(a, F.lit(1))["n"]), F.get(a, F.lit(0))["name"]))

    return F.flatten(F.transform(F.array(F.split(F.lower(text), r"[^\p{L}]+")), of_words))[0]


def uris(text: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URI), 1)))


def hosts(text: str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(uris(text), lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))))))


def passwords(text: str) -> Column:
    """Last words of lines that an announcement stands right before, one white space between: an announcing word with
    its mark, attached or one white space behind it, if it needs one."""
    split = F.struct(F.split(text, r"\s").alias("words"), F.regexp_extract_all(text, F.lit(r"(\s)"), 1).alias("gaps"))

    def in_text(x: Column) -> Column:  # the lambda's variable, so that the text is split once
        def named(word: Column, i: Column) -> Column:
            ends = F.coalesce(F.get(x["gaps"], i) == "\n", F.lit(True))
            return F.when((word != "") & ends & F.coalesce(_announce(F.lower(F.get(x["words"], i - 2)), F.lower(F.get(x["words"], i - 1))), F.lit(False)), word)

        return F.transform(x["words"], named)

    found = F.flatten(F.transform(F.array(split), in_text))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def _announce(first: Column, second: Column) -> Column:
    ok = _ends_in(second, "", PLAIN_WORDS) | F.coalesce((second == "") & _ends_in(first, "", PLAIN_WORDS), F.lit(False))
    for mark in MARKS + ONLY_PLAIN_MARKS:
        own = PLAIN_WORDS + (() if mark in ONLY_PLAIN_MARKS else MARKED_WORDS)
        ok = ok | _ends_in(second, mark, own) | F.coalesce((second == mark) & _ends_in(first, "", own), F.lit(False))
    return ok


def _ends_in(text: Column, mark: str, words: tuple[str, ...]) -> Column:
    """Whether the text ends in one of the words and the mark, the word not inside a longer one."""
    bare = F.when(text.endswith(mark), F.substring(text, F.lit(1), F.length(text) - len(mark)))
    return F.coalesce(F.regexp_extract(bare, r"(?U)(\w+)$", 1).isin(*words), F.lit(False))


def has_card_number(text: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(CARD), 1)
    return F.exists(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"\D", "")))
