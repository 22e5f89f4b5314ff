import random

import numpy as np
import pytest

from nestlake.llm import langid as L
from nestlake.llm import subjects as S

BASE = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("label", "code"), [("en-GB", "en"), ("ENGLISH", "en"), ("de_AT", "de"), ("rus", "ru"), ("", None), (None, None), ("und", None), ("??", None), (float("nan"), None), ("pt-BR", "pt"), ("Dutch", "nl"), ("xx", None)])
def test_names(label, code):
    assert L.named(label) == code


@pytest.fixture(scope="module")
def profiles(spark):
    return L.train(spark.read.parquet(f"{BASE}/documents.parquet").select("text", "lang"))


def test_languages(profiles):
    cases = {"en": "According to the note, the charge was moved to the north site and nothing more.", "de": "Laut Vermerk wird die Übertragung nicht mehr geprüft, und der Rest folgt morgen.", "fr": "Selon la note, le rapport sera envoyé demain et rien de plus.",
             "es": "Según la nota, el informe se enviará mañana y nada más por ahora.", "it": "Secondo la nota, il rapporto sarà inviato domani e nient’altro.", "pl": "Według notatki raport zostanie wysłany jutro i nic więcej.", "ru": "Согласно записке, отчёт будет отправлен завтра и ничего больше."}
    for code, text in cases.items():
        (para, lang, conf), = L.label(text, profiles)
        assert (para, lang) == (-1, code) and 0 < conf <= 1
    mixed = L.label(cases["de"] + "\n\n" + cases["fr"] + "\n\n42", profiles)
    assert [(p, x) for p, x, _ in mixed][:2] == [(0, "de"), (1, "fr")] and len(mixed) == 3
    quoted = L.label(cases["en"] + " („Jądro atomu“)\n\n" + cases["en"] + " https://x.example/über", profiles)
    assert [(p, x) for p, x, _ in quoted] == [(-1, "en")]


def test_held_out_labels_agree(spark, profiles):
    """Labels of the documents are mostly right, so the label and the profile must mostly agree on other documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.lang for r in L.label_documents(docs, profiles).where("para = -1").collect()}
    said = [(L.named(r.lang), got[r.doc_id]) for r in docs.collect() if r.doc_id in got and L.named(r.lang)]
    assert sum(a == b for a, b in said) > 0.85 * len(said)


def test_edges(spark, profiles):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "1234 " * 50), (None, "According to the note, the rest follows tomorrow."), (5, "the rest of it " * 20_000)], "doc_id long, text string")
    rows = L.label_documents(df, profiles).collect()
    assert {r.doc_id for r in rows} == {None, 5} and all(r.lang == "en" for r in rows)
    empty = L.train(df.where("false").selectExpr("text", "text AS lang"))
    assert L.label_documents(df, empty).count() == 0


def plain_distances(text, top):
    """Out-of-place distances by the book: top is language -> list of n-grams in order of frequency."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    count: dict = {}
    for w in words:
        padded = f" {w} "
        grams = list(w) + [padded[k:k + 2] for k in range(len(padded) - 1)] + [padded[k:k + 3] for k in range(len(padded) - 2)]
        for g in grams:
            count[g] = count.get(g, 0) + 1
    return count, {x: {g: r for r, g in enumerate(gs)} for x, gs in top.items()}


def test_distances_against_plain_python():
    """Profiles of two made languages in two scripts; the vectorised distances against dictionaries."""
    code = lambda g: sum((L.ABSENT if len(g) < 3 - k else 0 if g[k - 3 + len(g)] == " " else int(L._LETTER[ord(g[k - 3 + len(g)])])) << (2 - k) * L.BITS for k in range(3))
    top = {"aa": ["a", "an", " a", "b", "ban", "an ", "n"], "el": ["α", "β", "αβ", " α", "αβγ", "γ "]}
    rows = [(x, code(g), r) for x, gs in top.items() for r, g in enumerate(gs)]
    p = L.profiles_of([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    texts = ["Banana ban, an ABBA", "αβγ αβγ αβ a", "zzz qq", "", "12 !?", "an αβγ" * 300]
    got = p.distances(texts)
    for t, d in zip(texts, got, strict=True):
        count, ranks = plain_distances(t, top)
        groups: dict = {}
        for g, n in count.items():  # equally frequent n-grams may stand in any order: take the span of their places
            groups.setdefault(n, []).append(g)
        lo, hi, at = np.zeros(2), np.zeros(2), 0
        for n in sorted(groups, reverse=True):
            for g in groups[n]:
                for k, x in enumerate(p.languages):
                    r = ranks[x].get(g)
                    offs = [abs(r - q) for q in range(at, at + len(groups[n]))] if r is not None else [L.PROFILE_SIZE]
                    lo[k] += min(offs)
                    hi[k] += max(offs)
            at += len(groups[n])
        want = (np.ones(2), np.ones(2)) if not count else (lo / (L.PROFILE_SIZE * len(count)), hi / (L.PROFILE_SIZE * len(count)))
        assert (d >= want[0] - 1e-9).all() and (d <= want[1] + 1e-9).all(), t


def test_an_eighth_language_is_learnt(spark):
    words = {"nl": "het is een oude vergadering van de gemeente over wegen", "el": "η επιτροπή συζητά το σχέδιο για τους δρόμους της πόλης"}
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choices(words[x].split(), k=40)), x if i % 3 else None) for i, x in enumerate(["nl", "el"] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = L.train(df)
    assert p.languages == ["el", "nl"] and {r.doc_id: r.lang for r in L.label_documents(df, p).collect()} == {i: ("nl", "el")[i % 2] for i in range(60)}
    assert L.train(df, ["nl"]).languages == ["nl"]


WORDS = {"law": ["court", "judge", "appeal", "statute"], "sport": ["match", "coach", "league", "goal"], "travel": ["hotel", "ticket", "luggage", "museum"]}
FILLER = ["Kind regards from all of us.", "See item nine for the rest.", "This page was left blank."]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        of = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        s = [f"The {rng.choice(WORDS[k])} reviews the {rng.choice(WORDS[k])} before the {rng.choice(['record', 'day'])}." for k in of for _ in range(4)] + rng.sample(FILLER, 2)
        rng.shuffle(s)
        docs.append((i, " ".join(s), rng.choice(["a", "b", None]), "en"))
        truth[i] = set(of)
    return docs, truth


def test_subjects_held_out(spark):
    docs, truth = corpus()
    rng = random.Random(2)
    labelled = [(i, s) for i in range(120) for s in truth[i]] + [(i, rng.choice(sorted(WORDS))) for i in range(5)] + [(1, "nonsense"), (None, "law"), (99999, "law")]
    df = spark.createDataFrame(docs + [(1000, None, None, None), (1001, "", "a", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labelled, "doc_id long, subject string")
    got: dict = {}
    for r in S.label_documents(df, labels, sorted(WORDS)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    test = range(120, 400)
    right = sum(len(got.get(i, set()) & truth[i]) for i in test)
    assert right / sum(len(got.get(i, set())) for i in test) > 0.93 and right / sum(len(truth[i]) for i in test) > 0.93
    assert 1000 not in got and 1001 not in got
    joined: dict = {}  # with most terms joined instead of broadcast
    for r in S.label_documents(df, labels, sorted(WORDS), size=3).collect():
        joined.setdefault(r.doc_id, set()).add(r.subject)
    assert joined == got


def test_learning_recovers_accuracies():
    rng = np.random.default_rng(0)
    k, n = 3, 20_000
    z = rng.choice(k + 1, n, p=[0.3, 0.2, 0.2, 0.3])
    vote = lambda acc: np.where(rng.random(n) < acc, np.where(z == k, k + 1, z), rng.integers(0, k + 2, n))
    patterns, counts = np.unique(np.stack([vote(0.9), vote(0.7), vote(0.0), vote(0.0)], 1), axis=0, return_counts=True)
    prior, confusion = S.learn(patterns, counts.astype(float), k)
    assert abs(prior[0] - 0.3) < 0.05 and confusion[0][0, 0] > 0.85 and 0.65 < confusion[1][0, 0] < 0.85


def test_sentences_against_plain_python():
    """Words, sentences and paragraphs of a batch against a splitter of one text."""
    import re

    from nestlake.llm import sentences as T

    texts = ["The court ruled. It was late, it was.\n\nNext   part: court 12 ok!\n \n• one item here • two more items", "", "a bb", "Ünïted «Straße». Nächster Satz: straße Straße.", "see https://court.example/law now and then. Well then.", "x" * 70_000 + " long word"] * 3
    got = T.split(texts)
    want = []
    for k, t in enumerate(texts):
        for par in re.split(r"\n\s*\n", re.sub(r"https?://\S+", " ", t).lower()):
            for s in re.split(r"(?<=[.!?…])[\"”“»]?\s+|•", par):
                words = re.findall(r"[^\W\d_]{3,}", s)
                if len(words) >= 2:
                    want.append((k, list(dict.fromkeys(words))))
    assert got.text.tolist() == [k for k, _ in want] and got.sizes.tolist() == [len(w) for _, w in want]
    known: dict = {}
    for h, w in zip(got.words.tolist(), [w for _, ws in want for w in ws], strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert len(set(zip(got.text.tolist(), got.paragraph.tolist()))) == len(set(got.paragraph.tolist()))
