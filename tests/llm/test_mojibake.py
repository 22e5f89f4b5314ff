import random

import pandas as pd
import pytest

from nestlake.llm import charset as C
from nestlake.llm import mojibake as M

SENTENCES = [
    "Die Prüfung der Bücher läuft, und die Übertragung wird größer.", "Le résumé précise que l’équipe a déjà reçu la pièce jointe.", "La operación mañana será difícil para el año próximo.",
    "Perché la città è così vicina, il caffè è già pronto.", "Według notatki zażalenie uchyla orzeczenie sądu, a świadek też.", "Согласно записке, протокол подтверждает закон и решение суда.",
    "The charge — as expected — refinances the bond; the “summary” says so.", "Żółta książka leży na półce w bibliotece głównej.", "Größentabelle, Gebührenverzeichnis und Schlüsselübergabe.",
    "Как выяснилось, перевод уже выигрывает финальный матч.", "Été 2013 à la mer, forêt brûlée, élève et maître.", "Señalización vía 15, edición española, niños y jóvenes.",
]


@pytest.fixture(scope="module")
def lp():
    r = pd.concat(M.count_bigrams(iter([pd.DataFrame({"text": SENTENCES * 40 + ["Plain words of an English text without any accents at all."] * 200})])))
    return M.model(r.pair.to_numpy(), r.n.to_numpy())


@pytest.mark.parametrize(("true", "wrong"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
                                             ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp866", "cp1251"), ("cp852", "cp1250"), ("cp437", "cp1252")])
def test_round_trip(true, wrong, lp):
    """Damage every sentence that the pair can damage without loss: all must be found, and nearly all restored exactly."""
    found = exact = n = 0
    for s in SENTENCES:
        try:
            bad = s.encode(true)
            table = C.TO_CHAR[{"latin-1": "latin_1"}.get(wrong, wrong)]
            bad = "".join(chr(table[b]) for b in bad)
        except UnicodeError:
            continue
        if bad == s:
            continue
        n += 1
        hit, text, _ = M.restore(bad, lp, None)
        found += hit
        exact += text == s
    assert n and found == n and exact >= 0.7 * n, (found, exact, n)


def test_partial_double_and_lost(lp):
    clean, bad = SENTENCES[0], SENTENCES[1].encode().decode("cp1252")
    hit, text, _ = M.restore(f"{clean}\n\n{bad}", lp)
    assert hit and text == f"{clean}\n\n{SENTENCES[1]}"
    twice = SENTENCES[2].encode().decode("cp1252").encode().decode("cp1252")
    assert M.restore(twice, lp)[:2] == (True, SENTENCES[2])
    assert M.restore(SENTENCES[0].encode("cp1252").decode("utf-8", "replace"), lp)[0]
    utf16 = "".join(c + "" for c in "Préparé")
    assert M.restore(utf16, lp)[:2] == (True, "Préparé")
    swapped = SENTENCES[0].encode("utf-16-le").decode("utf-16-be", "replace")
    assert M.restore(swapped, lp)[0]


def test_clean_stays(lp):
    for s in [*SENTENCES, None, "", " \n", "plain", "SÃO JOANINHO", "½ × ¾", "† 1912", "€ 12,50", "資料一覧", "a" * 100_000]:
        assert M.restore(s, lp)[:2] == (False, s), s


def test_spark(spark, lp):
    rows = [("a", 1, "Prüfung", "1252"), ("a", 2, "PrÃ¼fung der BÃ¼cher", None), ("a", 2, "PrÃ¼fung der BÃ¼cher", None), ("b", None, None, None), ("b", 3, "x", "65001")]
    df = spark.createDataFrame(rows, "src string, rec_id long, text string, declared string")
    got = M.find(M.only_suspicious(df, lp), lp).collect()
    assert [(r.src, r.rec_id, r.restored, r.restorable) for r in got] == [("a", 2, "Prüfung der Bücher", True)] * 2
    assert M.find(M.only_suspicious(df.where("false"), lp), lp).count() == 0
    assert M.train(df.select("text").where("false")).shape == lp.shape


def test_utf8_units_against_decoder():
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("aé—ßжあ x") for _ in range(rng.randrange(12)))
        b = C.TO_BYTE["latin_1"][C.points(s.encode().decode("latin-1"))]
        y, used, broken = C.utf8_units(b)
        assert "".join(chr(v) for v, u in zip(y, used, strict=True) if not u) == s and not broken.any()


def _taught(texts):
    r = pd.concat(M.count_bigrams(iter([pd.DataFrame({"text": texts})])))
    return M.model(r.pair.to_numpy(), r.n.to_numpy())


def test_frequent_damage_is_still_found():
    """Damage without odd characters neither teaches the model nor passes the first pass as clean."""
    bad = "Договор аренды".encode("koi8_r").decode("cp1251")
    taught = _taught(SENTENCES * 40 + ["Договор аренды подписан.", "Новая редакция"] * 40 + [bad] * 60)
    assert M.suspicious(pd.Series([bad]), taught)[0]
    assert M.restore(bad, taught)[:2] == (True, "Договор аренды")


def test_first_pass_keeps_what_the_decoder_finds(lp):
    texts = ["ZdjÄ™cie 152", "Lâ€™enzyme 77", "Kšnigsberger Akte 30", *SENTENCES]
    for said in (None, "cp1252", "mac_roman"):
        found = [hit for hit, _, _ in M.restore_all(texts, lp, [said] * len(texts))]
        assert all(s or not f for s, f in zip(M.suspicious(pd.Series(texts), lp), found, strict=True))


def test_damage_is_found_however_long_the_clean_rest_is(lp):
    clean, good = SENTENCES[5], SENTENCES[0]
    bad = good.encode("cp1252").decode("mac_roman")
    before, after = "\n\n".join([clean] * 60), "\n\n".join([SENTENCES[1]] * 60)
    assert M.restore(f"{before}\n\n{bad}\n\n{after}", lp)[:2] == (True, f"{before}\n\n{good}\n\n{after}")
