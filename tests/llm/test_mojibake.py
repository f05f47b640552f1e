import numpy as np
import pytest

from crowdsignal.llm.mojibake import CHAINS, garble, garbled_documents, restore, segments, train, ungarble

CLEAN = [
    "The café’s résumé reads “well” — it’s naïve.", "We’re not for sale, said Müllerhof’s board; the €3 bn offer stands.", "L’été dernier, j’ai acheté à découvert à Besançon.",
    "Größere Rücksetzer nutze ich für Nachkäufe, schöner wäre mehr.", "Mañana compraré más acciones; ¿alguien sabe por qué cayó?", "ATENÇÃO: A COTAÇÃO NÃO É RECOMENDAÇÃO.", "Não vou vender, a inflação já está no preço.",
    "Рынок сегодня очень слабый, объёмы маленькие.", "Дивиденды обещали повысить в следующем году.", "市场情绪很差，先观望吧。", "这家公司的利润比去年低很多。", "β = 1.2 ± 0.05, σ² ≈ 0.3, × ½ → α", "To the moon 🚀🚀 💎🙌",
]


@pytest.fixture(scope="module")
def model():
    return train(CLEAN * 20)


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[-1][1] != "utf-8"])
def test_chains_are_undone(chain):
    done = 0
    for text in CLEAN:
        g = garble(text, chain)
        if g is not None:
            back = ungarble(g, chain)
            assert back is not None and back[0] == text or back is not None and back[1]
            done += back[0] == text
    assert done or all(garble(t, chain) is None for t in CLEAN)


def test_segments_rejoin():
    for text in [*CLEAN, "", "a" * 5000, "one. two!\nthree？ four"]:
        assert "".join(segments(text)) == text


def test_clean_text_is_left_alone(model):
    for text, n, _ in restore(CLEAN + ["plain ascii", "", None], model):
        assert n == 0
        assert text in CLEAN + ["plain ascii", "", None]


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "mac-roman"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1251", "cp1252"),), (("koi8-r", "cp1251"),)])
def test_garbled_text_is_found_and_restored(model, chain):
    texts = [t for t in CLEAN[:9] if garble(t, chain)]
    out = restore([f"In plain words. {garble(t, chain)} And so on." for t in texts], model)
    assert sum(n > 0 for _, n, _ in out) >= len(texts) - 1
    assert sum(r == f"In plain words. {t} And so on." for (r, _, _), t in zip(out, texts, strict=True)) >= len(texts) - 1


def test_losses_are_found(model):
    text = garble(CLEAN[4], (("cp1252", "utf-8"),))
    assert "�" in text
    assert [(n > 0, lost > 0) for _, n, lost in restore([text], model)] == [(True, True)]


def test_documents(spark):
    bad = garble(CLEAN[0], (("utf-8", "cp1252"),))
    rows = [(k, t, "x", 1) for k, t in enumerate(CLEAN * 8)] + [(1000, bad, "x", 1), (1000, bad, "x", 1), (1001, None, "x", 1), (1002, "", "x", 1), (None, bad + "x" * 60_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc bigint, text string, id string, n_lost int")
    out = garbled_documents(df, "doc", "text").collect()
    assert sorted((r["doc"] is None, r["doc"]) for r in out) == [(False, 1000), (False, 1000), (True, None)]
    assert {r["restored"] for r in out if r["doc"]} == {CLEAN[0]}
    assert garbled_documents(df.limit(0), "doc", "text").count() == 0


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("gbk", "cp1252"),)])
def test_long_paragraphs_without_blanks_are_restored(model, chain):
    text = ("这家公司的利润比去年低很多，市场情绪很差，先观望吧，" * 50)[:1000]
    garbled = garble(text, chain)
    assert "".join(segments(garbled)) == garbled
    assert restore([garbled], model) == [(text, 1, 0)]
    mixed = f"In words, {garble(text[:600] + ' GME ' + text[:700], chain)} and so on"
    assert restore([mixed], model)[0][0] == f"In words, {text[:600]} GME {text[:700]} and so on"


def test_long_clean_lines_are_cut():
    assert max(map(len, segments("Größe, " * 400))) <= 400 and max(map(len, segments("слово и " * 20 + "слово, " * 300))) <= 400


def test_garbled_text_that_cannot_be_restored_is_found(model):
    for text in ["fineâ€", "He said fine'â€ and left."]:
        assert [n for _, n, _ in restore([text], model)] == [1]
    text = "fineâ€"  # the last byte of the quote was dropped
    assert restore([text], model) == [(text, 1, 1)]


def test_text_garbled_into_ascii(model):
    model = train(CLEAN * 20)
    cases = {"utf-7": "Größere Rücksetzer nutze ich", "hz": "市场情绪很差", "iso2022_jp": "市情"}
    for encoding, text in cases.items():
        garbled = f"In words {text.encode(encoding).decode('ascii')} and so on."
        assert garbled.isascii()
        assert restore([garbled], model) == [(f"In words {text} and so on.", 1, 0)]
    fine = ["up +100% and +100-200 or +AAPL- and C+++, ~{x", "a+b-c +12345 +CALL- +PUTS", "x = y+ABCDE-1"]
    assert restore(fine, model) == [(t, 0, 0) for t in fine]


def test_segments_garbled_in_part_are_restored(model):
    bad = garble("The café’s résumé reads", (("utf-8", "cp1252"),))
    assert restore([f"{bad} “well” — said Müllerhof"], model)[0][:2] == ("The café’s résumé reads “well” — said Müllerhof", 1)
    assert restore(["Le chiffre est rÃ©visÃ© Ã  la baisse."], model)[0][:2] == ("Le chiffre est révisé à la baisse.", 1)


def test_held_out_documents_come_back_exactly(spark):
    clean = [f"{a} {k} {b}" for k, (a, b) in enumerate(zip(CLEAN[:11] * 12, CLEAN[3:11] * 17))]
    chains = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "mac-roman"),)]
    rows = [(k, g if k % 4 == 0 and (g := garble(t, chains[k // 4 % 4])) else t) for k, t in enumerate(clean)]
    out = {r["doc"]: r["restored"] for r in garbled_documents(spark.createDataFrame(rows, "doc bigint, text string"), "doc", "text").collect()}
    bad = {k for (k, g), t in zip(rows, clean, strict=True) if g != t}
    assert len(bad & set(out)) >= 0.97 * len(bad) and not set(out) - bad
    assert sum(out.get(k) == clean[k] for k in bad) >= 0.95 * len(bad)


def test_chances_of_chains_that_agree_are_summed(model):
    class Shared:  # as if cp437 and cp850, which agree in these letters, were equally likely
        sure = 0.99

        def scores(self, texts):
            out = np.zeros((len(texts), len(CHAINS) + 1))
            for row, t in zip(out, texts, strict=True):
                row[[CHAINS.index((("cp1252", e),)) for e in ("cp437", "cp850")] if t != "Größe" else [-1]] = 0.5 if t != "Größe" else 1
            return out

    garbled = garble("Größe", (("cp1252", "cp437"),))
    assert ungarble(garbled, (("cp1252", "cp850"),))[0] == ungarble(garbled, (("cp1252", "cp437"),))[0] == "Größe"
    assert restore([garbled], Shared()) == [("Größe", 1, 0)]
