import numpy as np
import pytest

from crowdsignal.llm.abuse import BATCH_WORDS, CLASSES, LANGUAGES, Scorer, _batches, buckets, fit, fit_held_out, language_thresholds, per_submission, score_content
from crowdsignal.llm.abuse_text import NAME, NUMBER, Reader, known_words, made_up

CLEAN = ["I read three reports on shipping this week.", "My plan is to buy the dip and then wait.", "I am a miserable jackass for selling early.", "What an ugly week, the chart looks like shit.", "Our rules forbid hate speech and personal attacks.", "The account is at $4,232.79 after a messy month."]
BAD = [("You are a worthless idiot and nobody wants you here.", "abuse"), ("Shut up, you braindead asshole.", "abuse"), ("I hope your house burns down.", "abuse"), ("All foreigners are vermin, ban the lot of them.", "hate"), ("I want to fuck you all night.", "sexual"), ("Hot babe here, selling nudes.", "sexual")]


@pytest.fixture(scope="module")
def net():
    return fit([(t, "none") for t in CLEAN * 6] + BAD * 6)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You are such a a_s_s_h_o_l_e now", ["asshole"]), ("j a c k a s s.", ["jackass"]), ("m4gg07 and 1d107", ["maggot", "idiot"]), ("du*bass m@ron n#des", ["dumbass", "moron", "nudes"]), ("Shhhhhit", ["shit"]),
        ("раrаsіtеs", ["parasites"]), ("idi​ot", ["idiot"]), ("JaCkAsS", ["jackass"]), ("b-a-n-g you", ["bang"]), ("f o o ls here", ["fools"]),
    ],
)
def test_spellings_are_undone(text, words):
    import re

    found = [w for s in Reader(known_words()).sentences(text) for w in s]
    assert set(re.sub(r"(.)\1+", r"\1", w) for w in words) <= set(found)


def test_reader_of_names_and_numbers():
    r = Reader(known_words(), LANGUAGES["en"].split())
    assert r.sentences("MarbleCanyon has $4,641.12 in GME. And?\nNew line") == [[NAME, "has", NUMBER, "in", NAME], ["and"], ["new", "line"]]
    assert r.sentences(None) == r.sentences("") == r.sentences("  ...  ") == []


def test_held_out_phrases(net):
    rows = [(t, label) for t, label in made_up(600, seed=99)]
    scores, kinds, _ = Scorer(net).score([[t] for t, _ in rows])
    truth = np.array([label != "none" for _, label in rows])
    flagged = scores >= language_thresholds(net, [(t, "none") for t in CLEAN] + BAD)[0]
    precision, recall = (flagged & truth).sum() / flagged.sum(), (flagged & truth).sum() / truth.sum()
    assert precision > 0.9 and recall > 0.9
    hit = flagged & truth
    assert np.mean([CLASSES[k] == label for k, (_, label), h in zip(kinds, rows, hit, strict=True) if h]) > 0.9


def test_a_text_scores_as_its_worst_part(net):
    scorer = Scorer(net)
    (bad,), _, _ = scorer.score([[BAD[1][0]]])
    long = " ".join(CLEAN * 300)
    scores, _, languages = scorer.score([[None, ""], [long, None], [long, BAD[1][0]], [long + " " + BAD[1][0], None]])
    assert scores[0] == 0 and scores[1] < 0.5
    assert scores[2] == pytest.approx(bad, abs=1e-4) and scores[3] == pytest.approx(bad, abs=1e-4)
    assert list(languages[1:3]) == [0, 0] and languages[0] == len(LANGUAGES)


def test_table(spark):
    labels = spark.createDataFrame([(k, t, "none") for k, t in enumerate(CLEAN * 3)] + [(k + 100, t, x) for k, (t, x) in enumerate(BAD * 3)] + [(300, "x", None), (301, None, "abuse")], "label_id bigint, text string, label string")
    rows = [("a", CLEAN[0], BAD[1][0]), ("b", BAD[4][0], None), ("c", CLEAN[1], CLEAN[5]), ("d", None, None), ("d", None, None), (None, "", "?!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, title string, selftext string, k0 int")
    out = score_content(df, "id", ["title", "selftext"], labels, ["k0"]).collect()
    assert len(out) == 6 and out[0].asDict().keys() == {"id", "k0", "score", "label", "language", "flagged"}
    assert {r["id"] for r in out if r["flagged"]} == {"a", "b"}
    assert all((r["label"] == "none") == (not r["flagged"]) for r in out)
    assert score_content(df.limit(0), "id", ["title"], labels.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        score_content(df.withColumnRenamed("k0", "score"), "id", ["title"], labels, ["score"])


def test_words_are_read_to_their_end():
    long = "antidisestablishmentarianism"
    assert set(buckets(long)) - set(buckets(long[:-1])) and len(buckets(long)) == 1 + (len(long) + 2 - 2) + (len(long) + 2 - 3)


def test_long_sentences_are_learnt_whole():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 8, 60, 5000, 20_000])
    batches = _batches(np.arange(6), lengths, 4, rng)
    assert sorted(np.concatenate(batches)) == list(range(6)) and all(len(b) == 1 or len(b) * lengths[b].max() <= BATCH_WORDS for b in batches)
    filler = "the market moved a little and we all waited for the numbers to come out while it did " * 10
    net = fit([(f"{filler} you vurblewort", "abuse")] * 8 + [(filler, "none")] * 8 + [(t, "none") for t in CLEAN * 2], epochs=12, made=0, foreign=[])
    scores, _, _ = Scorer(net).score([[f"{filler} you vurblewort"], [filler]])
    assert scores[0] > scores[1] + 0.2


def test_thresholds_are_of_rows_not_learnt_from():
    rows = [(t, "none") for t in CLEAN * 10] + BAD * 10
    net, thresholds = fit_held_out(rows, [])
    assert thresholds.shape == (len(LANGUAGES) + 1,) and (thresholds > 0.2).all() and (thresholds < 0.95).all()
    assert (language_thresholds(net, []) == 0.5).all()


def test_one_row_per_submission(spark):
    rows = [("a", "x", 0.5, "none", "en", False), ("a", "x", 0.500001, "abuse", "en", True), ("b", None, 0.1, "none", "de", False), (None, "x", 0.0, "none", "en", False), (None, "x", 0.2, "none", "en", False)]
    df = spark.createDataFrame(rows, "id string, subreddit string, score double, label string, language string, flagged boolean")
    out = sorted(map(tuple, per_submission(df, "id", ["subreddit"]).collect()), key=str)
    assert out == sorted([("a", "x", 0.500001, "abuse", "en", True), ("b", None, 0.1, "none", "de", False), (None, "x", 0.2, "none", "en", False)], key=str)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("fück you blöd ídíot", ["fuck", "you", "blod", "idiot"]), ("fu\u0308ck", ["fuck"]), ("Ты тупой идиот!", ["ты", "тупой", "идиот"]), ("мой ёж", ["мой", "ёж"]), ("GME-акция", ["gme", "акция"]),
        ("你是白痴。滚", ["你", "是", "白", "痴", "滚"]), ("バカ", ["バ", "カ"]), ("أنت غبي", ["أنت", "غبي"]), ("तुम मूर्ख", ["तुम", "मूर्ख"]), ("Іdіоt", ["idiot"]), ("❤️ 🚀", []),
    ],
)
def test_words_of_any_script(text, words):
    assert [w for s in Reader(known_words()).sentences(text) for w in s] == words


def test_other_languages_are_scored(net):
    bad = ["Ты просто тупой идиот и урод", "你真是个白痴，去死吧", "Du bist ein blöder Idiot, du Arschloch", "Cállate, imbécil de mierda", "Fück you, you ídíot"]
    fine = ["Рынок сегодня очень слабый, объёмы маленькие", "这家公司的利润比去年低很多", "Ich habe die Aktie gekauft und warte auf die Zahlen", "Alguien sabe por qué cayó el mercado?"]
    scores, _, _ = Scorer(net).score([[t] for t in bad + fine])
    assert min(scores[: len(bad)]) > 0.5 > max(scores[len(bad) :])
    _, _, languages = Scorer(net).score([["Я думаю, что это не так, как мы хотели"], ["Ich weiß nicht, für wen das ist"]])
    assert [list(LANGUAGES)[k] for k in languages] == ["ru", "de"]


def test_words_in_capitals_are_read():
    r = Reader(known_words(), LANGUAGES["en"].split(), tickers=["GME", "F"])
    assert r.sentences("you CUNT and KYS WXYZ, GME $ABC") == [["you", "cunt", "and", "kys", "wxyz", NAME, NAME]]
    assert r.sentences("now FuckYou or DieScum you $LUT, MarbleCanyon") == [["now", "fuck", "you", "or", "die", "scum", "you", "slut", NAME, "marble", "canyon"]]


def test_words_of_the_labels_become_known():
    net = fit([("you are a total blorf today", "abuse")] * 8 + [(t, "none") for t in CLEAN * 3], epochs=1)
    assert "blorf" in net.known and Scorer(net).reader.sentences("what a BLORF he is") == [["what", "a", "blorf", "he", "is"]]
