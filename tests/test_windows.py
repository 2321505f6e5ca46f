"""Windows against a search of all runs, and cases of cuts and marks."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import windows as W

WORDS = "the spot Black was given to Whom? sea, land 3.5 7-8 snake_case Ünï 12,000".split()


def all_runs(text, query, width):
    wanted = {t.word for t in W.tokens(query)}
    hits = [t for t in W.tokens(text) if t.word in wanted]
    best = None
    for i in range(len(hits)):
        runs = [j for j in range(i, len(hits)) if hits[j].end - hits[i].start <= width]
        if runs:
            j = runs[-1]
            counts = Counter(h.word for h in hits[i : j + 1])
            key = (len(counts), sorted(counts.values()), -(hits[j].end - hits[i].start), -i)
            best = max(best, (key, (hits[i].start, hits[j].end))) if best else (key, (hits[i].start, hits[j].end))
    return best and best[1]


def test_densest_is_the_best_of_all_runs():
    rng = random.Random(0)
    for _ in range(800):
        text = " ".join(rng.choice(WORDS + ["filler"] * 6) for _ in range(rng.randint(0, 60)))
        query = " ".join(rng.sample(WORDS, rng.randint(0, 4)))
        width = rng.choice([3, 12, 40, 120])
        assert W.densest(text, query, width) == all_runs(text, query, width)


def test_words_are_normalizes(spark):
    rng = random.Random(4)
    runs = ["".join(rng.choice("aBé1٣ß_.,-–−'’­​ﬁ²½漢%#") for _ in range(rng.randint(1, 8))) for _ in range(600)] + WORDS
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, r string").orderBy("i").select(X.normalize(F.col("r"))).collect()]
    assert [" ".join(W.words(r)) for r in runs] == got


@pytest.mark.parametrize("budget", [150, 400, 1000])
def test_windows_keep_to_the_budget_and_show_what_they_say(budget):
    rng = random.Random(budget)
    for n in range(300):
        text = " ".join(rng.choice(["alpha", "be", "gamma-delta", "ε", "longish" * 3]) for _ in range(rng.randint(1, 400)))
        at = rng.randrange(len(text))
        text = f"{text[:at]} needle pin {text[at:]}"
        if n % 5 == 0:
            text += W._TAIL.format(rng.randint(1, 10**6))
        found = W.around(text, rng.choice(["needle pin", "needle", "absent", ""]), budget)
        assert len(found.text) <= max(budget, len(text) if len(text) <= budget else 0)
        shown = W.without_marks(found.text)
        assert text[found.start : found.end] == shown and found.end - found.start == len(shown)
        if found.start:
            assert text[found.start - 1].isspace() and found.text.startswith(W._HEAD.format(found.start))
        if found.end < found.whole:
            assert found.text.endswith(f"{found.whole - found.end - (0 if found.start else 0)} characters not shown]") or found.start == 0


def test_a_match_deep_in_a_text_is_shown_with_both_marks():
    text = "start " + "filler words here " * 900 + "the black spot was given " + "more of it " * 400
    found = W.around(text, "black spot", 600)
    assert "black spot was given" in found.text and found.text.startswith("[chapter begins earlier: ") and found.text.endswith("not shown]") and 500 < len(found.text) <= 600
    assert W.around(text, "nowhere", 600) == W.around(text, "", 600) and W.around(text, "", 600).start == 0
    assert W.around(text, "more it", 10**6).text == text
    tail = W.around(text + "omega", "omega", 300)
    assert tail.text.endswith("omega") and tail.end == tail.whole and len(tail.text) > 200


def test_a_head_is_the_same_however_long_a_text_was_before_it_was_cut():
    text = "word " * 2000
    cut = W.around(text, "", 5000).text
    assert W.around(cut, "absent", 700) == W.around(text, "absent", 700)._replace(seen=len(W.without_marks(cut)))
    inner = W.around(cut.replace("word", "need", 900).replace("need", "word", 899), "need", 400)
    assert inner.whole == len(text) and "need" in inner.text


def test_a_word_longer_than_the_window():
    found = W.around("x" * 5000, "y", 200)
    assert found.start == 0 and len(found.text) == 200
    assert W.around("a " + "needle" * 900, "needle" * 900, 200).start == 0


def test_runs_do_not_cross_joiners(spark):
    text = f"black{W.JOINER}spot"
    assert {t.part for t in W.tokens(text)} == {0, 1} and text[W.tokens(text)[1].start :] == "spot"
    rows = spark.createDataFrame([("a b " * 300 + "pin " + "c d " * 300, "pin"), (None, "x"), ("abc", None)], "t string, q string")
    got = [r.w for r in rows.select(W.window(rows.t, rows.q, 200).alias("w")).collect()]
    assert "pin" in got[0].text and (got[1].text, got[1].whole) == ("", 0) and got[2].text == "abc"


def test_tokens_of_wanted_words_alone():
    from lectern.operators import windows as W

    assert [t.word for t in W.tokens("The sea, the SEA and a 3.5-mile sea", {"sea", "3.5"})] == ["sea", "sea", "3.5", "sea"]
    assert W.tokens("of the sea", {"sea"}) == [t for t in W.tokens("of the sea") if t.word == "sea"]
