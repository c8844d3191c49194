import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwarden.llm import quality_rules as q

TEXTS = [None, "", "a b", "a b c a b c a b c", "x\n\nx\n x\ny", "  lead\x0b#% |<>&*$ É \U0001f600 ", "w " * 500, "one two three four one two three", "\n".join(["same line here", "other", "same line here"]), "a b\x85c d e\x1cf", "aa bb cc dd " * 3 + "ee"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words double, kept string")
    got = {r[0]: tuple(r[1:6]) for r in q.text_statistics(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_statistics(spark):
    check(spark, TEXTS)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cé", "#", "\n", "\n", "d\x0be"]), max_size=60).map(" ".join), min_size=1, max_size=20))
def test_statistics_property(spark, texts):
    check(spark, texts)


def test_learning_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(q.FEATURES)))
    bad = (x[:, 1] > 0.9) | ((x[:, 4] <= 0.2) & (x[:, 6] > 0.7))
    hold = rng.random(3000) < 0.33
    rules = q.learn_rules(x, bad, hold)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= q.covers(r, x)
    assert (hit == bad).mean() > 0.98 and all(len(r) <= 4 for r in rules)
    assert q.learn_rules(x, np.zeros(3000, bool), hold) == []
    noise = rng.random(3000) < 0.1
    assert sum(q.covers(r, x).sum() for r in q.learn_rules(x, noise, hold)) < 60


def test_query(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 997}" + ("#" if i % 4 == 0 else "") for k in range(60)), "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, None, None), (None, "a b", None), (3, rows[3][1], None)], "doc_id long, text string, rule string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = q.quality_rules(docs, labels).collect()
    assert len(got) == 203
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["kept"] == (r["doc_id"] % 4 != 0) and not r["base_failed"]
        else:
            assert r["base_failed"] and not r["kept"]
    assert q.quality_rules(docs.limit(0), labels).count() == 0
    assert q.quality_rules(docs, labels.limit(0)).filter("kept").count() == 201
