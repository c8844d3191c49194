import zlib

import numpy as np
import pyarrow as pa

from spanwarden.llm import language_id as lid
from spanwarden.llm import textkernel as tk
from spanwarden.llm.toxicity import toxicity

TEXTS = ["", "a", "  The cat\x0bsat\n", "é x", " ", "a" * 5000, "cat The", "\x00b c", "one two\ttwo  one\r\n"]


def test_words_match_bytes_split():
    for most in (1, 7, 1 << 20):
        seen = []
        for lo, hi, buf, offsets in tk.chunks(pa.array(TEXTS[:3] + [None] + TEXTS[3:]), most):
            starts, ends, bounds = tk.words(buf, offsets)
            hashes = tk.word_hashes(buf, starts, ends)
            for k in range(hi - lo):
                own = range(bounds[k], bounds[k + 1])
                seen.append([(bytes(buf[starts[i] : ends[i]]), hashes[i]) for i in own])
        want = [(t or "").encode().split() for t in TEXTS[:3] + [None] + TEXTS[3:]]
        assert [[w for w, _ in x] for x in seen] == want
        of = {}
        for x in seen:
            for w, h in x:
                assert of.setdefault(w, h) == h
        assert len(set(of.values())) == len(of)


def test_grams_by_hand():
    texts = ["ab C-d", "", "x1é"]
    _, _, buf, offsets = next(tk.chunks(pa.array(texts)))
    keys, bounds = lid.grams(buf, offsets)
    for k, t in enumerate(texts):
        plain = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in t.lower().encode())
        padded = b" " + plain + b" " * (2 * lid.GRAM)
        want = [padded[i : i + lid.GRAM] for i in range(len(plain) + lid.GRAM) if padded[i] != 32 or padded[i + 1] != 32]
        assert [int(x).to_bytes(8, "little")[: lid.GRAM] for x in keys[bounds[k] : bounds[k + 1]]] == [x for x in want if x.strip()]


def test_filter_holds_every_gram():
    own = {x: np.random.default_rng(i).integers(0, 1 << 40, 5000, dtype=np.uint64) for i, x in enumerate("abc")}
    f = lid.LanguageFilter.of(own, "a")
    for i, x in enumerate("abc"):
        assert (f.masks(own[x])[0] >> i & 1).all()
    best, score = f.predict(np.concatenate([own["b"], own["c"]]), np.array([0, 5000, 10000]))
    assert best.tolist() == [1, 2] and (score > 0.95).all()


def corpus(spark):
    en = "the cat sat on the mat with another thing that was there"
    fr = "le chat était sur la chaise avec une autre chose qui était là"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr", 0.5, "x") for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "12 %%", "fr", None, None), (102, "", None, None, None), (None, "the mat was there", None, None, None), (5, "the cat", None, None, None), (103, "漢字 \U0001f600", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")


def test_language_id(spark):
    rows = lid.language_id(corpus(spark)).collect()
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]) for r in rows}
    assert len(rows) == 66
    for i in range(60):
        assert (i, "en" if i % 2 else "fr", zlib.crc32(str(i).encode()) % 4 == 2) in got
    assert (None, "en", False) in got and (5, "en", zlib.crc32(b"5") % 4 == 2) in got
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (100, 101, 102)} == {("und", 0.0)}
    assert [r["lang_pred"] in ("en", "fr") for r in rows if r["doc_id"] == 103] == [True]
    assert lid.language_id(corpus(spark).limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(plain, 40))
        if i % 5 == 0:
            text[3] = text[20] = "nasty"
        rows.append((i, " ".join(text) + f" own{i}", "x", 1.0))
        if i < 500:
            labels.append((i, int(i % 5 == 0), None))
    rows += [(700, None, None, None), (701, "", None, None), (None, "w1 nasty w2", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    marks = spark.createDataFrame(labels + [(3, None, 1), (None, 1, 1), (7, 0, 0)], "doc_id long, toxic int, text int")
    got = toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in range(600):
        assert by[i]["predicted"] == int(i % 5 == 0) and 0 <= by[i]["score"] <= 1 and by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert by[700]["score"] == by[701]["score"] and by[700]["predicted"] == 0 and by[None]["predicted"] == 1
    assert {r["score"] for r in toxicity(docs, marks.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity(docs.limit(0), marks).count() == 0


def test_toxicity_of_long_texts(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, (30, 300, 3000)[i % 3]))
        if i % 4 == 0:
            at = int(rng.integers(len(text)))
            text[at : at + 1] = ["nasty", "vile"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {(r["doc_id"], r["predicted"]) for r in got} == set(labels)
