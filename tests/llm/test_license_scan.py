import math
import random
import re

from spanwarden.llm import license_scan as ls


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w, hits = words(text), []
    for phrase, label in ls.BASE_PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def brute_blocks(text, threshold):
    w, step = words(text), max(len(ls.template_tokens(t)) for _, t in ls.TEMPLATES)
    out = set()
    for b in range(0, math.ceil(len(w) / step)):
        own = set(w[b * step : (b + 2) * step])
        for k, (label, t) in enumerate(ls.TEMPLATES):
            t = set(ls.template_tokens(t))
            if len(own & t) >= math.ceil(threshold * len(t) - 1e-9):
                out.add((b, label, k, len(own & t) / len(t)))
    return out


def corpus():
    rng = random.Random(3)
    common = ["the", "of", "to", "this", "license", "under", "é", "x1", "copy", "software", "and", "or"]
    out = [None, "", "All Rights\nReserved. all rights reserved", "CC-BY cc by cc", "cc", "by", "general  public.license", "reserved all rights"]
    for k in range(60):
        label, t = ls.TEMPLATES[k % len(ls.TEMPLATES)]
        parts = t.split()
        if k % 3 == 1:
            parts.pop(rng.randrange(len(parts)))
        if k % 3 == 2:
            parts = parts[: len(parts) // 2]
        out.append(" ".join(rng.choices(common, k=rng.randrange(120)) + parts + rng.choices(common, k=rng.randrange(120))))
    return out + [out[-1]]


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(None if i == 9 else i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    for threshold in (0.9, 0.6):
        got = {r["doc_id"]: r for r in ls.license_scan(docs, threshold=threshold).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            r, base, blocks = got[None if i == 9 else i], brute_base(t), brute_blocks(t, threshold)
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base
            assert r["labels"] == ",".join(sorted({x for x in base[4].split(",") if x} | {b[1] for b in blocks}))
            assert r["score"] == (1.0 if base[1] else max((b[3] for b in blocks), default=0.0))


def test_blocks_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "key long, text string").select("key", ls.words_of("text").alias("words"))
    got = {(r["key"], r["block"], r["label"], r["template"], r["containment"]) for r in ls.similar_blocks(df, threshold=0.7).collect()}
    assert got == {(i, *b) for i, t in enumerate(texts) for b in brute_blocks(t, 0.7)}


def test_empty(spark):
    assert ls.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_template_that_repeats_words(spark):
    template = " ".join(f"{w} again" for w in "abcdefghijklmnopqrst")
    docs = spark.createDataFrame([(k, " ".join(["x"] * k + [template] + ["y"] * 50)) for k in range(45)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in ls.license_scan(docs, templates=(("long", template),), threshold=1.0).collect()}
    assert got == {k: ("long", 1.0) for k in range(45)}
