import random
import re

import numpy as np
import pyarrow as pa

from spanwarden.llm import near_dedup as nd
from spanwarden.llm.textkernel import chunks


def sets(text, k):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, percent=80):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(s[i] & s[j])
            if s[i] and s[j] and 100 * inter >= percent * (len(s[i]) + len(s[j]) - inter) or rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return sorted((rows[i][0], len(s[i]), low[find(i)], rows[i][0] == low[find(i)]) for i in range(len(rows)))


def corpus(seed, k):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [None, "", " \x0b ", "One", "one", "ONE two", "É x", "é x", "a" * 9000]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(2, 300))]
        texts.append(" ".join(base))
        chain = base
        for _ in range(rng.randrange(6)):
            chain = list(chain)
            for _ in range(rng.randrange(1, max(2, len(chain) // (8 * k)))):
                chain[rng.randrange(len(chain))] = word()
            texts.append("  ".join(chain).upper() if rng.random() < 0.3 else "\n".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(80)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_against_brute_force(spark):
    for k in (2, 5):
        rows = corpus(k, k)
        docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n long, bands string")
        assert sorted(map(tuple, nd.near_dedup(docs, k=k).collect())) == brute(rows, k)


def test_near_copies_of_one_text(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(6):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_dedup(docs, k=2).collect())) == brute(rows, 2)


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "PAIRED", 3)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 1500)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        t = list(base)
        for _ in range(rng.choice([1, 6, 9, 12])):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert sorted(map(tuple, nd.near_dedup(docs, k=2).collect())) == want and 2 < sum(r[3] for r in want) < 190


def test_repeated_and_null_ids(spark):
    rows = [(3, "a b c d e f g"), (3, "p q r s t u v"), (1, "p q r s t u v"), (7, "a b c d e f g"), (9, "z z z")]
    docs = spark.createDataFrame([*rows, (None, "z z z"), (None, "alone here")], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_dedup(docs, k=2).collect()), key=str)
    want = [(i, n, c, k) for i, n, c, k in brute(rows, 2)] + [(None, 1, 9, False), (None, 1, None, True)]
    assert got == sorted([(i, n, c, k if i is not None else k) for i, n, c, k in want], key=str)
    assert nd.near_dedup(docs.limit(0)).count() == 0


def test_sketch_is_filled_and_unbiased():
    rng = np.random.default_rng(1)
    t = 512
    for n in (1, 3, 50, 5000):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        one, two = pool[: n + n // 2], pool[n // 2 :]
        table = nd.sketch(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), t)
        assert (table != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        real = len(set(one.tolist()) & set(two.tolist())) / len(set(pool.tolist()))
        if n >= 50:
            assert abs((table[0] == table[1]).mean() - real) < 0.12
    same = nd.sketch(np.array([5, 9, 9, 5], np.uint64), np.array([0, 2, 4]), t)
    assert (same[0] == same[1]).all()


def test_shingles_match_strings():
    texts = ["a b c a b c d", "A  b", "", "x", "a b c d e f", None]
    for k in (2, 5):
        for _, _, buf, offsets in chunks(pa.array(texts)):
            values, bounds = nd.shingles(buf, offsets, k)
            assert np.diff(bounds).tolist() == [len(sets(t, k)) for t in texts]


def test_bucket_led_by_a_text_of_another_size(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, f"{text} more"), (3, " ".join(f"v{i}" for i in range(300)))], "id long, text string")
    # a bucket whose chosen member is the long text
    key = nd.F.xxhash64("node", "bucket")
    led = spark.range(64).withColumnRenamed("id", "bucket").crossJoin(docs.select(nd.F.col("id").alias("node"))).groupBy("bucket").agg(nd.F.min_by("node", key).alias("a")).filter("a = 3").head()["bucket"]
    reps = nd.stored(nd.set_table(docs, 5, nd.BANDS, nd.ROWS).select(nd.F.col("id").alias("node"), "n", "k1", "k2", nd.F.array(nd.F.lit(led).cast("long")).alias("bands")), "test-reps")
    found = nd.near_links(docs, reps, 5, 80)
    assert found is not None and sorted(map(tuple, found.collect())) == [(1, 1), (2, 1)]
