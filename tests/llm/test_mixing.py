import re

import numpy as np
from pyspark.sql import functions as F

from spanwarden.llm import mixing as m


def brute_schedule(quotas, n):
    """The sequence by a plain loop."""
    edges = np.cumsum(quotas) / sum(quotas)
    seen, out = [0] * len(quotas), []
    for k in range(n):
        s = min(int(np.searchsorted(edges, ((k + 1) * m.GOLDEN) % 1, "right")), len(quotas) - 1)
        if seen[s] < quotas[s]:
            out.append((k, s, seen[s]))
        seen[s] += 1
    return out


def test_targets():
    got = m.targets({"b": 100, "a": 100, "B": 100, None: 100})
    assert list(got) == ["B", "a", "b", None] and abs(sum(got.values()) - 600) < 1e-6
    assert got["B"] == 200 and got[None] == 200 and abs(got["a"] - 200 / 3) < 1e-9
    assert m.targets({"a": 0, "b": 10})["a"] == 0
    assert m.targets({"a": 10}) == {"a": 15}


def test_schedule(spark):
    quotas = [700, 0, 41, 2000]
    got = sorted(map(tuple, m.schedule(spark, quotas, piece_slots=64).collect()))
    assert got == brute_schedule(quotas, max(g[0] for g in got) + 1)
    for s, q in enumerate(quotas):
        assert sorted(r for _, x, r in got if x == s) == list(range(q))
    # every stretch holds each source near its share
    seq = [s for _, s, _ in got][:2600]
    for lo in range(0, 2500, 250):
        assert abs(seq[lo : lo + 250].count(3) / 250 - 2000 / 2741) < 0.03


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 300))), ["a", "b", "c", None, "d"][min(4, int(rng.integers(0, 9)))], "x", 1) for i in range(3000)]
    rows += [(5000, None, "a", None, None), (5001, "", "e", None, None), (8000, "x\x0b y\r\n", "b", None, None), (8000, "x\x0b y\r\n", "b", None, None), (None, "one two", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, piece string, size int")
    got = m.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, m.mix(docs.repartition(7)).collect()))
    sizes, source = {}, {}
    for i, t, s, *_ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + n
        source[i] = s
    goal, taken = m.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6
        assert r["taken"] == r["times"] * r["size"] <= 2 * r["size"] and (r["times"] > 0) == (r["first_slot"] is not None)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 300 + 0.01 * goal[s], (s, taken[s], goal[s])
    assert m.mix(docs.limit(0)).count() == 0


def test_running_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 50).alias("p"), "id", (F.col("id") * 7 % 11).alias("v"))
    got = {(r["g"], r["id"]): r["s"] for r in m.before(df, "g", "p", ["id"], "v", "s").collect()}
    assert got == {(i % 3, i): sum(j * 7 % 11 for j in range(i) if j % 3 == i % 3) for i in range(500)}


def test_rare_source_in_a_large_mix(spark):
    rows = [(i, None, "abc"[i % 3], (2_400_000, 1_800_000, 600_000)[i % 3]) for i in range(3000)]
    rows += [(3000 + i, None, "rare", 100) for i in range(4)] + [(3010 + i, None, "tiny", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got, of = {}, {i: s for i, _, s, _ in rows}
    for r in m.mix(docs, size=F.col("n")).collect():
        source = of[r["doc_id"]]
        taken, _ = got.get(source, (0, 0))
        got[source] = taken + r["taken"], r["target"]
    assert got["rare"] == (800, 800) and got["tiny"] == (20, 20)
    for s in "abc":
        assert abs(got[s][0] - got[s][1]) <= 0.01 * got[s][1] + 2_400_000, (s, got[s])


def test_schedule_reaches_a_rare_quota(spark):
    quotas = [100_000, 1, 3, 20]
    got = {r["source"]: r["n"] for r in m.schedule(spark, quotas).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert [got.get(s, 0) for s in range(4)] == quotas
