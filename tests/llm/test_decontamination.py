import random
import re

from spanwarden.llm.decontamination import contaminated


def runs(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(900)}"
    items = [" ".join(word() for _ in range(rng.choice([3, 5, 6, 9, 15, 30, 59, 140, 400]))) for _ in range(60)]
    items += [None, "", items[5], "a a a a a a a"]
    docs = [None, "", "a b", "a a a a a a a a a"]
    for k in range(160):
        body = [word() for _ in range(rng.choice([0, 30, 900]))]
        if k % 4:
            part = rng.choice(items[:60]).split()
            if k % 4 == 2 and len(part) > 40:
                for _ in range(max(1, len(part) // 60)):
                    part[rng.randrange(len(part))] = "other"
            if k % 4 == 3:
                part = part[: int(len(part) * rng.choice([0.7, 0.85, 0.95]))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() + "," for x in part]
        docs.append(" ".join(body))
    docs.append(docs[-1])
    d = spark.createDataFrame([(None if i == 7 else i, t, 5, "k") for i, t in enumerate(docs)], "doc_id long, text string, n_item int, key string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(map(str, contaminated(d, b).collect()))
    want = []
    for i, t in enumerate(docs):
        own = runs(t)
        for j, x in enumerate(items):
            s = runs(x)
            if s and len(own & s) / len(s) >= 0.8:
                want.append(f"Row(doc_id={None if i == 7 else i}, item_id={j}, n_item={len(s)}, n_shared={len(own & s)}, containment={len(own & s) / len(s)})")
    assert got == sorted(want) and len(want) > 60
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
