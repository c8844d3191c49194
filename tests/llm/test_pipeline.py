import os

import pytest

import corpus_pipeline as cp
from spanwarden.llm.decontamination import contaminated
from spanwarden.llm.mixing import mix
from spanwarden.llm.toxicity import toxicity
from spanwarden.session import stored, table
from tests.llm.test_decontamination import runs
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, outs = docs.columns, [docs]
    for name, stage in cp.STAGES:
        outs.append(stored(stage(spark, outs[-1], SF), f"test-{name}"))
    assert [o.columns for o in outs[1:-1]] == [columns] * 4
    ids = [sorted(r["doc_id"] for r in o.select("doc_id").collect()) for o in outs]
    flagged = {r["doc_id"] for r in toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert ids[1] == [i for i in ids[0] if i not in flagged]
    rows = [(r["doc_id"], r["text"]) for r in outs[1].collect()]
    assert ids[2] == sorted(r[0] for r in brute(rows, 5) if r[3])
    items = [s for s in (runs(r["text"]) for r in table(spark, SF, "benchmark").collect()) if s]
    left = [r["doc_id"] for r in outs[2].collect() if all(len(s & runs(r["text"])) / len(s) < 0.8 for s in items)]
    assert ids[3] == sorted(left) and len(left) < len(ids[2])
    times = {r["doc_id"]: r["times"] for r in mix(outs[3]).collect()}
    assert ids[4] == sorted(i for i, n in times.items() for _ in range(n))
    assert ids[5] == ids[4]


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, "a b c d e f g h", None, "s", 1, "k"), (1, "a b c d e f g h", None, "s", 1, "k"), (2, "a b c d e f g h", "en", None, None, None), (None, None, None, None, None, None), (3, "", "en", "s", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "q r s t u v w"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
    assert {r["doc_id"] for r in docs.collect()} <= {1, 2, 3}
    empty = spark.createDataFrame([], schema)
    for name, stage in cp.STAGES:
        empty = stored(stage(spark, empty, str(tmp_path)), f"odd-{name}")
    assert empty.count() == 0


def test_rows_without_an_id(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = lambda name: " ".join(f"{name}{j}" for j in range(60))
    a, b, c, p = map(made, "abcp")
    rows = [(1, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "fr", "s", 1), (None, f"{b} more", "en", "s", 1), (None, c, "en", "s", 1), (None, f"{c} {p}", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(0, p)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: sorted((r["doc_id"] or 0, "b" if (r["text"] or "").startswith(b) else r["text"] or "") for r in df.collect())
    one = stored(cp.near_dedup_stage(spark, docs, str(tmp_path)), "test-near")
    assert one.columns == docs.columns
    assert texts(one) == sorted([(1, a), (0, "b"), (0, c), (0, f"{c} {p}"), (0, ""), (0, "")])
    two = stored(cp.decontamination_stage(spark, one, str(tmp_path)), "test-clean")
    assert texts(two) == sorted([(1, a), (0, "b"), (0, c), (0, ""), (0, "")])
    three = stored(cp.mixing_stage(spark, two, str(tmp_path)), "test-mix")
    assert three.columns == docs.columns and set(texts(three)) == {(1, a), (0, "b"), (0, c)} and 4 <= three.count() <= 5
    assert cp.token_output_stage(spark, three, str(tmp_path)).count() == three.count()


def test_stages_give_memory_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "q r s t u v w")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    for name, stage in cp.STAGES:
        before = whole.getCollectionCount()
        stage(spark, docs, str(tmp_path))
        assert whole.getCollectionCount() > before, name
