"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a sketch of a whole document says nothing
about an item in it. Items are therefore partitioned by their number of shingles, and
for each class of sizes documents are cut into blocks of an eighth of the class's size.
A block that lies inside a copy of an item has the item's shingles only, so its MinHash
(the smallest hash of its shingles) is one of the item's hashes; a copy with four fifths
of an item's shingles holds several such blocks. Minima of larger blocks are minima of
smaller blocks' minima. Candidates are verified by the exact share of the item's
shingles that the whole document holds. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.license_scan import words_of
from spanwarden.session import stored

#: Blocks that a class's largest item has, and shingles of a block at most.
PARTS, LARGEST = 8, 16
#: Rows up to which a table is sent to every executor (some tens of bytes each).
SENT_ROWS = 500_000


def bounded(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows or fewer; ``df`` must be stored."""
    return F.broadcast(df) if df.count() <= most else df


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of runs of ``k`` words of an array column; null with fewer words."""
    run = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), run))


def shingle_texts(words: str, k: int) -> Column:
    run = lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " ")
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - k), run)))


def block_size(n: Column) -> Column:
    """Shingles of a block for items of ``n`` shingles: their size class over PARTS, LARGEST at most."""
    size_class = F.pow(F.lit(2), F.ceil(F.log2(n.cast("double"))))
    return F.greatest(F.lit(1), F.least(F.lit(LARGEST), F.floor(size_class / PARTS))).cast("int")


def level_key(value: Column, level: Column) -> Column:
    """One number for a hash and a block size."""
    return value.bitwiseAND(F.lit(~63)).bitwiseOR(level.cast("long"))


def level_keys(values: str, level: int) -> Column:
    return F.transform(values, lambda x: level_key(x, F.lit(level)))


def block_minima(values: str, size: int) -> Column:
    """The smallest of each ``size`` successive values of an array column."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))
    return F.transform(blocks, lambda i: F.array_min(F.slice(values, i * size + 1, F.lit(size))))


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, containment: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id``, ``item``, n_item, n_shared and containment of each row and item it holds.

    Words are lower-cased runs of letters, digits and non-ASCII characters; a shingle is
    ``k`` of them. n_item counts an item's distinct shingles, n_shared those that the
    document has; a pair is returned from ``containment`` on. Items with fewer than ``k``
    words or a null text are not searched for, nor are such documents searched. Repeated
    rows are reported one by one, as are repeated item ids, by text; null ids appear as
    null. Other columns are not read. Items are broadcast if they have few enough
    shingles, and joined by shuffle otherwise.
    """
    words = lambda df, key: df.select(key, F.xxhash64(F.col(text_col)).alias("key"), words_of(F.col(text_col).cast("string")).alias("words"))
    own = words(items.filter(F.col(text_col).isNotNull()), F.col(item_col).alias("item")).filter(F.size("words") >= k)
    own = stored(own.withColumn("hashes", F.array_distinct(shingle_hashes("words", k))).select("item", F.col("key").alias("item_key"), "hashes", shingle_texts("words", k).alias("shingles")).dropDuplicates(["item", "item_key"]), "benchmark-items")
    level = block_size(F.size("hashes"))
    index = stored(own.select("item", "item_key", level.alias("level"), F.explode("hashes").alias("h")).select("item", "item_key", "level", level_key(F.col("h"), F.col("level")).alias("value")).distinct(), "benchmark-index")
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())
    rows = words(docs.filter(F.col(text_col).isNotNull()), F.col(id_col).alias("id"))
    minima = rows.select("id", "key", shingle_hashes("words", k).alias("m0"))
    last, size = "m0", 1
    for b in levels:
        step = b // size
        if step > 1:
            minima = minima.withColumn(f"m{b}", block_minima(last, step))
            last, size = f"m{b}", b
        minima = minima.withColumn(f"k{b}", level_keys(last, b))
    keys = F.array_distinct(F.concat(*[f"k{b}" for b in levels])) if levels else F.array().cast("array<bigint>")
    # explode_outer: for explode, Spark infers a filter on the array, pushes it down to the text and there
    # repeats the split for every word; rows without a value meet nothing in the join
    probes = minima.select("id", "key", F.explode_outer(keys).alias("value"))
    found = stored(probes.join(bounded(index), "value").select("id", "key", "item", "item_key").distinct(), "benchmark-candidates")
    # candidates' texts: the ids go to every executor if they are few enough
    ids = stored(found.select(F.col("id").alias("c_id"), F.col("key").alias("c_key")).distinct(), "benchmark-documents")
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key"))
    texts = rows.join(bounded(ids), same, "left_semi").select("id", "key", shingle_texts("words", k).alias("held"))
    named = found.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), F.col("item").alias("c_item"), F.col("item_key").alias("c_item_key"))
    pairs = named.join(bounded(own), F.col("c_item").eqNullSafe(F.col("item")) & (F.col("c_item_key") == F.col("item_key")))
    shared = F.size(F.array_intersect("shingles", "held")).cast("long")
    checked = texts.join(pairs, same).select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.size("shingles").cast("long").alias("n_item"), shared.alias("n_shared"))
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= containment)
