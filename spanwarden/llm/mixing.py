"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot k has the point frac((k + 1) * golden ratio),
which the cumulative weights map to a source, so every stretch of the sequence has
each source in near its share. A source's documents, shuffled by a hash, are cut into
blocks of equal words, smaller ones in a rare source, which has more slots for its words;
the r-th slot of a source takes its block r modulo the number of its blocks, so a source
repeats only once all of it was taken.

Running sums and ranks are taken in two levels: within small pieces of a source, and
over the pieces' totals. A source that holds a third of all rows is many pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwarden.session import stored

#: frac(golden ratio) as a 64-bit fixed-point fraction is this over 2**64; slots use its top 53 bits.
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: dict, pattern=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes by weight, none above ``cap`` times its size.

    Sources in code point order, None last, weigh ``pattern``, repeating. What is cut off
    at the cap goes to the others by weight until none is above.
    """
    names = sorted((x for x in sizes if x is not None), key=lambda x: [ord(c) for c in x]) + [x for x in sizes if x is None]
    weight = {x: pattern[k % len(pattern)] for k, x in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        unit = left / sum(weight[x] for x in free)
        over = [x for x in free if weight[x] * unit > cap * sizes[x]]
        if not over:
            out |= {x: weight[x] * unit for x in free}
            break
        for x in over:
            out[x] = cap * sizes[x]
            left -= out[x]
        free = [x for x in free if x not in out]
    return {x: float(out[x]) for x in names}


def before(df: DataFrame, group: str, piece: str, order: list, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of ``group`` before each row.

    Rows are ordered by ``piece``, then ``order``. Each piece is summed by itself; the
    totals of pieces, which are few, are summed over their group and joined.
    """
    totals = df.groupBy(group, piece).agg(F.sum(value).alias("_own"))
    over = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("_group"), F.col(piece).alias("_piece"), F.coalesce(F.sum("_own").over(over), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy(group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = summed.join(totals, (F.col(group) == F.col("_group")) & (F.col(piece) == F.col("_piece")))
    return joined.withColumn(name, (F.col("_earlier") + F.col("_within")).cast("long")).drop("_group", "_piece", "_earlier", "_within")


def schedule(spark: SparkSession, quotas: list[int], piece_slots: int = 4096) -> DataFrame:
    """slot, source (index of ``quotas``) and rank: slots until each source has its quota.

    A source's slots past its quota are left out, so ranks of source s are 0 to
    quotas[s] - 1.
    """
    total = sum(quotas)
    # golden points in an interval of share w number n * w to within O(log n), so the rarest source needs most
    n = total + total * (4 + math.log(total + 1)) / min((q for q in quotas if q), default=1)
    n = int(n * (1 + 1e-9)) + 1
    edges, at = [], 0
    for q in quotas:
        at += q
        edges.append(at / max(total, 1))
    # (k + 1) * golden modulo 1: products of 26-bit halves keep k up to 2**52 exact enough for the order
    k = F.col("id") + 1
    point = (F.pmod(k * F.lit(int(GOLDEN * (1 << 31))), F.lit(1 << 31)) / F.lit(float(1 << 31)) + k * F.lit(GOLDEN - int(GOLDEN * (1 << 31)) / (1 << 31))) % 1.0
    source = None
    for s, edge in enumerate(edges[:-1]):
        source = (F if source is None else source).when(F.col("point") < F.lit(edge), F.lit(s))
    source = F.lit(len(quotas) - 1) if source is None else source.otherwise(F.lit(len(quotas) - 1))
    slots = spark.range(n).select("id", point.alias("point")).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / piece_slots).alias("piece"), F.lit(1).alias("one"))
    ranked = before(slots, "source", "piece", ["slot"], "one", "rank")
    quota = F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("source") + 1)
    return ranked.filter(F.col("rank") < quota).select("slot", "source", "rank")


def mix(docs: DataFrame, pattern=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int | None = None, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """``id``, size, source_size, target, taken, times and first_slot of each row.

    times is how often the mix takes the document and taken the words of that; first_slot
    is its block's first place in the sequence (null if it is not taken). A document
    belongs to the block that holds its middle word. Blocks have about ``block_words``
    words (by default a 100 000th of the mix, a million at most), and at most a hundredth
    of their own source's target, whatever the size of the others.

    A null text has size 0 and takes 0; a null source is a source of its own, the last.
    Repeated rows are mixed as documents of their own; reruns agree. Sources must be few
    enough to list on the driver. Other columns are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    size = word_count(text) if size is None else size
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.lit(53)).alias("shuffled"), F.xxhash64(text).alias("tie")), "mix-sizes")
    stats = {r["source"]: (r["words"], r["rows"]) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()}
    if not stats:
        return spark.createDataFrame([], f"{id_col} {sized.schema[0].dataType.simpleString()}, size long, source_size long, target double, taken long, times long, first_slot long")
    goal = targets({x: w for x, (w, _) in stats.items()}, pattern, share, cap)
    names, whole = list(goal), sum(goal.values())
    most = block_words or max(1, min(1_000_000, int(whole / 100_000)))
    words = [max(1, min(most, int(goal[x] / 100))) for x in names]
    blocks = [max(1, -(-stats[x][0] // w)) for x, w in zip(names, words)]
    quotas = [min(round(goal[x] / w), int(cap * n)) for x, w, n in zip(names, words, blocks)]
    number = F.lit(names.index(None) if None in names else -1)
    listed = [x for x in names if x is not None]
    if listed:
        number = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for x in listed for y in (x, names.index(x))]), F.coalesce("source", F.lit("\0"))), number)
        number = F.when(F.col("source").isNull(), F.lit(names.index(None) if None in names else -1)).otherwise(number)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("number") + 1)
    # pieces of a source hold some thousand rows each
    pieces = [max(1, -(-stats[x][1] // 4096)) for x in names]
    placed = sized.withColumn("number", number)
    placed = placed.withColumn("piece", F.floor((F.shiftrightunsigned("shuffled", 1) / F.lit(float(1 << 63))) * of(pieces, "double")).cast("long"))
    placed = placed.withColumn("spot", F.struct("number", "piece"))
    run = before(placed, "number", "piece", ["shuffled", "id", "tie"], "size", "start")
    middle = F.col("start") + F.floor(F.col("size") / 2)
    run = run.withColumn("block", F.least(F.floor(middle / of(words, "long")), of(blocks, "long") - 1).cast("long"))
    slots = schedule(spark, quotas)
    block_count = F.element_at(F.array(*[F.lit(b).cast("long") for b in blocks]), F.col("source") + 1)
    taken = slots.groupBy(F.col("source").alias("_source"), (F.col("rank") % block_count).alias("_block")).agg(F.count("*").alias("n"), F.min("slot").alias("first_slot"))
    joined = run.join(taken, (F.col("number") == F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    times = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias(id_col),
        "size",
        of([stats[x][0] for x in names], "long").alias("source_size"),
        of([goal[x] for x in names], "double").alias("target"),
        (times * F.col("size")).alias("taken"),
        times.alias("times"),
        F.col("first_slot"),
    )
