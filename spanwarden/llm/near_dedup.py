"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch of t bins is filled in rounds: in round i every element of the set falls into
a random bin with the value i + (random fraction), and each bin keeps its smallest
value; from round t on, round i serves bin i - t alone. So every bin is filled whatever
the set's size, and the share of equal bins of two sketches is concentrated about the
sets' Jaccard similarity. Bands of bins give buckets.

No large bucket is expanded into pairs. First each bucket's members are compared with one
of them, the first in an order that all bands share. The links found give components, and only members of a
bucket that are in different components are then compared with each other: in small
buckets as rows, in larger ones in blocks of members, which send on links only. Links are
confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.textkernel import LOWER, chunks, mix, row_sums, word_hashes, words
from spanwarden.llm.workers import small_batches, tidy
from spanwarden.session import stored

#: Bands and bins of a band: at similarity 0.8 a pair shares no band with probability 8e-6; at 0.2, where texts
#: only share a passage, it shares one with probability 2e-4, so a common passage makes few candidates.
BANDS, ROWS = 64, 8
#: Ids up to which a join with texts sends the ids to every executor (16 bytes each).
SENT_IDS = 1_000_000
#: Members of a bucket up to which its pairs become rows, and shingles of a block of a larger one.
PAIRED, BLOCK_SHINGLES = 32, 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's runs of ``k`` words, ascending, and each row's first place.

    A row with fewer words has its whole sequence as one; a row without words none.
    """
    low = LOWER[buf]
    starts, ends, bounds = words(low, offsets)
    h, n = word_hashes(low, starts, ends), np.diff(bounds)
    rows = len(n)
    factor = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(len(h), np.uint64)
    size = max(0, len(h) - k + 1)
    for j in range(k):
        full[:size] = full[:size] * factor + h[j : j + size]
    counts = np.where(n >= k, n - k + 1, 0)
    row = np.repeat(np.arange(rows), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    values = mix(full[at] + np.uint64(k))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            for x in h[bounds[r] : bounds[r + 1]].tolist():
                own[i] = (int(own[i]) * int(factor) + x) & 0xFFFFFFFFFFFFFFFF
        values, row = np.concatenate([values, mix(own + n[short].astype(np.uint64))]), np.concatenate([row, short])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[first], row[first]
    return values, np.searchsorted(row, np.arange(rows + 1))


def sketch(values: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, a row for each set; rows of empty sets stay at the largest number."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = np.diff(bounds)
    table = np.full(len(n) * t, empty)
    row = np.repeat(np.arange(len(n)), n)
    wide = np.uint64(t)
    for i in range(2 * t):
        if not len(row):
            break
        v = mix(values + np.uint64((i + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        # within a round smaller fractions win; earlier rounds win over later ones
        value = (np.uint64(i) << np.uint64(48)) | (v & np.uint64(0xFFFFFFFFFFFF))
        if i < t:
            slot = row * t + (((v >> np.uint64(48)) * wide) >> np.uint64(16)).astype(np.int64)
        else:
            slot = row * t + (i - t)
        free = (table[slot] == empty) | (table[slot] >> np.uint64(48) == np.uint64(i))
        np.minimum.at(table, slot[free], value[free])
        if i < 4 or i % 8 == 0 or i >= t:
            left = (table.reshape(-1, t) == empty).any(1)
            stay = left[row]
            if not stay.all():
                values, row = values[stay], row[stay]
    return table.reshape(-1, t)


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's bins and its number."""
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(table), b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            key = mix(key * _STEP + table[:, j])
        out[:, b] = key
    return out


def set_table(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, n, k1, k2, bands of each row of (id, text): its set's size, a 128-bit digest of it, and its band keys."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in chunks(b.column(1), 1 << 19):
                values, bounds = shingles(buf, offsets, k)
                keys = band_keys(sketch(values, bounds, bands * rows), bands, rows)
                digest = [row_sums(mix(values ^ np.uint64(x)), bounds).view(np.int64) for x in (0x1234567, 0x89ABCDEF)]
                n = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * (hi - lo) + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *map(pa.array, digest), lists], ["id", "n", "k1", "k2", "bands"])

    return docs.mapInArrow(tidy(sketches), "id long, n long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, set (ascending 64-bit hashes) of the rows of (id, text) whose id is in ``nodes`` (node, k1, k2)."""
    ids = nodes.select(F.col("node").alias("id")).distinct()
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in chunks(b.column(1), 1 << 19):
                values, bounds = shingles(buf, offsets, k)
                digest = [row_sums(mix(values ^ np.uint64(x)), bounds).view(np.int64) for x in (0x1234567, 0x89ABCDEF)]
                raw, at = values.tobytes(), (8 * bounds).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, digest), pa.array([raw[a:z] for a, z in zip(at, at[1:])], pa.binary())], ["node", "k1", "k2", "set"])

    found = docs.join(ids, "id", "left_semi").mapInArrow(tidy(sets), "node long, k1 long, k2 long, set binary")
    # an id may come with several texts: each of its sets counts once
    return found.dropDuplicates(["node", "k1", "k2"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= ``percent`` * union, counted on full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                at = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
                shared = int((two[at] == one).sum()) if len(two) else 0
                keep.append(len(one) > 0 and 100 * shared >= percent * (len(one) + len(two) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(tidy(verify), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over ``links`` (a, b), for nodes that have a link.

    Each round takes the smallest component among neighbours, then jumps to the component
    of that component; tables in the shared folder cut the lineage.
    """
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    state = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "near-components")
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        lower = state.join(near, "node").select("node", F.least("comp", "m").alias("new"), "comp")
        jump = state.select(F.col("node").alias("new"), F.col("comp").alias("j"))
        new = stored(lower.join(jump, "new").select("node", F.least("new", "j").alias("comp"), (F.least("new", "j") != F.col("comp")).alias("changed")), "near-components")
        if not new.filter("changed").head(1):
            return new.select("node", "comp")
        state = new.select("node", "comp")


def near_links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """node, comp over the sets of ``reps`` (node, n, k1, k2, bands); None if nothing is linked."""
    close = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    member = reps.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    # the same order in every band, so that a group's buckets mostly agree on the member that leads them
    order = F.xxhash64("node", F.lit(47))
    shared = member.groupBy("bucket").agg(F.min_by("node", order).alias("a"), F.min_by("n", order).alias("an"), F.count("*").alias("m")).filter("m > 1").drop("m")
    # buckets with company are few: they are hashed, and the members streamed past them unsorted
    buckets = stored(member.join(shared.hint("shuffle_hash"), "bucket"), "near-buckets")
    if not buckets.head(1):
        return None
    star = stored(buckets.filter((F.col("a") != F.col("node")) & close(F.col("n"), F.col("an"))).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "near-pairs")
    # every member of a bucket with company may be compared later on
    sets = stored(full_sets(docs, buckets.select("node").distinct(), k), "near-sets")
    links = stored(confirmed(star, sets, percent), "near-links")
    joined = components(links) if links.head(1) else None
    if joined is None:
        placed = buckets.withColumn("comp", F.col("node"))
    else:
        placed = buckets.join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed.select("bucket", "node", "n", "comp", "a"), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("node") == F.col("a"), F.col("comp"))).alias("main"), F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).filter("lo < hi").drop("lo", "hi")
    rest = stored(placed.join(mixed, "bucket"), "near-rest")
    small = rest.filter(F.col("m") <= PAIRED)
    minor = small.filter("comp != main").select("bucket", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("comp").alias("xc"))
    other = small.select("bucket", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("comp").alias("yc"), (F.col("comp") != F.col("main")).alias("ym"), "a")
    met = minor.join(other, (minor["bucket"] == other["bucket"]) & (F.col("xc") != F.col("yc")) & (F.col("y") != F.col("a")) & (~F.col("ym") | (F.col("x") < F.col("y"))) & close(F.col("xn"), F.col("yn")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = stored(confirmed(pairs, sets, percent).unionAll(block_links(rest.filter(F.col("m") > PAIRED), sets, percent)), "near-links")
    if not more.head(1):
        return joined
    return components(links.unionAll(more))


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket (bucket, node, n, comp, main, blocks) that are in different components.

    A bucket's members are dealt over its blocks by a hash; each pair of blocks is one
    group, which counts intersections by an index of its shingles. Pairs that are both in
    the main component are not looked at.
    """
    block = F.pmod(F.xxhash64("node", F.lit(43)), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "comp", (F.col("comp") == F.col("main")).alias("main"), "block")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, comp, main, at = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "main", "block"))
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        n = np.array([len(x) for x in held])
        bounds = np.concatenate([[0], np.cumsum(n)])
        _, word = np.unique(np.concatenate(held), return_inverse=True)
        mark = np.zeros(int(word.max()) + 1 if len(word) else 1, np.int32)
        out = []
        for x in np.flatnonzero(~main):
            own = word[bounds[x] : bounds[x + 1]]
            mark[own] = 1
            both = row_sums(mark[word], bounds)
            mark[own] = 0
            near = (n > 0) & (n[x] > 0) & (100 * both >= percent * (n + n[x] - both)) & (comp != comp[x])
            if one != two:
                near &= at != at[x]
            # members of one component are linked already: one link to it is enough
            _, first = np.unique(comp[near], return_index=True)
            out += [(min(node[x], y), max(node[x], y)) for y in node[near][first].tolist()]
        out = sorted(set((int(a), int(b)) for a, b in out))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return keyed.join(sets.select("node", "set"), "node").groupBy("bucket", "one", "two").applyInArrow(compare, "a long, b long")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, n_shingles, component_id (the smallest id reachable over links) and kept of each row.

    Rows with equal sets are one class, linked without comparison. A null or blank text
    has an empty set and is linked with nothing. Rows that repeat an id are one document
    with several texts, and so are linked. A null id joins its class but never names or
    links one: alone, it has a null component and is kept. kept is true where the id
    names its component. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        every = stored(set_table(texts, k, bands, rows), "near-sketches")
    classes = every.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    reps = stored(classes.filter(F.col("node").isNotNull()), "near-classes")
    with small_batches(docs.sparkSession):
        found = near_links(texts, reps, k, percent)
    # an id with several texts ties its classes together
    ids = every.filter("n > 0 and id is not null").join(reps.select("k1", "k2", "n", "node"), ["k1", "k2", "n"]).select("id", "node")
    ties = stored(ids.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("id", "lo"), "near-ties")
    if ties.head(1):
        same = ids.join(ties, "id").filter("node != lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
        found = components(same if found is None else same.unionAll(found.filter("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))))
    named = reps.select("k1", "k2", "n", "node")
    if found is None:
        named = named.withColumn("comp", F.col("node"))
    else:
        named = named.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    out = every.select("id", "n", "k1", "k2").join(named.select("k1", "k2", "n", "comp"), ["k1", "k2", "n"], "left")
    comp = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, comp.isNull()).alias("kept"))
