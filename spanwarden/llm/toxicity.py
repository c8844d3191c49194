"""Toxicity by class-conditional Kneser-Ney models of words.

A bigram model of toxic texts and one of ordinary texts score each text. The mean over
its words of the difference of their log-likelihoods, the largest difference of a word
and of a window of words (a long text is toxic by a few words, which a mean over
thousands hides) and the length go through a logistic curve. Both models interpolate down to one distribution of words
counted over both classes together, so an expression that a class has rarely or never
shown counts about the same under both. The curve is fitted on ratios of texts under
models that have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.language_id import crc_fold
from spanwarden.llm.textkernel import LOWER, NOT_ALNUM, chunks, row_sums, word_hashes, words
from spanwarden.llm.workers import tidy
from spanwarden.session import stored

DISCOUNT = 0.75
#: Words of a window.
WINDOW = 16
#: Parts of the sample; the curve sees each part through models of the others.
FOLDS = 3


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, bounds = words(low, offsets, NOT_ALNUM)
    return word_hashes(low, starts, ends), bounds


@dataclass
class KneserNeyPair:
    """``vocab``: hashes of known words, ascending; word ids are places in it plus 1, and 0 is any other word.

    ``alone``: for each id, log P(w | toxic) - log P(w | ordinary) in the lower order;
    ``pairs``: keys of bigrams with an estimate of their own, and ``together`` the
    difference for each.
    """

    vocab: np.ndarray
    alone: np.ndarray
    pairs: np.ndarray
    together: np.ndarray
    curve: np.ndarray | None = None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)

    def ratios(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each row the mean over its words of the difference of the log-likelihoods, the largest of them and the largest mean of ``WINDOW`` words (0 at least), and the logarithm of its length; 0 without words."""
        ids, n = self.ids(hashes), np.diff(bounds)
        before = np.zeros(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[bounds[:-1][n > 0]] = 0
        value = self.alone[ids]
        if len(self.pairs):
            key = before * len(self.alone) + ids
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            value = np.where(self.pairs[at] == key, self.together[at], value)
        top = np.zeros((2, len(n)))
        if len(value):
            total = np.concatenate([[0.0], np.cumsum(value)])
            end = np.minimum(np.arange(len(value)) + WINDOW, np.repeat(bounds[1:], n))
            for k, x in enumerate((value, (total[end] - total[:-1]) / WINDOW)):
                top[k, n > 0] = np.maximum.reduceat(x, bounds[:-1][n > 0])
        return np.stack([row_sums(value, bounds) / np.maximum(n, 1), *np.maximum(top, 0), np.log1p(n)], 1)

    def score(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(ratios @ self.curve[:-1] + self.curve[-1], -30, 30)))


def apart(toxic: np.ndarray, both: np.ndarray, share: float) -> np.ndarray:
    """Standard deviations by which the toxic class's part of each count is off its share."""
    expected = both * share
    return np.abs(toxic - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))


def fit_pair(vocab: np.ndarray, specific: np.ndarray, prev: np.ndarray, word: np.ndarray, toxic: np.ndarray, n: np.ndarray, least: int = 5, deviations: float = 4.0) -> KneserNeyPair:
    """From counts of bigrams of ids (0: start, or a word outside the vocabulary) in each class.

    ``specific``: for each id, whether the classes use the word at different rates beyond
    chance. A word or bigram without such evidence has the shared estimate under both
    classes, so it weighs nothing; others get each class's Kneser-Ney estimate. Bigrams
    seen less than ``least`` times in both classes together give continuation counts and
    back off.
    """
    size = len(vocab) + 1
    kinds = np.bincount(word, minlength=size).astype(float)  # histories of each word, over both classes
    shared = (np.maximum(kinds - DISCOUNT, 0) + DISCOUNT * (kinds > 0).sum() / size) / max(kinds.sum(), 1)
    every, where = np.unique(prev * size + word, return_inverse=True)
    seen = np.stack([np.bincount(where, weights=n * (toxic == c), minlength=len(every)) for c in (1, 0)])
    both = seen.sum(0)
    kept = (both >= least) & (every % size > 0) & (apart(seen[0], both, seen[0].sum() / max(both.sum(), 1)) >= deviations)
    pairs, seen = every[kept], seen[:, kept]
    first, low, high = pairs // size, [], []
    for c in (1, 0):
        own = toxic == c
        counts = np.bincount(word[own], minlength=size).astype(float)
        lower = np.maximum(counts - DISCOUNT, 0) / max(counts.sum(), 1)
        lower += (1 - lower.sum()) * shared
        history = np.bincount(prev[own], weights=n[own], minlength=size)
        weight = np.where(history > 0, DISCOUNT * np.bincount(prev[own], minlength=size) / np.maximum(history, 1), 1.0)
        low.append(lower)
        high.append(np.maximum(seen[1 - c] - DISCOUNT, 0) / np.maximum(history[first], 1) + weight[first] * lower[pairs % size])
    return KneserNeyPair(vocab, np.where(specific, np.log(low[0] / low[1]), 0.0), pairs, np.log(high[0] / high[1]))


def fit_curve(ratios: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and shift of a weighted logistic regression with a small ridge, by Newton steps."""
    middle, scale = ratios.mean(0), ratios.std(0)
    scale[scale < 1e-9] = 1.0  # what rounding leaves of a constant
    x = np.column_stack([(ratios - middle) / scale, np.ones(len(ratios))])
    beta = np.zeros(x.shape[1])
    ridge = np.array([1e-2] * ratios.shape[1] + [1e-4])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - ridge * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    slopes = beta[:-1] / scale
    return np.append(slopes, beta[-1] - slopes @ middle)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]] | None:
    """Texts of a hashed sample of labelled ids outside the held-out fold, stored; and each class's weight.

    At most about ``per_class`` ids of either class; an id or text labelled both ways
    counts as toxic, and equal texts as one.
    """
    one = labels.filter(F.col("toxic").isin(0, 1) & (crc_fold(id_col) != 2)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_class / v))])
    picked = one.filter(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < share[F.col("toxic")] * (1 << 20))
    # bounded by per_class, so every executor can hold it and no text is shuffled
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = stored(sample.select("toxic", "text", F.pmod(F.xxhash64("text", F.lit(31)), F.lit(FOLDS)).cast("int").alias("fold")), "toxicity-sample")
    return sample, {k: max(1.0, v / per_class) for k, v in sizes.items()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000, least_docs: int = 5, most_words: int = 100_000, deviations: float = 4.0) -> KneserNeyPair | None:
    """Fits both models on the sample, and the curve on ratios under models of its other parts; None without both classes.

    The vocabulary has words of at least ``least_docs`` sampled texts, ``most_words`` of
    them at most, by number of texts. A sample too small to have both classes outside
    each part is judged by its own models.
    """
    found = labelled_sample(docs, labels, per_class, id_col, text_col)
    if found is None:
        return None
    sample, weights = found
    kinds = {(r["fold"], r["toxic"]) for r in sample.select("fold", "toxic").distinct().collect()}
    if {x for _, x in kinds} != {0, 1}:
        return None

    def word_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(0).to_numpy() + 2 * b.column(1).to_numpy().astype(np.int64)
            for lo, hi, buf, offsets in chunks(b.column(2)):
                hashes, bounds = hashed_words(buf, offsets)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                order = np.lexsort((row, hashes))
                h, r = hashes[order], row[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                keys, at = np.unique(h[first], return_inverse=True)
                counts = np.bincount(at * 2 * FOLDS + part[lo:hi][r[first]], minlength=len(keys) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x.copy()) for x in counts.T)], ["word", *parts])

    parts = [f"n{i}" for i in range(2 * FOLDS)]
    worded = sample.select("toxic", "fold", "text").mapInArrow(tidy(word_docs), "word long, " + ", ".join(f"{x} long" for x in parts))
    frequent = worded.groupBy("word").agg(*(F.sum(x).alias(x) for x in parts)).withColumn("n", sum(map(F.col, parts))).filter(F.col("n") >= least_docs)
    got = frequent.orderBy(F.desc("n"), "word").limit(most_words).toArrow()
    vocab, texts = got.column(0).to_numpy().view(np.uint64), np.stack([got.column(x).to_numpy() for x in parts], 1)
    order = np.argsort(vocab)
    vocab, texts = vocab[order], texts[order].reshape(-1, FOLDS, 2)
    sizes = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect():
        sizes[r["fold"], r["toxic"]] = r["n"]
    lookup = KneserNeyPair(vocab, np.zeros(1), np.empty(0, np.int64), np.empty(0))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocab) + 1
        for b in batches:
            part = b.column(0).to_numpy() + 2 * b.column(1).to_numpy().astype(np.int64)
            for lo, hi, buf, offsets in chunks(b.column(2)):
                hashes, bounds = hashed_words(buf, offsets)
                ids, n = lookup.ids(hashes), np.diff(bounds)
                before = np.zeros(len(ids), np.int64)
                before[1:] = ids[:-1]
                before[bounds[:-1][n > 0]] = 0
                keys, counts = np.unique((before * size + ids) * (2 * FOLDS) + np.repeat(part[lo:hi], n), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts, pa.int64())], ["key", "n"])

    counted = sample.select("toxic", "fold", "text").mapInArrow(tidy(bigrams), "key long, n long").groupBy("key")
    got = counted.agg(F.sum("n").cast("int").alias("n")).toArrow()
    key, n = got.column(0).to_numpy(), got.column(1).to_numpy().astype(float)
    order = np.argsort(key)
    key, n, size = key[order], n[order], len(vocab) + 1
    word, fold, toxic = key // (2 * FOLDS), key % (2 * FOLDS) // 2, key % 2

    def fitted(without: int | None) -> KneserNeyPair:
        use = fold != without if without is not None else np.ones(len(key), bool)
        taken = np.arange(FOLDS) != (FOLDS if without is None else without)
        mine, total = texts[:, taken, 1].sum(1), sizes[taken].sum(0)
        specific = apart(mine, texts[:, taken].sum((1, 2)).astype(float), total[1] / max(1, total.sum())) >= deviations
        # the folds of a bigram in a class are added up
        grams, where = np.unique(word[use] * 2 + toxic[use], return_inverse=True)
        return fit_pair(vocab, np.concatenate([[False], specific]), grams // 2 // size, grams // 2 % size, grams % 2, np.bincount(where, weights=n[use], minlength=len(grams)), deviations=deviations)

    model = fitted(None)
    crossed = all({x for k, x in kinds if k != f} == {0, 1} for f in range(FOLDS))
    models = [fitted(f) if crossed else model for f in range(FOLDS)]

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(1).to_numpy()
            for lo, hi, buf, offsets in chunks(b.column(2)):
                hashed = hashed_words(buf, offsets)
                own = np.stack([m.ratios(*hashed) for m in models])[part[lo:hi], np.arange(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *map(pa.array, own.T.copy())], ["toxic", "mean", "word", "window", "length"])

    got = sample.select("toxic", "fold", "text").mapInArrow(tidy(ratios), "toxic int, mean double, word double, window double, length double").toArrow()
    toxic, *seen = (c.to_numpy().astype(float) for c in got.columns)
    order = np.lexsort((toxic, *seen))
    toxic, seen = toxic[order], np.stack(seen, 1)[order]
    model.curve = fit_curve(seen, toxic, np.where(toxic == 1, weights[1], weights[0]))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000) -> DataFrame:
    """``id``, held_out, score and predicted (1 if score >= ``threshold``) of each row.

    Labels are learned from rows whose id's crc32 modulo 4 is not 2; held_out is true
    where it is 2 (false for a null id). Null and empty texts have no words and get the
    score of a text that speaks for neither class. Without labels of both classes every
    score is 0. Repeated rows are each scored; other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, per_class)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(crc_fold(id_col) == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for lo, hi, buf, offsets in chunks(b.column(2)):
                out[lo:hi] = model.score(model.ratios(*hashed_words(buf, offsets)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["id", "held_out", "score"])

    scored = rows.mapInArrow(tidy(score), f"id {rows.schema[0].dataType.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``; all rows if nothing could be learned."""
    model = fit_toxicity(docs, labels, id_col, text_col, per_class)
    if model is None:
        return docs
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for lo, hi, buf, offsets in chunks(b.column(place)):
                out[lo:hi] = model.score(model.ratios(*hashed_words(buf, offsets)))
            yield b.filter(pa.array(out < threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)
