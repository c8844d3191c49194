"""Language identification by bit-sliced Bloom filters of byte n-grams.

One filter holds the n-grams of all languages: each of its rows has a bit for each
language, and an n-gram's rows are ANDed, which gives the languages that contain it
in one look-up. A text's hits are counted for each language and corrected for the
filter's false positives; the language with most hits left wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwarden.llm.textkernel import LOWER, NOT_ALNUM, chunks, row_sums

#: Bytes of an n-gram, rows of the filter as a power of 2, hash functions.
GRAM, ROW_BITS, HASHES = 5, 18, 3
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_DIGIT = np.array([48 <= i < 58 for i in range(256)])


def crc_fold(id_col: str):
    """crc32 of the id's text, modulo 4; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased n-grams of each row and the index of each row's first.

    What is no letter becomes a space; each text stands between spaces; n-grams
    start at a letter or at the space before one.
    """
    plain = LOWER[buf]
    plain[NOT_ALNUM[buf] | _DIGIT[buf]] = 32
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(buf) + GRAM * n + GRAM, 32, np.uint8)
    padded[np.arange(len(buf)) + GRAM * row + 1] = plain
    size = len(padded) - GRAM
    keys = np.zeros(size, np.uint64)
    for k in range(GRAM):
        keys |= padded[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    real = (padded[:size] != 32) | (padded[1 : size + 1] != 32)
    # a gram whose second byte belongs to the next row begins with this row's padding
    at = np.flatnonzero(real)
    return keys[at], np.searchsorted(at, offsets + GRAM * np.arange(n + 1))


def slots(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys * np.uint64(f)) >> np.uint64(64 - ROW_BITS)).astype(np.int64) for f in _FACTORS[:HASHES]]


@dataclass
class LanguageFilter:
    """``rows``: for each group of up to 64 languages, the filter's rows."""

    langs: list[str]
    rows: list[np.ndarray]
    wrong: np.ndarray
    prior: int

    @staticmethod
    def of(by_lang: dict[str, np.ndarray], prior: str) -> LanguageFilter:
        langs, rows, wrong = sorted(by_lang), [], []
        for lo in range(0, len(langs), 64):
            group = langs[lo : lo + 64]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= len(group))
            table = np.zeros(1 << ROW_BITS, kind)
            for k, lang in enumerate(group):
                for at in slots(by_lang[lang]):
                    table[at] |= kind(1 << k)
                wrong.append(float(((table >> kind(k)) & kind(1)).mean()) ** HASHES)
            rows.append(table)
        return LanguageFilter(langs, rows, np.array(wrong), langs.index(prior))

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each group of languages, the bits of those that contain each n-gram."""
        at = slots(keys)
        out = []
        for table in self.rows:
            m = table[at[0]]
            for a in at[1:]:
                m &= table[a]
            out.append(m)
        return out

    def predict(self, keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's language, and its share of all corrected hits."""
        n = np.diff(bounds).astype(float)
        hits = np.empty((len(n), len(self.langs)))
        k = 0
        for m in self.masks(keys):
            for bit in range(min(64, len(self.langs) - k)):
                hits[:, k] = row_sums(((m >> m.dtype.type(bit)) & m.dtype.type(1)).astype(np.int32), bounds)
                k += 1
        real = np.maximum(0, (hits - n[:, None] * self.wrong) / (1 - self.wrong))
        total, best = real.sum(1), real.argmax(1)
        best[total == 0] = self.prior
        score = np.divide(real[np.arange(len(n)), best], total, out=np.full(len(n), 1 / len(self.langs)), where=total > 0)
        return best, np.clip(score, 0, 1)


def fit_language_filter(rows: DataFrame, docs_per_lang: int = 800, grams_per_lang: int = 20_000, least_count: int = 3, typical: float = 0.2) -> LanguageFilter | None:
    """Learns from columns id, text and lang of ``rows`` (none null).

    At most about ``docs_per_lang`` rows of each language, picked by a hash of the id,
    are read. Of a language's n-grams those stay that occur ``least_count`` times, at
    least ``typical`` times as often as in the language where they are most frequent;
    the ``grams_per_lang`` most frequent of them enter the filter.
    """
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, docs_per_lang / v))])
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                for _, _, buf, offsets in chunks(b.column(1).filter(pa.array(langs == lang))):
                    keys, n = np.unique(grams(buf, offsets)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.filter(F.col("n") >= least_count).toArrow()
    lang, gram, n = np.array(got.column(0).to_pylist(), object), got.column(1).to_numpy().astype(np.uint64), got.column(2).to_numpy().astype(float)
    by_lang, most = {}, {}
    rate = np.zeros(len(n))
    for x in sizes:
        rate[lang == x] = n[lang == x] / max(1.0, n[lang == x].sum())
    every, where = np.unique(gram, return_inverse=True)
    most = np.zeros(len(every))
    np.maximum.at(most, where, rate)
    for x in sizes:
        own = np.flatnonzero((lang == x) & (rate >= typical * most[where]))
        by_lang[x] = gram[own[np.lexsort((gram[own], -rate[own]))[:grams_per_lang]]]
    return LanguageFilter.of(by_lang, min(sizes, key=lambda x: (-sizes[x], x)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 800) -> DataFrame:
    """``id``, held_out, lang_pred and score of each row.

    The filter learns from rows with an id, a text and a language whose id's crc32
    modulo 4 is not 2; held_out is true where that remainder is 2 (false for a null
    id). A row whose text is null or has no letter gets ``und`` and 0; so does every
    row when nothing could be learned. A text with letters but without any hit gets
    the most frequent language. Ties go to the first language in code point order.
    Repeated rows are each predicted; other columns are not read. No shuffle of texts.
    """
    fold = crc_fold(id_col)
    learn = docs.filter((fold != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = fit_language_filter(learn.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), docs_per_lang)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*model.langs, "und"], object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, best, score = b.column(2), np.empty(b.num_rows, np.int64), np.empty(b.num_rows)
            for lo, hi, buf, offsets in chunks(column):
                keys, bounds = grams(buf, offsets)
                best[lo:hi], score[lo:hi] = model.predict(keys, bounds)
                ascii_letters = row_sums(_LETTER[buf].astype(np.int32), offsets)
                for k in np.flatnonzero(ascii_letters == 0):
                    if not any(map(str.isalpha, column[lo + int(k)].as_py())):
                        best[lo + k], score[lo + k] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best], pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    out = rows.mapInArrow(predict, f"id {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


_LETTER = ~NOT_ALNUM & ~_DIGIT & (np.arange(256) < 128)
