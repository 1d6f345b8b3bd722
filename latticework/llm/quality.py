"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight vector over hashed words
and text shapes, shared by all grades, and ordered thresholds. Selection is by
the tail probability P(grade >= j) or the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, cut, large, release

#: The fit is on a bounded sample: of the labelled ids those of least hash, at most so many, and in that
#: order at most so many (text, word) entries in all, so that neither long texts nor repeated ids enlarge it.
SAMPLE, SAMPLE_ENTRIES = 8000, 4_000_000
#: Hashed words, and shapes of words after them.
WORDS, SHAPES = 1 << 18, 8
#: A word gets a weight if it is in so many texts of the sample and their mean grade is so many standard
#: errors from the sample's. Held out at sf0.1, 5 errors and 4 texts keep 2.9 % of poor, 8.2 % of toxic and
#: 99.3 % of good texts; 2 errors and 3 texts keep 7.6 %, 7.5 % and 99.7 %.
LEAST_TEXTS, LEAST_ERRORS = 4, 5.0
#: Bounds of the bins of each shape's part of the words and of distinct words.
PARTS, DISTINCT = np.array([1e-9, 0.02, 0.1, 0.3, 0.6]), np.array([0.15, 0.3, 0.5, 0.7])
COLUMNS = SHAPES * (len(PARTS) + 1) + len(DISTINCT) + 1
STEPS, RATE, DECAY = 400, 0.05, 2e-4


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null where quality is null."""
    return F.when(F.coalesce(toxic, F.lit(0)) == 1, F.lit(0)).otherwise(F.when(quality.isNotNull(), F.least(quality, F.lit(1)) + 1))


def shape(word: str) -> int:
    if word.isupper() and len(word) > 1:
        return 1 if word[-1] in "!?" else 2
    if not word[-1].isalnum():
        return 3 if word[-2:-1] == word[-1] else 4
    if any(c.isdigit() for c in word):
        return 5
    return 6 if len(word) > 1 and len(set(word)) == 1 else 0


def word_key(word: str) -> int:
    """Hash of a word without case and without marks around it."""
    return xxhash.xxh3_64_intdigest(word.lower().strip(".,;:!?\"'()[]{}*#-_")) % WORDS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashed words of each text, their number per text, binned parts of its words with each
    shape and of distinct words, one column set per bin)"""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False).astype(bool)]
    coded = flat.filter(full).dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    keys = np.fromiter(map(word_key, distinct), np.int64, len(distinct))
    shapes = np.fromiter(map(shape, distinct), np.int64, len(distinct))
    pairs = np.unique(owner * WORDS + keys[codes])
    number = np.bincount(pairs // WORDS, minlength=len(texts))
    counts = np.bincount(owner * SHAPES + shapes[codes], minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    bins = np.digitize(counts / total, PARTS) + np.arange(SHAPES) * (len(PARTS) + 1)
    variety = np.digitize(number / total[:, 0], DISTINCT) + SHAPES * (len(PARTS) + 1)
    hot = np.zeros((len(texts), COLUMNS))
    np.put_along_axis(hot, np.concatenate((bins, variety[:, None]), axis=1), 1.0, axis=1)
    return pairs % WORDS, number, hot


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray  # ascending

    def grades(self, texts: pa.Array) -> np.ndarray:
        """P(grade > j) of each text, a column for each threshold."""
        words, n, parts = features(texts)
        score = np.bincount(np.repeat(np.arange(len(n)), n), self.words[words], len(n)) + parts @ self.shapes
        return 1 / (1 + np.exp((self.thresholds[None, :] - score[:, None]).clip(-50, 50)))


def fit(words: np.ndarray, n: np.ndarray, parts: np.ndarray, grades: np.ndarray, levels: int) -> Model:
    """Penalised likelihood by Adam over all rows at once. Words that are rare or
    tell nothing keep weight 0."""
    seen = np.bincount(words, minlength=WORDS)
    sums = np.bincount(words, np.repeat(grades, n), WORDS)
    errors = np.abs(sums - seen * grades.mean()) / (np.sqrt(np.maximum(seen, 1)) * max(grades.std(), 1e-9))
    kept = np.flatnonzero((seen >= LEAST_TEXTS) & (errors >= LEAST_ERRORS))
    place = np.full(WORDS, -1)
    place[kept] = np.arange(len(kept))
    owner, column = np.repeat(np.arange(len(n), dtype=np.int32), n), place[words].astype(np.int32)
    owner, column = owner[column >= 0], column[column >= 0]
    cuts = levels - 1
    share = np.array([(grades <= j).mean() for j in range(cuts)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    # Thresholds are the first one and the logs of the steps between them, so they stay ordered.
    x = np.concatenate((np.zeros(len(kept) + COLUMNS), start[:1], np.log(np.maximum(np.diff(start), 0.1))))
    first, second = np.zeros_like(x), np.zeros_like(x)
    k = len(kept)
    for step in range(1, STEPS + 1):
        thresholds = np.cumsum(np.concatenate((x[k + COLUMNS : k + COLUMNS + 1], np.exp(x[k + COLUMNS + 1 :]))))
        score = np.bincount(owner, x[column], len(n)) + parts @ x[k : k + COLUMNS]
        upto = 1 / (1 + np.exp((score[:, None] - thresholds[None, :]).clip(-50, 50)))
        low = np.where(grades > 0, np.take_along_axis(upto, np.maximum(grades - 1, 0)[:, None], 1)[:, 0], 0.0)
        high = np.where(grades < cuts, np.take_along_axis(upto, np.minimum(grades, cuts - 1)[:, None], 1)[:, 0], 1.0)
        inside = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / inside, low * (1 - low) / inside
        d_score = d_low - d_high  # of the log likelihood
        d_cut = np.array([d_high[grades == j].sum() - d_low[grades == j + 1].sum() for j in range(cuts)])
        later = np.cumsum(d_cut[::-1])[::-1]
        d_steps = np.concatenate((later[:1], later[1:] * np.exp(x[k + COLUMNS + 1 :])))
        gradient = np.concatenate((np.bincount(column, d_score[owner], k), parts.T @ d_score, d_steps)) / len(n)
        gradient[: k + COLUMNS] -= DECAY * x[: k + COLUMNS]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x = x + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(WORDS)
    weights[kept] = x[:k]
    return Model(weights, x[k : k + COLUMNS], np.cumsum(np.concatenate((x[k + COLUMNS : k + COLUMNS + 1], np.exp(x[k + COLUMNS + 1 :])))))


def train(docs: DataFrame, graded: DataFrame, levels: int) -> Model | None:
    """Fit on rows of `graded` (id, grade) with a grade, within SAMPLE and SAMPLE_ENTRIES; None without any.
    Of several texts with one id that of least hash counts."""
    sample = graded.where("grade is not null and id is not null").groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    text = F.struct(F.xxhash64("text").alias("h"), F.col("text"))
    # Copies of a sampled row fall together before anything is shuffled.
    rows = docs.join(F.broadcast(sample), "id").groupBy("id", "grade").agg(F.min(text).alias("one")).select(F.xxhash64("id").alias("place"), "id", F.col("one.text").alias("text"), F.col("grade").cast("int").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts):
                words, n, parts = features(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(words.astype(np.int32)))
                shapes = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * COLUMNS).astype(np.int32)), pa.array(parts.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("place", "id", "grade")], lists, shapes], names=["place", "id", "grade", "words", "shapes"])

    found = cut(rows.mapInArrow(run, "place long, id long, grade int, words array<int>, shapes array<double>"), "features")
    upto = Window.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over SAMPLE short rows
    within = found.select("id", F.sum(F.size("words") + 1).over(upto).alias("upto")).where(F.col("upto") <= SAMPLE_ENTRIES).select("id")
    got = found.join(F.broadcast(within), "id").select("grade", "words", "shapes").toArrow().combine_chunks()
    if not len(got):
        return None
    lists = got["words"].combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    model = fit(lists.flatten().to_numpy(), n, got["shapes"].combine_chunks().flatten().to_numpy().reshape(-1, COLUMNS), got["grade"].to_numpy().astype(np.int64), levels)
    del got, lists
    release()  # the driver's memory is small
    return model


def classify(docs: DataFrame, graded: DataFrame, text: str = "text", row_id: str = "doc_id", levels: int = 3, tail_from: int = 2, keep_from: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept), one row per input row.

    `graded` has (id, grade) with grades 0 .. levels-1; rows with a null in
    either are left out, and an id with several grades counts with the least.
    tail_probability is P(grade >= tail_from); rows from keep_from on are kept.
    Null text counts as empty and is judged by the thresholds alone. Without
    any graded row nothing is known: both figures are null and all rows are
    kept. Repeated rows get equal figures. A text of any length is judged whole.
    An empty table gives no rows. Other columns are ignored. The fit is on a
    bounded sample (SAMPLE, SAMPLE_ENTRIES), the only bounds.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    model = train(rows, graded, levels)
    if model is None:
        return rows.select(F.col("id").alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts):
                above = model.grades(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(above.sum(axis=1)), pa.array(above[:, tail_from - 1])], names=["doc_id", "expected_grade", "tail_probability"])

    out = rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= keep_from)


def keep_good(docs: DataFrame, graded: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that `classify` keeps, whole and with their columns (any names).

    Texts that are equal are judged equally, so rows repeated under one id stay or
    go by their own text. A null text counts as empty, a null id is judged like others, a
    text of any length is read whole; without labels all rows stay; no rows give no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    model = train(keyed, graded, options.get("levels", 3))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tail, least = options.get("tail_from", 2), options.get("keep_from", 0.5)
    schema = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = large(batch.column("__row").field(at))
            kept = [model.grades(texts.slice(a, b - a))[:, tail - 1] >= least for a, b in chunks(texts)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    at = docs.columns.index(text)
    return whole.mapInArrow(run, schema).select("__row.*")
