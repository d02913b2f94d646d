"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each whole text (shares of symbols, digits, capitals, repeated words and lines,
compression and so on), standardized over all documents, are mapped by random Fourier features,
which approximate a Gaussian kernel. Each task sums the normal equations of its labelled rows;
the sums, of a fixed size, are added up in a few tasks and solved on the driver. Isotonic regression
calibrates the ridge scores on labelled rows that the ridge has not seen (where these have one class only, on all).
Ridge scores are bounded by the weights; they are counted at steps of STEP of that range, which bounds the table and ties scores closer than that.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2: the ridge from remainders 0 and 1, the calibration from 3. Neither labels nor
lang, source or doc_id enter a score.

Defined cases: null and empty texts have statistics of zeros and a score like any other; a null
doc_id is never held out and has no label; repeated labels of a document count once, as the
highest; rows that repeat each get a row, with equal scores; where the ridge's rows have labels of one class or none, it learns from all labelled rows; with no label at all every score is 1, with labels of
one class every score is that class; a text of any length is measured whole (one of over 2 MB is a block of its
own); an empty table gives an empty result; other columns, whatever their names, play no part and are kept by good_documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .bytewords import SPACED, Block, blocks, words
from .quality_rules import _counts
from .store import fresh, written

FEATURES, WIDTH, RIDGE, STEP, SEED, THRESHOLD = 256, 0.35, 1e-3, 1e-6, 11, 0.7
_BYTE = np.arange(256)
_UPPER, _LOWERCASE, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 48) & (_BYTE <= 57)
_PUNCT = ((_BYTE > 32) & (_BYTE < 127)) & ~_UPPER & ~_LOWERCASE & ~_DIGIT
STATISTICS = ("log_bytes", "log_words", "word_length", "symbols", "digits", "capitals", "punctuation", "white_space", "line_breaks", "non_ascii", "repeated_lines", "repeated_words", "distinct_words", "compression", "longest_word", "one_letter_words", "closing_marks")


def statistics(block: Block, level: int = 3) -> np.ndarray:
    """One row of STATISTICS for each text of the block."""
    import zstandard

    n, data = block.rows, block.data
    size = np.diff(block.offsets).astype(float)
    per = np.maximum(size, 1)
    # Counts of byte classes by text, from running sums at the texts' ends.
    ends = block.offsets
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[ends]).astype(float)
    base = _counts(block)
    found = words(block, SPACED)
    n_words = np.maximum(base["n_words"], 1).astype(float)
    lengths = found.ends - found.starts
    longest = np.zeros(n)
    np.maximum.at(longest, found.doc, lengths)
    pairs = np.unique(np.stack([found.doc.astype(np.uint64), found.hashes]), axis=1)[0].astype(np.int64) if len(found.doc) else found.doc
    n_lines = count(data == 10) + 1
    press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    view = memoryview(np.ascontiguousarray(data))
    ratio = np.array([len(press.compress(view[int(a) : int(b)])) / (b - a) if b > a else 0.0 for a, b in zip(ends[:-1], ends[1:], strict=True)])
    upper, lower = count(_UPPER[data]), count(_LOWERCASE[data])
    return np.column_stack(
        [
            np.log1p(size), np.log1p(base["n_words"]), base["word_chars"] / n_words, base["n_symbols"] / per, count(_DIGIT[data]) / per,
            upper / np.maximum(upper + lower, 1), count(_PUNCT[data]) / per, count(~SPACED[data]) / per, count(data == 10) / per, count(data >= 0x80) / per,
            base["n_dup_lines"] / n_lines, base["n_repeat_words"] / n_words, np.bincount(pairs, minlength=n) / n_words, ratio, np.log1p(longest),
            np.bincount(found.doc[lengths == 1], minlength=n) / n_words, count((data == 33) | (data == 63)) / per,
        ]
    )


@dataclass(frozen=True)
class QualityModel:
    """All that a task needs to score texts; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(SEED))
        directions = rng.standard_normal((stats.shape[1], FEATURES)) * WIDTH
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones(len(stats))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.values[0])
        return np.interp(self.ridge(stats), self.knots, self.values)


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id, fold (crc32(doc_id as text) mod 4), held_out and the statistics of every text."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)).cast("int")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                stats = statistics(block)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(block.first, block.rows) for i in (0, 1)] + [flat], names=["doc_id", "fold", "stats"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), "text").mapInArrow(rows, "doc_id long, fold int, stats array<double>")
    return out.select("doc_id", "fold", (F.col("fold") == 2).alias("held_out"), "stats")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _isotonic(score: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order of score."""
    pools: list[list[float]] = []  # positives, rows, sum of score * rows
    for s, k, p in zip(score, n, positive, strict=True):
        pools.append([p, k, s * k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    pools_ = np.array(pools)
    return pools_[:, 2] / pools_[:, 1], pools_[:, 0] / pools_[:, 1]


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """stats: of statistics_table; labels(doc_id, quality)."""
    k = len(STATISTICS)
    moments = stats.agg(*[f(F.get("stats", F.lit(i))).alias(f"{name}{i}") for i in range(k) for name, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    mean = np.array([moments[f"mean{i}"] or 0.0 for i in range(k)])
    scale = np.array([moments[f"std{i}"] or 0.0 for i in range(k)])
    blank = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), None, np.zeros(1), np.ones(1))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    labelled = stats.where("fold <> 2").join(known, "doc_id").select("fold", "stats", "y")
    side = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side + 1, side + 1))
        for batch in batches:
            x = blank.features(_matrix(batch.column(0)))
            xy = np.column_stack([x, batch.column(1).to_numpy()])
            total += xy.T @ xy
        if total[side - 1, side - 1]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                one = np.frombuffer(raw.as_py())
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((side + 1, side + 1))
    for rows in (labelled.where("fold < 2"), labelled):
        sums = rows.select("stats", "y").mapInArrow(partial, "sums binary").repartition(4).mapInArrow(added, "sums binary").collect()  # at most four rows of fixed size
        total = sum((np.frombuffer(r["sums"]).reshape(side + 1, side + 1) for r in sums), np.zeros((side + 1, side + 1)))
        n, positive = total[side - 1, side - 1], total[side - 1, side]
        if 0 < positive < n:
            break
    if not n:
        return blank
    if positive in (0.0, n):
        return QualityModel(blank.mean, blank.scale, None, np.zeros(1), np.full(1, positive / n))
    weights = np.linalg.solve(total[:side, :side] + RIDGE * n * np.diag([1.0] * FEATURES + [0.0]) / FEATURES, total[:side, side])
    raw = QualityModel(blank.mean, blank.scale, weights, blank.knots, blank.values)

    # |features| is at most sqrt(2) for the cosines and 1 for the constant, so ridge scores are within this bound.
    bound = float(np.sqrt(2) * np.linalg.norm(weights[:FEATURES]) + abs(weights[FEATURES]))
    step = STEP * max(bound, 1e-300)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, of = np.unique(np.rint(raw.ridge(_matrix(batch.column(1))) / step).astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.zeros(len(at), int))), pa.array(at), pa.array(np.bincount(of)), pa.array(np.bincount(of, batch.column(2).to_numpy()))], names=["fold", "bin", "n", "good"])

    counted = lambda some: some.mapInArrow(binned, "fold int, bin long, n long, good double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    # At most 2 / STEP rows, whatever the number of labels.
    table = counted(labelled.where("fold = 3"))
    if not 0 < sum(r["good"] for r in table) < sum(r["n"] for r in table):
        table = counted(labelled)
    score, value = _isotonic(np.array([r["bin"] for r in table]) * step, np.array([r["n"] for r in table], float), np.array([r["good"] for r in table]))
    return QualityModel(blank.mean, blank.scale, weights, score, value)


def score_table(stats: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(_matrix(batch.column(2)))  # doc_id, held_out, stats
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "held_out", "stats").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text)."""
    stats = written(statistics_table(docs), "text_statistics")
    return score_table(stats, fit(stats, labels))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of the threshold or more, with all their columns.

    The statistics are written beside the rows they belong to, so that each text is measured once.
    """
    name, text = fresh(docs, "stats"), docs.columns.index("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text)):
                part, stats = batch.slice(block.first, block.rows), statistics(block)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], names=[*part.schema.names, name])

    measured = written(docs.mapInArrow(measure, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])), "text_statistics")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4, F.lit(0)).cast("int")
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col(name).alias("stats")), labels)
    last = len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pc.greater_equal(pa.array(model.scores(_matrix(batch.column(last)))), threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[:last], names=batch.schema.names[:last]).filter(good)

    return measured.mapInArrow(keep, docs.schema)
