"""Document quality by regularised quadratic discriminant analysis of text statistics.

Each class has a mean and a covariance over transformed statistics of whole texts, the covariance shrunk towards that of both
classes together and towards its diagonal. A score comes from the difference of the log densities, Mahalanobis distances by way of
Cholesky factors that are computed once. Labels are only used to fit, a bounded sample of them; moments are summed on the executors.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, need_columns, ship, written

FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "symbols", "odd_symbols", "bars", "shouts", "log_line_words", "line_ends", "line_repeats", "type_ratio", "top_word", "bigram_ratio", "entropy", "sentence_words", "stop_words",
)
#: Share of each class covariance that comes from both classes together, and from their variances alone.
POOLED, DIAGONAL = 0.15, 0.05
#: Standardised statistics are held within so many deviations.
LIMIT = 5.0
# fixed values: frequent short words of the languages met
STOP = frozenset("the of and to in a is that for it was on are as with his they be at this from or had by der die und das von zu mit den ist des sich auf für ein eine im dem nicht le la les de du un une et à en que qui dans pour pas sur au est il el los las y por con para se del una su al lo como".split())
_ASCII = np.zeros(128, np.int8)  # 1 letter, 2 digit, 3 white space, 4 usual sign, 5 other sign
_ASCII[[*range(65, 91), *range(97, 123)]] = 1
_ASCII[48:58] = 2
_ASCII[[9, 10, 11, 12, 13, 32]] = 3
_ASCII[[c for c in range(33, 127) if not _ASCII[c]]] = 5
_ASCII[[ord(c) for c in ".,;:'\"-()?"]] = 4


def _logit(share: float) -> float:
    share = min(max(share, 1e-4), 1 - 1e-4)
    return math.log(share / (1 - share))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; an empty one has those of no words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, *[_logit(0)] * 7, 0.0, _logit(0), _logit(0), _logit(1), _logit(0), _logit(1), 0.0, 0.0, _logit(0)]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    wide = points >= 128
    counts = np.bincount(_ASCII[points[~wide]], minlength=6)
    signs = int(((points >= 0x2000) & (points < 0x2C00)).sum())
    letters = int(counts[1]) + int(wide.sum()) - signs
    seen = len(points) - int(counts[3])
    upper = int(((points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE)).sum())
    lowered = [w.strip(".,;:!?\"'()").lower() for w in words]
    kinds = Counter(lowered)
    lines = [x for x in text.split("\n") if x.strip()]
    freq = np.bincount(np.minimum(points, 1023))
    p = freq[freq > 0] / len(points)
    pairs = len(set(zip(lowered, lowered[1:], strict=False)))
    ends = text.count(".") + text.count("?") + text.count("!")
    return [
        math.log1p(n),
        math.log(seen / n + 1),
        _logit(letters / max(1, seen)),
        _logit(upper / max(1, letters)),
        _logit(int(counts[2]) / max(1, seen)),
        _logit((int(counts[4]) + signs) / max(1, seen)),
        _logit(int(counts[5]) / max(1, seen)),
        _logit(text.count("|") / n),
        _logit(text.count("!!") / n),
        math.log1p(n / len(lines)),
        _logit(sum(x.rstrip()[-1] in ".!?:\"”»" for x in lines) / len(lines)),
        _logit(1 - len(set(lines)) / len(lines)),
        _logit(len(kinds) / n) + 0.5 * math.log1p(n),
        _logit(kinds.most_common(1)[0][1] / n),
        _logit(pairs / max(1, n - 1)),
        float(-(p * np.log2(p)).sum()),
        math.log1p(n / (1 + ends)),
        _logit(sum(kinds[w] for w in STOP if w in kinds) / n),
    ]


#: Rows that a worker has as Python objects at a time.
SLICE = 256
#: Labels that the discriminant learns from, about so many, drawn by a hash of id and label: a bound on the sample, whatever the input.
LEARN_LABELS = 100_000


def statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """Of two classes: how statistics are standardised, means, whitening by Cholesky factors, and what is added to the log densities."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    whiten: tuple[np.ndarray, ...] = ()
    constant: tuple[float, ...] = ()

    @classmethod
    def standard(cls, moments: dict[int, Moments]) -> Discriminant:
        """Only how statistics are standardised: by their mean over both classes and their deviation within the classes."""
        total = sum(m[0] for m in moments.values())
        inside = sum(m[0] / total * np.diag(m[2] / m[0] - np.outer(m[1], m[1]) / m[0] ** 2) for m in moments.values())
        return cls(sum(m[1] for m in moments.values()) / total, np.sqrt(np.maximum(inside, 1e-6)))

    def with_moments(self, moments: dict[int, Moments]) -> Discriminant:
        """The whole discriminant from the moments of standardised statistics."""
        d, total = len(self.centre), sum(m[0] for m in moments.values())
        covariance = {y: m[2] / m[0] - np.outer(m[1], m[1]) / m[0] ** 2 for y, m in moments.items()}
        pooled = sum(m[0] / total * covariance[y] for y, m in moments.items())
        factors = [np.linalg.cholesky((1 - POOLED - DIAGONAL) * covariance[y] + POOLED * pooled + DIAGONAL * np.eye(d)) for y in (0, 1)]
        constant = tuple(math.log(moments[y][0] / total) - float(np.log(np.diag(factors[y])).sum()) for y in (0, 1))
        return Discriminant(self.centre, self.scale, tuple(moments[y][1] / moments[y][0] for y in (0, 1)), tuple(np.linalg.inv(f) for f in factors), constant)

    def standardised(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.scale, -LIMIT, LIMIT)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1, over a half where class 1 is likelier. Large differences are compressed, so that they stay apart."""
        x = self.standardised(stats)
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.constant, strict=True)]
        z = logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.sign(z) * np.log1p(np.abs(z))))


#: Of one class: rows, sums and sums of products of statistics.
Moments = tuple[float, np.ndarray, np.ndarray]


def moments(stats: DataFrame, of: Discriminant | None = None) -> dict[int, Moments]:
    """Of both classes of stats (_y, _w, _stats), each row counted _w times; of: whose standardised statistics are meant. Summed on the executors."""
    d = len(FEATURES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, d)
            x = of.standardised(x) if of else x
            y, w = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
            for c in (0, 1):
                xc, wc = x[y == c], w[y == c]
                sums[c] += np.concatenate([[wc.sum()], wc @ xc, ((xc * wc[:, None]).T @ xc).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], sums.shape[1]), pa.int32()), pa.array(np.tile(np.arange(sums.shape[1]), 2), pa.int32()), pa.array(sums.ravel())], ["y", "at", "v"])

    flat = np.zeros((2, 1 + d + d * d))
    for r in stats.select("_y", "_w", "_stats").mapInArrow(work, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        flat[r["y"], r["at"]] = r["v"]
    return {c: (flat[c, 0], flat[c, 1 : 1 + d], flat[c, 1 + d :].reshape(d, d)) for c in (0, 1)}


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LEARN_LABELS) -> Discriminant | None:
    """The discriminant from the texts of about ``most`` of the labels, or of all if there are fewer.

    labels: rows to learn from; a label other than 0 and 1 and ids without a text are left out, repeats count again.
    None if there are not two rows of either class.
    """
    ship(df.sparkSession)
    learn = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    learn = learn.groupBy("_id", "_y").agg(F.count("*").alias("_w"))
    share = min(1.0, most / max(1, learn.count()))
    drawn = learn.filter(F.pmod(F.xxhash64("_id", "_y"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # some 16 bytes for each of so many labels: small enough for every task
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(drawn), "_id").select("_text", "_y", "_w")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(statistics_of(b.column(0))), pa.list_(pa.float64()))], ["_y", "_w", "_stats"])

    stats = written(texts.mapInArrow(work, "_y int, _w long, _stats array<double>"), "statistics")
    raw = moments(stats)
    if min(m[0] for m in raw.values()) < 2:
        return None
    standard = Discriminant.standard(raw)
    model = standard.with_moments(moments(stats, standard))
    forget(stats)
    return model


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels but for the third that is held out: CRC-32 of the id as text, modulo 3, is 1."""
    return labels.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LEARN_LABELS) -> DataFrame:
    """One row per row of df: id, held_out, score and predicted, learnt from the rows of labels that are not held out.

    Null and empty texts have a score as well. Null ids are scored and count as not held out. Repeated rows stay, an empty df
    gives no rows. Without two labelled rows of either class nothing can be learnt: then every score is a half.
    """
    need_columns(df, id_col, text_col)
    model = fit(df, training_rows(labels, id_col), id_col, text_col, label_col, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                s = model.scores(statistics_of(b.column(1))) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["_id", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(work, "_id long, score double, predicted int").select(F.col("_id").alias(id_col), held_out.alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LEARN_LABELS) -> DataFrame:
    """The rows of df that score() predicts to be good, with all columns of df under whatever names; each is judged where it is, nothing is shuffled.

    Where nothing can be learnt every score is a half, and all rows stay.
    """
    need_columns(df, id_col, text_col)
    model = fit(df, training_rows(labels, id_col), id_col, text_col, label_col, most)
    if model is None:
        return df
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                yield b.filter(pa.array(model.scores(statistics_of(b.column(place))) >= 0.5))

    return df.mapInArrow(work, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents, labels.quality."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
