"""Quality classifier by Bradley-Terry pairwise ranking.

A pair prefers a document of label 1 to one of label 0. Scores are linear in features of the text alone; the logistic loss
of the feature differences of all pairs is minimised. The threshold is the quantile of all training scores
at the share of label 0; a score is the logistic function of the distance to it, so that 0.5 is the threshold.

Training takes every labelled row that isn't held out, and every pair of them, without forming the pairs: a pair's loss depends on the
difference of two scores alone, and is smooth in both. Scores are cut into cells, and within a cell the loss and its derivatives are
polynomials of either score to some 13 digits (Chebyshev interpolation of NODES points). So moments of the rows by label, cell and
point, which are sums, give the whole loss, its slope and its curvature. A step of Newton's method is one pass over the features of
the labelled rows; the driver gets sums whose number is that of the cells. The threshold is selected by rank in passes that count.
Features, scores and everything else are DataFrame functions over all documents, in one scan of the texts.

Defined results: null and empty texts get the features of no words and a score like any other; documents without
label are scored alike; repeated rows are scored each, and learnt from each; labels other than 0 and 1 are none; without both labels to
learn from all scores are 0.5; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, text_or_empty
from loopwright.llm.textstats import char_histogram, listed_words, with_counts, word_histogram

#: Width of a cell of scores, and points of interpolation in it. The logistic function's poles are pi away: errors fall by 6.4 a point.
CELL, NODES = 2.0, 16
#: Ranges that scores are counted in, a pass, when one is selected by its rank.
RANGES = 1000


@dataclass(frozen=True)
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    spread: float


def feature_columns() -> list[tuple[str, Column]]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("n_chars"), F.lit(1)).cast("double")
    part = lambda i: F.element_at("chars", i) / chars
    capped = lambda c, most: F.least(c, F.lit(most)) / most
    return [
        ("length", F.log1p("n_words")),
        ("very_short", (F.col("n_words") < 50).cast("double")),
        ("word_length", capped(F.col("word_chars") / n, 20.0)),
        ("symbols", capped(F.col("n_symbols") / n, 0.25)),
        ("upper", capped(part(2), 0.25)),
        ("digits", capped(part(3), 0.2)),
        ("punctuation", capped(part(5), 0.15)),
        ("other", capped(part(6), 0.1)),
        ("duplicate_lines", capped(F.col("n_dup_lines") / n, 0.1)),
        ("repeats", capped(F.col("n_repeat_words") / n, 0.5)),
        ("distinct", F.col("n_distinct") / n),
        ("common", capped(F.col("n_common") / n, 0.4)),
        ("no_common", ((F.col("n_words") >= 50) & (F.col("n_common") / n < 0.07)).cast("double")),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the features of the text."""
    df = with_counts(chosen(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text")))
    df = df.withColumn("n_chars", F.length("text")).withColumn("n_distinct", F.size(F.array_distinct("ws")))
    df = df.withColumn("chars", char_histogram(F.col("text"), F.col("word_chars"), F.col("residue"))).withColumn("n_common", listed_words(word_histogram(F.col("ws"))))
    return df.select("doc_id", F.array(*[c.cast("double") for _, c in feature_columns()]).alias("x"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = 50_000, steps: int = 40, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Newton's method on the logistic loss of pairs drawn from rows in memory; train() takes all pairs of a table."""
    width = x.shape[1] if x.ndim == 2 else 0
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model([0.0] * width, [1.0] * width, [0.0] * width, 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    draw = np.random.default_rng(seed)
    pairs = min(max_pairs, len(good) * len(bad))
    diff = ((good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)])) / scale
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        slope = diff.T @ (p - 1) / pairs + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    score = (x - mean) / scale @ w
    threshold = _gap(np.sort(score), (y == 0).mean())
    return Model(mean.tolist(), scale.tolist(), w.tolist(), threshold, float(score.std()) / 2 or 1.0)


def _gap(ordered: np.ndarray, share: float) -> float:
    """The quantile of the scores at `share`, half way to the next score."""
    at = min(max(int(round(share * len(ordered))), 1), len(ordered) - 1)
    return float((ordered[at - 1] + ordered[at]) / 2)


def _upper(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> DataFrame:
    """good, cell, sums of rows (x, y): by label and cell of the score, sums over the rows of Chebyshev polynomials of the score times 1, the features and their products."""
    first, second = _upper(len(mean))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean)) - mean) / scale
            score, good = z @ weights, batch.column(1).to_numpy(zero_copy_only=False) == 1
            cell = np.floor(score / CELL).astype(np.int64)
            basis = chebyshev.chebvander((score / CELL - cell) * 2 - 1, NODES - 1)
            powers = np.concatenate([np.ones((len(z), 1)), z, z[:, first] * z[:, second]], axis=1)
            for key in np.unique(cell * 2 + good):
                own = cell * 2 + good == key
                at = (bool(key & 1), int(key >> 1))
                found[at] = found.get(at, 0.0) + basis[own].T @ powers[own]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.bool_()), pa.array([c for _, c in found], pa.int64()), pa.array([m.ravel() for m in found.values()], pa.list_(pa.float64()))], names=["good", "cell", "sums"])

    def added(group: pa.Table) -> pa.Table:
        sums = group["sums"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return group.slice(0, 1).select(["good", "cell"]).append_column("sums", pa.array([sums], pa.list_(pa.float64())))

    schema = "good boolean, cell bigint, sums array<double>"
    return rows.select("x", "y").mapInArrow(summed, schema).groupBy("good", "cell").applyInArrow(added, schema)


def whole_loss(sums: list, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean over all pairs of the logistic loss, its slope and its curvature, from the moments by label and cell."""
    at = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
    # from moments of polynomials to weights of the points of interpolation
    points = chebyshev.chebvander(at, NODES - 1) * np.where(np.arange(NODES) == 0, 1, 2) / NODES
    first, second = _upper(width)
    sides = []
    for good in (True, False):
        own = sorted((r for r in sums if r["good"] == good), key=lambda r: r["cell"])
        place = np.concatenate([(r["cell"] + (at + 1) / 2) * CELL for r in own])
        held = np.concatenate([points @ np.array(r["sums"]).reshape(NODES, -1) for r in own])
        square = np.empty((len(held), width, width))
        square[:, first, second] = square[:, second, first] = held[:, 1 + width :]
        sides.append((place, held[:, 0], held[:, 1 : 1 + width], square))
    (s, n, x, xx), (t, m, y, yy) = sides
    apart = s[:, None] - t
    wrong = np.exp(-np.logaddexp(0, apart))
    bend = wrong * np.exp(-np.logaddexp(0, -apart))
    loss = n @ np.logaddexp(0, -apart) @ m
    slope = y.T @ (n @ wrong) - x.T @ (wrong @ m)
    cross = x.T @ bend @ y
    curve = np.tensordot(bend @ m, xx, 1) + np.tensordot(n @ bend, yy, 1) - cross - cross.T
    total = sum(np.array(r["sums"])[0] for r in sums if r["good"]) * sum(np.array(r["sums"])[0] for r in sums if not r["good"])
    return loss / total, slope / total, curve / total


def ranked(values: DataFrame, rank: int) -> float:
    """The value of this rank (0 for the least) of a column `s` of doubles, exactly: counted in ranges, then in those of the range that holds it."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        within = values.where(F.col("s").between(low, high))
        part = F.least(F.floor((F.col("s") - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        for r in sorted(within.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect(), key=lambda r: r["part"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def train(rows: DataFrame, steps: int = 60, ridge: float = 1e-3) -> Model:
    """Newton's method on the logistic loss of all pairs of rows (x, y), y being 0 or 1; a step that makes the loss worse is halved."""
    width = len(feature_columns())
    columns = [F.element_at("x", i + 1) for i in range(width)]
    known = rows.agg(F.sum("y"), F.count("*"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    ones, n = known[0] or 0, known[1]
    if not 0 < ones < n:
        return Model([0.0] * width, [1.0] * width, [0.0] * width, 0.0, 1.0)
    mean, scale = np.array(known[2 : 2 + width]), np.array(known[2 + width :])
    scale[scale == 0] = 1.0
    w, best, step = np.zeros(width), None, np.zeros(width)
    for _ in range(steps):
        loss, slope, curve = whole_loss(moments(rows, mean, scale, w + step).collect(), width)
        loss += ridge / 2 * float((w + step) @ (w + step))
        if best is not None and loss > best * (1 + 1e-9):
            step = step / 2
            continue
        w, best = w + step, loss
        step = -np.linalg.solve(curve + ridge * np.eye(width), slope + ridge * w)
        if np.abs(step).max() < 1e-6:
            w = w + step
            break
    plain = Model(mean.tolist(), scale.tolist(), w.tolist(), 0.0, 1.0)
    scores = materialise(rows.select(_total(F.col("x"), plain).alias("s")))
    at = n - ones
    low, spread = ranked(scores, at - 1), scores.agg(F.stddev_pop("s")).first()[0] / 2
    upto, above = scores.agg(F.count_if(F.col("s") <= low), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    drop(scores)
    threshold = low if upto > at else (low + above) / 2
    return Model(plain.mean, plain.scale, plain.weights, threshold, spread or 1.0)


def _total(x: Column, model: Model) -> Column:
    terms = [(F.element_at(x, i + 1) - m) / s * w for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights))]
    return sum(terms, F.lit(0.0))


def score(x: Column, model: Model) -> Column:
    away = F.greatest(F.least((_total(x, model) - model.threshold) / model.spread, F.lit(30.0)), F.lit(-30.0))
    return 1.0 / (1.0 + F.exp(-away))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Rows that are held out are never learnt from."""
    known = materialise(features(docs))
    judged = chosen(labels, id="doc_id", y=label_col).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    learnt = materialise(known.join(judged.select("id", F.col("y").cast("int").alias("y")).hint("merge"), F.col("doc_id") == F.col("id"), "inner").select("x", "y"))
    model = train(learnt)
    drop(learnt)
    return known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("x"), model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
