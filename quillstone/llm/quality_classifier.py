"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are computed once and written, narrow. The features approximate a Gaussian kernel over
the standardised statistics. Tasks sum their part of the normal equations, Spark sums the parts, and the driver solves a
system of FEATURES + 1 unknowns. Calibration pools adjacent violators over BINS bins of the ridge score, which tasks
count. All labelled rows outside the held-out fold are learned from; nothing grows with the corpus but the tables.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; without labels,
or with one class only, every score is that of the labels' mean (0.5 if there are none); null labels are left out;
several labels of a document all count; an empty table gives no rows; repeated rows each have a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, read, utf8_buffer
from quillstone.llm.quality_rules import base_columns
from quillstone.llm.spans import NOT_WHITE, owners, per_text, runs, span_numbers
from quillstone.llm.token_counts import batches

FEATURES, SEED, PENALTY, BINS, FOLDS = 256, 20240229, 1e-3, 512, 3
#: Bandwidth of the kernel, in standard deviations of the statistics.
BANDWIDTH = 4.0
#: Standardised statistics are cut off at so many standard deviations.
CUT = 4.0
BATCH_BYTES = 2_000_000
#: One in so many labelled rows calibrates and is not fitted on.
CALIBRATE = 3
STATISTICS = 20


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS floats for each text."""
    data, offsets = utf8_buffer(texts)
    n = len(offsets) - 1
    base = base_columns(data, offsets)
    size = np.diff(offsets)
    some, words = np.maximum(size, 1), np.maximum(base["n_words"], 1)
    share = lambda flags: per_text(offsets, flags) / some
    starts, ends = runs(NOT_WHITE[data], offsets)
    text, h = owners(offsets, starts), span_numbers(data, starts, ends)
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    by_word = lambda flags: np.bincount(text[flags], minlength=n) / words
    first, last = (data[starts], data[ends - 1]) if len(data) else (np.zeros(0, np.uint8),) * 2
    lines = per_text(offsets, data == 10) + 1
    length = ends - starts
    spread = np.bincount(text, weights=length.astype(float) ** 2, minlength=n) / words - (np.bincount(text, weights=length, minlength=n) / words) ** 2
    capital, small, digit = ((data >= i) & (data <= j) for i, j in ((65, 90), (97, 122), (48, 57)))
    other = (data > 32) & (data < 127) & ~capital & ~small & ~digit
    return np.column_stack(
        [
            np.log1p(size), np.log1p(base["n_words"]), base["word_chars"] / words, np.sqrt(np.maximum(spread, 0)),
            share(capital), share(digit), share(other), share(data >= 128), share(data == 33), share(data == 124),
            base["n_symbols"] / some, base["n_dup_lines"] / lines, base["n_repeat_words"] / words, np.log1p(lines), np.log(some / lines),
            by_word(follows), by_word(length == 1), by_word((first >= 65) & (first <= 90)), by_word((last < 48) & (last > 32)), share((data == 44) | (data == 46)),
        ]
    ).astype(np.float32)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, stats array<float>."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                s = statistics(part)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * STATISTICS), pa.array(s.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), lists], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def fourier(s: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Features of the standardised statistics, with a constant at the end."""
    rng = np.random.default_rng(SEED)
    w, phase = rng.normal(0, 1 / BANDWIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((s - mean) / spread, -CUT, CUT)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(s), 1))])


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of arrays emitted as rows (i, v array<double>), stacked by i."""
    out = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((out["i"].max() + 1, out["j"].max() + 1)) if len(out) else np.zeros((0, 0))
    total[out["i"], out["j"]] = out["x"]
    return total


def normal_equations(train: DataFrame, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over train(stats, y) of z z' and z y."""

    def part(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in tables:
            z = fourier(matrix(b.column("stats")), mean, spread)
            total += z.T @ np.hstack([z, b.column("y").to_numpy()[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    total = summed(train.select("stats", "y").mapInArrow(part, "i int, v array<double>"))
    return total[:, :-1], total[:, -1]


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit: mean x and y of each pool."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def fit(train: DataFrame) -> dict:
    """The model of train(stats, y, calibrate): scores are fitted on the rows without the mark and calibrated on those with it.

    Without rows to calibrate on, a score is the ridge's own, cut off at 0 and 1; with one label only, or none, it is constant.
    """
    rest, train = train.where("calibrate"), train.where("not calibrate")
    moments = train.select(F.posexplode("stats").alias("j", "s"), "y").groupBy("j").agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.stddev_pop("s").alias("d"), F.avg("y").alias("y")).toPandas().sort_values("j")
    if not len(moments) or moments["y"].iloc[0] in (0.0, 1.0):
        return {"constant": float(moments["y"].iloc[0]) if len(moments) else 0.5}
    mean, spread = moments["m"].to_numpy(), np.maximum(moments["d"].to_numpy(), 1e-6)
    a, b = normal_equations(train, mean, spread)
    penalty = PENALTY * float(moments["n"].iloc[0]) * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 0
    w = np.linalg.solve(a + penalty, b)

    def bins(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            r = fourier(matrix(b.column("stats")), mean, spread) @ w
            own = pd.DataFrame({"bin": np.clip(np.floor((r + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32), "r": r, "y": b.column("y").to_numpy(), "n": 1}).groupby("bin", as_index=False).sum()
            yield pa.RecordBatch.from_pandas(own[["bin", "r", "y", "n"]], preserve_index=False)

    binned = rest.select("stats", "y").mapInArrow(bins, "bin int, r double, y double, n long").groupBy("bin").agg(F.sum("r").alias("r"), F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas().sort_values("bin")
    knots = pool_adjacent_violators(binned["r"] / binned["n"], binned["y"] / binned["n"], binned["n"]) if len(binned) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return {"mean": mean, "spread": spread, "w": w, "knots": knots}


def scored(stats: DataFrame, model: dict) -> DataFrame:
    """stats with a calibrated score."""
    if "constant" in model:
        return stats.select("doc_id", F.lit(model["constant"]).alias("score"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            r = fourier(matrix(b.column("stats")), model["mean"], model["spread"]) @ model["w"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(np.interp(r, *model["knots"]), 0, 1))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality-classifier")
    stats = scratch.table(with_statistics(read(spark, sf_dir, "documents")), "stats")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    labels = read(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold != 1)).select("doc_id", F.col("quality").cast("double").alias("y"))
    calibrate = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    train = scratch.table(stats.join(labels, "doc_id").withColumn("calibrate", calibrate), "train")
    model = fit(train)
    scratch.keep("stats")
    done = scored(stats, model)
    return done.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
