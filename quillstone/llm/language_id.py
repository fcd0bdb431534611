"""Language ID: the family first, then one-versus-one linear support vector machines between its languages.

Features are hashed byte trigrams of the whole text (letters lowered, digits alike), square-rooted and normalised. Each
machine is fitted by one task on a bounded sample: at most PER_CLASS documents of each side, spread evenly over a
family's languages. Families are told apart the same way, pair by pair. Languages of no known family, such as stray values
of lang, form families of TOGETHER by name, so machines grow with their number and not with its square until there are
very many. The weights, TRIGRAMS small floats a pair, are broadcast up to MOST_BYTES; more is an error, not a crash.

Learning uses text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0; prediction uses text only.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if there is nothing to
learn from; with one language only, that one has score 1; a null doc_id is neither held out nor learned from; equal
votes go to the name that sorts first; an empty table gives no rows; repeated rows each have a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, free_names, read, utf8_buffer
from quillstone.llm.spans import SLICE, owners
from quillstone.llm.token_counts import batches

# Languages of a family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "ms", "tl"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
TRIGRAMS = 4096
#: Other languages in a family, and bytes of weights that may be broadcast.
TOGETHER, MOST_BYTES = 16, 400_000_000
#: Documents that a machine learns each side from.
PER_CLASS = 1000
HELD_OUT_FOLDS = 5
BATCH_BYTES, BATCH_TEXTS = 2_000_000, 512

FOLDED = np.arange(256, dtype=np.int64)
FOLDED[65:91] += 32
FOLDED[48:58] = 48
FOLDED[9:14] = 32


def families_of(langs: list[str]) -> dict[str, list[str]]:
    """The languages of each family."""
    out = defaultdict(list)
    for lang in sorted(langs):
        if lang in FAMILY_OF:
            out[FAMILY_OF[lang]].append(lang)
    others = sorted(set(langs) - set(FAMILY_OF))
    for k in range(0, len(others), TOGETHER):
        out[f"others from {others[k]}"] = others[k : k + TOGETHER]
    return dict(sorted(out.items()))


def features(texts: pa.Array) -> np.ndarray:
    """A row of TRIGRAMS floats of norm 1 for each text; zeros if it has under three bytes."""
    data, offsets = utf8_buffer(texts)
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, TRIGRAMS), np.float32)
    counts = np.zeros(n * TRIGRAMS, np.int64)
    for i in range(0, len(data) - 2, SLICE):
        b = FOLDED[data[i : i + SLICE + 2]]
        h = (b[:-2] * 961 + b[1:-1] * 31 * 7 + b[2:] * 40503 + (b[:-2] ^ b[2:]) * 2654435761 % 4294967296 // 65536) % TRIGRAMS
        at = np.arange(i, i + len(h))
        text = owners(offsets, at)
        whole = at + 3 <= offsets[text + 1]
        counts += np.bincount(text[whole] * TRIGRAMS + h[whole], minlength=n * TRIGRAMS)
    x = np.sqrt(counts.reshape(n, TRIGRAMS), dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def small_batches(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for at, part in batches(column, BATCH_BYTES):
        for k in range(0, len(part), BATCH_TEXTS):
            yield at + k, part.slice(k, BATCH_TEXTS)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights and bias of the L2-regularised machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (2 * 2.0 + penalty)  # rows have norm sqrt(2), weights sum to 1
    w = look = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        slack = np.maximum(1 - y * (x @ look), 0)
        new = look - step * (penalty * look - 2 * ((each * y * slack) @ x))
        look = new + k / (k + 3) * (new - w)
        w = new
    return w


def pairs_of(langs: list[str]) -> list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]:
    """Machines: their level ('' or a family), a name of each side joined by a line end, and the languages of each side."""
    of = families_of(langs)
    out = [("", f"{a}\n{b}", tuple(of[a]), tuple(of[b])) for a, b in combinations(sorted(of), 2)]
    return out + [(f, f"{a}\n{b}", (a,), (b,)) for f, own in sorted(of.items()) for a, b in combinations(own, 2)]


def learn(docs: DataFrame, scratch: Scratch) -> tuple[list[str], dict[tuple[str, str], np.ndarray]]:
    """The languages, and the weights by (level, pair). docs(doc_id, text, lang) are those to learn from."""
    spark = docs.sparkSession
    totals = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs = sorted(totals)
    machines = pairs_of(langs)
    if not machines:
        return langs, {}
    if len(machines) * TRIGRAMS * 2 > MOST_BYTES:
        raise ValueError(f"{len(langs)} languages need {len(machines)} machines, more than may be broadcast")
    # About twice the bound by a hash of doc_id, then the bound itself: only the sample is shuffled.
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, 2 * PER_CLASS / n))) for x, n in totals.items()])
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = docs.where(F.pmod(order, F.lit(1_000_003)) < share * 1_000_003)
    sample = sample.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))).where(F.col("rank") <= PER_CLASS)

    def vectors(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in small_batches(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(at, len(part)), b.column("rank").slice(at, len(part)), pa.array([x.tobytes() for x in features(part)], pa.binary())], ["lang", "rank", "x"])

    sample = scratch.table(sample.select("lang", "rank", "text").mapInArrow(vectors, "lang string, rank int, x binary"), "sample")
    sides = [(level, pair, lang, sign, PER_CLASS // len(own)) for level, pair, a, b in machines for sign, own in ((1, a), (-1, b)) for lang in own]
    wanted = spark.createDataFrame(sides, "level string, pair string, lang string, sign int, most int")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), TRIGRAMS)
        return pd.DataFrame({"level": rows["level"][:1], "pair": rows["pair"][:1], "w": [fit_machine(x, rows["sign"].to_numpy(np.float32)).astype(np.float16).tobytes()]})

    fitted = sample.join(F.broadcast(wanted), "lang").where(F.col("rank") <= F.greatest("most", F.lit(1)))
    fitted = fitted.groupBy("level", "pair").applyInPandas(train, "level string, pair string, w binary")
    machines = {(r["level"], r["pair"]): np.frombuffer(r["w"], np.float16) for r in fitted.collect()}
    scratch.keep()
    return langs, machines


def choose(x: np.ndarray, names: list[str], level: str, machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """The index of the name with most one-versus-one votes, and the least margin with which it won its own pairs."""
    votes, margins = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        w = machines[level, f"{a}\n{b}"]
        w = w.astype(np.float32)
        m = x @ w[:-1] + w[-1]
        votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
        votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
        margins[:, i], margins[:, j] = np.minimum(margins[:, i], m), np.minimum(margins[:, j], -m)
    best = votes.argmax(1)
    return best, margins[np.arange(len(x)), best]


def predict(docs: DataFrame, langs: list[str], machines: dict, columns: list[str]) -> DataFrame:
    """The columns asked for with lang_pred and score, from text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, machines))
    docs = docs.select(*dict.fromkeys([*columns, "text"]))
    has_letter, *own = free_names(docs, "has_letter", "lang_pred", "score")
    docs = docs.withColumn(has_letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"{own[0]} string", f"{own[1]} double"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, machines = shared.value
        of = families_of(langs)
        families = list(of)
        for b in tables:
            for at, part in small_batches(b.column("text")):
                letter = b.column(has_letter).slice(at, len(part)).to_numpy(zero_copy_only=False) & bool(langs)
                named, least = np.full(len(part), "und", object), np.full(len(part), -np.inf)
                if langs:
                    x = features(part)
                    family, margin = choose(x, families, "", machines)
                    for k, f in enumerate(families):
                        rows = np.flatnonzero(family == k)
                        if len(rows):
                            best, inner = choose(x[rows], of[f], f, machines)
                            named[rows], least[rows] = np.array(of[f], object)[best], np.minimum(margin[rows], inner)
                score = np.where(letter, 1 / (1 + np.exp(-4 * least)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(at, len(part)) for c in columns), pa.array(np.where(letter, named, "und"), pa.string()), pa.array(score)], [*columns, *own]
                )

    return docs.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_FOLDS == 0
    langs, machines = learn(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), Scratch(spark, "language-id"))
    done = predict(docs, langs, machines, ["doc_id"])
    return done.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
