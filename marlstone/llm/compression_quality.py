"""Quality by compression: which of two dictionaries, of good and of bad text, shrinks a text more.

Two zstandard dictionaries are built from labelled texts. Every whole text is cut into blocks, each block is
compressed with either dictionary, and the difference of the summed sizes, divided by the text's size, becomes
a score through a logistic calibration fitted on other labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import materialize, table

#: Labelled documents used for fitting at most, of each label; half build the dictionary, half calibrate.
MAX_EACH = 1_500
#: A dictionary is trained on SAMPLES pieces of SAMPLE_BYTES of each of its texts at most, evenly spread over the whole
#: text, and has DICT_BYTES at most. Calibration and scores read whole texts.
SAMPLES, SAMPLE_BYTES, DICT_BYTES = 8, 512, 110 << 10
#: Texts are compressed in blocks, so that a long text does not become its own dictionary.
BLOCK = 4_096
LEVEL = 3


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def samples(raw: bytes, most: int = SAMPLES) -> list[bytes]:
    """At most `most` pieces of a text, evenly spread from its beginning to its end."""
    n = -(-len(raw) // SAMPLE_BYTES)
    return [raw[i * SAMPLE_BYTES : (i + 1) * SAMPLE_BYTES] for i in sorted({k * n // min(n, most) for k in range(min(n, most))})] if n else []


def build_dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary trained on pieces of texts; the pieces themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:]


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=params)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / bytes of the text; 0 for an empty or null text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return 0.0
    g, b = _compressor(good), _compressor(bad)
    return sum(len(b.compress(x)) - len(g.compress(x)) for x in blocks(raw)) / len(raw)


def logistic(x: list[float], y: list[int], steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a light ridge; each label has the same total weight."""
    a, t = np.array(x, dtype=float), np.array(y, dtype=float)
    if not len(t) or t.min() == t.max():
        return 0.0, 0.0
    w = np.where(t == 1, 0.5 / (t == 1).mean(), 0.5 / (t == 0).mean())
    m, s = float(a.mean()), float(a.std()) or 1.0
    z, k = np.stack([(a - m) / s, np.ones(len(a))], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ k, -30, 30)))
        grad = z.T @ (w * (p - t)) + 1e-2 * k
        k = k - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
    return float(k[0] / s), float(k[1] - k[0] * m / s)


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, text: str | None) -> float:
        v = self.slope * difference(text, self.good, self.bad) + self.intercept
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_EACH) -> DataFrame:
    """doc_id, label, builds (for the dictionaries, else for calibration) and text: one row for each of at most `most`
    ids of each label, chosen by a hash of the id among rows that are not held out."""
    clean = (
        labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("hi"), F.min("quality").alias("lo")).where("hi = lo")
        .select("doc_id", F.col("hi").alias("label"), F.xxhash64(F.lit("fit"), "doc_id").alias("h"))
    )
    chosen = clean.where("label = 0").orderBy("h", "doc_id").limit(most).union(clean.where("label = 1").orderBy("h", "doc_id").limit(most))
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # 2 * most rows
    return joined.groupBy("doc_id", "label", (F.pmod("h", F.lit(2)) == 0).alias("builds")).agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EACH) -> CompressionModel:
    """Learn from rows that are not held out: at most `most` ids of each label, half for the dictionaries and half, whole
    texts, for calibration.

    Ids with null or contradicting labels and null texts are left out; of an id with several texts the first by code
    point counts. With one label only, all scores are 0.5.
    """
    chosen = materialize(labelled_texts(docs, labels, most), "labelled")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(
                [samples(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], names=["doc_id", "label", "pieces"])

    schema = StructType([chosen.schema["doc_id"], *StructType.fromDDL("label int, pieces array<binary>")])
    parts = chosen.select("doc_id", F.col("label").cast("int").alias("label"), "builds", "text")
    pieces = parts.where("builds").mapInArrow(cut, schema).orderBy("doc_id").collect()  # most * SAMPLES * SAMPLE_BYTES for each label
    good, bad = (build_dictionary([bytes(x) for r in pieces if r.label == label for x in r.pieces]) for label in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(
                [difference(t, good, bad) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "label", "x"])

    schema = StructType([chosen.schema["doc_id"], *StructType.fromDDL("label int, x double")])
    rest = parts.where("not builds").mapInArrow(measure, schema).orderBy("doc_id").collect()  # 2 * most numbers
    slope, intercept = logistic([r.x for r in rest], [r.label for r in rest])
    return CompressionModel(good, bad, slope, intercept)


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted for every row of docs(doc_id, text).

    Empty and null texts score as a difference of 0. Rows repeat as they repeat, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], *StructType.fromDDL("score double")]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
