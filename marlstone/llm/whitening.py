"""Embedding whitening by a weighted covariance of distinct vectors.

1. Entries become integers, x = floor(64 * c) + 1000000. Rows whose x vectors are equal are one distinct vector with a
   multiplicity, so that copies are added up before anything is multiplied.
2. Sums of each dimension are exact. Vectors are centred on them as integers, n * x - S, and only then divided and multiplied:
   every task adds one matrix product of its vectors, weighted with their multiplicity (or one), and the products are
   summed by rows of the matrix.
3. The eigenvectors of that d by d matrix are found on the driver; d is the dimension and does not grow with the rows.
4. Each distinct vector is whitened once and stored; the rows of the input join it by their x vector. Vectors with a
   large share of the rows are few, so those rows and the whitened vector are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import materialize, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries from here on do not fit a long integer.
LIMIT = 2.0**62
#: Eigenvalues under this share of the largest are no components: the vectors do not spread in that direction.
FLAT = 1e-12
#: Vectors with more than 1 / HOT of the rows (fewer than HOT of them) are dealt over tasks with up to 1 / HOT of the rows each.
HOT = 256
_MAX = (1 << 63) - 1


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, d and key for each row with a vector: its length and its x entries as little-endian 64-bit integers. Rows whose vector is
    null or has entries that are null, not finite or too large for a long x are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("embedding")
            lengths = np.diff(vectors.offsets.to_numpy())
            entries = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum())) if len(vectors) else vectors.values
            c = entries.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE  # null becomes NaN
            good = np.abs(c) < LIMIT  # false for NaN
            x = np.floor(np.where(good, c, 0.0)).astype("<i8") + SHIFT
            ends = np.concatenate(([0], np.cumsum(lengths)))
            bad = np.concatenate(([0], np.cumsum(~good)))
            keep = (bad[ends[1:]] == bad[ends[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            raw, at = x.tobytes(), 8 * ends
            keys = [raw[at[i] : at[i + 1]] for i in np.flatnonzero(keep)]
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").filter(pa.array(keep)), pa.array(lengths[keep].astype(np.int32)), pa.array(keys, pa.binary())], names=["vec_id", "d", "key"])

    schema = StructType([embeddings.schema["vec_id"], *StructType.fromDDL("d int, key binary")])
    return embeddings.select("vec_id", "embedding").mapInArrow(run, schema)


def _matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    """The x vectors of a batch, a row each."""
    return np.frombuffer(b"".join(b.column("key").to_pylist()), dtype="<i8").reshape(-1, d)


@dataclass
class Whitening:
    """n and S of the fit list, the eigenvalues e and eigenvectors (columns) of its covariance, and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit, else Python's."""
        quotient = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = [s % self.n for s in self.sums]
        if len(x) and self.n * (max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, map(int, quotient)), default=0) + 1) < 1 << 62:
            return (x - quotient) * self.n - np.array(rest, dtype=np.int64)
        return (x.astype(object) - quotient.astype(object)) * self.n - np.array(rest, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles."""
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2 of each vector, exact; null where it does not fit a long."""
        y = self.numerators(x)
        if y.dtype == object or (y.size and max(abs(int(y.min())), abs(int(y.max()))) ** 2 * y.shape[1] > _MAX):
            exact = [sum(int(v) ** 2 for v in row) for row in y]
            return [v if v <= _MAX else None for v in exact]
        return (y * y).sum(axis=1).tolist()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _sums(distinct: DataFrame, d: int, weight: str) -> tuple[int, list[int]]:
    """n and the exact sums of the d dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for b in batches:
            x, w = _matrix(b, d), b.column("w").to_numpy()
            if len(x):
                small = max(abs(int(x.min())), abs(int(x.max()))) * int(w.sum()) < 1 << 62
                added = w @ x if small else (w.astype(object)[:, None] * x.astype(object)).sum(axis=0)
                total = [t + int(a) for t, a in zip(total, [w.sum(), *added], strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d + 1), pa.int32()), "s": pa.array([str(t) for t in total])})

    rows = distinct.select("key", F.col(weight).alias("w")).mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    total = {r.i: int(r.s) for r in rows}  # d + 1 rows
    return total.get(0, 0), [total.get(i, 0) for i in range(1, d + 1)]


def _gram(rows: DataFrame, width: int, n: int, read) -> np.ndarray:
    """The sum of w * y y' over rows, divided by n; read gives the centred vectors y and the weights w of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            y, w = read(b)
            total += (y * w[:, None]).T @ y
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * width + 1, width), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), lists], names=["i", "v"])

    parts = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width ** 2 rows
        out[r.i, r.j] = r.v / n
    return (out + out.T) / 2


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS, weights: str = "counts") -> Whitening | None:
    """The whitening of distinct(key, copies), whose vectors have d dimensions; None if they do not spread at all.

    weights: "counts" fits each distinct vector with its multiplicity, "one" with one.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    if not d:
        return None
    rows = distinct.withColumn("one", F.lit(1).cast("long"))
    weight = "copies" if weights == "counts" else "one"
    n, sums = _sums(rows, d, weight)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    v = _gram(rows.select("key", F.col(weight).alias("w")), d, n, lambda b: (model.centred(_matrix(b, d)), b.column("w").to_numpy().astype(np.float64)))
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    kept = min(components, int(np.count_nonzero(e > FLAT * e[0])) if e[0] > 0 else 0)
    return Whitening(n, sums, e[:kept].copy(), vectors[:, :kept].copy(), float(np.trace(v))) if kept else None


def identity_error(whitened: DataFrame, weight: str, model: Whitening) -> float:
    """The largest entry, without sign, of the covariance of whitened(z, weight) minus the identity."""
    k = len(model.values)

    def read(b: pa.RecordBatch) -> np.ndarray:
        return b.column("z").flatten().to_numpy().reshape(-1, k)

    sums = whitened.select(F.posexplode("z").alias("i", "v"), weight).groupBy("i").agg(F.sum(F.col("v") * F.col(weight)).alias("s")).collect()  # k rows
    mean = np.zeros(k)
    for r in sums:
        mean[r.i] = r.s / model.n
    v = _gram(whitened.select("z", F.col(weight).alias("w")), k, model.n, lambda b: (read(b) - mean, b.column("w").to_numpy().astype(np.float64)))
    return float(np.abs(v - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error for each row of embeddings
    (vec_id, embedding) that has a proper vector, and each component up to `components`.

    A vector that is null, or has an entry that is null, not finite or of 2 ** 56 or more, is left out. The dimension is the length
    that most rows have, the larger one in a tie; vectors of other lengths are left out. Directions in which the vectors do not
    spread (rank deficiency, a single distinct vector, an empty table) are no components. A deviation beyond 64 bits is null. Repeated
    rows and ids each give their rows; a missing id stays null. Extra columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings)
    counted = materialize(rows.groupBy("d", "key").agg(F.count("*").alias("copies")), "distinct", few=False)
    top = counted.groupBy("d").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    d = top.d if top else 0
    distinct = counted.where(F.col("d") == d).select("key", "copies")
    model = fit(distinct, d, components, weights)
    schema = StructType([embeddings.schema["vec_id"], *StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, d)
            z = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k), pa.int32()), pa.array(model.whiten(x).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), pa.array(model.deviations(x), pa.int64()), z], names=["key", "copies", "deviation", "z"])

    whitened = materialize(distinct.mapInArrow(run, "key binary, copies long, deviation long, z array<double>"), "whitened").withColumn("one", F.lit(1).cast("long"))
    error = identity_error(whitened, "copies" if weights == "counts" else "one", model)
    share = max(1, top.n // HOT)
    hot = F.broadcast(distinct.where(F.col("copies") > share).select("key", F.ceil(F.col("copies") / share).cast("int").alias("parts")))  # fewer than HOT rows
    left = rows.where(F.col("d") == d).join(hot, "key", "left").select(
        "vec_id", "key", F.coalesce(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    right = whitened.join(hot, "key", "left").select(
        "key", "deviation", "z", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return left.join(right, ["key", "part"]).select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "i").alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
