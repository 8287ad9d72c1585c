"""Katz backoff language model of any order: Good-Turing discounted counts with exactly normalised backoff weights.

The model is a table of words and, for each level from 2 to the order, a table of n-grams with the statistics of their
contexts, dealt over partitions by a hash of the context; none of it is ever held in one place. A context of level k is an
n-gram of level k - 1 and known by its id there. Texts are cut into chunks of tokens. Level by level, a chunk asks the
partitions for the counts (and ids) of its distinct n-grams and the statistics of their contexts; the same questions
carry the chunk's own training counts, so that one exchange both trains and answers. The partitions' tables are stored.
Later texts are scored by the same exchange, to which the stored tables bring the counts. Questions, answers and tables
are packed columns of integers, one row for each chunk and partition or for each partition.

P(w | context) is discounted where the n-gram was seen in training, else the context's weight times P(w | the context
without its first word); for the empty context it is discounted where the word was seen, else the mass that the discounts
leave, which all unseen words share as one event. A context that was not seen weighs 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from marlstone.llm.common import materialize, table
from marlstone.llm.wordhash import NON_SPACE, U, mix, words_of

#: Tokens in a chunk and in a partition of the tables, about.
CHUNK_TOKENS, PARTITION_TOKENS = 1_200_000, 1_500_000
#: Counts up to this are discounted.
K = 5
#: A context with at least this share of the tokens is split over SPLITS partitions; there are 1 / HOT_SHARE of them at most.
HOT_SHARE, SPLITS = 1e-4, 64
#: Words that an n-gram of the highest level has.
ORDER = 2
END = U(0xE5D0F1A2B3C4D5E7)
ROWS = 256


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes."""
    import zstandard

    v = np.ascontiguousarray(a, dtype="<i8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    width = b[0]
    planes = np.frombuffer(zstandard.decompress(b[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").reshape(-1)


def discounts(n: np.ndarray) -> np.ndarray:
    """By count from 0 to K: what a count is multiplied with. n[r] is how many have count r, up to K + 1.

    Where the Good-Turing estimate does not lie between 0 and 1 (few data), half a count is taken off instead.
    """
    d = np.ones(K + 1)
    half = (np.arange(1, K + 1) - 0.5) / np.arange(1, K + 1)
    if not (n[1 : K + 2] > 0).all():
        d[1:] = half
        return d
    cut = (K + 1) * n[K + 1] / n[1]
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:] = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - cut) / (1 - cut)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        d[1:] = half
    return d


@dataclass(frozen=True)
class Words:
    """What the chunks need to know of the word table as a whole."""

    tokens: int
    types: int
    docs: int
    discount: np.ndarray
    #: What counts are divided by, and the probability of all unseen words together.
    total: int
    unseen: float

    def probability(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words that occur c times in training."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, self.discount[np.where(c > K, 0, c)] * c / self.total, self.unseen)

    @staticmethod
    def of(tokens: int, types: int, docs: int, n: np.ndarray) -> Words:
        d = discounts(n)
        left = float(((1 - d[1:]) * np.arange(1, K + 1) * n[1 : K + 1]).sum()) / max(1, tokens)
        if left <= 0 and tokens:  # all words are frequent: one count more is set aside
            return Words(tokens, types, docs, d, tokens + 1, 1 / (tokens + 1))
        return Words(tokens, types, docs, d, tokens, left if tokens else 1.0)

    @property
    def hot(self) -> float:
        return max(1000.0, HOT_SHARE * self.tokens)


def held_out(doc_id: Column) -> Column:
    """Rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _chunks(docs: DataFrame, learn: bool = True) -> DataFrame:
    """One row for each chunk: its documents and tokens, and its words with their training counts, which are 0 unless it is to learn."""
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    arrow = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(id_type)), ("n_tokens", pa.int64()), ("held", pa.binary()), ("lens", pa.binary()),
                       ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def row(no: int, ids: list, held: list, parts: list, lens: list) -> pa.RecordBatch:
        h, n, out = np.concatenate(parts), np.concatenate(lens), np.array(held, dtype=np.int64)
        words, inverse, uses = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-uses, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        tokens = place[inverse]
        counts = np.bincount(tokens[np.repeat((out == 0) & learn, n)], minlength=len(words))
        return pa.RecordBatch.from_pylist([{
            "chunk": no, "doc_ids": ids, "n_tokens": len(h), "held": pack(out), "lens": pack(n), "tokens": pack(tokens),
            "hashes": words[order].tobytes(), "counts": pack(counts)}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no, size = TaskContext.get().partitionId() << 32, 0
        ids, held, parts, lens = [], [], [], []
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                w = words_of(b.column("text").to_pylist(), NON_SPACE)
                parts.append(np.insert(w.hashes, w.ptr[1:], END))
                lens.append(np.diff(w.ptr) + 1)
                ids += b.column("doc_id").to_pylist()
                held += b.column("held").to_pylist()
                size += len(parts[-1])
                if size >= CHUNK_TOKENS:
                    yield row(no, ids, held, parts, lens)
                    no, size, ids, held, parts, lens = no + 1, 0, [], [], [], []
        if ids:
            yield row(no, ids, held, parts, lens)

    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).cast("int").alias("held"))
    schema = StructType.fromDDL("chunk long, doc_ids array<long>, n_tokens long, held binary, lens binary, tokens binary, hashes binary, counts binary")
    schema["doc_ids"].dataType.elementType = docs.schema["doc_id"].dataType
    return given.mapInArrow(run, schema)


ANSWER = "kind int, chunk long, part int, x binary, y binary, z binary, stats array<double>, packed array<binary>"
_ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()),
                     ("stats", pa.list_(pa.float64())), ("packed", pa.list_(pa.binary()))])
WORD, GRAM, TOTAL, CONTEXT, MODEL = 1, 2, 3, 4, 5
#: The chunk that stands for a stored table among those that ask.
STORED = -1
_QUESTION = ("contexts", "runs", "hot", "steps", "own", "lower")


def _answer(kind: int, chunk: int = STORED, part: int = 0, x: bytes = b"", y: bytes = b"", z: bytes = b"", stats=(), packed=()) -> dict:
    return {"kind": kind, "chunk": chunk, "part": part, "x": x, "y": y, "z": z, "stats": list(map(float, stats)), "packed": list(packed)}


def _word_questions(chunks: DataFrame, parts: int) -> DataFrame:
    """By word partition and chunk: places in the chunk, hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, n = np.frombuffer(b.column("hashes")[i].as_py(), dtype=U), unpack(b.column("counts")[i].as_py())
                part = (h % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, order[lo:hi]) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _ in rows], pa.int32()), pa.array([b.column("chunk")[i].as_py()] * len(rows), pa.int64()),
                    pa.array([pack(np.diff(at, prepend=0)) for _, at in rows], pa.binary()), pa.array([h[at].tobytes() for _, at in rows], pa.binary()),
                    pa.array([pack(n[at]) for _, at in rows], pa.binary())], names=["part", "chunk", "at", "hashes", "counts"])

    return chunks.select("chunk", "hashes", "counts").mapInArrow(run, "part int, chunk long, at binary, hashes binary, counts binary")


def _word_answers(questions: DataFrame, parts: int) -> DataFrame:
    """To each chunk the ids and training counts of its words, one row of totals, and the part of the word table.

    Words seen in training get the first ids, frequent ones small ids, whatever unseen words are asked for beside them.
    """

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        hashes = [np.frombuffer(x.as_py(), dtype=U) for x in t.column("hashes")]
        counts = [unpack(x.as_py()) for x in t.column("counts")]
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(words)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        ids, out, lo = 1 + rank * parts + part, [], 0
        for chunk, at, h in zip(t.column("chunk").to_pylist(), t.column("at"), hashes, strict=True):
            own = inverse[lo : lo + len(h)]
            lo += len(h)
            if chunk != STORED:
                out.append(_answer(WORD, chunk, part, at.as_py(), pack(ids[own]), pack(total[own])))
        out.append(_answer(TOTAL, stats=[total.sum(), (total > 0).sum(), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]]))
        seen = order[total[order] > 0]
        out.append(_answer(MODEL, part=part, packed=[words[seen].tobytes(), pack(total[seen])]))
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return questions.groupBy("part").applyInArrow(run, ANSWER)


@dataclass(frozen=True)
class Level:
    """What the chunks need to know of a level of n-grams as a whole: discounts, and the statistics of split contexts."""

    number: int
    discount: np.ndarray
    hot: dict[int, list[float]]


class Chunk:
    """A chunk's tokens with all that the levels so far have answered: p is the probability of each token."""

    def __init__(self, row: pa.Table, answers: list[dict], words: Words, levels: list[Level], parts: int, learn: bool = True):
        self.words_known, self.parts, self.learn = words, parts, learn
        self.held, self.lens, self.tokens = (unpack(row.column(c)[0].as_py()) for c in ("held", "lens", "tokens"))
        self.n_words = int(self.tokens.max()) + 1
        self.word_ids, self.word_counts = np.zeros(self.n_words, dtype=np.int64), np.zeros(self.n_words, dtype=np.int64)
        for a in answers:
            if a["kind"] == WORD:
                at = np.cumsum(unpack(a["x"]))
                self.word_ids[at], self.word_counts[at] = unpack(a["y"]), unpack(a["z"])
        self.starts = np.cumsum(self.lens) - self.lens
        # the n-gram that ends at each token, in the level that was answered last, by place in the chunk; ids and counts by place
        self.item, self.ids, self.counts = self.tokens, self.word_ids, self.word_counts
        self.p = words.probability(self.word_counts)[self.tokens]
        for level in levels:
            self.ask(level.number)
            self.hear(level, [a for a in answers if a["kind"] == GRAM and a["level"] == level.number])

    def ask(self, level: int) -> None:
        """The distinct n-grams of the next level, in the order of their partitions: context v, word w, lower (what P(w) below is made of)."""
        context = np.concatenate(([0], self.item[:-1] + 1))
        context[self.starts] = 0  # the start of a text has id 0
        ids, counts = np.concatenate(([0], self.ids)), np.concatenate(([self.words_known.docs], self.counts))
        keys, self.gram_of = np.unique(context * self.n_words + self.tokens, return_inverse=True)
        first, second = keys // self.n_words, keys % self.n_words
        own = np.bincount(self.gram_of[np.repeat((self.held == 0) & self.learn, self.lens)], minlength=len(keys))
        w = self.word_ids[second]
        hot = counts[first] >= self.words_known.hot
        salt = np.where(hot, w % SPLITS + 1, 0)
        part = (mix(ids[first].astype(U) * U(SPLITS + 1) + salt.astype(U)) % U(self.parts)).astype(np.int64)
        self.order = o = np.lexsort((w, ids[first], part))
        self.part, self.v, self.w, self.hot, self.own, self.count_v = part[o], ids[first][o], w[o], hot[o], own[o], counts[first][o]
        below = np.empty(len(keys))
        below[self.gram_of] = self.p
        self.p_below, self.lower = below[o], self.word_counts[second][o] if level == 2 else below[o]
        self.cuts = np.searchsorted(self.part, np.arange(self.parts + 1))

    def runs(self, lo: int, hi: int) -> np.ndarray:
        """Where a new context begins among the n-grams from lo to hi."""
        return np.flatnonzero(np.diff(self.v[lo:hi], prepend=-1))

    def hear(self, level: Level, answers: list[dict]) -> None:
        total, ids = np.zeros(len(self.v), dtype=np.int64), np.zeros(len(self.v), dtype=np.int64)
        none = np.zeros(len(self.v), dtype=bool)
        few, mass = np.zeros((len(self.v), K)), np.zeros(len(self.v))
        for r in answers:
            lo, hi = self.cuts[r["part"]], self.cuts[r["part"] + 1]
            total[lo:hi] = unpack(r["x"])
            begin = self.runs(lo, hi)
            runs = np.diff(np.append(begin, hi - lo))
            none[lo:hi] = np.repeat(unpack(r["y"]) > 0, runs)
            open_ = (np.add.reduceat((total[lo:hi] == 0).astype(np.int64), begin) > 0) & ~self.hot[lo:hi][begin]
            f, m = np.zeros((len(begin), K)), np.zeros(len(begin))
            f[open_], m[open_] = unpack(r["z"]).reshape(-1, K), r["stats"]
            few[lo:hi], mass[lo:hi] = np.repeat(f, runs, axis=0), np.repeat(m, runs)
            if r["packed"]:
                ids[lo:hi] = unpack(r["packed"][0])
        if self.hot.any():
            names = np.array(sorted(level.hot), dtype=np.int64)
            stats = np.array([level.hot[int(k)] for k in names]).reshape(-1, K + 1)
            at = np.searchsorted(names, self.v[self.hot])
            few[self.hot], mass[self.hot] = stats[at, :K], stats[at, K]
            none[self.hot] = stats[at, :K].sum(axis=1) == 0
        cv = np.maximum(self.count_v, 1)
        # a context without counts up to K sets one count more aside
        seen = level.discount[np.where(total > K, 0, total)] * total / np.where(none, cv + 1, cv)
        left_over = np.where(none, 1 / (cv + 1), (few * _lost(level.discount)).sum(axis=1) / cv)
        weight = np.where(self.count_v > 0, left_over / np.maximum(1 - mass, 1e-12), 1.0)
        back = lambda x: _scatter(x, self.order)
        self.p = back(np.where(total > 0, seen, weight * self.p_below))[self.gram_of]
        self.item, self.ids, self.counts = self.gram_of, back(ids), back(total)


def _scatter(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[order] = x
    return out


def _lost(discount: np.ndarray) -> np.ndarray:
    """By count from 1 to K: what the discount takes from it."""
    return (1 - discount[1:]) * np.arange(1, K + 1)


def _floats(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a, dtype="<f8").tobytes(), 3)


def _packed(v: np.ndarray, w: np.ndarray, hot: np.ndarray, own: np.ndarray, lower: np.ndarray, level: int) -> dict[str, bytes]:
    """n-grams in the order of v and w: contexts with their runs, steps of words, counts and lower probabilities."""
    begin = np.flatnonzero(np.diff(v, prepend=-1))
    step = np.diff(w, prepend=0)
    step[begin] = w[begin]
    return {"contexts": pack(np.diff(v[begin], prepend=0)), "runs": pack(np.diff(np.append(begin, len(v)))), "hot": pack(hot[begin].astype(np.int64)),
            "steps": pack(step), "own": pack(own), "lower": pack(lower) if level == 2 else _floats(lower)}


def _questions(chunks: DataFrame, answers: DataFrame, words: Words, levels: list[Level], parts: int, learn: bool) -> DataFrame:
    """By partition and chunk the n-grams of the level after `levels`, with the chunk's training counts."""
    level = len(levels) + 2
    fields = [("part", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in _QUESTION)]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, right.to_pylist(), words, levels, parts, learn)
        c.ask(level)
        rows = []
        for p, (lo, hi) in enumerate(zip(c.cuts[:-1], c.cuts[1:], strict=True)):
            if lo < hi:
                rows.append({"part": p, "chunk": left.column("chunk")[0].as_py()} | _packed(*(x[lo:hi] for x in (c.v, c.w, c.hot, c.own, c.lower)), level))
        return pa.Table.from_pylist(rows, schema=pa.schema(fields))

    asking = chunks.select("chunk", "held", "lens", "tokens").groupBy("chunk")
    return asking.cogroup(answers.groupBy("chunk")).applyInArrow(ask, "part int, chunk long, " + ", ".join(f"{x} binary" for x in _QUESTION))


def _steps_back(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Ids from their steps, which start anew with each run."""
    total = np.cumsum(steps)
    begin = np.cumsum(runs) - runs
    return total - np.repeat(total[begin] - steps[begin], runs)


def _unpacked(row: dict, level: int) -> dict:
    import zstandard

    out = {c: unpack(row[c]) for c in _QUESTION[:-1]}
    out["lower"] = unpack(row["lower"]) if level == 2 else np.frombuffer(zstandard.decompress(row["lower"]), dtype="<f8")
    out["v"], out["w"] = np.repeat(np.cumsum(out["contexts"]), out["runs"]), _steps_back(out["steps"], out["runs"])
    return out


def _gram_answers(questions: DataFrame, words: Words, level: int, parts: int, last: bool) -> DataFrame:
    """To each chunk the training counts of its n-grams (and their ids unless the level is the last) and, for contexts with an
    n-gram unseen in training, how many have count 1 to K and the sum of the lower probabilities of those seen; the same in
    rows of their own for split contexts; and the part of the level's table."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        asked = [_unpacked(r, level) | {"chunk": r["chunk"]} for r in rows]
        v, w, lower = (np.concatenate([a[c] for a in asked]) for c in ("v", "w", "lower"))
        order = np.lexsort((w, v))
        new = np.flatnonzero((np.diff(v[order], prepend=-1) != 0) | (np.diff(w[order], prepend=-1) != 0))
        total = np.add.reduceat(np.concatenate([a["own"] for a in asked])[order], new)
        gram_of = _scatter(np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order)))), order)
        context, word, lower = v[order][new], w[order][new], lower[order][new]
        begin = np.flatnonzero(np.diff(context, prepend=-1))
        below = words.probability(lower) if level == 2 else lower
        mass = np.add.reduceat(np.where(total > 0, below, 0.0), begin)
        few = np.stack([np.add.reduceat((total == r).astype(np.int64), begin) for r in range(1, K + 1)], axis=1)
        names, out, lo = context[begin], [], 0
        part = rows[0]["part"]
        hot = np.unique(np.concatenate([np.cumsum(a["contexts"])[a["hot"] > 0] for a in asked]))
        # ids of n-grams seen in training do not depend on what is asked beside them
        ids = 1 + _scatter(np.arange(len(total)), np.argsort(total == 0, kind="stable")) * parts + part
        for a in asked:
            n = len(a["steps"])
            mine = gram_of[lo : lo + n]
            lo += n
            if a["chunk"] == STORED:
                continue
            answer = total[mine]
            at = np.searchsorted(names, np.cumsum(a["contexts"]))
            runs_at = np.cumsum(a["runs"]) - a["runs"]
            open_ = (np.add.reduceat((answer == 0).astype(np.int64), runs_at) > 0) & (a["hot"] == 0)
            none = few[at].sum(axis=1) == 0
            out.append(_answer(GRAM, a["chunk"], part, pack(answer), pack(none.astype(np.int64)), pack(few[at[open_]].reshape(-1)), mass[at[open_]],
                               [] if last else [pack(ids[mine])]))
        for i in np.searchsorted(names, hot):
            out.append(_answer(CONTEXT, x=int(names[i]).to_bytes(8, "little"), stats=[*few[i], mass[i]]))
        out.append(_answer(TOTAL, stats=np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]))
        seen = total > 0
        if seen.any():
            table = _packed(context[seen], word[seen], np.isin(context[seen], hot), total[seen], lower[seen], level)
            out.append(_answer(MODEL, part=part, packed=[table[c] for c in _QUESTION]))
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return questions.groupBy("part").applyInArrow(run, ANSWER)


def _scores(chunks: DataFrame, answers: DataFrame, words: Words, levels: list[Level], parts: int) -> DataFrame:
    id_type = to_arrow_type(chunks.schema["doc_ids"].dataType.elementType)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left, right.to_pylist(), words, levels, parts)
        known = c.word_counts[c.tokens]
        base = np.log10((known + 0.1) / (words.tokens + 0.1 * (words.types + 1)))
        add = lambda x: np.add.reduceat(x, c.starts)
        return pa.Table.from_arrays([
            pa.array(left.column("doc_ids")[0].as_py(), id_type), pa.array(c.held > 0), pa.array(c.lens), pa.array(add((known > 0).astype(np.int64))),
            pa.array(np.full(len(c.lens), words.tokens, dtype=np.int64)), pa.array(add(base)), pa.array(add(np.log10(c.p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = StructType.fromDDL("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    schema["doc_id"].dataType = chunks.schema["doc_ids"].dataType.elementType
    return chunks.select("chunk", "doc_ids", "held", "lens", "tokens").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(evaluate, schema)


def _totals(answers: DataFrame, n: int) -> np.ndarray:
    row = answers.where(F.col("kind") == TOTAL).agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(n)]).first()
    return np.array(list(row))


@dataclass(frozen=True)
class KatzModel:
    """A trained model: its tables by level (packed rows, one for each partition) and what holds for all of it."""

    spark: SparkSession
    tables: tuple[DataFrame, ...]
    words: Words
    levels: tuple[Level, ...]
    parts: int

    def _stored(self, level: int) -> DataFrame:
        return self.tables[level - 1].where(F.col("kind") == MODEL)

    def word_table(self) -> DataFrame:
        """hash, word (its id) and count of each word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    h, n = np.frombuffer(r["packed"][0], dtype=U).view(np.int64), unpack(r["packed"][1])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(1 + np.arange(len(h)) * parts + r["part"]), pa.array(n)], names=["hash", "word", "count"])

        parts = self.parts
        return self._stored(1).select("part", "packed").mapInArrow(run, "hash long, word long, count long")

    def ngram_table(self, level: int) -> DataFrame:
        """context (0: the start of a text; else an id of the level below), word, count and lower (P(word) below) of each n-gram."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    g = _unpacked(dict(zip(_QUESTION, r["packed"], strict=True)), level)
                    below = words.probability(g["lower"]) if level == 2 else g["lower"]
                    yield pa.RecordBatch.from_arrays([pa.array(g["v"]), pa.array(g["w"]), pa.array(g["own"]), pa.array(below)], names=["context", "word", "count", "lower"])

        words = self.words
        return self._stored(level).select("packed").mapInArrow(run, "context long, word long, count long, lower double")

    def context_table(self, level: int) -> DataFrame:
        """context, total and backoff: what P below is multiplied with for words that were not seen after the context."""
        lost = F.coalesce(F.get(F.array(*map(F.lit, [0.0, *_lost(self.levels[level - 2].discount).tolist()])), F.col("count").cast("int")), F.lit(0.0))
        sums = self.ngram_table(level).groupBy("context").agg(
            F.sum("count").alias("total"), F.sum("lower").alias("mass"), F.sum(lost).alias("lost"), F.min("count").alias("least"))
        left = F.when(F.col("least") > K, 1 / (F.col("total") + 1)).otherwise(F.col("lost") / F.col("total"))
        return sums.select("context", "total", (left / F.greatest(1 - F.col("mass"), F.lit(1e-12))).alias("backoff"), "mass", "least")

    def score(self, docs: DataFrame) -> DataFrame:
        """As score_texts, for any docs(doc_id, text), none of which is learned from."""
        return _run(docs, len(self.levels) + 1, self)[1]


def _run(docs: DataFrame, order: int, model: KatzModel | None) -> tuple[KatzModel, DataFrame]:
    """The model learned from docs that are not held out (or `model`, which learns nothing), and the scores of docs."""
    if order < 2:
        raise ValueError("order must be at least 2")
    chunks = materialize(_chunks(docs, model is None), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = model.parts if model else max(16, -(-size // PARTITION_TOKENS))
    asked = _word_questions(chunks, parts)
    if model:
        asked = asked.unionByName(model._stored(1).select("part", F.lit(STORED).cast("long").alias("chunk"), F.lit(pack(np.zeros(0))).alias("at"),
                                                          F.col("packed")[0].alias("hashes"), F.col("packed")[1].alias("counts")))
    tables = [materialize(_word_answers(asked, parts), "words")]
    tokens, types, *n = _totals(tables[0], K + 4)
    n_docs = model.words.docs if model else docs.where(~held_out(F.col("doc_id"))).count()
    words = Words.of(int(tokens), int(types), n_docs, np.array(n))
    answers = tables[0].where(F.col("kind") == WORD).withColumn("level", F.lit(1))
    levels: list[Level] = []
    for k in range(2, order + 1):
        asked = _questions(chunks, answers, words, levels, parts, model is None)
        if model:
            asked = asked.unionByName(model._stored(k).select("part", F.lit(STORED).cast("long").alias("chunk"), *(F.col("packed")[i].alias(c) for i, c in enumerate(_QUESTION))))
        tables.append(materialize(_gram_answers(asked, words, k, parts, k == order), "ngrams"))
        split = tables[-1].where(F.col("kind") == CONTEXT).groupBy("x").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 1)])
        hot = {int.from_bytes(r[0], "little"): list(r[1:]) for r in split.collect()}  # 1 / HOT_SHARE rows at most
        levels.append(Level(k, discounts(_totals(tables[-1], K + 2)), hot))
        answers = answers.unionByName(tables[-1].where(F.col("kind") == GRAM).withColumn("level", F.lit(k)))
    return model or KatzModel(docs.sparkSession, tuple(tables), words, tuple(levels), parts), _scores(chunks, answers, words, levels, parts)


def train(docs: DataFrame, order: int = ORDER) -> KatzModel:
    """The model of the rows of docs(doc_id, text) that are not held out; its tables are in the shared folder.

    Null and empty texts consist of the end alone; rows that repeat count each; rows without an id are held out; extra
    columns are ignored. Of an empty table the model gives any text the score 0.
    """
    return _run(docs, order, None)[0]


def score_texts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs(doc_id, text).

    The model is learned from the rows that are not held out, in the exchange that answers. Null and empty texts consist
    of the end alone; rows that repeat count and score each by itself; rows without an id are held out; extra columns are
    ignored. An empty table gives an empty result; without training rows the score is 0 for any text.
    """
    return _run(docs, order, None)[1]


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLES: dict[str, str] = {}
