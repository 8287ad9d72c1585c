"""Scores of sets of queries, document by document: what a document holds of all queries' phrases or tokens meets in one task, so that no pair of
a query and a document is ever shuffled but the best ones of each task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that are scored at once in a task, and queries that are scored in one pass.
ROWS, BLOCK = 256, 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths


def _spread(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of lengths in a row."""
    return np.arange(lengths.sum()) - np.repeat(_starts(lengths), lengths)


def grouped_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a last column of tokens as rows of their distinct tokens, each with its positions in order."""
    for batch in _slices(batches):
        lists = batch.column(batch.num_columns - 1)
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        if not sizes.sum():
            continue
        flat = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)
        both = row * len(flat.dictionary) + np.asarray(flat.indices)
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        at = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(_spread(sizes)[order], pa.int32()))
        own = pa.array(row[order][first])
        token = flat.dictionary.take(pa.array(np.asarray(flat.indices)[order][first]))
        kept = range(batch.num_columns - 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in kept), token, at], names=[*(batch.schema.names[i] for i in kept), "token", "positions"])


class Sequences:
    """Where sequences of tokens, each given once, stand in a row in lists of tokens."""

    def __init__(self, wanted: list[tuple[str, ...]]):
        self.tokens = sorted({t for s in wanted for t in s})
        code = {t: i for i, t in enumerate(self.tokens)}
        self.coded = [np.array([code[t] for t in s]) for s in wanted]
        self.single = np.full(len(code) + 1, -1)
        for i, w in enumerate(self.coded):
            if len(w) == 1:
                self.single[w[0]] = i
        self.several = [i for i, w in enumerate(self.coded) if len(w) > 1]

    def find(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The row, the number of the sequence and the place in the row (from 0) of each occurrence."""
        sizes, flat = np.asarray(lists.value_lengths().fill_null(0)), lists.flatten()
        ids = np.asarray(pa.compute.index_in(flat, value_set=pa.array(self.tokens, flat.type)).fill_null(-1))
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(ids >= 0)
        one = self.single[ids[at]]
        found, places = [one[one >= 0]], [at[one >= 0]]
        if self.several:
            order = at[np.argsort(ids[at], kind="stable")]
            bound = np.searchsorted(ids[order], np.arange(len(self.tokens) + 1))
            held = np.diff(bound)
            for i in self.several:
                w = self.coded[i]
                by = np.argsort(held[w], kind="stable")  # the rarest token of these rows first
                begun = order[bound[w[by[0]]] : bound[w[by[0]] + 1]] - by[0]
                begun = begun[(begun >= 0) & (begun + len(w) <= len(ids))]
                for j in by[1:]:
                    if not len(begun):
                        break
                    begun = begun[ids[begun + j] == w[j]]
                begun = begun[row[begun] == row[begun + len(w) - 1]]
                found.append(np.full(len(begun), i))
                places.append(begun)
        place = np.concatenate(places)
        return row[place], np.concatenate(found), place - _starts(sizes)[row[place]]


def phrase_counts(wanted: list[tuple[str, ...]], weights: list[float], key: str):
    """For Index.mapped: n, the numbers p of the wanted phrases that a document holds, and f: how often, weighted by field."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(wanted)
        for batch in _slices(batches):
            rows, ps, ws = [], [], []
            for i, weight in enumerate(weights):
                row, p, _ = sequences.find(batch.column(f"t{i}"))
                rows.append(row)
                ps.append(p)
                ws.append(np.full(len(row), weight))
            both, which = np.unique(np.concatenate(rows) * len(wanted) + np.concatenate(ps), return_inverse=True)
            f = np.bincount(which, np.concatenate(ws), len(both))
            offsets = pa.array(np.searchsorted(both, np.arange(batch.num_rows + 1) * len(wanted)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(both % max(1, len(wanted)), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(f, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("generation"), batch.column("n_tokens").cast(pa.float64()), *lists], names=[key, "generation", "n", "p", "f"])

    return counted


def sequence_places(wanted: list[tuple[str, ...]], column: str, key: str):
    """For Index.mapped: the number p and the start (from 0) of each place at which a wanted sequence stands in a document."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(wanted)
        for batch in _slices(batches):
            row, p, start = sequences.find(batch.column(column))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(own), batch.column("generation").take(own), pa.array(p, pa.int32()), pa.array(start, pa.int32())], names=[key, "generation", "p", "start"])

    return placed


def contained(tokens: list[str], column: str):
    """For mapInArrow: the rows, and the numbers p (in order) of the tokens that lie within a column; rows without any are left out."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = {t: i for i, t in enumerate(tokens)}, sorted({len(t) for t in tokens})
        for batch in batches:
            texts = batch.column(column).to_pylist()
            p = [sorted({known[s] for n in lengths for i in range(len(t) - n + 1) if (s := t[i : i + n]) in known}) for t in texts]
            own = pa.array([i for i, x in enumerate(p) if x], pa.int64())
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in kept), pa.array([x for x in p if x], pa.list_(pa.int32()))], names=[*kept, "p"])

    return held


def by_document(rows: DataFrame, key: str) -> DataFrame:
    """key, n, p and f from rows(key, p, f), some of them of the same key and p: f is added up; the row with p = -1 has n, and a key without others is left out."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            keys = t.column(0).combine_chunks().dictionary_encode()
            d = pd.DataFrame({"k": np.asarray(keys.indices), "p": np.asarray(t.column(1)), "f": np.asarray(t.column(2))}).groupby(["k", "p"], as_index=False).sum()
            n = d[d.p < 0].set_index("k").f
            d = d[d.p >= 0]
            sizes = d.groupby("k").size()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy())]), pa.int32())
            return pa.RecordBatch.from_arrays([
                keys.dictionary.take(pa.array(sizes.index.to_numpy())), pa.array(n.reindex(sizes.index).to_numpy(), pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(d.p.to_numpy(), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(d.f.to_numpy(), pa.float64()))], names=[key, "n", "p", "f"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 100_000:
                continue
            keys = held.column(0)
            change = np.flatnonzero(np.asarray(pa.compute.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))))
            if len(change):  # all but the last key are complete
                yield out(held.slice(0, int(change[-1]) + 1))
                held = held.slice(int(change[-1]) + 1)
        if held is not None and held.num_rows:
            yield out(held)

    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))
    return dealt.mapInArrow(gathered, f"`{key}` {kind}, n double, p array<int>, f array<double>")


class Best:
    """The best `limit` keys of each query among those seen so far: higher scores first, then smaller keys. Without a limit, all that scored."""

    def __init__(self, queries: int, limit: int | None):
        self.limit, self.least = limit, np.zeros(queries)
        self.kept: list[pd.DataFrame] = []
        self.n, self.begun = 0, False

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        row, q = np.nonzero((scores > 0) & (scores >= self.least))
        if len(row):
            self.kept.append(pd.DataFrame({"q": q, "score": scores[row, q], "key": keys[row]}))
            self.n += len(row)

    def cut(self) -> pd.DataFrame:
        rows = pd.concat(self.kept) if self.kept else pd.DataFrame({"q": [], "score": [], "key": []})
        if self.limit is not None and len(rows):
            rows = rows.sort_values(["q", "score", "key"], ascending=[True, False, True]).groupby("q").head(self.limit)
            of = rows.groupby("q").score.agg(["size", "min"])
            of = of[of["size"] >= self.limit]
            self.least[of.index.to_numpy().astype(int)] = of["min"].to_numpy()
        self.kept, self.n, self.begun = [rows], len(rows), True
        return rows

    @property
    def many(self) -> bool:
        return self.n > 4 * (self.limit or 0) * len(self.least) + 20_000


def best_rows(docs: DataFrame, key: str, ids: list, kind: str, limit: int | None, scores) -> DataFrame:
    """query_id (ids, of that kind), key and score of what can be among the best `limit` documents of each query; scores() makes, once for each task, a function of
    a slice of docs to an array of scores by document and query, 0 for none."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, score, form = Best(len(ids), limit), scores(), None

        def out(rows: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids[int(q)] for q in rows.q], {"int": pa.int32()}.get(kind)), pa.array(rows.key.tolist(), form), pa.array(rows.score.to_numpy(), pa.float64())], names=["query_id", key, "score"])

        for batch in _slices(batches):
            form = batch.schema.field(key).type
            best.add(score(batch), batch.column(key).to_pandas().to_numpy(dtype=object))
            if best.many or not best.begun:
                rows = best.cut()
                if limit is None:
                    yield out(rows)
                    best.kept, best.n = [], 0
        if best.n:
            yield out(best.cut())

    return docs.mapInArrow(found, f"query_id {kind}, `{key}` {docs.schema[key].dataType.simpleString()}, score double")


def phrase_scores(of: np.ndarray, idf: np.ndarray, average: float, k1: float, b: float, every: bool):
    """For best_rows over by_document: BM25 of the queries that have phrase p of[p, q] times; with `every`, of documents with all phrases of a query."""
    whole = (of > 0).astype(np.float32)
    need = whole.sum(axis=0)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        p, f = batch.column("p"), np.asarray(batch.column("f").flatten(), np.float64)
        sizes = np.asarray(p.value_lengths())
        row, p = np.repeat(np.arange(len(sizes)), sizes), np.asarray(p.flatten())
        n = np.asarray(batch.column("n"))[row]
        held = np.zeros((len(sizes), len(idf)))
        held[row, p] = idf[p] * f * (k1 + 1) / (f + k1 * (1 - b + b * n / average))
        out = np.round(held @ of, 9)
        if every:
            out[((held > 0).astype(np.float32) @ whole) < need] = 0
        return out

    return score


def path_scores(of: np.ndarray, df: np.ndarray):
    """For best_rows over (m, p): 1 / df for each token of a query that a path of m documents holds, m times."""
    worth = of / np.maximum(df, 1)[:, None]

    def score(batch: pa.RecordBatch) -> np.ndarray:
        p = batch.column("p")
        sizes = np.asarray(p.value_lengths())
        out = np.zeros((len(sizes), worth.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(sizes)), sizes), worth[np.asarray(p.flatten())])
        return np.round(out * np.asarray(batch.column("m"))[:, None], 9)

    return score


def containment_scores(tokens: list[str], of: np.ndarray, column: str):
    """For best_rows over documents with a column of (field, units): in how many fields each token of a query lies within a unit, added over its tokens."""
    known, weights = {t: i for i, t in enumerate(tokens)}, of.astype(np.float32)
    lengths = sorted({len(t) for t in tokens})

    def within(unit: str) -> np.ndarray:
        return np.array(sorted({known[s] for n in lengths if n <= len(unit) for i in range(len(unit) - n + 1) if (s := unit[i : i + n]) in known}), np.int32)

    seen: dict[str, np.ndarray] = {}

    def score(batch: pa.RecordBatch) -> np.ndarray:
        fields = batch.column(column)
        per = np.asarray(fields.value_lengths())
        units = fields.flatten().field("units")
        out = np.zeros((len(per), weights.shape[1]))
        if not len(units):
            return out
        sizes = np.asarray(units.value_lengths())
        coded = units.flatten().dictionary_encode()
        if len(seen) > 200_000:
            seen.clear()
        held = [seen[u] if u in seen else seen.setdefault(u, within(u)) for u in coded.dictionary.to_pylist()]
        n = np.array([len(h) for h in held], np.int64)
        if not n.sum():
            return out
        code = np.asarray(coded.indices)
        entry = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n[code])
        at = np.repeat(_starts(n)[code], n[code]) + _spread(n[code])
        found = np.zeros((len(sizes), len(tokens)), np.float32)
        found[entry, np.concatenate(held)[at]] = 1
        np.add.at(out, np.repeat(np.arange(len(per)), per), found @ weights)
        return np.round(out)

    return score
