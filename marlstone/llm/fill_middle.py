"""Fill-in-the-middle over texts stored as seekable zstandard frames.

A text is stored as independent frames of bounded size, each with the number of units (tokens) and characters that end before
it ends. A cut after u units lies in the first frame whose count reaches u, so that only the frames that hold cuts are
decompressed, split and compressed again; all other frames of the output are those of the text, put in another order.
Digests, and the search for markers when a text is restored, stream the frames of the output in order, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import materialize, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Bytes of text in a frame.
FRAME_BYTES = 1 << 14
LEVEL = 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A frame's compressed bytes and its numbers of unit ends and characters.
Frame = tuple[bytes, int, int]


def _ends(b: np.ndarray) -> np.ndarray:
    """The ends of words that white space follows in b."""
    space = _SPACE[b]
    return np.flatnonzero(space[1:] & ~space[:-1]) + 1


def _characters(b: np.ndarray) -> int:
    return int(np.count_nonzero((b & 0xC0) != 0x80))


def pack(raw: bytes, frame_bytes: int = FRAME_BYTES) -> list[Frame]:
    """The frames of a text (UTF-8). A unit is a word with the white space before it; white space at the end of the text is one, too."""
    b, out, lo = np.frombuffer(raw, dtype=np.uint8), [], 0
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    while lo < len(b):
        hi = min(len(b), lo + frame_bytes)
        while hi < len(b) and b[hi] & 0xC0 == 0x80:  # a character is not cut
            hi += 1
        piece = b[lo:hi]
        last = hi == len(b) or (not _SPACE[piece[-1]] and bool(_SPACE[b[hi]]))  # a unit ends with the frame
        out.append((compress(raw[lo:hi]), len(_ends(piece)) + last, _characters(piece)))
        lo = hi
    return out


def read(frames: Iterable[Frame]) -> Iterator[bytes]:
    """The text, a frame at a time."""
    d = zstandard.ZstdDecompressor()
    return (d.decompress(f[0]) for f in frames)


def cut(frames: list[Frame], units: list[int], start: int = 0) -> tuple[list[list[Frame]], int]:
    """The frames parted after each number of units (ascending); frames that hold no cut stay as they are, and how many were opened."""
    out: list[list[Frame]] = []
    part: list[Frame] = []
    ended, opened = start, 0
    rest = list(reversed(frames))
    for u in units:
        while rest and ended + rest[-1][1] < u:
            f = rest.pop()
            part.append(f)
            ended += f[1]
        if u > ended and rest:
            f = rest.pop()
            raw = next(read([f]))
            opened += 1
            ends = _ends(np.frombuffer(raw, dtype=np.uint8))
            k = u - ended
            at = int(ends[k - 1]) if k <= len(ends) else len(raw)
            head, tail = _frame(raw[:at], k), _frame(raw[at:], f[1] - k)
            part += head
            rest += tail
            ended = u
        out.append(part)
        part = []
    return [*out, part + rest[::-1]], opened


def _frame(raw: bytes, units: int) -> list[Frame]:
    return [(zstandard.ZstdCompressor(level=LEVEL).compress(raw), units, _characters(np.frombuffer(raw, dtype=np.uint8)))] if raw else []


def digest(pieces: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
    return h.hexdigest()


def choose(doc_id, n: int, plain: bool, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, int, int]:
    """The form of a document of n units and the two places of its cuts, from the hash of its id (a missing id: nothing)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if plain or not n or h3 % 100 >= fim_percent:
        return "plain", a, b
    return ("spm" if h4 % 100 < spm_percent else "psm"), a, b


def transform(frames: list[Frame], form: str, a: int, b: int) -> tuple[list[Frame], int | None, int | None]:
    """The frames of the output, and the characters of prefix and middle (None if plain)."""
    if form == "plain":
        return frames, None, None
    (prefix, middle, suffix), _ = cut(frames, [a, b])
    p, s, m = ([*_frame(x, 0)] for x in (PREFIX, SUFFIX, MIDDLE))
    out = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
    return out, sum(f[2] for f in prefix), sum(f[2] for f in middle)


def _places(pieces: Iterable[bytes], markers: list[bytes]) -> tuple[list[int], int]:
    """Where the markers, which come in this order, begin in a stream of bytes, and its length."""
    found, tail, at = [], b"", 0  # at: the place of tail's first byte
    for p in pieces:
        seen = tail + p
        lo = 0
        while len(found) < len(markers) and (i := seen.find(markers[len(found)], lo)) >= 0:
            found.append(at + i)
            lo = i + 3
        keep = max(lo, len(seen) - 2)
        tail, at = seen[keep:], at + keep
    return found, at + len(tail)


def _section(frames: list[Frame], lo: int, hi: int) -> Iterator[bytes]:
    """Bytes lo to hi of the text of frames; frames outside are not opened."""
    at = 0
    for f in frames:
        size = zstandard.frame_content_size(f[0])
        if at < hi and at + size > lo:
            yield next(read([f]))[max(0, lo - at) : hi - at]
        at += size


def restore(frames: list[Frame], form: str) -> Iterator[bytes]:
    """The text that an output and its form came from, a piece at a time."""
    if form == "plain":
        yield from read(frames)
        return
    order = [PREFIX, SUFFIX, MIDDLE] if form == "psm" else [SUFFIX, PREFIX, MIDDLE]
    places, end = _places(read(frames), order)
    of = {m: (lo + 3, hi) for m, lo, hi in zip(order, places, [*places[1:], end], strict=True)}
    for m in (PREFIX, MIDDLE, SUFFIX):
        yield from _section(frames, *of[m])


_FRAMES = "array<struct<z: binary, units: long, chars: long>>"


def frame_table(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, n (units), marked (holds a marker) and frames for each row of docs(doc_id, text). A null text is an empty one: no units, no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                texts = [(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
                packed = [pack(t, frame_bytes) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([sum(f[1] for f in fs) for fs in packed], pa.int64()),
                     pa.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], pa.bool_()), _arrow(packed)], names=["doc_id", "n", "marked", "frames"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, StructType([docs.schema["doc_id"], *StructType.fromDDL(f"n long, marked boolean, frames {_FRAMES}")]))


def _arrow(packed: list[list[Frame]]) -> pa.Array:
    kind = pa.list_(pa.struct([("z", pa.binary()), ("units", pa.int64()), ("chars", pa.int64())]))
    return pa.array([[{"z": z, "units": u, "chars": c} for z, u, c in fs] for fs in packed], kind)


def _frames_of(b: pa.RecordBatch) -> list[list[Frame]]:
    return [[(f["z"], f["units"], f["chars"]) for f in fs] for fs in b.column("frames").to_pylist()]


def fill_in_middle(stored: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and frames (of the output) for each row of a frame_table.

    form is plain (the text itself) for texts that are empty or hold a marker and for all but fim_percent of the others, else spm or
    psm. Rows that repeat an id are cut alike if they have as many units. unframe turns frames into text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                forms, prefixes, middles, out = [], [], [], []
                for i, n, marked, frames in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("marked").to_pylist(), _frames_of(b), strict=True):
                    form, x, y = choose(i, n, marked, seed, fim_percent, spm_percent)
                    made, p, m = transform(frames, form, x, y)
                    forms.append(form)
                    prefixes.append(p)
                    middles.append(m)
                    out.append(made)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), _arrow(out)],
                                                 names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return stored.mapInArrow(run, StructType([stored.schema["doc_id"], *StructType.fromDDL(f"n long, form string, prefix_chars long, middle_chars long, frames {_FRAMES}")]))


def digests(outputs: DataFrame) -> DataFrame:
    """output_sha256 and restored_sha256 instead of the frames of fill_in_middle's rows; the text is rebuilt from output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                frames, forms = _frames_of(b), b.column("form").to_pylist()
                made, back = [digest(read(f)) for f in frames], [digest(restore(f, form)) for f, form in zip(frames, forms, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(made, pa.string()), pa.array(back, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    kept = [c for c in outputs.columns if c != "frames"]
    return outputs.mapInArrow(run, StructType([*(outputs.schema[c] for c in kept), *StructType.fromDDL("output_sha256 string, restored_sha256 string")]))


def unframe(outputs: DataFrame) -> DataFrame:
    """The rows with a column text instead of frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([b"".join(read(f)) for f in _frames_of(b)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), texts], names=[*kept, "text"])

    kept = [c for c in outputs.columns if c != "frames"]
    return outputs.mapInArrow(run, StructType([*(outputs.schema[c] for c in kept), *StructType.fromDDL("text string")]))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(frame_table(table(spark, sf_dir, "documents")), "frames", compression="none")
    return digests(fill_in_middle(stored))


QUERIES = {"op13_fill_middle": op13_fill_middle}
ORACLES = {"op13_fill_middle": r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
c as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint % (len(u) + 1) as a, ('0x' || h[9:16])::bigint % (len(u) + 1) as b, ('0x' || h[17:24])::bigint % 100 as d, ('0x' || h[25:32])::bigint % 100 as e
  from t),
f as (
  select *, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b) + 1:], '') as s,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d >= 50 then 'plain' when e < 80 then 'spm' else 'psm' end as form
  from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from f
"""}
