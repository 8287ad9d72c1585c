"""Token ids of whole texts and their binary form, and exact counts of tokens.

Ids are ranked by their frequency in the corpus, so that frequent ids are small numbers. A document's ranks
are written in a byte-aligned variable-length code: one stream of control bytes with two bits for each
value (its length less one) and one stream of data bytes. Decoding looks control bytes up in a numpy
table of lengths. Blocks of documents are rows of Parquet files in the shared folder, in ascending order of
doc_id, with the position of their first id in the shard, so that any reader of the store can take any block.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import materialize, shared_dir, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Ids in one block of a file, about; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Pieces of words that a Python worker remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64
#: Documents in one shard, about.
SHARD_ROWS = 20_000
#: Texts that are encoded together.
TEXTS = 256


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blanks_part(config: dict) -> bool:
    """Whether a tokenizer's file says that what blanks part is encoded each by itself and blanks give no ids.

    Its normaliser may compose, lower-case and replace white space; its first split must keep matches of a pattern
    only, none of which takes a blank or a newline in.
    """
    import regex

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else x[inner] if x["type"] == "Sequence" else [x]

    for n in steps(config.get("normalizer"), "normalizers"):
        if not (n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "):
            return False
    split, *rest = steps(config.get("pre_tokenizer"), "pretokenizers") or [{"type": None}]
    if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in rest):
        return False
    if config.get("post_processor") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in config["added_tokens"]):
        return False
    around = ["a{}b", "{}", "1{}2", ".{}!", "'{}s", "a{}", "{}b", "{}.", "a{0}{0}b"]
    return not any(c in m[0] for c in " \n" for x in around for m in regex.finditer(split["pattern"]["Regex"], x.format(c)))


# The characters of the short way (ASCII but for "<", and Latin-1 letters that are their own composed form), and
# the pieces that texts of them fall into, lower-cased; Encoder compares them with the tokenizer's own pattern.
_PLAIN = re.compile(r"[\t\n\r -;=-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder(dict):
    """Texts to ids by the tokenizers library; remembers the ids of pieces of words.

    Where blanks part a text (see blanks_part) and the file's pattern cuts plain texts as _PIECE does, pieces of those go to the
    library's model once each, the words of other texts to the library; the first texts are compared with what the library
    gives for them whole. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        #: ids fit in two bytes or take four
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.parted = blanks_part(config)
        self.plain = self.parted and self._cuts_alike(config)
        letters = _byte_letters()
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}
        self.unchecked = 8

    @staticmethod
    def _cuts_alike(config: dict) -> bool:
        """Whether the file lower-cases, cuts all pairs of plain characters, and contractions, as _PIECE does, and gives pieces
        byte by byte to its model."""
        import regex

        split = config["pre_tokenizer"]
        if '"Lowercase"' not in json.dumps(config["normalizer"]) or config["model"]["type"] != "BPE" or split["type"] != "Sequence":
            return False
        if [x["type"] for x in split["pretokenizers"]] != ["Split", "ByteLevel"] or any("<" not in t["content"] for t in config["added_tokens"]):
            return False
        own = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"])
        plain = [c for c in map(chr, range(0x100)) if _PLAIN.fullmatch(c) and c == c.lower()]
        return all(own.findall(x) == _PIECE.findall(x) for x in [
            *(a + b for a in plain for b in plain), *(f"a'{e}{c}" for e in ("s", "t", "re", "ve", "m", "ll", "d", "r", "v", "l", "") for c in plain)])

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.code, [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.spelled))]).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def _text(self, text: str) -> bytes:
        if text.isascii() and "<" not in text and text.replace("\n", "").isprintable() or _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))
        return b"".join(
            b"".join(map(self.__getitem__, _PIECE.findall(w.lower()))) if _PLAIN.fullmatch(w) else array(self.code, self.library.encode(w, add_special_tokens=False).ids).tobytes()
            for w in re.split("[ \n]+", text))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids that the library gives for whole texts."""
        return [np.array(e.ids, dtype=self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null."""
        given = [t or "" for t in texts]
        if not self.plain:
            return self.whole(given)
        out = [np.frombuffer(self._text(t), dtype=self.kind) for t in given]
        if self.unchecked:
            for mine, theirs in zip(out[: self.unchecked], self.whole(given[: self.unchecked]), strict=True):
                if not np.array_equal(mine, theirs):
                    raise ValueError("this tokenizer does not encode what blanks part each by itself")
            self.unchecked = max(0, self.unchecked - len(out))
        return out


def _byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for each byte: printable Latin-1 as itself, the others from U+0100 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values: two bits each, four values in a control byte."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    more = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    four = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    four[: len(r)] = more
    c = four.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


#: By control byte: the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def decode_ranks(control: bytes, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """The values that encode_ranks wrote for documents of these lengths, one after another."""
    lens = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)
    padded = -(-lengths // 4) * 4
    inside = np.arange(len(lens)) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(lengths, padded)
    lens = lens[inside]
    out = np.zeros((len(lens), 4), dtype=np.uint8)
    out[np.arange(4) < lens[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def tokenize(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, width (bytes of an id, 2 or 4) and ids of every row, the end id last: first all low bytes, then the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = int(enc.kind[-1])
        tail = np.array([] if end_id is None else [end_id], dtype=enc.kind)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                ids = [_planes(np.concatenate((x, tail))) for x in enc.ids(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "width", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], *StructType.fromDDL("width int, ids binary")]))


def _planes(ids: np.ndarray) -> bytes:
    return ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes()


def _ids(width: int, planes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1)


def count_tokens(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id and n_tokens of every row."""
    one = int(end_id is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                n = [len(x) + one for x in enc.ids(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], *StructType.fromDDL("n_tokens long")]))


def id_ranks(tokens: DataFrame) -> np.ndarray:
    """The ids by falling frequency, then by id: place r holds the id with rank r. As long as the vocabulary's used part at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            own = [_ids(width, ids.as_buffer()) for width, ids in zip(b.column("width").to_pylist(), b.column("ids"), strict=True)]
            for lo in range(0, len(own), TEXTS):
                n = np.bincount(np.concatenate(own[lo : lo + TEXTS]), minlength=len(total))
                n[: len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    return np.array([r.id for r in rows.select("id").collect()], dtype="<u4")


def write_ids(docs: DataFrame, path: str, out: str | None = None, end_id: int | None = END_ID) -> str:
    """Encode docs(doc_id, text) and write blocks and the table of ranks below `out`; returns `out`.

    Null texts are empty and give the end id alone. Null ids come first; rows with equal ids keep an order by a hash
    of their ids and by their place, so that one id with very many rows spreads over shards, too. Extra columns are
    ignored, an empty table gives files without blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    staged = materialize(tokenize(docs, path, end_id), "tokens", "zstd")
    by_rank = id_ranks(staged)
    to_rank = np.zeros(int(by_rank.max(initial=0)) + 1, dtype="<u4")
    to_rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    shared = spark.sparkContext.broadcast(to_rank)  # one entry for each id of the vocabulary
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))),
                       ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, rows, held, start, no = TaskContext.get().partitionId(), [], 0, 0, 0

        def block() -> pa.RecordBatch:
            control, data = encode_ranks(shared.value[np.concatenate([r[1] for r in rows])])
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": no, "start": start, "doc_ids": [r[0] for r in rows], "lengths": [len(r[1]) for r in rows],
                "control": control, "data": data}], schema=arrow)

        for b in batches:
            for doc_id, width, ids in zip(b.column("doc_id").to_pylist(), b.column("width").to_pylist(), b.column("ids"), strict=True):
                own = _ids(width, ids.as_buffer())
                if rows and held + len(own) > BLOCK_IDS:
                    yield block()
                    rows, start, held, no = [], start + held, 0, no + 1
                rows.append((doc_id, own))
                held += len(own)
        if rows:
            yield block()

    schema = f"shard int, block long, start long, doc_ids array<{dict(docs.dtypes)['doc_id']}>, lengths array<long>, control binary, data binary"
    order = ["doc_id", "_tie", "_row"]
    tied = staged.select("*", F.xxhash64("ids").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    ranged = tied.repartitionByRange(-(-max(1, staged.count()) // SHARD_ROWS), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "width", "ids").mapInArrow(pack, schema).write.option("compression", "zstd").parquet(f"{out}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id long").write.parquet(f"{out}/ranks")
    return out


def read_ids(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """The files of write_ids: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    ranks = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()  # one row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r.id for r in ranks], dtype="<u4"))
    blocks = spark.read.parquet(f"{out}/blocks")
    id_field = blocks.schema["doc_ids"].dataType.elementType
    totals = blocks.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row for each shard
    before = totals.withColumn("_before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "_before")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_id = shared.value
        for b in batches:
            for i in range(b.num_rows):
                lens = np.array(b.column("lengths")[i].as_py(), dtype=np.int64)
                ids = to_id[decode_ranks(b.column("control")[i].as_py(), b.column("data")[i].as_py(), lens.sum(keepdims=True))]
                ends = np.cumsum(lens)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, lens, strict=True)]
                start = ends - lens + b.column("start")[i].as_py() + b.column("_before")[i].as_py()
                cols = [b.column("doc_ids")[i].values, pa.array(start, pa.int64()), pa.array(lens, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = StructType.fromDDL("doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    schema["doc_id"].dataType = id_field
    return blocks.join(before, "shard").mapInArrow(unpack, schema)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(table(spark, sf_dir, "documents"), tokenizer_path()))


# ---- token counts

#: Lengths that share a first level of the sums.
SPAN = 1024


def length_histogram(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """length and n_docs: how many documents have so many ids. Null texts are empty; every row counts."""
    return count_tokens(docs, path, end_id).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and ids at this length, docs_below, docs_from (this long or longer), tokens_below,
    tokens_from, truncated_total (ids kept when documents are cut to this length) and rank_high (share of
    documents this long or shorter).

    percents are the whole per cents of documents whose quantile is this length. Sums run over spans of lengths first and
    inside each span then, so that no task holds the whole histogram. The histogram is computed once.
    """
    h = materialize(histogram, "lengths").select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / SPAN).alias("_span"))
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    below = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = spans.select(
        "_span", (F.sum("d").over(below) - F.col("d")).alias("_d"), (F.sum("t").over(below) - F.col("t")).alias("_t"),
        F.sum("d").over(Window.partitionBy()).alias("_docs"), F.sum("t").over(Window.partitionBy()).alias("_tokens"))
    inside = Window.partitionBy("_span").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = h.join(offsets, "_span").select(
        "length", "n_docs", "n_tokens",
        (F.col("_d") + F.sum("n_docs").over(inside) - F.col("n_docs")).alias("docs_below"),
        (F.col("_t") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("tokens_below"), "_docs", "_tokens")
    return summed.select(
        "length", "n_docs", "n_tokens", "docs_below", (F.col("_docs") - F.col("docs_below")).alias("docs_from"), "tokens_below",
        (F.col("_tokens") - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("length") * (F.col("_docs") - F.col("docs_below"))).alias("truncated_total"),
        F.try_divide(F.col("docs_below") + F.col("n_docs"), F.col("_docs")).alias("rank_high"),
        F.when(F.col("n_docs") > 0, F.expr("filter(sequence(100 * docs_below div _docs + 1, 100 * (docs_below + n_docs) div _docs), p -> 100 * docs_below < p * _docs and p * _docs <= 100 * (docs_below + n_docs))")
               ).alias("percents"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit and the ids kept when every document is cut to it, for any limits: what lies below the next length in the
    table, and the limit for each document from there on. Of an empty table there is no total."""
    asked = list(dict.fromkeys(map(int, limits)))
    after = [F.min(F.when(F.col("length") >= x, F.struct("length", "tokens_below", "docs_from"))).alias(f"l{i}") for i, x in enumerate(asked)]
    row = sums.agg(*after, F.max(F.struct("length", (F.col("tokens_below") + F.col("n_tokens")).alias("all"))).alias("top"))
    totals = [F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(
        F.col(f"l{i}.tokens_below") + x * F.col(f"l{i}.docs_from"), F.col("top.all")).alias("total")) for i, x in enumerate(asked)]
    return row.select(F.inline(F.array(*totals))).where("total is not null")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and the least length that at least this share of the documents does not exceed."""
    exprs = [F.min(F.when(F.col("rank_high") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    pairs = [y for i, q in enumerate(shares) for y in (F.lit(float(q)), F.col(f"q{i}"))]
    return sums.agg(*exprs).select(F.explode(F.create_map(*pairs)).alias("share", "length"))


#: Context limits that the query answers beside the lengths that occur.
LIMITS = [1 << k for k in range(9, 18)]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suffix sums at every length that occurs and, with no documents of their own, at the usual context limits."""
    counted = length_histogram(table(spark, sf_dir, "documents"), tokenizer_path())
    limits = spark.createDataFrame([(x, 0) for x in LIMITS], "length long, n_docs long")
    return with_suffix_sums(counted.union(limits).groupBy("length").agg(F.sum("n_docs").alias("n_docs")))


QUERIES = {"op2_token_ids": op2_token_ids, "op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
