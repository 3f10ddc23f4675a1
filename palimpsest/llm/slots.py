"""Token output in training order: a keyed permutation gives every sequence a slot, shards hold the slots in order.

Texts become ids of the tokenizer, each text's followed by the end id. Documents follow each other in the order of their ids
(null first) and then of a hash of their texts, so their order, and all that comes of it, does not depend on how the table is
stored or dealt. The stream of ids is cut into sequences of `length`: one sequence may hold the end of a document, whole ones
and the beginning of another; only the very last is padded, with the end id. No window numbers the documents: a task adds up
its range of them, and the sums of all ranges, one row each, come before it.

A Feistel network over the smallest even number of bits that holds the count permutes the sequences' numbers under a key; a
result beyond the count goes through it again (cycle walking), so the slots are exactly 0 to count - 1. A shard holds
`per_shard` slots, records of one size: slot s is at byte s % per_shard * stride of shard s // per_shard, so a reader seeks to
any slot and reads on from there. A task writes a range of shards; there are at most `TASKS`, so more tokens mean more shards
for each. Shards are files of Spark's text writer, as this is its only one that writes bytes as they are: `shard=N/part-*`, with
one line feed after the last record.

Null texts count as empty: the end id only. Rows that repeat are documents of their own. A very long text is held whole by one
task, as ids in pieces. An empty table gives no sequence. Of other columns none is read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import pattern, vocabulary
from palimpsest.llm.shared import held, lean, scratch, shared_dir, stored

VOCABULARY, LENGTH, PER_SHARD, KEY, ROUNDS = "byte_bpe_50k.tiktoken", 1024, 4096, "order-1", 6
#: Tasks that write shards, at most.
TASKS = 16_384


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, count: int, key: str = KEY) -> np.ndarray:
    """The slots of numbers below count: a bijection of 0 .. count - 1 for each key."""
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def _encoding(ranks: bytes, pat: str):
    import tiktoken

    def make() -> object:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}
        return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=table, special_tokens={})

    return held(("slots", hashlib.sha256(ranks + pat.encode()).hexdigest()), make)


def _pack():
    """A quick compressor of bytes: ids take two thirds of their room in what is stored between."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress


def _unpack():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


@dataclass(frozen=True)
class Stream:
    """The documents' ids one after the other: a stored table (doc_id, n, ids, start) and what follows from its sums."""

    table: DataFrame
    tokens: int
    length: int
    end: int
    kind: str

    @property
    def count(self) -> int:
        """Sequences."""
        return -(-self.tokens // self.length)

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.kind).itemsize


def stream(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> Stream:
    """Encodes docs (doc_id, text) in their order; start is the number of ids before a document's own. ids are packed by _pack."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    raw = vocabulary(path)
    end = len(raw.split()) // 2
    kind, pat = ("<u2" if end < 2**16 else "<u4"), pattern()
    ranks = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, at, pack = _encoding(ranks.value, pat), 0, _pack()
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*encoding.encode_ordinary(text.as_py() or ""), end], kind)
                rows.append((doc_id, len(ids), at, pack(ids.tobytes())))
                at, held = at + len(ids), held + len(ids)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names, kinds = ["doc_id", "n", "at", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    # The last column deals rows that are alike in all others, in whatever order.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("like"), "text")
    dealt = dealt.repartitionByRange("doc_id", "hash", "like").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    table = stored(dealt.mapInArrow(lean(run, keeps=True), "doc_id long, n long, at long, ids binary"), "token-stream")
    table = table.withColumn("range", F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long"))
    # One row a file, which is a task's range of documents: the ids that precede its own.
    sums, before, tokens = table.groupBy("range").agg(F.max(F.col("at") + F.col("n")).alias("n")).orderBy("range").collect(), [], 0
    for r in sums:
        before.append((r["range"], tokens))
        tokens += r["n"]
    ranges = F.broadcast(docs.sparkSession.createDataFrame(before, "range long, before long"))
    return Stream(table.join(ranges, "range").select("doc_id", "n", "ids", (F.col("before") + F.col("at")).alias("start")), tokens, length, end, kind)


def _slot(count: int, key: str):
    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(np.int64), count, key))

    return slot


def _pieces(s: Stream, key: str) -> DataFrame:
    """slot, off, ids: each document's part in each sequence that it is in; off is its place there, in bytes."""
    length, wide, count = s.length, np.dtype(s.kind).itemsize, s.count
    schema = pa.schema([("slot", pa.int64()), ("off", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack()
        for b in batches:
            number, off, ids, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                slots = permuted(np.array(number, np.int64), count, key)
                return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(off, pa.int64()), pa.array(ids, pa.binary())], schema=schema)

            for start, own in zip(b.column("start").to_pylist(), b.column("ids"), strict=True):
                own = unpack(own.as_py())
                at, low = start, 0
                while low < len(own):
                    size = min((length - at % length) * wide, len(own) - low)
                    number.append(at // length)
                    off.append(at % length * wide)
                    ids.append(own[low : low + size])
                    at, low, held = at + size // wide, low + size, held + size
                    if held > 4_000_000:
                        yield made()
                        number, off, ids, held = [], [], [], 0
            if number:
                yield made()

    return s.table.select("start", "ids").mapInArrow(lean(run), "slot long, off long, ids binary")


def ordered(s: Stream, key: str = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, offset, record of all sequences: partitions hold ranges of shards, sorted by slot."""
    shards = max(1, -(-s.count // per_shard))
    tasks = min(shards, TASKS)
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    # Slots are dealt evenly, so their ranges need no sample.
    rows = _pieces(s, key).repartitionById(tasks, F.floor(shard * tasks / shards).cast("int")).sortWithinPartitions("slot", "off")
    stride, pad = s.stride, np.array([s.end], s.kind).tobytes()
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, records, now, parts = [], [], None, []

        def made() -> pa.RecordBatch:
            at = np.array(slots, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(at // per_shard), pa.array(at % per_shard * stride), pa.array(records, pa.binary())], schema=schema)

        def closed() -> bytes:
            whole = b"".join(parts)
            return whole + pad * ((stride - len(whole)) // len(pad))

        for b in batches:
            for slot, ids in zip(b.column("slot").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if slot != now:
                    if parts:
                        slots.append(now)
                        records.append(closed())
                        if len(records) * stride > 4_000_000:
                            yield made()
                            slots, records = [], []
                    now, parts = slot, []
                parts.append(ids)
        if parts:
            slots.append(now)
            records.append(closed())
        if records:
            yield made()

    return rows.mapInArrow(lean(run), "slot long, shard long, offset long, record binary")


def token_slots(docs: DataFrame, folder: str | None = None, key: str = KEY, per_shard: int = PER_SHARD, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Writes all shards of docs, then slot, shard, offset, n_tokens, doc_ids, record_sha256 of what the files hold, a row a sequence.

    n_tokens is without padding; doc_ids are the documents in the sequence, in order. Without a folder the shards go to a new
    one in the shared folder. They stay there: `folder` in the metadata of the column `shard` names it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/palimpsest/shards-{uuid.uuid4().hex}"
    with scratch() as keep:
        with scratch() as kept:  # what one step reads goes before the next one writes: the ids are on disk two or three times at most
            s = stream(docs, path, length)
            number = F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n") - 1) / length)))
            # a sequence holds at most `length` documents, as each has an end id
            names = s.table.select("start", "doc_id", number.alias("number")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id"))).alias("docs"))
            names = names.select(_slot(s.count, key)("number").alias("slot"), F.least(F.lit(length), F.lit(s.tokens) - F.col("number") * length).cast("long").alias("n_tokens"), F.col("docs.doc_id").alias("doc_ids"))
            names = keep(kept(stored(names, "token-names")))
            # A row is a shard, so that sizes have to be looked at after each.
            each = {"parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "compression": "zstd"}
            whole = kept(stored(_whole(ordered(s, key, per_shard)), "token-shards", **each))
        _write(whole, folder)
    there = _files(spark, folder).agg(F.sum(F.expr(f"length div {s.stride}"))).first()[0] or 0
    if there != s.count:
        raise OSError(f"{folder} holds {there} of {s.count} records")
    out = names.join(_records(spark, folder, s.stride, per_shard), "slot")
    return out.select("slot", F.col("shard").alias("shard", metadata={"folder": folder}), "offset", "n_tokens", "doc_ids", "record_sha256")


def _whole(rows: DataFrame) -> DataFrame:
    """What ordered() returns -> shard, content: a row a shard, its records one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, parts = None, []
        made = lambda: pa.RecordBatch.from_pydict({"shard": [open_shard], "content": [b"".join(parts)]})
        for b in batches:
            for shard, record in zip(b.column("shard").to_pylist(), b.column("record"), strict=True):
                if shard != open_shard:
                    if parts:
                        yield made()
                    open_shard, parts = shard, []
                parts.append(record.as_py())
        if parts:
            yield made()

    return rows.select("shard", "record").mapInArrow(lean(run), "shard long, content binary")


def _write(whole: DataFrame, folder: str) -> None:
    """One text file a shard, of one line: its records, then a line feed. Spark's writer takes every path that Spark takes."""
    text = whole.select("shard", F.col("content").cast("string").alias("content"))
    text.write.mode("overwrite").partitionBy("shard").text(folder, compression="none", lineSep="\n")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """shard, path, length, content of the shards in a folder; length is without the line feed."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="part-*").load(folder)
    return found.select(F.regexp_extract("path", "/shard=([0-9]+)/", 1).cast("long").alias("shard"), "path", (F.col("length") - 1).alias("length"), "content")


def _records(spark: SparkSession, folder: str, stride: int, per_shard: int) -> DataFrame:
    """slot, shard, offset, record_sha256 of each record in the shards of a folder."""
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("record_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                data = memoryview(content.as_buffer())[:-1]
                offsets = np.arange(0, len(data), stride)
                digests = [hashlib.sha256(data[i : i + stride]).hexdigest() for i in offsets.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + offsets // stride), pa.array(np.full(len(offsets), shard)), pa.array(offsets), pa.array(digests)], schema=schema)

    return _files(spark, folder).select("shard", "content").mapInArrow(lean(run), "slot long, shard long, offset long, record_sha256 string")


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes what ordered() returns into a folder, whatever it held before; returns shard, path, records, bytes, sha256.

    The folder is any path that Spark takes and all executors share. A shard appears under its name only when it is whole;
    bytes and sha256 are without the line feed at its end.
    """
    stride = (rows.select(F.length("record")).first() or [1])[0]
    _write(_whole(rows), folder)
    data = F.expr("substring(content, 1, cast(length AS int))")
    return _files(rows.sparkSession, folder).select("shard", "path", F.expr(f"length div {stride}").alias("records"), F.col("length").alias("bytes"), F.sha2(data, 256).alias("sha256"))


def read_from(folder: str, slot: int, stride: int, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """The records from a slot on, read in order, by the driver's session."""
    sc = SparkSession.active().sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    shard, at = divmod(slot, per_shard)
    while found := fs.globStatus(path(f"{folder}/shard={shard}/part-*")):
        f = fs.open(found[0].getPath())
        try:
            f.seek(at * stride)
            while len(record := bytes(f.readNBytes(stride))) == stride:
                yield record
        finally:
            f.close()
        shard, at = shard + 1, 0
