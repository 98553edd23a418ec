"""Token ids in training order, as fixed-stride binary shards.

All documents form one stream of token ids, each document followed by an end mark, cut into sequences
of `length` ids. A keyed Feistel permutation over the next power of four, walked until it falls below the
number of sequences, gives each sequence a global slot: a seeded shuffle that needs no sort and no table,
and that anyone can invert. Slots are dealt to shards by range, and shards to partitions by range; a shard is one file in which
slot s begins at (s - first slot) * stride, so a reader starts at any slot and reads on.

Where a document lies in the stream follows from counts: the ids are stored, a first pass sums those of each
partition of the stored table, the second adds them up within it. Both read the same files; should a partition hold other rows
the second time nevertheless (a checksum of all of it tells), the run fails. Only pieces of sequences are shuffled, once: those that
a batch has for a shard travel together, compressed. A partition's task writes its shards one after the other, each file
whole or not at all, and holds one at a time.

Ids are little-endian numbers of `width` bytes. `byte_ids` gives the UTF-8 bytes as ids of width 1, in which 255 and 254
never occur; the query writes the ids of the byte-level BPE, width 2. The two largest numbers of a width are the end mark and the padding
after the last document. Nulls: a null text has no ids, only its end mark;
a null doc_id is carried along. Repeated rows are each written. An empty table gives no shards. Columns other
than doc_id and the ids are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import groupby
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import portions, shared_path, stored

LENGTH = 2048
SHARD_SLOTS = 4096
KEY = 0x5EED_0F_7A1E
ROUNDS = 6
#: Partitions that write shards, at most.
WRITERS = 10_000
#: The compression level of stored ids and of pieces on their way.
LEVEL = 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _feistel(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in rounds:
        if rounds.step > 0:
            left, right = right, left ^ (_mix(right, key + r * 0x1F123BB5) & mask)
        else:
            left, right = right ^ (_mix(left, key + r * 0x1F123BB5) & mask), left
    return (left << np.uint64(half)) | right


def permuted(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each sequence below n, or with `back` the sequence of each slot."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    out = _feistel(np.asarray(x, np.uint64), half, key, rounds)
    while (far := out >= np.uint64(n)).any():  # one in four steps at worst stays below n
        out[far] = _feistel(out[far], half, key, rounds)
    return out.astype(np.int64)


def byte_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("ids"))


def marks(width: int) -> tuple[int, int]:
    """The end mark and the padding of ids of so many bytes."""
    return (1 << 8 * width) - 1, (1 << 8 * width) - 2


def _sizes(batches: Iterator[pa.RecordBatch], width: int):
    """(batch, bytes and number of ids of each row with the end mark, checksum of all rows up to here)."""
    digest = 0
    for batch in portions(batches, "ids", 4096):
        raw = [x or b"" for x in batch.column("ids").to_pylist()]
        sizes = np.array([len(x) // width + 1 for x in raw], np.int64)
        digest = zlib.crc32(repr((batch.column("doc_id").to_pylist(), sizes.tolist())).encode(), digest)
        for x in raw:
            digest = zlib.crc32(x, digest)
        yield batch, raw, sizes, digest


#: The pieces that a batch has for a shard: for each its document, the place of its first id in the document, its slot, its place in it and
#: its number of ids; and all their ids, compressed.
PIECES = "shard long, writer int, doc_ids array<long>, offsets array<long>, slots array<long>, positions array<int>, sizes array<int>, tokens binary"
PLACES = "doc_id long, offset long, n_ids long, slot long, position long, shard long, byte_offset long, path string"


def materialise(docs: DataFrame, path: str, width: int = 1, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Writes docs (doc_id, ids as binary) below path and returns where each piece of a document lies."""
    spark = docs.sparkSession
    docs = stored(docs.select(F.col("doc_id").cast("long"), "ids"), "token-ids", **{"compression": "zstd", "parquet.compression.codec.zstd.level": str(LEVEL)})
    end, pad = marks(width)

    def count(batches):
        total = digest = 0
        for _, _, sizes, digest in _sizes(batches, width):
            total += int(sizes.sum())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, total, digest)], ["part", "total", "digest"])

    parts = {r.part: (r.total, r.digest) for r in docs.mapInArrow(count, "part long, total long, digest long").collect()}  # a row for each partition
    first, total = {}, 0
    for part in sorted(parts):
        first[part] = (total, parts[part][1])
        total += parts[part][0]
    sequences = -(-total // length)
    shards = -(-sequences // shard_slots)
    writers = max(1, min(shards, WRITERS))
    sent = spark.sparkContext.broadcast(first)

    def pieces(batches):
        at, expected = sent.value[TaskContext.get().partitionId()]
        digest, packer = 0, zstandard.ZstdCompressor(LEVEL)
        mark = end.to_bytes(width, "little")
        for batch, raw, sizes, digest in _sizes(batches, width):
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            # A row's ids are cut where sequences begin.
            first_cut = -(-(starts + 1) // length) * length
            inner = np.maximum(0, -(-(starts + sizes - first_cut) // length))
            row = np.repeat(np.arange(len(raw)), inner + 1)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(inner + 1) - (inner + 1), inner + 1)
            lo = np.where(nth == 0, 0, first_cut[row] + (nth - 1) * length - starts[row])
            hi = np.minimum(first_cut[row] + nth * length - starts[row], sizes[row])
            place = starts[row] + lo
            slot = permuted(place // length, sequences, key)
            data = [x + mark for x in raw]
            ids = batch.column("doc_id").to_pylist()
            out = []
            order = np.lexsort((slot, slot // shard_slots))
            for shard, own in groupby(order.tolist(), lambda i: int(slot[i]) // shard_slots):
                own = list(own)
                tokens = b"".join([data[row[i]][lo[i] * width : hi[i] * width] for i in own])
                columns = [[ids[row[i]] for i in own], lo[own], slot[own], place[own] % length, (hi - lo)[own]]
                out.append((shard, shard * writers // shards, *columns, packer.compress(tokens)))
            kinds = [pa.int64(), pa.int32(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], [f.split()[0] for f in PIECES.split(", ")])
        if digest != expected:
            raise RuntimeError("a partition holds other rows than counted")

    def write(batches):
        """Rows come shard by shard."""
        shard, buffer = None, bytearray()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if shard is not None:
                        _put(shard_file(path, shard), bytes(buffer))
                    shard = r["shard"]
                    # A slot no piece reaches to its end is the stream's last: the rest of it is padding.
                    buffer = bytearray(pad.to_bytes(width, "little") * (length * min(shard_slots, sequences - shard * shard_slots)))
                tokens, at = zstandard.decompress(r["tokens"]), 0
                for doc_id, offset, slot, position, n in zip(r["doc_ids"], r["offsets"], r["slots"], r["positions"], r["sizes"]):
                    to = ((slot - shard * shard_slots) * length + position) * width
                    buffer[to : to + n * width] = tokens[at : at + n * width]
                    at += n * width
                    out.append((doc_id, offset, n, slot, position, shard, to, shard_file(path, shard)))
            if out:
                kinds = [*[pa.int64()] * 7, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], [f.split()[0] for f in PLACES.split(", ")])
        if shard is not None:
            _put(shard_file(path, shard), bytes(buffer))

    dealt = docs.mapInArrow(pieces, PIECES).repartitionById(writers, "writer").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(write, PLACES), "token-places")  # written once, here


def shard_file(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:06d}.bin"


def _store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _put(path: str, data: bytes) -> None:
    """The file appears whole or not at all; a task that runs twice puts the same bytes."""
    store, name = _store_of(path)
    folder, _, file = name.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{file}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def read_slots(path: str, start: int, stop: int, width: int = 1, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> Iterator[np.ndarray]:
    """The ids of the slots from start up to stop, read in order."""
    stride = length * width
    slot = start
    while slot < stop:
        shard = slot // shard_slots
        store, name = _store_of(shard_file(path, shard))
        with store.open_input_file(name) as f:
            f.seek((slot - shard * shard_slots) * stride)
            while slot < min(stop, (shard + 1) * shard_slots):
                yield np.frombuffer(f.read(stride), f"<u{width}")
                slot += 1


def op9_training_order(spark, sf_dir):
    """Where each piece of each document's BPE ids lies: the file, the slot, the place in both."""
    from .bpe import encode, public_vocabulary
    from .shared import table

    path, pattern = public_vocabulary()
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, out="ids", width=2, most_common=0)  # one pass over the texts
    return materialise(ids, shared_path(spark, "training-order"), width=2)
