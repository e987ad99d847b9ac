"""Sorted-string-table shards of documents.

Documents are range-partitioned by identifier, so that shards don't overlap and
follow each other. A shard is data blocks, a block index, a Bloom filter, the
schema and a footer:

* a block holds records in order of key; a key is stored as the length that it
  shares with the one before it and the rest; blocks are compressed each;
* the index has each block's last key, place and size, for a binary search;
* the Bloom filter answers for most absent keys without reading a block;
* the footer, of fixed size, tells where all these are.

A key is the identifier in eight order-preserving bytes after ``\\x01``; a null
identifier is the key ``\\x00`` and comes first. A value is the text (or its
token ids, where a tokenizer file is given) and the other columns as JSON.

Defined cases: null texts and null columns come back as null, empty texts as
empty; equal identifiers are all kept and all found by a lookup; a text of any
length is one record; an empty table has no shard; other columns, whatever their
names, are kept in the JSON.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean, qualified

BLOCK = 64 << 10
#: Bytes of text in a shard: at most so many, and at least so few where the session's parallelism wants more shards.
SHARD_BYTES, LEAST_BYTES = 512 << 20, 8 << 20
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"PLSST001"
FOOTER = "<QQQQQQQQ8s"  # index, bloom, schema: place and size; entries; Bloom bits; magic
SCHEMA = "shard int, seq int, kind string, place long, entries long, first_id long, last_id long, payload binary"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def get_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


class Block:
    """Records in order; ``add`` compresses keys by their prefixes."""

    def __init__(self):
        self.raw, self.last, self.n, self.first = bytearray(), b"", 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        for x in (shared, len(key) - shared, len(value)):
            put_varint(self.raw, x)
        self.raw += key[shared:]
        self.raw += value
        self.last, self.n = key, self.n + 1

    @staticmethod
    def records(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
        at, key = 0, b""
        while at < len(raw):
            shared, at = get_varint(raw, at)
            rest, at = get_varint(raw, at)
            size, at = get_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size


def bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    one, two = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (one[:, None] + two[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> np.ndarray:
    bits = max(64, -(-len(hashes) * BLOOM_BITS // 8) * 8)
    out = np.zeros(bits, dtype=bool)
    out[bloom_places(hashes, bits).ravel().astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


class Table:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes):
        self.data = data
        ia, iz, ba, bz, sa, sz, self.entries, self.bits, magic = struct.unpack(FOOTER, data[-struct.calcsize(FOOTER) :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.filter = np.frombuffer(data[ba : ba + bz], dtype=np.uint8)
        self.schema = json.loads(data[sa : sa + sz])
        self.keys, self.places = [], []
        at, index = 0, data[ia : ia + iz]
        while at < len(index):
            n, at = get_varint(index, at)
            self.keys.append(index[at : at + n])
            at += n
            place, at = get_varint(index, at)
            size, at = get_varint(index, at)
            self.places.append((place, size))

    def may_have(self, doc_id: int | None) -> bool:
        at = bloom_places(np.array([xxhash.xxh3_64_intdigest(key_of(doc_id))], dtype=np.uint64), self.bits)[0].astype(np.int64)
        return bool(((self.filter[at >> 3] >> (at & 7)) & 1).all())

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        place, size = self.places[k]
        return Block.records(zstandard.ZstdDecompressor().decompress(self.data[place : place + size]))

    def _row(self, key: bytes, value: bytes) -> dict:
        n, at = get_varint(value, 0)
        rest = json.loads(value[at : at + n])
        at += n
        flag, body = value[at], value[at + 1 :]
        if flag == 0:
            text = None
        elif flag == 1:
            text = body.decode()
        else:
            text = np.frombuffer(body, dtype="<u2" if flag == 2 else "<u4").tolist()
        return {"doc_id": id_of(key), "text": text} | rest

    def get(self, doc_id: int | None) -> list[dict]:
        """All records of an identifier: filter, binary search in the index, then the blocks that may hold it."""
        if not self.may_have(doc_id):
            return []
        key, out = key_of(doc_id), []
        for k in range(bisect_left(self.keys, key), len(self.keys)):
            rows = [(a, v) for a, v in self.block(k) if a >= key]
            out += [self._row(a, v) for a, v in rows if a == key]
            if rows and rows[-1][0] > key:
                break
        return out

    def __iter__(self) -> Iterator[dict]:
        for k in range(len(self.keys)):
            for a, v in self.block(k):
                yield self._row(a, v)


def _writer(columns: list[tuple[str, str]], tokenizer: str | None, block_bytes: int, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=1)
        encode = None
        if tokenizer:
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(tokenizer)
            encode.encode_special_tokens = True
        place = seq = entries = 0
        index, hashes, block = bytearray(), [], Block()
        out: list[tuple] = []
        sink = _Sink(folder, shard) if folder else None

        def piece(kind: str, payload: bytes, n: int, first=None, last=None) -> None:
            nonlocal place, seq
            out.append((shard, seq, kind, place, n, first, last, None if sink else payload))
            if sink:
                sink.write(payload)
            place += len(payload)
            seq += 1

        def close() -> None:
            nonlocal block
            raw = press.compress(bytes(block.raw))
            put_varint(index, len(block.last))
            index.extend(block.last)
            put_varint(index, place)
            put_varint(index, len(raw))
            piece("block", raw, block.n, id_of(block.first), id_of(block.last))
            block = Block()

        def drain() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 8
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            b = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            out.clear()
            return b

        last = None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                ids = encode.encode_batch_fast([x or "" for x in texts], add_special_tokens=False) if encode else None
                wide = encode is not None and encode.get_vocab_size() > 65536
                for k, (i, rest, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("rest").to_pylist(), texts)):
                    value = bytearray()
                    rest = rest.encode()
                    put_varint(value, len(rest))
                    value += rest
                    if text is None:
                        value.append(0)
                    elif encode:
                        value.append(3 if wide else 2)
                        value += np.array(ids[k].ids, dtype="<u4" if wide else "<u2").tobytes()
                    else:
                        value.append(1)
                        value += text.encode("utf-8", "surrogatepass")
                    key = key_of(i)
                    block.add(key, bytes(value))
                    if key != last:
                        hashes.append(xxhash.xxh3_64_intdigest(key))
                    last = key
                    entries += 1
                    if len(block.raw) >= block_bytes:
                        close()
                    if len(out) >= 32:
                        yield drain()
        if block.n:
            close()
        if entries:
            marks = []
            filter_ = bloom(np.array(hashes, dtype=np.uint64))
            for kind, payload in (("index", bytes(index)), ("bloom", filter_.tobytes()), ("schema", json.dumps(columns).encode())):
                marks += [place, len(payload)]
                piece(kind, payload, 0)
            piece("footer", struct.pack(FOOTER, *marks, entries, len(filter_) * 8, MAGIC), entries)
            if sink:
                sink.close()
        if out:
            yield drain()

    return run


class _Sink:
    """One shard's file: written under a task's own name, then moved, so that a repeated task does no harm."""

    def __init__(self, folder: str, shard: int):
        import uuid

        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.temp = f"{base}/shard-{shard:05d}.sst", f"{base}/.shard-{shard:05d}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, payload: bytes) -> None:
        self.out.write(payload)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.name)


def shard_count(docs: DataFrame) -> int:
    """Shards by bytes, so that a shard, its Bloom filter and its index don't grow with the table."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // SHARD_BYTES), min(wanted, -(-total // LEAST_BYTES)))


def shards(docs: DataFrame, partitions: int | None = None, tokenizer: str | None = None, block_bytes: int = BLOCK, folder: str | None = None) -> DataFrame:
    """The shards' pieces in order; with ``folder`` (on storage all tasks share) they go to files there and the rows are the manifest."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    flat = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]), {"ignoreNullFields": "false"}) if rest else F.lit("{}")).alias("rest"),
    )
    n = partitions or shard_count(docs)
    ranged = flat.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "rest", F.asc_nulls_first("text"))
    types = [(c, t) for c, t in docs.dtypes]
    folder = qualified(docs.sparkSession, folder) if folder else None
    return ranged.mapInArrow(lean(_writer(types, tokenizer, block_bytes, folder)), SCHEMA)


def assemble(pieces: list) -> dict[int, bytes]:
    """{shard: file} of collected rows (for reading a few shards; files are written by ``folder``)."""
    out: dict[int, bytearray] = {}
    for r in sorted(pieces, key=lambda r: (r["shard"], r["seq"])):
        out.setdefault(r["shard"], bytearray()).extend(r["payload"])
    return {k: bytes(v) for k, v in out.items()}


def query(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
