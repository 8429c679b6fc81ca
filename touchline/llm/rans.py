"""Operator 8: token ids as range-coded binary files (static range asymmetric numeral system).

A file holds the documents of one range of ids, in ascending order. Its header has one frequency table, counted over
all of its ids and shared by all of its blocks. A block codes up to ``BLOCK`` ids with ``LANES`` interleaved states
(id i belongs to lane i mod LANES), so that numpy advances all lanes at once; blocks are independent of one another.
The index has a checkpoint a block (first id, number of ids, place, CRC-32 of the coded bytes and of the ids), so a
reader can start at any block, and blocks decode in parallel. Layout, little-endian:

    magic "TLRA", u32 version, documents, symbols, blocks, log2 of the frequencies' sum, lanes
    u64 doc_id, u32 n_ids                           a document
    u16 symbol, u16 frequency - 1                   a symbol
    u64 first id, u32 n ids, u64 place, u32 bytes, u32 crc of bytes, u32 crc of ids    a block
    blocks: u32 states of the lanes, then u16 words in the order in which the decoder reads them

Tokenizing and counting happen once: a task tokenizes its range into memory (two bytes an id), and writes a file for
each ``FILE_IDS`` ids, so memory is bounded by that and by the longest document. Files are binary values of a table in
the shared folder, written and read by Spark, so any store works and a lost task is simply run again.

Defined results: null text is empty and has only its end id; documents with equal ids (repeated rows) stand next to
one another in the order of their text's hash; a null id sorts first and is stored as id -2^63; an empty table gives
no files and no rows. A damaged block raises an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import tokenizer, vocabulary

MAGIC, VERSION = b"TLRA", 1
#: Lanes of a block, ids of a block, ids of a file, bits of the frequencies' sum (more where more symbols occur).
LANES, BLOCK, FILE_IDS, SCALE = 4096, 1 << 19, 1 << 22, 16
LOW = 1 << 16
END_ID = 2
NO_ID = -(1 << 63)
HEAD, DOC, CHECK = "<4s6I", np.dtype([("doc", "<i8"), ("n", "<u4")]), np.dtype([("first", "<u8"), ("n", "<u4"), ("place", "<u8"), ("bytes", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts as positive whole frequencies that sum to ``2**scale``; zero counts stay zero."""
    total = 1 << scale
    seen = np.flatnonzero(counts)
    if len(seen) > total:
        raise ValueError("more symbols than the table can hold")
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    share = counts[seen] / counts[seen].sum()
    got = np.maximum(1, np.floor(share * (total - len(seen))).astype(np.int64))
    got[np.argmax(got)] += total - got.sum()  # the floor leaves at most one a symbol over
    out[seen] = got
    return out


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int, lanes: int) -> bytes:
    """Last row first; states stay in [2^16, 2^32), so each step writes at most one 16-bit word a lane."""
    rows = -(-len(ids) // lanes)
    width = min(lanes, len(ids))
    state = np.full(width, LOW, np.uint64)
    f, c = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    out = []
    for r in range(rows - 1, -1, -1):
        a, b = r * lanes, min((r + 1) * lanes, len(ids))
        x, fr = state[: b - a], f[a:b]
        full = x >= (fr << np.uint64(32 - scale))
        out.append((x[full] & np.uint64(0xFFFF)).astype("<u2"))
        x = np.where(full, x >> np.uint64(16), x)
        high = x // fr
        state[: b - a] = (high << np.uint64(scale)) + (x - high * fr) + c[a:b]
    return state.astype("<u4").tobytes() + b"".join(w.tobytes() for w in reversed(out))


def decode_block(data: bytes, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray, scale: int, lanes: int) -> np.ndarray:
    width = min(lanes, n)
    state = np.frombuffer(data, "<u4", width).astype(np.uint64)
    words, at = np.frombuffer(data, "<u2", offset=4 * width).astype(np.uint64), 0
    ids = np.empty(n, np.uint16)
    mask = np.uint64((1 << scale) - 1)
    for a in range(0, n, lanes):
        b = min(a + lanes, n)
        x = state[: b - a]
        slot = x & mask
        got = symbol[slot]
        ids[a:b] = got
        x = freq[got] * (x >> np.uint64(scale)) + slot - start[got]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << np.uint64(16)) | words[at : at + len(need)]
        at += len(need)
        state[: b - a] = x
    return ids


def encode_file(docs: list[int], lengths: list[int], ids: np.ndarray, scale: int = SCALE, lanes: int = LANES, block: int = BLOCK) -> bytes:
    """One file of these documents, whose ids stand in ``ids`` one after the other."""
    counts = np.bincount(ids, minlength=1 << 16)
    freq = frequencies(counts, scale)
    start = np.cumsum(freq) - freq
    seen = np.flatnonzero(freq)
    blocks, checks, place = [], [], 0
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        coded = encode_block(part, freq, start, scale, lanes)
        checks.append((a, len(part), place, len(coded), zlib.crc32(coded), zlib.crc32(part.astype("<u2").tobytes())))
        blocks.append(coded)
        place += len(coded)
    head = struct.pack(HEAD, MAGIC, VERSION, len(docs), len(seen), len(blocks), scale, lanes)
    index = np.array(list(zip(docs, lengths)), DOC).tobytes()
    symbols = np.stack([seen, freq[seen] - 1], 1).astype("<u2").tobytes()
    return b"".join([head, index, symbols, np.array(checks, CHECK).tobytes(), *blocks])


def open_file(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple, memoryview]:
    """Documents, checkpoints, the decoding tables, the coded blocks."""
    magic, version, docs, symbols, blocks, scale, lanes = struct.unpack_from(HEAD, data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file of this version")
    at = struct.calcsize(HEAD)
    index = np.frombuffer(data, DOC, docs, at)
    at += index.nbytes
    table_ = np.frombuffer(data, "<u2", 2 * symbols, at).reshape(symbols, 2)
    at += table_.nbytes
    checks = np.frombuffer(data, CHECK, blocks, at)
    at += checks.nbytes
    freq = np.zeros(1 << 16, np.uint64)
    freq[table_[:, 0]] = table_[:, 1].astype(np.uint64) + np.uint64(1)
    start = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(1 << 16), freq.astype(np.int64))
    return index, checks, (freq, start, symbol, scale, lanes), memoryview(data)[at:]


def decode_blocks(checks: np.ndarray, tables: tuple, coded: memoryview) -> np.ndarray:
    """The ids of these blocks (any run of checkpoints), each checked against both checksums."""
    out = [np.zeros(0, np.uint16)]
    for c in checks:
        part = bytes(coded[int(c["place"]) : int(c["place"]) + int(c["bytes"])])
        if zlib.crc32(part) != c["crc"]:
            raise ValueError(f"block at id {c['first']} is damaged")
        ids = decode_block(part, int(c["n"]), *tables)
        if zlib.crc32(ids.astype("<u2").tobytes()) != c["ids_crc"]:
            raise ValueError(f"block at id {c['first']} decodes to other ids")
        out.append(ids)
    return np.concatenate(out)


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a whole file."""
    index, checks, tables, coded = open_file(data)
    return index["doc"], index["n"].astype(np.int64), decode_blocks(checks, tables, coded)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """A table (first, mark, part, n_docs, n_ids, data) of token files in the shared folder, ranges of ids ascending."""
    path = path or vocabulary()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        keys: list[int] = []
        marks: list[int] = []
        parts: list[bytes] = []
        held, part = 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u2")
            data = encode_file(keys, [len(p) // 2 for p in parts], ids)
            row = [[keys[0]], [marks[0]], [part], [len(keys)], [len(ids)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (*[pa.int64()] * 5, pa.binary()))], ["first", "mark", "part", "n_docs", "n_ids", "data"])

        for batch in batches:
            for key, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
                ids = encode.ids(text.as_py() or "") + end
                if held and held + len(ids) // 2 > file_ids:
                    yield flush()
                    keys, marks, parts, held, part = [], [], [], 0, part + 1
                marks.append(mark)
                keys.append(NO_ID if key is None else key)
                parts.append(ids)
                held += len(ids) // 2
        if keys:
            yield flush()

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = kept.repartitionByRange(shuffles, "id", "mark").sortWithinPartitions("id", "mark")
    files = ordered.mapInArrow(run, "first bigint, mark bigint, part bigint, n_docs bigint, n_ids bigint, data binary")
    return written(files, "token-files", compression="uncompressed")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    place = ["first", "mark", "part"]
    names = [*place, "doc_id", "inside", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *key, data in zip(*(batch[c] for c in (*place, "data"))):
                docs, lengths, ids = decode_file(data.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [*(pa.array(np.full(len(docs), k.as_py())) for k in key), pa.array(docs.astype(np.int64), mask=docs == NO_ID), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = files.select(*place, "data").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    # one row a file of millions of ids comes together here, without its data
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(files.select(*place, before.alias("before")), "token-starts")
    return rows.join(starts, place).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_rans(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
