"""Operator 13: byte-level BPE encoding and decoding through a global shuffle of distinct words.

Encoding. A task splits its texts into pre-tokens (the matches of the split pattern) and gathers them in blocks of
``BLOCK`` pre-tokens; each pre-token is exploded into its word and its position in the block. A block's distinct words
are dealt by hash, so every distinct word of the corpus comes to one task, which merges it once however many blocks hold
it; a word is listed once a block, so the commonest word weighs no more than a rare one. The words' ids are joined back
on the block, and the block's documents are put together by position. Rows carry many words each (those of one block and
one of ``BUCKETS`` buckets a shuffle partition), and positions travel as one compressed array a block, so both shuffles
together move about as many bytes as the input has.

Decoding. Ids are exploded into (block, id, positions), one row a distinct id of a block, and joined with the table of
token bytes on the id; bytes are put together by position. A table of at most ``BROADCAST`` tokens (a vocabulary's size,
not the data's) is broadcast, so nothing is shuffled and a block's rows stay together; a larger one is joined by
shuffle and rows are brought together by block. A block that comes apart raises an error.

Memory: one block's words and positions, the distinct words of one bucket, and the longest document.

Defined results: null or empty text has no ids and decodes to no bytes; repeated rows and ids, null ids and ties stay,
row for row; an empty table gives no rows; of the input only the named columns are read. An id that the token table
lacks raises an error.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pre-tokens (or ids, in decoding) of a block; buckets a shuffle partition; most tokens that are broadcast.
BLOCK, BUCKETS, BROADCAST = 1 << 21, 4, 1 << 20
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Splitter:
    """``words(text)``: the matches of the pattern, as the library splits.

    White space is Unicode's, without the information separators. Libraries follow different versions of Unicode, so a
    character that Python's own tables do not know yet is shown to the library (as the second of a pair that is one
    token if the pattern joins it) and stood in for, while splitting, by a character of the class that the library gives it.
    """

    def __init__(self, pattern: str):
        import regex

        self.pattern = pattern
        self.match = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.sure: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def _like(self, c: str) -> str:
        """A letter, a numeral or a sign that no pattern names, whichever the library takes ``c`` for."""
        import tiktoken

        for before, like in (("a", "\u00e9"), ("1", "\u0663")):
            pair = before + c
            probe = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks={bytes([b]): b for b in range(256)} | {pair.encode(): 256}, special_tokens={})
            if len(probe.encode_ordinary(pair)) == 1:
                return like
        return "\u00a7"

    def words(self, text: str) -> list[str]:
        new = set(text) - self.sure
        if new:
            unknown = {c for c in new if unicodedata.category(c) == "Cn"}
            self.sure |= new - unknown
            self.stand_ins |= {ord(c): self._like(c) for c in unknown if ord(c) not in self.stand_ins}
            if unknown:
                return [text[a:b] for a, b in (m.span() for m in self.match.finditer(text.translate(self.stand_ins)))]
        return self.match.findall(text)


@functools.cache
def splitter(pattern: str) -> Splitter:
    """The worker's splitter for this pattern."""
    return Splitter(pattern)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def merger(path: str):
    """Encodes one pre-token: its pattern takes the whole string, so only the merges are left."""
    import tiktoken

    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The token-byte table (id, bytes) of a vocabulary file."""
    found = ranks(path or vocabulary())
    rows = pa.table({"id": pa.array(list(found.values()), pa.int64()), "bytes": pa.array(list(found), pa.binary())})
    return spark.createDataFrame(rows)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: one byte each, with 255 for those above 254, whose rest follows by bytes' rank."""
    a = np.asarray(a, np.uint32)
    rest = np.ascontiguousarray(a[a >= 255] - 255, "<u4").view(np.uint8).reshape(-1, 4).T
    raw = np.minimum(a, 255).astype(np.uint8).tobytes() + rest.tobytes()
    return len(a).to_bytes(8, "little") + rest.shape[1].to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, more = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = np.frombuffer(pa.decompress(data[16:], n + 4 * more, "zstd", asbytes=True), np.uint8)
    out = raw[:n].astype(np.uint32)
    out[raw[:n] == 255] += np.ascontiguousarray(raw[n:].reshape(4, more).T).view("<u4").reshape(more)
    return out


def _pack_words(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    raw = lens + b"".join(words)
    return len(words).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack_words(data: bytes) -> list[bytes]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = pa.decompress(data[16:], size, "zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _shelve(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unshelve(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _cells(data: bytes | memoryview, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ``data`` as binary cells."""
    ends = np.cumsum(lengths, dtype=np.int64)
    offsets = np.concatenate([[0], ends]).astype("<i8")
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _serial() -> Iterator[int]:
    """Numbers that no other task gives, the same ones when the task is run again."""
    from pyspark import TaskContext

    k = TaskContext.get().partitionId() << 32
    while True:
        yield k
        k += 1


class Units(dict):
    """What stands between two spaces -> the numbers of its words (with the space before it), None if it is not apart.

    Words of the public pattern hold no space but before their first character, so between spaces next to no other white
    space texts fall apart into units, each with words of its own. A recurring unit is split once a block.
    """

    def __init__(self, split, known: dict[str, int]):
        self.split, self.known = split, known

    def __missing__(self, unit: str) -> tuple[int, ...] | None:
        apart = unit and not unit[0].isspace() and not unit[-1].isspace()
        self[unit] = found = tuple([self.known[w] for w in self.split(" " + unit)]) if apart else None
        return found

    def numbers(self, text: str) -> np.ndarray:
        head, *units = text.split(" ")
        found = list(map(self.__getitem__, units))
        if None in found or (head and head[-1].isspace()):
            return np.array([self.known[w] for w in self.split(text)], np.uint32)
        return np.array([*(self.known[w] for w in self.split(head)), *chain.from_iterable(found)], np.uint32)


PIECES = "block bigint, bucket int, words binary, places binary, buckets binary, docs binary"


def pieces(docs: DataFrame, id_col: str, text_col: str, pattern: str, buckets: int, block: int, by_spaces: bool = True) -> DataFrame:
    """A row for each block and bucket with its distinct words, and one a block with positions and documents.

    In its positions a block numbers its words by how often they stand, so most numbers are small; ``buckets`` tells
    each word's bucket, in which they keep that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, serial = splitter(pattern).words, _serial()
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__
        units = Units(split, known)
        ids: list[pa.Array] = []
        places: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            words = [w.encode() for w in known]
            seq = np.concatenate([np.zeros(0, np.uint32), *places])
            often = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            bucket = (np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets)[often]
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(words)]
            rows = [_pack_words([words[i] for i in often[order[a:b]]]) for a, b in zip(first.tolist(), ends)]
            at, n = next(serial), len(rows) + 1
            head = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(p) for p in places], pa.int64())], ["id", "n"])
            last = lambda data: pa.array([None] * (n - 1) + [data], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * n, pa.int64()), pa.array([*found.tolist(), at % buckets], pa.int32()), pa.array([*rows, None], pa.binary()), last(_pack(rank[seq])), last(_pack(bucket)), last(_shelve(head))],
                ["block", "bucket", "words", "places", "buckets", "docs"],
            )

        for batch in batches:
            for i, cell in enumerate(batch["text"]):
                text = cell.as_py() or ""
                # no more pre-tokens than characters
                if held and held + len(text) > block:
                    yield flush()
                    known.clear()
                    units.clear()
                    ids, places, held = [], [], 0
                ids.append(batch["id"][i : i + 1])
                places.append(units.numbers(text) if by_spaces else np.array([known[w] for w in split(text)], np.uint32))
                held += len(places[-1])
        if ids:
            yield flush()

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, PIECES)


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """``pieces`` dealt by bucket, with each distinct word's ids in place of the word: (block, bucket, lens, ids, places, buckets, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(path)
        known: dict[bytes, list[int]] = {}
        at = None
        for batch in batches:
            lens: list[bytes | None] = []
            ids: list[bytes | None] = []
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["words"]):
                if packed.as_py() is None:
                    lens.append(None)
                    ids.append(None)
                    continue
                if bucket != at:
                    at, known = bucket, {}
                words = _unpack_words(packed.as_py())
                for w in words:
                    if w not in known:
                        known[w] = merge(w.decode())
                found = [known[w] for w in words]
                lens.append(_pack(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(_pack(np.array([x for f in found for x in f], np.uint32)))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["bucket"], pa.array(lens, pa.binary()), pa.array(ids, pa.binary()), batch["places"], batch["buckets"], batch["docs"]], ["block", "bucket", "lens", "ids", "places", "buckets", "docs"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block bigint, bucket int, lens binary, ids binary, places binary, buckets binary, docs binary")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_tokens, ids): every document's ids as little-endian unsigned 32-bit numbers."""
    path, by_spaces = path or vocabulary(), pattern in (None, split_pattern())
    pattern = pattern or split_pattern()
    kind = docs.schema[id_col].dataType
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def assemble(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        whole = rows.filter(pa.compute.is_valid(rows["docs"]))
        words = rows.filter(pa.compute.is_valid(rows["lens"]))
        lens = np.concatenate([np.zeros(0, np.int32), *(_unpack(x.as_py()).astype(np.int32) for x in words["lens"])])
        ids = np.concatenate([np.zeros(0, "<u4"), *(_unpack(x.as_py()) for x in words["ids"])])
        head, places = _unshelve(whole["docs"][0].as_py()), _unpack(whole["places"][0].as_py())
        order = np.argsort(_unpack(whole["buckets"][0].as_py()), kind="stable")  # words by bucket, as numbers by frequency
        start, size = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        start[order], size[order] = np.cumsum(lens) - lens, lens
        n = size[places]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        at += np.repeat((start[places] - (ends - n)).astype(np.int32), n)
        before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(head["n"].to_numpy())])]
        tokens = np.diff(before)
        return pa.table({id_col: head["id"], "n_tokens": pa.array(tokens, pa.int64()), "ids": _cells(ids[at].tobytes(), 4 * tokens)})

    coded = encode_words(pieces(docs, id_col, text_col, pattern, buckets, block, by_spaces), path)
    return coded.groupBy("block").applyInArrow(assemble, f"{id_col} {kind.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, tokens: DataFrame, ids_col: str = "ids", block: int = BLOCK, most: int = BROADCAST) -> DataFrame:
    """The rows of ``encoded`` with ``bytes`` in place of their ids; ``tokens``: (id, bytes)."""
    kept = [c for c in encoded.columns if c != ids_col]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = _serial()
        held: list[pa.RecordBatch] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable").astype("<u4")
            found, first = np.unique(ids[order], return_index=True)
            cells = _cells(order.tobytes(), 4 * np.diff([*first.tolist(), len(ids)]) if len(found) else np.zeros(0, np.int64))
            at, n = next(serial), len(found) + 1
            docs = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            docs = docs.append_column("_n", pa.array([len(p) // 4 for p in parts], pa.int64()))
            none = pa.nulls(len(found), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * n, pa.int64()), pa.array([n - 1] * n, pa.int64()), pa.concat_arrays([pa.array([None], pa.int64()), pa.array(found.astype(np.int64))]), pa.concat_arrays([pa.array([None], pa.binary()), cells]), pa.concat_arrays([pa.array([_shelve(docs)], pa.binary()), none])],
                ["block", "n", "id", "places", "docs"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch[ids_col][i].as_py() or b""
                if parts and size + len(part) // 4 > block:
                    yield flush()
                    held, parts, size = [], [], 0
                held.append(batch.select(kept)[i : i + 1])
                parts.append(part)
                size += len(part) // 4
        if parts:
            yield flush()

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, wanted, docs = None, 0, b""
        rows: list[tuple[bytes, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            whole = _unshelve(docs).combine_chunks()
            n = whole["_n"].to_numpy()
            lens = np.zeros(int(n.sum()), np.int32)
            for data, places in rows:
                lens[places] = len(data)
            ends = np.cumsum(lens, dtype=np.int64)
            out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
            for data, places in rows:
                if data:
                    out[(ends[places] - len(data))[:, None] + np.arange(len(data))] = np.frombuffer(data, np.uint8)
            upto = np.concatenate([[0], ends])[np.cumsum(n)]
            cells = _cells(out.tobytes(), np.diff([0, *upto.tolist()]))
            return pa.RecordBatch.from_arrays([*(whole[c].combine_chunks() if whole[c].num_chunks != 1 else whole[c].chunk(0) for c in kept), cells], [*kept, "bytes"])

        for batch in batches:
            for block_, n, i, data, places, head in zip(*(batch[c] for c in ("block", "n", "id", "bytes", "places", "docs"))):
                if i.as_py() is None:
                    if len(rows) != wanted:
                        raise ValueError("a block has come apart")
                    at, wanted, docs, rows = block_.as_py(), n.as_py(), head.as_py(), []
                else:
                    if block_.as_py() != at:
                        raise ValueError("a block has come apart")
                    if data.as_py() is None:
                        raise ValueError(f"no token has the id {i.as_py()}")
                    rows.append((data.as_py(), np.frombuffer(places.as_py(), "<u4")))
                if len(rows) == wanted:
                    yield done()
        if len(rows) != wanted:
            raise ValueError("a block has come apart")

    rows = encoded.select(*kept, ids_col).mapInArrow(explode, "block bigint, n bigint, id bigint, places binary, docs binary")
    table_ = tokens.select(F.col("id").cast("bigint").alias("id"), "bytes")
    small = tokens.limit(most + 1).count() <= most
    joined = rows.join(F.broadcast(table_) if small else table_, "id", "left")
    if not small:
        joined = joined.repartition("block").sortWithinPartitions("block", F.col("id").asc_nulls_first())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema)
    return joined.mapInArrow(reassemble, kinds + ", bytes binary")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents")).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(coded, token_bytes(spark)).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
