"""Operator 1: media columns of ISO base media files (MP4, MOV, M4A), payloads left undecoded.

``media_columns`` walks the nested boxes of each binary value and decodes the sample tables (``stts``, ``stss``,
``stsc``, ``stsz``/``stz2``, ``stco``/``co64``) of every track, and the runs of movie fragments (``moof``), into codec,
timing and keyframe byte ranges.
``text_media`` is the writing side: it stores a text's bytes as 8-bit samples of one sound track.

Defined results: null media gives status ``null`` and no tracks; empty bytes give ``empty``; bytes that end inside a
box or whose tables point outside the file give ``damaged`` with the tracks read until then. A track's duration is the
media header's and that of its fragments; the header's does not count where all samples are in fragments. Fragments that
name no track of the file, or come before its tracks, are damage; the codec is that of the first sample entry. Both operators work row
by row (no shuffle), so ties, repeated rows and skewed keys need no care; only the named columns are kept, so extra
columns cannot clash. Memory: one Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) at a time, its rows
handled in slices of at most ``SLICE_BYTES`` (or one row).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: One sample (access unit) holds this many bytes; texts are padded with spaces to a multiple of it.
UNIT = 192
#: Samples a chunk; the first sample of each chunk is marked as a keyframe (a place to seek to).
CHUNK_SAMPLES = 16
#: Sampling rate of the sound track that carries text: 8-bit mono, one byte a tick.
RATE = 8000
#: Slices of a batch that are turned into media at once.
SLICE_BYTES = 16 << 20
#: Fixed values of the format: boxes that hold other boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"])

#: Fixed value of the format: the mark of a sample that is no keyframe.
NOT_SYNC = 0x10000

RANGE = "array<struct<start:bigint,length:bigint>>"
TRACK = (
    "struct<track_id:bigint,kind:string,codec:string,timescale:bigint,duration:bigint,duration_s:double,"
    f"n_samples:bigint,sample_bytes:bigint,n_keyframes:bigint,keyframes:{RANGE},chunks:{RANGE}>"
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` and so many spaces that a positive multiple of UNIT results."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def mux(payload: bytes) -> bytes:
    """One sound track whose samples are ``payload`` in units of UNIT bytes. Equal payloads give equal files."""
    samples = len(payload) // UNIT
    chunks = -(-samples // CHUNK_SAMPLES)
    last = samples - (chunks - 1) * CHUNK_SAMPLES
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK_SAMPLES, 1)] if chunks > 1 else []
    if last != CHUNK_SAMPLES or chunks == 1:
        runs.append((chunks, last, 1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK_SAMPLES)
        wide = bool(starts[-1] >= 1 << 32)
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
            _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK_SAMPLES + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, samples)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload) & 0xFFFFFFFF, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", bytes(12)), b"sound\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload) & 0xFFFFFFFF), bytes(16), unity, bytes(8), flags=7)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(payload) & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    size = len(moov(0))
    return head + moov(len(head) + size + 8) + _box(b"mdat", payload)


class _Damaged(ValueError):
    pass


def _walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of each box in ``data[start:end]``, not of those nested in them."""
    while start < end:
        if end - start < 8:
            raise _Damaged("a box header is cut")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise _Damaged("a long box header is cut")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise _Damaged("a box reaches beyond its parent")
        yield kind, body, start + size
        start += size


def _numbers(data: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    if count * np.dtype(kind).itemsize > end - at:
        raise _Damaged("a table is cut")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _track(data: memoryview, start: int, end: int) -> dict:
    boxes: dict[bytes, tuple[int, int]] = {}

    def visit(a: int, b: int) -> None:
        for kind, at, to in _walk(data, a, b):
            if kind in CONTAINERS:
                visit(at, to)
            else:
                boxes.setdefault(kind, (at, to))

    visit(start, end)

    def word(kind: bytes, offset: int, form: str = ">I") -> int:
        if kind not in boxes or boxes[kind][1] - boxes[kind][0] < offset + struct.calcsize(form):
            raise _Damaged(f"no whole {kind.decode('latin-1')}")
        return struct.unpack_from(form, data, boxes[kind][0] + offset)[0]

    def entries(kind: bytes, form: str, width: int) -> np.ndarray:
        n = word(kind, 4)
        at, to = boxes[kind]
        return _numbers(data, at + 8, to, n * width, form).reshape(n, width)

    late = data[boxes[b"mdhd"][0]] == 1 if word(b"mdhd", 0) is not None else False
    scale, duration = (word(b"mdhd", 20), word(b"mdhd", 24, ">Q")) if late else (word(b"mdhd", 12), word(b"mdhd", 16))
    codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1") if word(b"stsd", 12) is not None else ""
    kind = struct.pack(">I", word(b"hdlr", 8)).decode("latin-1")
    if b"stsz" in boxes:
        each, n = word(b"stsz", 4), word(b"stsz", 8)
        sizes = np.full(n, each, np.int64) if each and n * each <= len(data) else _numbers(data, boxes[b"stsz"][0] + 12, boxes[b"stsz"][1], n, ">u4")
    else:
        bits, n, at = word(b"stz2", 4) & 255, word(b"stz2", 8), boxes[b"stz2"][0] + 12
        if bits == 4:
            packed = _numbers(data, at, boxes[b"stz2"][1], -(-n // 2), "u1")
            sizes = np.stack([packed >> 4, packed & 15], 1).ravel()[:n]
        else:
            sizes = _numbers(data, at, boxes[b"stz2"][1], n, {8: "u1", 16: ">u2"}.get(bits, ">u2"))
    starts = entries(b"co64", ">u8", 1)[:, 0] if b"co64" in boxes else entries(b"stco", ">u4", 1)[:, 0]
    runs = entries(b"stsc", ">u4", 3)
    per = np.zeros(len(starts), np.int64)
    if len(starts):
        if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
            raise _Damaged("chunk runs are out of order")
        per = runs[np.searchsorted(runs[:, 0], np.arange(1, len(starts) + 1), "right") - 1, 1]
    if per.sum() != n:
        raise _Damaged("chunks and samples disagree")
    chunk = np.repeat(np.arange(len(starts)), per)
    before = np.concatenate([[0], np.cumsum(sizes)])
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    offsets = starts[chunk] + before[:-1] - before[first][chunk] if n else np.zeros(0, np.int64)
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise _Damaged("samples lie outside the file")
    keys = np.arange(n) if b"stss" not in boxes else entries(b"stss", ">u4", 1)[:, 0] - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise _Damaged("keyframes lie outside the track")
    if b"stts" in boxes and not duration:
        duration = int((entries(b"stts", ">u4", 2).prod(1)).sum())
    return {
        "track_id": word(b"tkhd", 20 if data[boxes[b"tkhd"][0]] == 1 else 12) if b"tkhd" in boxes else None,
        "kind": kind, "codec": codec, "timescale": scale, "duration": duration, "duration_s": duration / scale if scale else None,
        "n_samples": n, "sample_bytes": int(sizes.sum()), "n_keyframes": len(keys),
        "keyframes": [{"start": int(a), "length": int(b)} for a, b in zip(offsets[keys], sizes[keys])],
        "chunks": [{"start": int(a), "length": int(before[f + p] - before[f])} for a, f, p in zip(starts, first, per)],
    }


def _extend(data: memoryview, track: dict, place: int, sizes: np.ndarray, keys: np.ndarray) -> int:
    """Adds a run of samples that starts at ``place`` to ``track``; where the run ends."""
    starts = place + np.cumsum(sizes) - sizes
    end = place + int(sizes.sum())
    if place < 0 or end > len(data):
        raise _Damaged("a fragment's samples lie outside the file")
    track["n_samples"] += len(sizes)
    track["sample_bytes"] += end - place
    track["n_keyframes"] += len(keys)
    track["keyframes"] += [{"start": int(a), "length": int(b)} for a, b in zip(starts[keys], sizes[keys])]
    track["chunks"] += [{"start": place, "length": end - place}] if len(sizes) else []
    return end


def _fragment(data: memoryview, start: int, a: int, b: int, tracks: dict[int, dict], preset: dict[int, list[int]], ticks: dict[int, int]) -> None:
    """Adds the samples of the ``moof`` box that begins at ``start`` to their tracks, and their durations to ``ticks``."""
    end = start  # of the samples of the track fragment before
    for outer, at, to in _walk(data, a, b):
        number, base = None, end
        for kind, at, to in _walk(data, at, to) if outer == b"traf" else ():
            if kind not in (b"tfhd", b"trun"):
                continue
            flags, second = _numbers(data, at, to, 2, ">u4").tolist()
            at += 8

            def take(bit: int, form: str, otherwise: int) -> int:
                nonlocal at
                if not flags & bit:
                    return otherwise
                value = int(_numbers(data, at, to, 1, form)[0])
                at += np.dtype(form).itemsize
                return value

            if kind == b"tfhd":
                number = second
                if number not in tracks:
                    raise _Damaged("a fragment of no track")
                base = end = take(0x1, ">i8", start if flags & 0x20000 else end)
                take(0x2, ">u4", 0)
                length, size, mark = (take(bit, ">u4", v) for bit, v in zip((0x8, 0x10, 0x20), preset.get(number, (0, 0, 0))))
            elif number is None or second > len(data):
                raise _Damaged("a run of samples without a head, or of more samples than bytes")
            else:
                end = base + take(0x1, ">i4", end - base)
                first = take(0x4, ">u4", -1)
                given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                columns = dict(zip(given, _numbers(data, at, to, second * len(given), ">u4").reshape(second, len(given)).T))
                lengths, sizes, marks = (columns.get(bit, np.full(second, v, np.int64)) for bit, v in ((0x100, length), (0x200, size), (0x400, mark)))
                if first >= 0:
                    marks[:1] = first
                end = _extend(data, tracks[number], end, sizes, np.flatnonzero(marks & NOT_SYNC == 0))
                ticks[number] = ticks.get(number, 0) + int(lengths.sum())


def parse(data: bytes | None) -> tuple[str, list[dict]]:
    """Status and tracks of one file."""
    if not data:
        return "null" if data is None else "empty", []
    view, tracks, start, preset, ticks, status = memoryview(data), [], 0, {}, {}, "ok"
    try:
        for kind, at, to in _walk(view, 0, len(view)):
            if kind == b"moov":
                for inner, a, b in _walk(view, at, to):
                    if inner == b"trak":
                        tracks.append(_track(view, a, b))
                    elif inner == b"mvex":  # defaults of the fragments' samples: duration, size, flags
                        preset |= {n[1]: n[3:] for n in (_numbers(view, x, y, 6, ">u4").tolist() for k, x, y in _walk(view, a, b) if k == b"trex")}
                named = {t["track_id"]: t for t in tracks if t["track_id"] is not None}
                whole = {n: t["duration"] if t["n_samples"] else 0 for n, t in named.items()}
            elif kind == b"moof":
                _fragment(view, start, at, to, named if tracks else {}, preset, ticks)
            start = to
    except (_Damaged, struct.error):
        status = "damaged"
    for n, more in ticks.items():
        if more:
            named[n]["duration"] = whole[n] + more
            named[n]["duration_s"] = named[n]["duration"] / named[n]["timescale"] if named[n]["timescale"] else None
    return status if tracks or status != "ok" else "no tracks", tracks


def read_samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, in order, by its byte ranges."""
    return b"".join(data[c["start"] : c["start"] + c["length"]] for c in track["chunks"])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum([x.as_py() or 0 for x in pc.binary_length(batch[column])]) if batch.num_rows else np.zeros(0)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES)))
        yield batch.slice(start, stop - start)
        start = stop


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text, null as empty, as a file of 8-bit samples. See ``media_columns`` to read it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "text"):
                raw = [(x or "").encode() for x in batch["text"].to_pylist()]
                files = pa.array([mux(pad(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(x) for x in raw], pa.int64()), files], ["id", "n_bytes", "media"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(write, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def media_columns(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    """The ``keep`` columns, the media, its ``status`` and its ``tracks``; with ``payload`` the first track's stored bytes."""
    kept = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(media_col).alias("media"))
    names = [*kept.columns, "status", "tracks", *["payload"] * payload]
    schema = ", ".join([*(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), f"media binary, status string, tracks array<{TRACK}>", *["payload binary"] * payload])
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    fields = [("track_id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("sample_bytes", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", ranges), ("chunks", ranges)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "media"):
                files = batch["media"].to_pylist()
                found = [parse(x) for x in files]
                columns = [*batch.columns, pa.array([s for s, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(pa.struct(fields)))]
                if payload:
                    columns.append(pa.array([read_samples(x, t[0]) if t else None for x, (_, t) in zip(files, found)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    out = kept.mapInArrow(read, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c) for c in names[len(keep) :]])


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns, from the files that ``text_media`` writes and ``media_columns`` reads."""
    media = text_media(table(spark, sf_dir, "documents"))
    read = media_columns(media, keep=("doc_id", "n_bytes"), payload=True)
    track = F.col("tracks")[0]
    return read.select(
        "doc_id", "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", track["kind"], track["codec"], track["timescale"], track["duration"], track["n_samples"], track["n_keyframes"], F.sha2(F.to_json(track["keyframes"]), 256)).alias("feature"),
        track["codec"].alias("codec"), track["duration_s"].alias("duration_s"), track["keyframes"].alias("keyframes"),
    )
