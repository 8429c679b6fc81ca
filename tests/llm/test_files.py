"""Media columns, token files, packing: exact round trips."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from touchline.llm import media, packing, rans
from touchline.llm.tokens import WordTokenizer, vocabulary

from .conftest import TEXTS


def encode(text, end):
    ids = Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_word_cache_gives_the_library_s_ids(texts):
    library, own = Tokenizer.from_file(vocabulary()), WordTokenizer(vocabulary())
    for text in [*list(texts.values())[:80], *(t or "" for _, t, _, _ in TEXTS), "à ̀b ΑΣ Σ. İstanbul ﬁ ½ ² <|startoftext|>x"]:
        assert np.frombuffer(own.ids(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_ascii_character_in_a_word():
    library, own = Tokenizer.from_file(vocabulary()), WordTokenizer(vocabulary())
    wrong = []
    for c in map(chr, range(128)):
        for text in (f"abc{c}def", f"x{c}", f"{c}y", f"!{c}?", f"1{c}2", f"é{c}a", f"one t{c}wo{c}{c} '{c}s", c):
            if np.frombuffer(own.ids(text), "<u2").tolist() != library.encode(text, add_special_tokens=False).ids:
                wrong.append(text)
    assert not wrong


def test_media_round_trip(odd, none):
    read = media.media_columns(media.text_media(odd), keep=("doc_id", "n_bytes"), payload=True)
    rows = read.collect()
    want = sorted(hashlib.sha256(media.pad((t or "").encode())).hexdigest() for _, t, _, _ in TEXTS)
    assert sorted(hashlib.sha256(r["payload"]).hexdigest() for r in rows) == want
    for r in rows:
        (track,) = r["tracks"]
        assert r["status"] == "ok" and track["codec"] == "raw " and track["kind"] == "soun" and track["duration"] == len(r["payload"]) == track["sample_bytes"]
        assert track["n_samples"] * media.UNIT == len(r["payload"]) and track["n_keyframes"] == -(-track["n_samples"] // media.CHUNK_SAMPLES)
        for k, key in enumerate(track["keyframes"]):
            at = k * media.UNIT * media.CHUNK_SAMPLES
            assert bytes(r["media"][key["start"] : key["start"] + key["length"]]) == bytes(r["payload"][at : at + media.UNIT])
    assert media.media_columns(media.text_media(none), keep=("doc_id",)).count() == 0


def fragmented(samples, keys, cut, version):
    """One video track whose samples, all in fragments of ``cut`` samples, follow each fragment's box."""
    box, full = media._box, media._full
    empty = [full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), *empty, full(b"stsz", struct.pack(">II", 0, 0)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 50, 0, 0, 0)), full(b"hdlr", struct.pack(">I4s12s", 0, b"vide", bytes(12))), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), mdia)
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 2, 0, 0x10000))))
    out = box(b"ftyp", b"iso5", bytes(4)) + moov
    places = []
    for a in range(0, len(samples), cut):
        part = samples[a : a + cut]

        def moof(offset):
            marks = [0 if a + k in keys else 0x10000 for k in range(len(part))]
            if version == 0:  # sizes and marks a sample, counted from the fragment's box
                tfhd = full(b"tfhd", struct.pack(">I", 7), flags=0x20000)
                rows = [struct.pack(">II", len(x), m) for x, m in zip(part, marks)]
                run = full(b"trun", struct.pack(">Ii", len(part), offset), *rows, flags=0x601)
                return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", tfhd, run))
            # an absolute base, a default duration, the first sample's own mark, composition offsets; two runs, the second without offset
            tfhd = full(b"tfhd", struct.pack(">IQI", 7, len(out) + offset, 2), flags=0x9)
            runs = [full(b"trun", struct.pack(">II", 1, marks[0]), struct.pack(">II", len(part[0]), 9), flags=0xA04)]
            runs.append(full(b"trun", struct.pack(">I", len(part) - 1), *(struct.pack(">III", 2, len(x), m) for x, m in zip(part[1:], marks[1:])), flags=0x700))
            return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", tfhd, *runs))

        head = moof(len(moof(0)) + 8)
        at = len(out) + len(head) + 8
        for x in part:
            places.append((at, len(x)))
            at += len(x)
        out += head + box(b"mdat", *part)
    return out, [places[k] for k in sorted(keys)]


@pytest.mark.parametrize("version", [0, 1])
def test_media_fragments(spark, version):
    rng = np.random.default_rng(4)
    samples = [rng.bytes(int(n)) for n in rng.integers(0, 90, 23)]
    keys = {0, 5, 6, 17, 22}
    data, want = fragmented(samples, keys, 5, version)
    files = [(0, data), (1, data[:-1]), (2, data.replace(struct.pack(">I", 7) + bytes(3), struct.pack(">I", 8) + bytes(3))), (3, fragmented([], set(), 5, version)[0])]
    rows = {r["id"]: r for r in media.media_columns(spark.createDataFrame(files, "id int, media binary"), keep=("id",), payload=True).collect()}
    (track,) = rows[0]["tracks"]
    assert rows[0]["status"] == "ok" and rows[0]["payload"] == b"".join(samples)
    assert (track["track_id"], track["codec"], track["n_samples"], track["sample_bytes"], track["duration"], track["duration_s"]) == (7, "avc1", 23, sum(map(len, samples)), 46, 0.92)
    assert [(k["start"], k["length"]) for k in track["keyframes"]] == want and track["n_keyframes"] == 5
    assert rows[1]["status"] == "damaged" and rows[3]["status"] == "ok" and rows[3]["tracks"][0]["n_samples"] == 0
    for cut in range(0, len(data), 7):  # never another error, whatever is cut or overwritten
        assert media.parse(data[:cut])[0] in ("empty", "damaged", "no tracks", "ok")
        assert media.parse(data[:cut] + b"\xff" * 4 + data[cut + 4 :])[0] in ("damaged", "no tracks", "ok")


def test_media_tables_of_several_kinds_and_damage(spark):
    box, full = media._box, media._full

    def movie(tables, mdhd, version=0):
        stsd = full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78)))
        stbl = box(b"stbl", stsd, *tables)
        head = struct.pack(">I", version << 24)
        mdia = box(b"mdia", box(b"mdhd", head, mdhd), full(b"hdlr", struct.pack(">I4s12s", 0, b"vide", bytes(12))), box(b"minf", stbl))
        return box(b"moov", box(b"trak", mdia))

    def tables(at):
        return [full(b"stts", struct.pack(">III", 1, 5, 10)), full(b"stss", struct.pack(">III", 2, 1, 4)), full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 3, 1)),
                full(b"stsz", struct.pack(">II5I", 0, 5, 3, 4, 5, 6, 7)), full(b"co64", struct.pack(">I2Q", 2, at, at + 7))]

    long = struct.pack(">QQIQI", 0, 0, 1000, 50, 0)
    head = len(movie(tables(0), long, 1))
    data = movie(tables(head + 16), long, 1) + struct.pack(">I4sQ", 1, b"mdat", 16 + 25) + bytes(25)
    status, (track,) = media.parse(data)
    assert (status, track["codec"], track["timescale"], track["duration_s"], track["n_samples"], track["sample_bytes"]) == ("ok", "avc1", 1000, 0.05, 5, 25)
    assert [(k["start"] - head - 16, k["length"]) for k in track["keyframes"]] == [(0, 3), (12, 6)]
    assert [c["length"] for c in track["chunks"]] == [7, 18]
    assert media.parse(None)[0] == "null" and media.parse(b"")[0] == "empty" and media.parse(data[:-10])[0] == "damaged" and media.parse(b"hello")[0] == "damaged"
    assert media.parse(box(b"free", b"x"))[0] == "no tracks"
    for cut in range(0, len(data), 7):
        assert media.parse(data[:cut])[0] in ("damaged", "empty", "no tracks")
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b""))], "k int, media binary")
    assert [r["status"] for r in media.media_columns(rows, keep=("k",)).orderBy("k").collect()] == ["ok", "null", "empty"]


@pytest.mark.parametrize("n, lanes", [(0, 4), (1, 4), (3, 4), (4, 4), (1000, 7), (5000, 4096)])
def test_block_round_trip(n, lanes):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype(np.uint16)
    data = rans.encode_file([1, 2], [n - n // 2, n // 2], ids, lanes=lanes, block=900)
    docs, lengths, got = rans.decode_file(data)
    assert docs.tolist() == [1, 2] and lengths.sum() == n and (got == ids).all()
    if n > 2000:  # any block decodes alone, and damage is found
        index, checks, tables, coded = rans.open_file(data)
        assert (rans.decode_blocks(checks[1:2], tables, coded) == ids[900:1800]).all()
        bad = bytearray(data)
        bad[-5] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rans.decode_file(bytes(bad))


def test_frequencies_sum_and_keep_rare_symbols():
    counts = np.zeros(1 << 16, np.int64)
    assert rans.frequencies(counts).sum() == 0
    counts[:60_000] = 1
    counts[5] = 10**12
    f = rans.frequencies(counts)
    assert f.sum() == 1 << 16 and (f[:60_000] > 0).all() and f[60_000:].sum() == 0


def test_token_files(odd, none):
    rows = rans.read_token_files(rans.write_token_files(odd, file_ids=2_000)).collect()
    want = defaultdict(list)
    for i, t, _, _ in TEXTS:
        ids = encode(t, rans.END_ID)
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert rans.read_token_files(rans.write_token_files(none)).count() == 0


@pytest.mark.parametrize("bins", [2, 256])
def test_packing(odd, none, bins):
    rows = packing.pack(odd, window=500, open_bins=bins, with_ids=True).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 500
    for i, t, _, _ in TEXTS:
        ids = encode(t, packing.END_ID)
        pieces = sorted(docs[i], key=lambda r: r["piece"])
        if i != 10:
            assert b"".join(r["ids"] for r in pieces) == ids.astype("<u2").tobytes()
            assert [r["start"] for r in pieces] == list(range(0, len(ids), 500)) and [r["piece"] for r in pieces] == list(range(len(pieces)))
    assert sum(r["length"] for r in docs[10]) == 2 * len(encode("stupid clown " * 30, 1))
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def test_packing_leaves_little_room(documents):
    rows = packing.pack(documents).collect()
    assert len({r["sequence_id"] for r in rows}) <= 1.03 * sum(r["length"] for r in rows) / packing.WINDOW + 2
