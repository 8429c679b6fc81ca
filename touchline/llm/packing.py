"""Operator 3: best-fit packing of token sequences into training windows of fixed length.

Bounded-space online best-fit: each task holds at most ``open_bins`` open sequences. A bitset over free space (one bit
for each possible number of free tokens) says which free sizes exist; the smallest that is large enough takes the
piece. If none fits, a new sequence opens, and when all places are taken the fullest open one closes first.

Only documents longer than the window are cut, into whole windows and one shorter last piece. A task packs the
documents of its own input split, so nothing is shuffled, a hot source or key spreads as its splits do, and a retried
task packs alike. Each split leaves at most ``open_bins`` sequences partly filled. Sequence numbers are the split's
number times 2^33 plus a counter.

Defined results: null text is empty and still has its end id; equal documents pack one by one; rows repeated under one
id give repeated pieces; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import tokenizer, vocabulary

WINDOW = 4096
OPEN_BINS = 256
END_ID = 1


class BestFit:
    """Places lengths up to ``window`` into sequences; ``place`` gives (sequence, offset)."""

    def __init__(self, window: int, open_bins: int):
        self.window, self.most = window, open_bins
        self.free = 0  # bit f is set: an open sequence has f free tokens
        self.open: dict[int, list[int]] = {}  # free tokens -> open sequences
        self.count = 0  # open sequences
        self.next = 0

    def _take(self, free: int) -> int:
        at = self.open[free]
        sequence = at.pop()
        if not at:
            del self.open[free]
            self.free ^= 1 << free
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        enough = self.free >> length
        if enough:
            free = length + (enough & -enough).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            free, sequence = self.window, self.next
            self.next += 1
        if left := free - length:
            self.open.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.count += 1
        return sequence, self.window - free


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset; ``with_ids`` adds the ids as bytes (u16)."""
    path = path or vocabulary()
    end = np.array([end_id], "<u2").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        fit, base = BestFit(window, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, keys = [], []
            for k, text in enumerate(batch["text"]):
                ids = encode.ids(text.as_py() or "") + end
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for piece, start in enumerate(range(0, len(wide), window)):
                    part = wide[start : start + window]
                    sequence, offset = fit.place(len(part))
                    keys.append(k)
                    rows.append((piece, start, len(part), zlib.crc32(part.tobytes()), base + sequence, offset, *[part.astype("<u2").tobytes()] * with_ids))
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = [pa.int32(), *[pa.int64()] * 5, *[pa.binary()] * with_ids]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
