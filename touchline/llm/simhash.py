"""Operator 10: near-duplicates by SimHash, all pairs within a radius found exactly, in tiles.

Fingerprints: XXH64 (seed 42, then 43 for further 64-bit lanes) of each word shingle, repeats included; a bit is set if
it is set in over half of the hashes. Texts with the same fingerprint form one class, so copies cost nothing.
Classes are put in order of the population counts of a fingerprint's halves, quarters and bytes, and cut into
tiles. Since two fingerprints differ in at least as many bits as their population counts differ, summed over the bytes,
a pair of tiles whose count ranges lie farther apart than the radius is skipped; so are pairs of small blocks inside a
pair of tiles. All others are compared bit by bit with numpy's exclusive-or and bit counts: no link is missed. Where
links also demand similar sizes (``ratio``), classes are put in order of size first, and tiles and blocks whose sizes
lie too far apart are skipped as well.

Each pair of tiles returns only a spanning forest of its links (at most one edge a class), which keeps every
component and never lists the pairs within a group. Components come from star contraction, written to the shared
folder every round. There are about ``PAIRS`` pairs of tiles for each core of the cluster, so a class is moved about as
often as the square root of that says, whatever the number of classes, until a tile reaches ``MOST`` classes (6 MB); from
there on the number of pairs, the data moved and the comparisons grow with the square of the number of classes.

A small radius (as op10's) needs few of these pairs: cut into radius + m blocks of bits, two fingerprints within the
radius agree in m blocks at least, whichever these are. So each choice of m blocks makes tiles of the classes that agree
in them; only these are compared bit by bit, and no link is missed. m grows with the number of classes, so that a tile keeps
``FEW`` classes or fewer on average, and data moved and comparisons grow with the classes. Classes of tiles that are far
larger (many near copies) meet in the tiles of the other kind, pair of tiles by pair of tiles.

Defined results: null or empty texts and those without words have the fingerprint zero, linked like any other; fewer
words than a shingle make one shingle of all of them; repeated ids stay, row for row; a null id belongs to its
fingerprint's class and is never the smallest; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table, written

WORDS, RADIUS, SEED = 4, 4, 42
#: Pairs of tiles for each core, least and most classes of a tile, classes of a block inside a tile.
PAIRS, LEAST, MOST, BLOCK = 12, 1 << 11, 1 << 18, 256
#: Tiles of agreeing classes: most choices of blocks, classes of a tile on average and at most, rows that a task holds, rows and links at a time.
CHOICES, FEW, CROWD, HELD, LINKS = 64, 1 << 10, 1 << 12, 1 << 17, 1 << 18


def shingles(text: str, words: int) -> list[bytes]:
    """Space-joined runs of ``words`` words of the text, A-Z lower-cased; fewer words: all of them; none: nothing."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1])
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]


def fingerprint(pieces: list[bytes], lanes: int = 1, step: int = 1 << 14) -> list[int]:
    """One unsigned 64-bit number a lane."""
    out = []
    for lane in range(lanes):
        ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
        for a in range(0, len(pieces), step):
            h = np.array([digest(p, SEED + lane) for p in pieces[a : a + step]], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(pieces), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, lanes: int = 1) -> DataFrame:
    """(id, f0 .. f<lanes - 1>): fingerprints as signed 64-bit numbers. No shuffle."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(shingles(t.as_py() or "", words), lanes) for t in batch["text"]], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(marks[:, i]) for i in range(lanes))], ["id", *names])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} bigint" for n in names)]))


def _counts(marks: np.ndarray) -> np.ndarray:
    """Population counts of each byte: (rows, 8 x lanes)."""
    return np.bitwise_count(np.ascontiguousarray(marks).view(np.uint8).reshape(len(marks), -1)).astype(np.int16)


def _order(marks: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """By size, then by the counts of halves, quarters and bytes."""
    c = _counts(marks)
    q = c.reshape(len(c), -1, 2).sum(2)
    h = q.reshape(len(c), -1, 2).sum(2)
    keys = np.concatenate([h, q[:, ::2], c[:, ::2]], 1)
    return np.lexsort([*keys.T[::-1], *([] if sizes is None else [sizes])])


def _boxes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(counts), BLOCK)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def links(left: np.ndarray, right: np.ndarray | None, radius: int, sizes: tuple[np.ndarray, np.ndarray | None] | None = None, ratio: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most ``radius`` differing bits, block by block; ``right`` None: within ``left``, i < j.

    With ``sizes`` (of both sides) the smaller size of a pair must be at least ``ratio`` of the larger one.
    """
    other = left if right is None else right
    (lo, hi), (lo2, hi2) = _boxes(_counts(left)), _boxes(_counts(other))
    if sizes is not None:
        n, n2 = sizes[0], sizes[0] if right is None else sizes[1]
        (least, most), (least2, most2) = _boxes(n), _boxes(n2)
    for p in range(len(lo)):
        near = np.maximum(np.maximum(lo2 - hi[p], lo[p] - hi2), 0).sum(1) <= radius
        if sizes is not None:
            near &= (least2 * ratio <= most[p]) & (least[p] * ratio <= most2)
        a = left[p * BLOCK : (p + 1) * BLOCK]
        for q in np.flatnonzero(near):
            if right is None and q < p:
                continue
            b = other[q * BLOCK : (q + 1) * BLOCK]
            bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for lane in range(1, a.shape[1]):
                bits += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
            i, j = np.nonzero(bits <= radius)
            i, j = i + p * BLOCK, j + q * BLOCK
            if right is None:
                i, j = i[i < j], j[i < j]
            if sizes is not None:
                fits = np.minimum(n[i], n2[j]) >= ratio * np.maximum(n[i], n2[j])
                i, j = i[fits], j[fits]
            if len(i):
                yield i, j


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that join what the pairs join, at most one a member."""
    parent = np.arange(n)
    for i, j in pairs:
        while True:  # hook larger roots on smaller ones until this batch of links is joined
            a, b = parent[i], parent[j]
            if (a == b).all():
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            parent = _roots(parent)
    member = np.flatnonzero(parent != np.arange(n))
    return member, parent[member]


def _tile_key(lanes: int) -> list[Column]:
    """The order of ``_order`` for Spark's range partitioning: halves, then quarters."""
    ones = lambda c, shift, width: F.bit_count(F.shiftrightunsigned(c, shift).bitwiseAND((1 << width) - 1))
    cols = [F.col(f"f{i}") for i in range(lanes)]
    return [*(ones(c, s, 32) for c in cols for s in (0, 32)), *(ones(c, s, 16) for c in cols for s in (0, 32)), *(ones(c, s, 8) for c in cols for s in (0, 16, 32, 48)), *cols]


def tile_size(classes: int, cores: int) -> int:
    """So many classes a tile that about ``PAIRS`` pairs of tiles meet each core; bounded on both sides."""
    return min(MOST, max(LEAST, -(-classes // math.ceil(math.sqrt(2 * PAIRS * cores)))))


def agreements(classes: int, lanes: int, radius: int) -> list[list[tuple[int, int, int]]]:
    """Choices of blocks (lane, first bit, bits), of which two fingerprints within the radius agree in one at least.

    The fewest whose tiles hold ``FEW`` classes on average; none if the radius would need more than ``CHOICES``.
    """
    found: list = []
    for agree in range(1, 64):
        each = -(-(radius + agree) // lanes)
        if each > 64 or math.comb(each * lanes, radius) > CHOICES:
            break
        cuts = [64 * k // each for k in range(each + 1)]
        blocks = [(lane, a, b - a) for lane in range(lanes) for a, b in zip(cuts, cuts[1:])]
        found = [list(c) for c in combinations(blocks, len(blocks) - radius)]
        if classes >> min(sum(n for _, _, n in c) for c in found) <= FEW:
            break
    return found


def run_links(marks: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within the radius among rows of one run; ``ends``: each row's end of its run."""

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(marks[i, lane] ^ marks[j, lane]).astype(np.int16) for lane in range(marks.shape[1])) <= radius

    first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, int)
    size = ends[first] - first
    i, d = np.flatnonzero(np.repeat(size <= 64, size)), 1  # short runs all at once: each row and the d-th after it
    while len(i := i[i + d < ends[i]]):
        fits = near(i, i + d)
        if fits.any():
            yield i[fits], i[fits] + d
        d += 1
    for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist()):
        for p in range(a, a + n, BLOCK):
            top, rest = marks[p : min(p + BLOCK, a + n)], marks[p : a + n]
            bits = np.bitwise_count(top[:, None, 0] ^ rest[None, :, 0])
            for lane in range(1, marks.shape[1]):
                bits += np.bitwise_count(top[:, None, lane] ^ rest[None, :, lane])
            i, j = np.nonzero(bits <= radius)
            i, j = i[i < j], j[i < j]
            if len(i):
                yield i + p, j + p


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer, larger arrays."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= LINKS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def agreeing_edges(classes: DataFrame, count: int, lanes: int, radius: int, choices: list[list[tuple[int, int, int]]], crowd: int = CROWD) -> DataFrame:
    """``class_edges`` by tiles of classes that agree in the blocks of a choice; no tile of more than ``crowd`` classes."""
    names = [f"f{i}" for i in range(lanes)]

    def bits(choice: list[tuple[int, int, int]]) -> Column:
        value, width = F.lit(0).cast("bigint"), 0
        for lane, at, n in choice:
            part = F.shiftrightunsigned(F.col(f"f{lane}"), at).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1).cast("bigint"))
            value, width = value.bitwiseOR(F.shiftleft(part, width)) if width + n <= 64 else F.xxhash64(value, part), width + n
        return value

    tiles = F.array(*[F.struct(F.lit(k).alias("choice"), bits(c).alias("value")) for k, c in enumerate(choices)])
    dealt = classes.select("key", *names, F.explode(tiles).alias("_t")).select("key", *names, "_t.choice", "_t.value")
    crowd = max(crowd, 4 * (count >> min(sum(n for _, _, n in c) for c in choices)))
    crowded = written(dealt.groupBy("choice", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("choice", "value"), "simhash-crowds")
    apart = None
    if not crowded.isEmpty():
        many = written(dealt.join(crowded, ["choice", "value"], "left_semi").select("key", *names).distinct(), "simhash-many")
        apart = tiled_edges(many, many.count(), lanes, radius)
        dealt = dealt.join(crowded, ["choice", "value"], "left_anti")

    def linked(piece: pa.Table) -> pa.RecordBatch:
        key, marks = piece["key"].to_numpy(), np.stack([piece[n].to_numpy() for n in names], 1).view(np.uint64)
        begins = _begins(piece)
        ends = np.repeat(np.r_[begins[1:], len(key)], np.diff(np.r_[begins, len(key)]))
        rank = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[rank] = np.arange(len(key))
        member, root = forest(len(key), ((at[i], at[j]) for i, j in _gathered(run_links(marks, ends, radius))))
        return pa.RecordBatch.from_arrays([pa.array(key[rank[member]], pa.int64()), pa.array(key[rank[root]], pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD and (at := int(_begins(piece := pa.Table.from_batches(held))[-1])):
                yield linked(piece.slice(0, at))
                held, rows = piece.slice(at).to_batches(), piece.num_rows - at
        if rows:
            yield linked(pa.Table.from_batches(held))

    rows, cores = count * len(choices), classes.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(4 * cores, rows >> 12), -(-rows >> 20))
    found = dealt.repartition(parts, "choice", "value").sortWithinPartitions("choice", "value").mapInArrow(run, "src bigint, dst bigint")
    edges = written((found.unionByName(apart) if apart else found).filter("src <> dst").distinct(), "simhash-edges")
    discard(crowded, *((many, apart) if apart else ()))
    return edges


def _begins(piece: pa.Table) -> np.ndarray:
    """Where runs of one (choice, value) begin."""
    choice, value = piece["choice"].to_numpy(), piece["value"].to_numpy()
    return np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (value[1:] != value[:-1])])


def class_edges(classes: DataFrame, lanes: int, radius: int, tile: int | None = None, ratio: float | None = None) -> DataFrame:
    """(src, dst) with dst < src: a spanning forest of all links between classes (key, f0 ..) within the radius.

    ``ratio``: classes have a size ``n`` too, and of a link the smaller one must be at least ``ratio`` of the larger one.
    Tiles in order of population counts are taken with a ``ratio``, a given size of ``tile`` or a large radius.
    """
    count = classes.count()
    choices = agreements(count, lanes, radius) if tile is None and ratio is None else []
    return agreeing_edges(classes, count, lanes, radius, choices) if choices else tiled_edges(classes, count, lanes, radius, tile, ratio)


def tiled_edges(classes: DataFrame, count: int, lanes: int, radius: int, tile: int | None = None, ratio: float | None = None) -> DataFrame:
    """``class_edges`` by pairs of tiles in order of population counts. ``count``: how many classes there are."""
    names = [f"f{i}" for i in range(lanes)]
    tile = tile or tile_size(count, classes.sparkSession.sparkContext.defaultParallelism)
    tiles = max(1, -(-count // tile))
    sized = ratio is not None
    # tiles meet on a place that their order makes nearly constant in a tile, and that a link shifts by ``reach`` at most
    reach = 1 if sized else radius
    step = math.log(1 / ratio) if sized else 1.0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile as one row: keys, marks, sizes and the ranges of its counts; no more than ``tile`` classes each."""
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        marks = np.stack([whole[n].to_numpy() for n in names], 1).view(np.uint64)
        keys, sizes = whole["key"].to_numpy(), whole["n"].to_numpy()
        order = _order(marks, sizes)
        marks, keys, sizes = marks[order], keys[order], sizes[order]
        for part, a in enumerate(range(0, len(keys), tile)):
            m, n = marks[a : a + tile], sizes[a : a + tile]
            c = _counts(m)
            at = np.floor(np.log(np.maximum(n, 1)) / step).astype(int) if sized else c[:, :4].sum(1)
            row = [[TaskContext.get().partitionId() * 1_000_000 + part], [keys[a : a + tile].astype("<i8").tobytes()], [m.astype("<u8").tobytes()], [n.astype("<i8").tobytes()], [c.min(0).tolist()], [c.max(0).tolist()], [int(n.min())], [int(n.max())], [int(at.min())], [int(at.max())]]
            kinds = (pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int32())] * 2, *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["tile", "keys", "marks", "sizes", "lo", "hi", "least", "most", "first", "last"])

    dealt = classes.select("key", *names, F.col("n").cast("bigint").alias("n") if sized else F.lit(0).cast("bigint").alias("n"))
    dealt = dealt.repartitionByRange(tiles, "n", *_tile_key(lanes)) if tiles > 1 else dealt.coalesce(1)
    cuts = written(dealt.mapInArrow(cut, "tile bigint, keys binary, marks binary, sizes binary, lo array<int>, hi array<int>, least bigint, most bigint, first bigint, last bigint"), "simhash-tiles")
    # two ranges of places meet if one begins inside the other's, widened by the reach
    ranges = cuts.select("tile", "lo", "hi", "least", "most", "first", "last")
    a = ranges.withColumn("at", F.explode(F.sequence(F.col("first") - reach, F.col("last") + reach)))
    b = ranges.select(F.col("first").alias("at"), *[F.col(c).alias(c + "2") for c in ("tile", "lo", "hi", "least", "most")])
    gap = F.aggregate(F.arrays_zip("lo", "hi", "lo2", "hi2"), F.lit(0), lambda acc, x: acc + F.greatest(x["lo2"] - x["hi"], x["lo"] - x["hi2"], F.lit(0)))
    meet = a.join(b, "at").filter(gap <= radius)
    if sized:
        meet = meet.filter((F.col("least2") * ratio <= F.col("most")) & (F.col("least") * ratio <= F.col("most2")))
    near = written(meet.select(F.least("tile", "tile2").alias("tile"), F.greatest("tile", "tile2").alias("tile2")).distinct(), "simhash-pairs")
    data = ["keys", "marks", "sizes"]
    left = near.join(cuts.select("tile", *data), "tile").select("tile", "tile2", *data)
    right = near.join(cuts.select(F.col("tile").alias("tile2"), *data), "tile2").select(F.col("tile").alias("a"), F.col("tile2").alias("b"), *[F.col(c).alias(c + "2") for c in data])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        take = lambda t, c: np.frombuffer(t[c][0].as_py(), "<u8" if c.startswith("marks") else "<i8")
        key, marks, n, others, n2 = take(a, "keys"), take(a, "marks").reshape(-1, lanes), take(a, "sizes"), None, None
        if a["tile"][0] != b["b"][0]:
            keys, others, n2 = take(b, "keys2"), take(b, "marks2").reshape(-1, lanes), take(b, "sizes2")
            key = np.concatenate([key, keys])
        rank = np.argsort(key)  # the smallest place is the smallest key
        at = np.empty(len(key), np.int64)
        at[rank] = np.arange(len(key))
        shift = 0 if others is None else len(marks)
        pairs = links(marks, others, radius, (n, n2) if sized else None, ratio or 0.0)
        member, root = forest(len(key), ((at[i], at[j + shift]) for i, j in pairs))
        return pa.table({"src": key[rank[member]], "dst": key[rank[root]]})

    edges = left.groupBy("tile", "tile2").cogroup(right.groupBy("a", "b")).applyInArrow(compare, "src bigint, dst bigint")
    edges = written(edges.distinct(), "simhash-edges")
    discard(cuts, near)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(key, root): each key that reaches a smaller one, and the smallest that it reaches. ``edges``: (src, dst) with dst < src.

    Each round links all larger neighbours of a key to its smallest one, then all smaller ones; it ends when no edge
    changes. Rounds grow with the logarithm of the longest chain. Hot keys are reduced by partial aggregation.
    """
    edges = written(edges.distinct(), "components")
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # minima are written first: a plain table on the other side lets Spark split a hot key's edges in the join
        least = written(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "components-least")
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = written(large.distinct(), "components-large")
        low = written(large.groupBy("src").agg(F.min("dst").alias("m")), "components-low")
        small = large.join(low, "src")
        small = small.select("src", F.col("m").alias("dst")).unionByName(small.filter("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))).distinct()
        after = written(small, "components")
        shape = lambda e: e.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("bigint")), F.sum("dst")).first()
        done = shape(edges) == shape(after)
        discard(edges, least, large, low)
        edges = after
        if done:
            return edges.select(F.col("src").alias("key"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, lanes: int = 1, tile: int | None = None) -> DataFrame:
    """(id, f0 .., component_id) for every row: the smallest id that its fingerprint reaches by links within the radius."""
    names = [f"f{i}" for i in range(lanes)]
    marks = written(fingerprints(docs, id_col, text_col, words, lanes), "simhash-marks")
    classes = written(marks.groupBy(*names).agg(F.min("id").cast("bigint").alias("key")).filter("key IS NOT NULL"), "simhash-classes")
    roots = components(class_edges(classes, lanes, radius, tile))
    found = classes.join(roots, "key", "left").select(*names, F.coalesce("root", "key").alias("component_id"))
    return marks.join(found, names, "left").select(F.col("id").alias(id_col), *names, "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
