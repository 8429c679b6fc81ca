"""Near-duplicate removal for the pipeline: SimHash candidates, links confirmed by exact similarity of shingle sets.

Texts with equal sets of five-word shingles form one class, so copies cost nothing. Fingerprints of 128 bits over the
distinct shingles link classes within 30 bits whose set sizes allow the similarity at all: texts of Jaccard similarity 0.8
differ in 19.4 bits on average (standard deviation 4.1), so 99.6 % of such pairs are candidates, and unrelated texts about
once in a billion pairs. A candidate pair is a link if its shingle sets have a Jaccard similarity of 0.8 or more, counted
exactly (over the upper 32 bits of the shingles' hashes); of each group that links connect, the smallest id stays.

Fingerprints of very few shingles spread too widely (sets of 4 and 5 shingles: 92 % found). Sets of at most ``FEW`` (13)
shingles are therefore linked exactly as well, without fingerprints: at similarity 0.8 two of them differ by at most two
shingles, so each set names itself and its subsets of one or two shingles less by 128-bit hashes (at most 92), and what
meets in a name is a link by its sizes alone. Each name's sets are tied to one of them, so no pairs are made.

Candidates are confirmed inside their components only. Small components share a task; one of more than ``BLOCK`` classes
or ``ELEMENTS`` shingles is cut into blocks by a hash of the key. First every block is joined in itself and with the
component's first class, which goes to every block. Only what that leaves apart from the first class's group is then
compared with the other blocks, so a group of near copies of any size is moved once, and no task holds more than two
blocks. Tasks skip pairs that are already connected and return a spanning forest, never the pairs of a group.

Scale: rows are written once with their marks; 40 bytes a class take part in the tiled comparison (see ``simhash``), sets
only of classes that have a candidate. Texts that have none are told by a bitmap of 8 MB and never moved. Every table is
removed when what needs it is written, but for the rows themselves.

Defined results: texts without words are alike; fewer than five words count as one shingle; rows have a number of their
own, so rows without an id or with the same id are compared like any other; a row with an id stays before one without;
an empty table gives no rows. Columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, sieve, sift, written
from .simhash import class_edges, components, links

WORDS, LANES, RADIUS, SIMILARITY = 5, 2, 30, 0.8
#: Classes and shingles of a block.
BLOCK, ELEMENTS = 4096, 1 << 24
#: Sets of at most so many shingles are linked by their subsets: two differ by at most (13 + 13) / 9 < 3 shingles.
FEW = 13
#: Odd numbers that spread bits (fixed values).
SPREAD, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``words`` words, A-Z lower-cased (fewer words: all of them)."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(codes))
    h = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mixed(h * SPREAD + codes[k : len(codes) - width + 1 + k])
    return np.unique(h)


def set_mark(h: np.ndarray, lanes: int = LANES, step: int = 1 << 14) -> list[int]:
    """The fingerprint of a set of shingle hashes, an unsigned 64-bit number a lane."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), step):
            x = h[a : a + step] if lane == 0 else _mixed(h[a : a + step] + SPREAD * np.uint64(lane))
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
    return out


def marked_rows(docs: DataFrame, text_col: str, words: int = WORDS, lanes: int = LANES) -> DataFrame:
    """``docs`` as k0 .. with a row number ``key``, the identity ``h0, h1`` and size ``n`` of the shingle set, and its mark f0 .."""
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)], F.monotonically_increasing_id().alias("key"))
    place = f"k{docs.columns.index(text_col)}"
    more = ["h0", "h1", "n", *(f"f{i}" for i in range(lanes))]
    names = [*named.columns, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch[place].cast(pa.string()):
                h = shingle_hashes(t.as_py() or "", words)
                whole = xxhash.xxh3_128_intdigest(h.tobytes())
                rows.append((whole >> 64, whole & (1 << 64) - 1, len(h), *set_mark(h, lanes)))
            marks = np.array(rows, np.uint64).reshape(-1, len(more)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in marks.T)], names)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields), *(f"{c} bigint" for c in more)])
    return named.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The first column, a text, becomes ``s``, the sorted distinct upper halves of its shingles' hashes, as bytes."""
    names = [*docs.columns[1:], "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_hashes(t.as_py() or "", words) >> np.uint64(32)).astype("<u4")).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names)

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[1:]) + ", s binary")


def shared(sets: list[np.ndarray], one: int, others: np.ndarray) -> np.ndarray:
    """How many elements the (sorted, not empty) set has in common with each other one."""
    joined = np.concatenate([sets[k] for k in others])
    own = sets[one]
    hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
    ends = np.cumsum([len(sets[k]) for k in others])
    return np.add.reduceat(hit, np.concatenate([[0], ends[:-1]]), dtype=np.int64)


def similar_forest(keys: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], split: int | None, radius: int, similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (larger key, smaller key) that connect what confirmed links connect. Rows before ``split`` are compared with
    those from it on; None: all with all. Rows with the same ``label`` are connected already."""
    n = np.array([len(s) for s in sets], np.int64)
    parent, edges = np.arange(len(keys)), []
    if label is not None:
        first, back = np.unique(label, return_index=True, return_inverse=True)[1:]
        parent = first[back]
    if split is None:
        pairs = links(marks, None, radius, (n, None), similarity)
    else:
        pairs = ((i, j + split) for i, j in links(marks[:split], marks[split:], radius, (n[:split], n[split:]), similarity))
    for i, j in pairs:
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        for x in np.unique(i):
            other = j[i == x]
            other = other[parent[other] != parent[x]]
            if not len(other):
                continue
            both = shared(sets, x, other)
            other = other[both >= similarity * (n[x] + n[other] - both)]
            for y in other:
                if parent[y] != parent[x]:
                    edges.append((max(keys[x], keys[y]), min(keys[x], keys[y])))
                    parent[parent == parent[y]] = parent[x]
    return edges


PLACE = ["key", "task", "blk"]


def _edges(rows: DataFrame, group: list[str], lanes: int, radius: int, similarity: float) -> DataFrame:
    """(src, dst) of each group's rows (key, f0 .., s; ``side`` and ``label`` where two sides are compared)."""
    names = [f"f{k}" for k in range(lanes)]
    two = "side" in rows.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("key", "ascending")] if two else "key")
        split = int((t["side"].to_numpy() == 0).sum()) if two else None
        edges = []
        if split is None or 0 < split < t.num_rows:
            marks = np.stack([t[c].to_numpy() for c in names], 1).view(np.uint64)
            edges = similar_forest(t["key"].to_numpy(), marks, [np.frombuffer(s.as_py(), "<u4") for s in t["s"]], split, radius, similarity, t["label"].to_numpy() if two else None)
        return pa.table({"src": pa.array([e[0] for e in edges], pa.int64()), "dst": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy(*group).applyInArrow(run, "src bigint, dst bigint")


def confirmed(members: DataFrame, lanes: int = LANES, radius: int = RADIUS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(key, root) of classes that confirmed links connect, from (key, task, blk, blocks, first, n, f0 .., s).

    ``task`` names a component, or a number of small ones; ``first`` is the component's first class if it has several blocks.
    """
    names = [f"f{k}" for k in range(lanes)]
    # the first class of a large component stands in all of its blocks
    own = F.when(F.col("key") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("blk"))
    inside = members.withColumn("blk", F.explode(own)).select(*PLACE, *names, "s")
    edges = written(_edges(inside, ["task", "blk"], lanes, radius, similarity), "dedup-inside")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        roots = written(components(edges), "dedup-roots")
        discard(edges)
        return roots
    joined = written(components(edges), "dedup-joined")
    label = large.select("key", "task", "first", "n").join(joined, "key", "left").select("key", "task", "first", "n", F.coalesce("root", "key").alias("label"))
    core = label.filter("key = first").select("task", F.col("label").alias("core"))
    label = written(label.join(core, "task").select("key", "task", "label", (F.col("label") != F.col("core")).alias("apart"), "n"), "dedup-labels")
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / ELEMENTS)).cast("int")
    apart = written(label.filter("apart").groupBy("task").agg(parts.alias("parts")), "dedup-apart")
    # what is apart goes to every block of its component, in parts; a block's rows go to every part
    rows = large.select(*PLACE, "blocks", *names, "s").join(label.select("key", "label", "apart"), "key").join(apart, "task")
    block_rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    apart_rows = rows.filter("apart").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
    apart_rows = apart_rows.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = apart_rows.select(*PLACE, "part", "side", "label", *names, "s").unionByName(block_rows.select(*PLACE, "part", "side", "label", *names, "s"))
    more = written(edges.unionByName(_edges(both, ["task", "blk", "part"], lanes, radius, similarity)), "dedup-across")
    roots = written(components(more), "dedup-roots")
    discard(edges, joined, label, apart, more)
    return roots


def class_groups(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """(h0, h1, grp): the group of each class of ``marked_rows``, named by one of its row numbers."""
    names = [f"f{k}" for k in range(LANES)]
    classes = written(rows.groupBy("h0", "h1", "n", *names).agg(F.min("key").alias("key")), "dedup-classes")
    found = class_edges(classes, LANES, RADIUS, ratio=similarity)
    joined = components(found)
    candidates = written(joined.unionByName(joined.select(F.col("root").alias("key"), "root").distinct()), "dedup-candidates")
    linked = classes.join(candidates, "key")
    groups = written(linked.groupBy("root").agg(F.count("*").alias("classes"), F.sum("n").alias("elements")), "dedup-groups")
    discard(found)
    small = (F.col("classes") <= block) & (F.col("elements") <= ELEMENTS)
    size = groups.filter(small).agg(F.sum("classes").alias("c"), F.sum("elements").alias("e")).first()
    tasks = max(1, (size["c"] or 0) // block, (size["e"] or 0) // ELEMENTS)
    # small components share tasks (named by negative numbers), large ones have their own and are cut into blocks
    blocks = F.when(small, 1).otherwise(F.ceil(F.greatest(F.col("classes") / block, F.col("elements") / ELEMENTS))).cast("int")
    place = groups.select("root", F.when(small, -1 - F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root")).alias("task"), blocks.alias("blocks"), F.when(~small, F.col("root")).alias("first"))
    members = linked.join(place, "root").select("key", "task", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("blk"), "blocks", "first", "n", *names)
    members = written(members, "dedup-members")
    bits = sieve(members)
    texts = sift(rows.select("text", "key"), bits).filter("_hit")
    sets = written(shingle_sets(texts.join(members, "key").select("text", *members.columns)), "dedup-sets", compression="uncompressed")
    roots = confirmed(sets, similarity=similarity, block=block)
    few = few_links(rows, classes, similarity)
    if not few.isEmpty():
        both = written(components(roots.select(F.col("key").alias("src"), F.col("root").alias("dst")).filter("src != dst").unionByName(few)), "dedup-roots")
        discard(roots)
        roots = both
    grouped = written(classes.join(roots, "key", "left").select("h0", "h1", F.coalesce("root", "key").alias("grp")), "dedup-grouped")
    discard(classes, candidates, groups, members, bits, sets, roots, few)
    return grouped


def subset_names(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, s0, s1, size, less) from (text, key): 128-bit names of a set of shingles and of its subsets of ``less`` (0 to
    2) shingles fewer, as far as a set of ``size`` can be similar to another one by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for text, key in zip(batch["text"].to_pylist(), batch["key"].to_pylist()):
                h = shingle_hashes(text or "", words)
                for less, fewest in ((0, 4), (1, 4), (2, 8)):
                    if len(h) - less < fewest:
                        continue
                    for left_out in combinations(range(len(h)), less):
                        name = xxhash.xxh3_128_intdigest(np.delete(h, left_out).tobytes())
                        out.append((key, name >> 64, name & (1 << 64) - 1, len(h) - less, less))
            key, s0, s1, size, less = zip(*out) if out else ((),) * 5
            named = [np.array(x, np.uint64).view(np.int64) for x in (s0, s1)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *map(pa.array, named), pa.array(size, pa.int32()), pa.array(less, pa.int32())], ["key", "s0", "s1", "size", "less"])

    return texts.mapInArrow(run, "key bigint, s0 bigint, s1 bigint, size int, less int")


def few_links(rows: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst) that connect classes of at most ``FEW`` shingles as all links between them do; exact for ``similarity``
    of 0.8 or more. A set and one with another shingle share size / (size + 1), two with one of their own each or a set
    and one with two more size / (size + 2)."""
    few = classes.filter(F.col("n").between(4, FEW)).select("key")
    names = subset_names(rows.filter(F.col("n").between(4, FEW)).select("text", "key").join(few, "key").select("text", "key"))
    one, two = F.col("size") >= similarity * (F.col("size") + 1), F.col("size") >= similarity * (F.col("size") + 2)
    names = written(names.filter(one), "dedup-names")
    whole, near = F.min(F.when(F.col("less") == 0, F.col("key"))), F.min(F.when(F.col("less") < 2, F.col("key")))
    lead = names.groupBy("s0", "s1", "size").agg(whole.alias("whole"), F.when(two, near).alias("near"), F.count("*").alias("sets")).filter("sets > 1 AND (whole IS NOT NULL OR near IS NOT NULL)").drop("sets")
    # sets with one shingle fewer or none are alike among themselves if that is near enough; the others only like the whole set
    to = F.when(F.col("less") == 2, F.when(two, F.col("whole"))).otherwise(F.coalesce("near", "whole"))
    tied = names.join(lead, ["s0", "s1", "size"]).select(F.col("key").alias("src"), to.alias("dst")).filter("src != dst").distinct()
    edges = written(tied, "dedup-few")
    discard(names)
    return edges


def _copies(rows: DataFrame, id_name: str, text_name: str, similarity: float, block: int) -> DataFrame:
    """(key, id, lead) of the rows to drop, and the id of the row that stays in their group."""
    plain = rows.select("key", F.col(id_name).alias("id"), F.col(text_name).cast("string").alias("text"), "h0", "h1", "n", *[f"f{k}" for k in range(LANES)])
    grouped = class_groups(plain, similarity, block)
    named = written(plain.select("key", "id", "h0", "h1").join(grouped, ["h0", "h1"]).select("key", "id", "grp"), "dedup-named")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    leads = written(named.groupBy("grp").agg(first.alias("lead"), F.count("*").alias("rows")).filter("rows > 1").select("grp", F.col("lead.id").alias("lead"), F.col("lead.key").alias("stays")), "dedup-leads")
    gone = written(named.join(leads, "grp").filter("key != stays").select("key", "id", "lead"), "dedup-gone")
    discard(grouped, named, leads)
    return gone


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, lead) of the rows to drop, and the id of the row that stays in their group."""
    rows = written(marked_rows(docs.select(id_col, text_col), text_col), "dedup-rows")
    gone = _copies(rows, "k0", "k1", similarity, block)
    discard(rows)
    return gone.select("id", "lead")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group."""
    rows = written(marked_rows(docs, text_col), "dedup-rows")
    gone = _copies(rows, f"k{docs.columns.index(id_col)}", f"k{docs.columns.index(text_col)}", similarity, block)
    sifted = sift(rows, sieve(gone))
    stay = sifted.filter("NOT _hit").unionByName(sifted.filter("_hit").join(gone.select("key"), "key", "left_anti"))
    return stay.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
