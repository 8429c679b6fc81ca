"""Operator 7: toxicity by nearest labelled examples, exact TF-IDF cosine of whole texts over an inverted index.

Terms are the lower-cased runs of letters, and their beginnings of four and five letters (for inflected words); all of
them count, by their inverse document frequency among the labelled texts. Terms that no labelled text has weigh like
those of one, and lengthen the vector. The labelled examples stand in a block-max inverted index, blocks of like examples
of one label; the most common terms of each tile of them are a matrix product, the other postings are read only in blocks
whose largest weights can reach the k-th cosine, or all where bounds would cost more, so the k nearest of each label are exact. Votes weigh by distance, and by how far the terms
that two texts share lean to toxic texts (root of chi-square among the teaching rows); isotonic calibration on
leave-one-out votes makes scores probabilities, and the nearest examples are returned as evidence. The number of
neighbours, one of ``KS``, is that whose leave-one-out votes give the teaching rows the least log loss; ``LEANING`` was
chosen in the same way.

Examples and terms come from at most about ``LABELLED`` labelled ids with about ``CHARS`` characters in all (both chosen
by hashes of the id), one row each, which bounds the vocabulary and the index that are broadcast; every text is scored
whole. Two passes over the labelled texts and one over all texts; only labelled texts are shuffled. Terms are known by
their 128-bit hashes; tasks sort the postings by ranges of terms, so the driver holds hashes, counts and packed postings,
neither terms nor vectors.

Defined results: null and empty texts, and texts without letters, get the calibrated share of toxic examples among
those without letters; texts that share no term with an example get the share among all. Cosines count to six places;
all examples of a label that tie with its k-th vote, so no id decides. Repeated rows are scored row for row; of labelled rows that
share an id one teaches. Without labels of both kinds every score is the share of toxic labels (0 if there are none).
Null labels and ids do not teach; a term counts 65,535 times at most. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, written

#: About so many labelled rows, with about so many characters, teach.
LABELLED, CHARS = 20_000, 1 << 26
#: Neighbours of each label (the choices), terms in a tile's matrix at most and texts scored at a time, pseudo-votes of the overall share, distance added to each, evidence kept.
KS, COMMON, BATCH, PRIOR, NEAR, EVIDENCE = (5, 15), 2048, 512, 0.5, 0.05, 3
#: Power of the leaning of shared terms in a vote.
LEANING = 2
#: Examples a tile, about; shares of a tile's examples from which on a term is common there, and from which on the first few are.
TILE, SHARE, LOW, FEW = 1024, 1 / 16, 1 / 128, 32
#: Examples a block (a power of two, at most 128), blocks of each label opened first, room for rounding in bounds.
BLOCK, FIRST, SLACK = 8, 16, 2e-5
#: Entries a posting from which on postings are read straight, without bounds.
STRAIGHT = 0.78
#: Ranges of terms whose postings are sorted in a task each, and examples whose postings are sent there at a time.
RANGES, POSTED = 64, 1024
#: Words whose terms, and texts whose scores, a worker remembers.
MEMORY, COPIES = 150_000, 10_000
CUT = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of Latin-1 to themselves, its other characters to spaces.
LATIN = bytes(c if LETTERS.fullmatch(chr(c)) else 32 for c in range(256))
#: Lengths of beginnings; they are marked with a hyphen.
BEGINNINGS = (4, 5)
#: Terms of a word at most.
WIDTH = 1 + len(BEGINNINGS)


def held_out(key: Column) -> Column:
    """Rows that teach nothing (fixed by the contract); a null id is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def teaching_rows(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, labelled: int, chars: int = CHARS) -> DataFrame:
    """(id, text, y) of about ``labelled`` ids and ``chars`` characters at most, one row each; ``docs``: id, text."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    share = max(1, known.count() / labelled)
    teach = F.broadcast(known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) / share)))  # bounded by ``labelled``
    one = docs.join(teach, "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.min("y").alias("y"))
    taught = written(one.select("id", "t.text", "y"), "toxic-taught")
    share = max(1, (taught.agg(F.sum(F.length("text"))).first()[0] or 0) / chars)
    return taught.filter(F.pmod(F.xxhash64("id", F.lit("chars")), F.lit(1 << 20)) < int((1 << 20) / share)) if share > 1 else taught


class Places:
    """Numbers of terms by their 128-bit hashes, which ascend: 16 bytes a term, where a dictionary takes over a hundred."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low

    def __len__(self) -> int:
        return len(self.high)

    def numbers(self, terms: list[str]) -> list[int]:
        """The number of each term, -1 if it is not known."""
        return self.find(terms).tolist()

    def find(self, terms: list[str]) -> np.ndarray:
        if not len(self) or not terms:
            return np.full(len(terms), -1)
        high, low = term_hashes(terms)
        at = np.minimum(self.high.searchsorted(high), len(self) - 1)
        same = self.high[at] == high
        found = np.where(same & (self.low[at] == low), at, -1)
        for k in np.flatnonzero(same & (self.low[at] != low)).tolist():  # others with the same first half
            found[k] = next((j for j in range(at[k], int(self.high.searchsorted(high[k], "right"))) if self.low[j] == low[k]), -1)
        return found


def term_hashes(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the terms' 128-bit hashes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


def letters(text: str | None) -> list[str]:
    """The lower-cased runs of letters; texts of Latin-1 alone are parted without the pattern, at a sixth of its time."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return LETTERS.findall(low)


def weigh_terms(texts: DataFrame) -> tuple[Places, np.ndarray, float, dict]:
    """All terms of (text, y) rows, their weights, the weight of a term that none of the rows has, and how many rows have
    each (for ``ExampleIndex``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter, seen = TermCounter(Places(*term_hashes([])), math.inf), [[], []]
            for (at, _), y in zip(counter.places(text.as_py() for text in batch["text"]), batch["y"].to_pylist()):
                seen[y].append(at)
            terms = counter.words.others
            n = [np.bincount(np.concatenate([np.zeros(0, np.int32), *s]), minlength=len(terms)) for s in seen]
            whole = [[len(s)] for s in seen]  # every text has the empty term
            hashes = [pa.array(h.view(np.int64)) for h in map(np.ascontiguousarray, term_hashes(["", *terms]))]
            yield pa.RecordBatch.from_arrays([*hashes, *(pa.array(np.concatenate([w, k]), pa.int64()) for w, k in zip(whole, n))], ["high", "low", "n0", "n1"])

    sums = written(texts.mapInArrow(count, "high bigint, low bigint, n0 bigint, n1 bigint").groupBy("high", "low").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")), "toxic-terms")
    got = sums.toArrow()  # the terms of ``labelled`` texts: 24 bytes each
    high, low, b, a = (got[c].to_numpy() for c in ("high", "low", "n0", "n1"))
    del got
    high, low = high.view(np.uint64), low.view(np.uint64)
    empty = (high == term_hashes([""])[0]) & (low == term_hashes([""])[1])
    nb, na = int(b[empty].sum()), int(a[empty].sum())
    if not nb or not na:
        return Places(high[:0], low[:0]), np.zeros(0), 1.0, {}
    order = np.lexsort((low, high))
    order = order[~empty[order]]
    high, low, a, df = high[order], low[order], a[order], (a + b)[order]
    n = na + nb
    idf = lambda df: np.log((1 + n) / (1 + df)) + 1
    return Places(high, low), idf(df), float(idf(1)), {"toxic": a, "all_": df, "rows": (na, n)}


class Words(dict):
    """Words met so far -> their row among ``terms``, the numbers of their terms (-1: none), once ``settle`` has run.

    A term's number is its place among the known ones, or follows from its place in ``others``.
    """

    def __init__(self, place: Places):
        self.place, self.others, self.heads, self.terms, self.new = place, [], {}, array("i"), []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row

    def settle(self) -> None:
        """Numbers the terms of the words that are new since the last time, all at once."""
        new, self.new = self.new, []
        size = np.fromiter(map(len, new), np.int64, len(new))
        heads = [[word[:n] + "-" for word in new if len(word) >= n] for n in BEGINNINGS]  # marked, so they are no words
        fresh = [head for head in dict.fromkeys(chain(*heads)) if head not in self.heads]
        terms = new + fresh
        found = self.place.find(terms)
        other = np.flatnonzero(found < 0)
        found[other] = len(self.place) + len(self.others) + np.arange(len(other))
        self.others.extend([terms[k] for k in other.tolist()])
        self.heads.update(zip(fresh, found[len(new) :].tolist()))
        rows = np.full((len(new), WIDTH), -1, np.int32)
        rows[:, 0] = found[: len(new)]
        for c, (n, row) in enumerate(zip(BEGINNINGS, heads), 1):
            rows[size >= n, c] = np.fromiter(map(self.heads.__getitem__, row), np.int32, len(row))
        self.terms.frombytes(rows.tobytes())


class TermCounter:
    """``count(texts)``: which of the known terms each text has, ascending, and how often; and the squared length of its others.

    Others are numbered from the last known term on, until the memory is full and starts anew.
    """

    def __init__(self, place: Places, memory: float = MEMORY):
        self.place, self.memory, self.words = place, memory, Words(place)

    def places(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the numbers of all its terms, ascending, and how often it has each; new words are numbered together."""
        waiting: list[np.ndarray] = []
        for text in texts:
            words = letters(text)
            waiting.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
            if len(self.words) > self.memory:
                yield from self._told(waiting)
                waiting, self.words = [], Words(self.place)
        yield from self._told(waiting)

    def _told(self, waiting: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.words.new:
            self.words.settle()
        terms, out = np.frombuffer(self.words.terms, np.int32).reshape(-1, WIDTH), []
        for rows in waiting:
            at = terms[rows].ravel()
            at = np.sort(at[at >= 0])
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            out.append((at[first], np.diff(first, append=len(at)).astype(np.int32)))
        return out

    def count(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for at, n in self.places(texts):
            end = np.searchsorted(at, len(self.place))
            yield at[:end], n[:end], float(((1 + np.log(n[end:])) ** 2).sum())


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def likeness_order(vectors: np.ndarray, size: int) -> np.ndarray:
    """Rows, like ones side by side: halves along the direction of largest spread until ``size`` rows are left."""
    out, stack = [np.zeros(0, np.int64)], [np.arange(len(vectors))]
    while stack:
        part = stack.pop()
        if len(part) <= size:
            out.append(part)
            continue
        x = vectors[part] - vectors[part].mean(0)
        part = part[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
        half = size * -(-len(part) // (2 * size))
        stack += [part[half:], part[:half]]
    return np.concatenate(out)


class Weights:
    """Texts as unit vectors, by the weights of the terms."""

    def __init__(self, idf: np.ndarray, unseen: float = 1.0):
        self.idf, self.unseen = idf, unseen

    def raw(self, t, n) -> np.ndarray:
        return (1 + np.log(np.asarray(n, np.float64))) * self.idf[np.asarray(t, np.int64)]

    def norm(self, w: np.ndarray, rest: float = 0.0) -> float:
        return np.sqrt((w * w).sum() + rest * self.unseen**2)

    def unit(self, t, n, rest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        w = self.raw(t, np.minimum(n, 65_535))
        return np.asarray(t, np.int64), w / self.norm(w, rest)


#: Random directions in which examples are laid out, by their weights of so many most common terms: these part the languages.
SKETCH, LOOK = 32, 1024


class Heads(Weights):
    """What the driver has to know of an example: the scale of its weights, and where it lies in a few random directions."""

    def __init__(self, idf: np.ndarray, unseen: float = 1.0):
        super().__init__(idf, unseen)
        self.look = np.full(len(idf), -1, np.int16)
        self.look[np.argsort(idf, kind="stable")[:LOOK]] = np.arange(min(LOOK, len(idf)))
        self.toss = np.random.default_rng(7).standard_normal((LOOK, SKETCH), np.float32)

    def head(self, t, n, *rest) -> tuple[float, np.ndarray]:
        if not len(t):
            return 1.0, np.zeros(SKETCH)
        t, w = self.unit(t, n)
        seen = self.look[t]
        return 1 / self.norm(self.raw(t, np.minimum(n, 65_535)), *rest), w[seen >= 0] @ self.toss[seen[seen >= 0]]


def posting_keys(t, n, place: int) -> np.ndarray:
    """One number a posting (term, place, count)."""
    return np.asarray(t, np.uint64) << np.uint64(38) | np.uint64(place << 16) | np.minimum(n, 65_535).astype(np.uint64)


def pack_postings(key: np.ndarray, start: int, stop: int) -> dict[str, bytes]:
    """Postings of the terms from ``start`` to ``stop``, compressed: of each (term, block) its block, less that before, and
    its number of postings; of each posting its place in the block and its count; of each term its number of blocks."""
    key = np.sort(key)
    count = key.astype(np.uint16)  # the low bits
    key >>= np.uint64(16)
    local = ((key & np.uint64((1 << 22) - 1)) % np.uint64(BLOCK)).astype(np.uint8)
    key //= np.uint64(BLOCK)
    first = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    size = np.diff(first, append=len(key)).astype(np.uint8)
    key = key[first]
    per_term = np.uint64((1 << 22) // BLOCK)
    block = np.diff((key % per_term).astype(np.int32), prepend=np.int32(0))
    entry = np.diff(np.searchsorted(key // per_term, np.arange(start, stop + 1, dtype=np.uint64))).astype(np.int32)
    return {name: zlib.compress(np.ascontiguousarray(x), 1) for name, x in {"first": size, "block": block, "count": count, "local": local, "entry": entry}.items()}


class ExampleIndex(Weights):
    """Examples as sparse unit vectors in a block-max inverted index: the k of largest cosine of each label, exactly.

    Places are dealt in blocks of ``BLOCK`` like examples of one label, these in tiles. The postings of a tile's most common
    terms (a language has its own) are a matrix that counts for every example of it. The other postings lie by term and block,
    an entry of each (term, block) with the largest weight in it. A block whose common part and largest weights cannot reach the k-th cosine is not opened. Where
    there are nearly as many entries as postings, bounds cost what they save, and the postings are read straight.
    """

    def __init__(self, ids: list, labels: list[int], vectors: list[tuple], idf: np.ndarray, unseen: float = 1.0, toxic: np.ndarray | None = None, all_: np.ndarray | None = None, rows: tuple[int, int] = (0, 0)):
        """``toxic`` and ``all_``: toxic and all teaching texts with each term, of ``rows``: toxic and all teaching texts."""
        head = Heads(idf, unseen).head
        heads = [head(*v) for v in vectors]
        self.lay(ids, labels, [len(v[0]) for v in vectors], [h[0] for h in heads], np.array([h[1] for h in heads], np.float32).reshape(-1, SKETCH), idf, unseen, toxic, all_, rows)
        keys = [posting_keys(v[0], v[1], self.where[i]) for i, v in zip(ids, vectors) if len(v[0])]
        self.pieces = [pack_postings(np.concatenate([np.zeros(0, np.uint64), *keys]), 0, len(idf))]
        self.unpack()

    @classmethod
    def laid(cls, *args) -> ExampleIndex:
        """An index whose postings are still to come (``pieces``); arguments as of ``lay``."""
        index = cls.__new__(cls)
        index.lay(*args)
        return index

    def lay(self, ids: list, labels: list[int], lengths: list[int], scales: list[float], sketch: np.ndarray, idf: np.ndarray, unseen: float = 1.0, toxic: np.ndarray | None = None, all_: np.ndarray | None = None, rows: tuple[int, int] = (0, 0)) -> None:
        """Deals the examples to places, by their numbers of terms, scales and sketches (see ``Heads``)."""
        self.idf, self.unseen = idf, unseen
        self.toxic, self.all, self.rows = (np.zeros(len(idf)) if toxic is None else toxic), (np.zeros(len(idf)) if all_ is None else all_), rows
        if len(idf) >= 1 << 26 or len(ids) >= 1 << 21 or sum(lengths) >= 1 << 31:
            raise ValueError("the index holds up to 2^26 terms and 2^31 postings of 2^21 examples: give a smaller ``labelled`` or ``chars``")
        bare = [y for y, n in zip(labels, lengths) if not n]
        self.share = sum(labels) / max(1, len(labels))
        self.bare = (sum(bare) + PRIOR * self.share) / (len(bare) + PRIOR)
        kinds, dealt, self.tiles = [], [], []
        for y in (1, 0):
            full = [k for k, n in enumerate(lengths) if n and labels[k] == y]
            some = [full[i] for i in likeness_order(sketch[full].astype(np.float64), BLOCK)]
            some += [-1] * (-len(some) % BLOCK)
            kinds.append(slice(len(dealt), len(dealt) + len(some)))
            step = BLOCK * -(-len(some) // (BLOCK * max(1, round(len(some) / TILE)))) or 1
            self.tiles += [slice(len(dealt) + k, len(dealt) + min(k + step, len(some))) for k in range(0, len(some), step)]
            dealt += some
        self.kinds = kinds
        self.ids = [ids[k] if k >= 0 else None for k in dealt]
        self.where = {i: place for place, i in enumerate(self.ids) if i is not None}
        self.labels = np.array([labels[k] if k >= 0 else 0 for k in dealt], np.float64)
        self.scale = np.array([scales[k] if k >= 0 else 1 for k in dealt], np.float32)
        self.opened = self.blocks = self.read = self.postings = 0
        self._lean = None

    @staticmethod
    def opened_piece(packed: dict[str, bytes]) -> tuple[np.ndarray, ...]:
        """First posting of each entry, first entry of each term, block of each entry, count and local place of each posting."""
        read = lambda name, kind: np.frombuffer(zlib.decompress(packed[name]), kind)
        first, entry = (np.append(np.int32(0), np.cumsum(read(name, kind), dtype=np.int32)) for name, kind in (("first", np.uint8), ("entry", np.int32)))
        return first, entry, np.cumsum(read("block", np.int32), dtype=np.int32), read("count", np.uint16), read("local", np.uint8)

    def choose(self, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], bool]:
        """Postings of each term, the (term, tile) pairs that are common, numbered by term and tile, and of each tile those of its matrix; ``straight``."""
        width = max(1, len(self.tiles))
        many = np.array([t.stop - t.start for t in self.tiles] or [1])
        least = np.maximum(1, min(LOW, SHARE) * many)
        sizes, keys, rows, blocks, at, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)], 0, 0
        for first, entry, block, *_ in map(self.opened_piece, self.pieces):
            key, terms = np.repeat(np.arange(len(entry) - 1) * width, np.diff(entry)) + tile[block], len(entry) - 1
            df = np.bincount(key, np.diff(first), terms * width)
            often = np.flatnonzero((df.reshape(-1, width) >= least).ravel())
            sizes.append(np.diff(first[entry]))
            keys.append(often + at * width)
            rows.append(df[often])
            blocks.append(np.bincount(key, minlength=terms * width)[often])
            at, entries = at + terms, entries + len(block)
        size, key, df, of = map(np.concatenate, (sizes, keys, rows, blocks))
        picks = []
        for n in range(width):
            k = np.flatnonzero(key % width == n)
            k = k[np.argsort(-df[k], kind="stable")[:COMMON]]
            picks.append(k[: max(FEW, int((df[k] >= SHARE * many[n]).sum()))])
        pick = np.sort(np.concatenate(picks))
        rare = size - np.bincount(key[pick] // width, df[pick], len(size)).astype(np.int64)
        return rare, key[pick], [np.sort(key[k] // width) for k in picks], bool(entries - of[pick].sum() > STRAIGHT * rare.sum())

    def unpack(self) -> None:
        """Matrices of the tiles and the other postings from their pieces, one piece at a time."""
        self.gain = (1 + np.log(np.maximum(np.arange(65_536), 1))).astype(np.float32)
        width, idf = max(1, len(self.tiles)), self.idf.astype(np.float32)
        tile = np.repeat(np.arange(len(self.tiles)), [(t.stop - t.start) // BLOCK for t in self.tiles])  # of each block
        n, chosen, terms, self.straight = self.choose(tile)
        self.start = np.append(0, np.cumsum(n))  # of each term's postings outside of the matrices
        self.common = np.unique(np.concatenate(terms))
        self.column = np.full(len(idf), -1, np.int32)
        self.column[self.common] = np.arange(len(self.common))
        self.columns = [self.column[t] for t in terms]
        self.slot = np.full((width, len(self.common)), -1, np.int16)  # the other way: column of each common term in each matrix
        for slot, columns in zip(self.slot, self.columns):
            slot[columns] = np.arange(len(columns))
        begin, wide = np.array([t.start for t in self.tiles] or [0]), np.array([len(t) for t in terms])
        cells = np.append(0, np.cumsum([(t.stop - t.start) * w for t, w in zip(self.tiles, wide)], dtype=np.int64))
        matrix = np.zeros(cells[-1], np.float32)
        self.matrices = [matrix[a:b].reshape(t.stop - t.start, w) for a, b, t, w in zip(cells, cells[1:], self.tiles, wide)]
        self.posted = np.zeros(n.sum() if self.straight else 0, np.dtype([("place", np.uint16 if len(self.ids) <= 1 << 16 else np.int32), ("weight", np.float32)]))
        self._bytes = memoryview(self.posted.view(np.uint8))
        kept: list[tuple] = []
        t = p = 0
        for first, entry, block, count, local in map(self.opened_piece, self.pieces):
            size, of = np.diff(first), np.repeat(np.arange(len(entry) - 1), np.diff(entry))
            column = np.full((len(entry) - 1) * width, -1, np.int32)  # in the tile's matrix
            for key in chosen[slice(*np.searchsorted(chosen, [t * width, (t + len(entry) - 1) * width]))]:
                column[key - t * width] = np.searchsorted(terms[key % width], key // width)
            c = column[of * width + tile[block]]
            common = np.repeat(c >= 0, size)
            place = np.repeat(block * BLOCK, size) + local
            e = np.repeat(np.arange(len(block)), size)[common]
            at, c_, k = place[common], c[e], tile[block[e]]
            matrix[cells[k] + (at - begin[k]).astype(np.int64) * wide[k] + c_] = self.gain[count[common]] * self.scale[at] * idf[t + of[e]]
            if self.straight:
                e = slice(p, p + len(place) - len(at))
                place = place[~common]
                self.posted["place"][e] = place
                self.posted["weight"][e] = self.gain[count[~common]] * self.scale[place] * np.repeat(idf[t + of], size)[~common]
                p = e.stop
            else:
                kept.append((size[c < 0], np.bincount(of[c < 0], minlength=len(entry) - 1), block[c < 0], count[~common], local[~common]))
            t += len(entry) - 1
        if not self.straight:
            whole = [np.concatenate([np.zeros(0, kind), *(x[c] for x in kept)]) for c, kind in enumerate((np.int32, np.int32, np.int32, np.uint16, np.uint8))]
            self.first, self.entry = (np.append(np.int32(0), np.cumsum(x, dtype=np.int32)) for x in whole[:2])
            self.block, self.count, self.local = whole[2:]
            del kept
            self.measure()

    def measure(self) -> None:
        """The largest weight of each entry."""
        self.peak = np.zeros(len(self.block), np.float32)
        for a in range(0, len(self.block), 1 << 19):
            e = slice(a, min(a + (1 << 19), len(self.block)))
            p = slice(self.first[e.start], self.first[e.stop])
            place = np.repeat(self.block[e] * BLOCK, np.diff(self.first[e.start : e.stop + 1])) + self.local[p]
            self.peak[e] = np.maximum.reduceat(self.gain[self.count[p]] * self.scale[place], self.first[e] - p.start)
        self.peak *= np.repeat(self.idf.astype(np.float32), np.diff(self.entry))

    def __getstate__(self) -> dict:
        """For the broadcast: packed postings; what follows from them is made in each worker."""
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "entry", "block", "count", "local", "start", "posted", "_bytes", "peak", "gain", "common", "column", "columns", "slot", "matrices", "where", "_lean")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lean = None
        self.where = {i: place for place, i in enumerate(self.ids) if i is not None}
        self.unpack()
        self.pieces = None

    def lean(self, at: np.ndarray, own: int | None = None) -> np.ndarray:
        """Root of chi-square of terms that toxic teaching texts have more often, else 0; ``own``: label of a teaching text
        that is left out."""
        a, df, (na, n) = self.toxic[at].astype(np.float64), self.all[at].astype(np.float64), self.rows
        if own is not None:
            a, df, na, n = a - own, df - 1, na - own, n - 1
        b, nb = df - a, n - na
        chi2 = n * (a * (nb - b) - b * (na - a)) ** 2 / (np.maximum(df, 0.5) * np.maximum(n - df, 0.5) * max(na, 1) * max(nb, 1))
        return np.sqrt(chi2) * ((a * nb > b * na) & (df > 0))

    def search(self, vectors: list[tuple], k: int = max(KS), but: list[int | None] | None = None, own: list[int | None] | None = None):
        """For each text (places, cosines, lean): of each label the k nearest examples with a cosine above 0, and all that
        tie with the last, nearest first; lean: the cosine's parts times the leaning of their terms, summed. ``but``
        leaves out one place, ``own`` its label."""
        units = [self.unit(*v) for v in vectors]
        dense, common = np.zeros((len(units), len(self.common)), np.float32), np.zeros((len(units), len(self.ids)), np.float32)
        for q, (at, w) in zip(dense, units):
            c = self.column[at]
            q[c[c >= 0]] = w[c >= 0]
        for part, columns, rows in zip(self.tiles, self.columns, self.matrices):
            common[:, part] = dense[:, columns] @ rows.T
        if own is None and self._lean is None:
            self._lean = self.lean(np.arange(len(self.idf)))
        begin = np.array([part.start for part in self.tiles])
        for j, (at, w) in enumerate(units):
            lean = self._lean[at] if own is None else self.lean(at, own[j])
            rare = np.flatnonzero(self.start[at + 1] > self.start[at])
            rare = np.concatenate([rare[lean[rare] > 0], rare[lean[rare] <= 0]])  # what leans first: no other is looked up again
            place, cos, part = self._near(common[j].astype(np.float64), at[rare], w[rare], lean[rare], k, but[j] if but else None)
            c = self.column[at]
            leans = np.flatnonzero((c >= 0) & (lean > 0))
            c, q, tile = c[leans], w[leans] * lean[leans], np.searchsorted(begin, place, "right") - 1
            for n in set(tile.tolist()):
                slot, mine = self.slot[n][c], np.flatnonzero(tile == n)
                part[mine] += self.matrices[n][(place[mine] - begin[n])[:, None], slot[slot >= 0]] @ q[slot >= 0]
            yield place, cos, part

    def _near(self, score: np.ndarray, at: np.ndarray, w: np.ndarray, lean: np.ndarray, k: int, but: int | None):
        """``score``: the common terms' part of each cosine, to which that of the others is added."""
        found = (self._read if self.straight else self._open)(score, at, w, lean, k, but)
        if but is not None:
            score[but] = -1
        kinds = [part for part in self.kinds if part.stop > part.start]
        near = [self.best(score[part], k) for part in kinds]
        place = np.concatenate([np.zeros(0, np.int64), *(n + part.start for (n, _), part in zip(near, kinds))])
        cos = np.concatenate([np.zeros(0), *(c for _, c in near)])
        order = np.argsort(-cos, kind="stable")
        place, cos = place[order], cos[order]
        is_near, slot, part = np.zeros(len(score), bool), np.zeros(len(score), np.int32), np.zeros(len(place))
        is_near[place], slot[place] = True, np.arange(len(place))
        for at_, weight, of_ in found:
            hit = np.flatnonzero(is_near[at_])
            part += np.bincount(slot[at_[hit]], weight[hit] * lean[of_[hit]], len(place)) if len(hit) else 0
        return place, cos, part

    def _read(self, score: np.ndarray, at: np.ndarray, w: np.ndarray, lean: np.ndarray, *_) -> list[tuple]:
        """All postings of the terms; gives those of the leaning ones, which come first: (places, parts of the cosine, which of the terms)."""
        start, stop, size = self.start[at], self.start[at + 1], self.posted.itemsize
        n = stop - start
        if not n.any():
            return []
        runs = map(slice, (start * size).tolist(), (stop * size).tolist())
        got = np.frombuffer(b"".join(map(self._bytes.__getitem__, runs)), self.posted.dtype)
        place, weight = got["place"].astype(np.intp), got["weight"] * np.repeat(w, n)
        score += np.bincount(place, weight, len(score))
        self.blocks, self.opened = self.blocks + len(score) // BLOCK, self.opened + len(score) // BLOCK
        self.postings, self.read = self.postings + len(place), self.read + len(place)
        of = np.repeat(np.arange(len(at), dtype=np.int32), n * (lean > 0))
        return [(place[: len(of)], weight[: len(of)], of)]

    def _open(self, score: np.ndarray, at: np.ndarray, w: np.ndarray, lean: np.ndarray, k: int, but: int | None) -> list[tuple]:
        """The same in the blocks that can hold one of the ``k`` nearest of a label."""
        runs = self.entry[at + 1] - self.entry[at]
        e, of = spread(self.entry[at], runs), np.repeat(np.arange(len(at)), runs)
        block = self.block[e]
        bound = score.reshape(-1, BLOCK).max(1) + np.bincount(block, self.peak[e] * w[of], len(score) // BLOCK)
        opened = np.zeros(len(bound), bool)
        found = []

        def open_(which: np.ndarray) -> None:
            opened[which] = True
            pick = np.flatnonzero(which[block])
            size = self.first[e[pick] + 1] - self.first[e[pick]]
            p, of_ = spread(self.first[e[pick]], size), np.repeat(of[pick], size)
            place = np.repeat(block[pick] * BLOCK, size) + self.local[p]
            weight = self.gain[self.count[p]] * (w * self.idf[at])[of_] * self.scale[place]
            np.add(score, np.bincount(place, weight, len(score)), out=score)
            found.append((place, weight, of_))

        kinds = [(part, slice(part.start // BLOCK, part.stop // BLOCK)) for part in self.kinds if part.stop > part.start]
        which = np.zeros(len(bound), bool)
        for _, blocks in kinds:  # those of the largest bounds first: they give the k-th cosine that others must reach
            high = min(FIRST, blocks.stop - blocks.start)
            which[blocks.start + np.argpartition(-bound[blocks], high - 1)[:high]] = True
        open_(which)
        which = np.zeros(len(bound), bool)
        for part, blocks in kinds:
            if but is not None:
                score[but] = -1
            least = np.partition(score[part], -k)[-k] if part.stop - part.start > k else 0
            which[blocks] = (bound[blocks] >= least - SLACK) & ~opened[blocks]
        open_(which)
        self.opened, self.blocks = self.opened + int(opened.sum()), self.blocks + len(opened)
        self.read, self.postings = self.read + sum(len(f[0]) for f in found), self.postings + int((self.first[self.entry[at + 1]] - self.first[self.entry[at]]).sum())
        return found

    @staticmethod
    def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k largest above 0 to six places, and all that tie with the last."""
        peak = score.reshape(BLOCK, -1).max(0) if len(score) % BLOCK == 0 else score  # the k-th largest is not below that of these
        least = np.partition(peak, -k)[-k] if len(peak) > k else 0
        place = np.flatnonzero(score >= least - 1e-5)
        near = np.round(score[place], 6)
        if len(near) > k:
            place, near = place[near >= (cut := np.partition(near, -k)[-k])], near[near >= cut]
        return place[near > 0], near[near > 0]

    def nearest(self, t, n, k: int = max(KS)) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search([(t, n)], k))[:2]

    def votes(self, vectors: list[tuple], ks: tuple[int, ...], but: list[int | None] | None = None, own: list[int] | None = None) -> list[tuple[list[float], list[tuple[object, float, int]]]]:
        """For each text the distance-weighted share of toxic neighbours, for each number of neighbours, and the evidence."""
        out: list = [None] * len(vectors)
        for k, (t, _, rest) in enumerate(vectors):
            if not len(t) or not self.ids:
                out[k] = ([self.share if len(t) or rest else self.bare] * len(ks), [])
        scored = [k for k, v in enumerate(out) if v is None]
        for a in range(0, len(scored), BATCH):
            some = scored[a : a + BATCH]
            pick = lambda xs: [xs[k] for k in some] if xs else None
            for at, (near, sims, part) in zip(some, self.search([vectors[k] for k in some], max(ks), pick(but), pick(own))):
                w, y = (1 + part / np.maximum(sims, 1e-9)) ** LEANING / (NEAR + 1 - np.minimum(sims, 1)), self.labels[near]
                raws = []
                for k in ks:
                    cut = [c[min(k, len(c)) - 1] if len(c := sims[y == label]) else 0.0 for label in (0, 1)]
                    v = w * (sims >= np.where(y > 0, cut[1], cut[0]))
                    raws.append(float(((v * y).sum() + PRIOR * self.share) / (v.sum() + PRIOR)))
                out[at] = (raws, [(self.ids[p], float(s), int(self.labels[p])) for p, s in zip(near[:EVIDENCE], sims)])
        return out


def isotonic(raw: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending votes and the non-decreasing shares that fit them best (pool adjacent violators)."""
    order = np.argsort(raw)
    pools: list[list[float]] = []
    for x, h, n in zip(raw[order], hits[order], rows[order]):
        pools.append([x, h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            x2, h2, n2 = pools.pop()
            x1, h1, n1 = pools[-1]
            pools[-1] = [(x1 * n1 + x2 * n2) / (n1 + n2), h1 + h2, n1 + n2]
    return np.array([p[0] for p in pools]), np.array([(p[1]) / p[2] for p in pools])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, chars: int = CHARS, ks: tuple[int, ...] = KS) -> DataFrame:
    """(id, score, evidence array<struct<id, similarity, toxic>>) for every row."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    taught = teaching_rows(named, labels, id_col, label_col, labelled, chars)
    kind, arrow_kind = named.schema["id"].dataType.simpleString(), to_arrow_type(named.schema["id"].dataType)
    place, weights, unseen, seen = weigh_terms(taught.select("text", "y"))
    place, terms = spark.sparkContext.broadcast(place), len(weights)
    weighed = spark.sparkContext.broadcast((weights, unseen))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, heads = TermCounter(place.value), Heads(*weighed.value)
        for batch in batches:
            found = list(counter.count(text.as_py() for text in batch["text"]))
            head = [heads.head(t, n) for t, n, _ in found]
            lists = [pa.array([v[c] for v in found], pa.list_(pa.int32())) for c in (0, 1)]
            mark = pa.array([xxhash.xxh3_64_intdigest(t.tobytes() + n.tobytes()) >> 1 for t, n, _ in found], pa.int64())
            numbers = [pa.array([float(x) for x in xs], pa.float64()) for xs in ([v[2] for v in found], [h[0] for h in head])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], *lists, numbers[0], mark, pa.array([len(v[0]) for v in found], pa.int32()), numbers[1], pa.array([h[1] for h in head], pa.list_(pa.float64()))], ["id", "y", "t", "n", "rest", "mark", "size", "scale", "sketch"])

    head_kinds = "mark bigint, size int, scale double, sketch array<double>"
    examples = written(taught.mapInArrow(count, f"id {kind}, y int, t array<int>, n array<int>, rest double, {head_kinds}"), "toxic-examples", compression="zstd")
    got = examples.select("id", "y", "mark", "size", "scale", "sketch").toArrow()  # bounded by ``labelled``
    ids, ys, marks = (got[c].to_pylist() for c in ("id", "y", "mark"))
    order = sorted(range(len(ids)), key=lambda k: (marks[k], ys[k], ids[k]))
    got = got.take(pa.array(order, pa.int64()))
    sketch = pc.list_flatten(got["sketch"]).to_numpy().reshape(-1, SKETCH)
    index = ExampleIndex.laid([ids[k] for k in order], [ys[k] for k in order], got["size"].to_pylist(), got["scale"].to_pylist(), sketch, weights, unseen, *seen.values())
    del got, weights, seen
    dealt, width = spark.sparkContext.broadcast(index.where), max(1, -(-terms // RANGES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (batch.slice(k, POSTED) for batch in batches for k in range(0, batch.num_rows, POSTED)):
            keys = [posting_keys(t.values.to_numpy(), n.values.to_numpy(), dealt.value[i]) for i, t, n in zip(batch["id"].to_pylist(), batch["t"], batch["n"]) if len(t)]
            key = np.sort(np.concatenate([np.zeros(0, np.uint64), *keys]))
            ends = np.searchsorted(key, np.arange(0, terms + width, width, dtype=np.uint64) << np.uint64(38))
            parts = [key[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "keys"])

    def pack(part: pa.Table) -> pa.Table:
        k = part["part"][0].as_py()
        packed = pack_postings(np.frombuffer(b"".join(part["keys"].to_pylist()), np.uint64), k * width, min(terms, (k + 1) * width))
        return pa.table({"part": pa.array([k], pa.int32())} | {name: pa.array([x], pa.binary()) for name, x in packed.items()})

    packed = examples.select("id", "t", "n").mapInArrow(post, "part int, keys binary").groupBy("part").applyInArrow(pack, "part int, first binary, block binary, count binary, local binary, entry binary")
    index.pieces = packed.toArrow().sort_by("part").drop_columns("part").to_pylist()
    shared = spark.sparkContext.broadcast(index)
    del index

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [(t.values.to_numpy(), n.values.to_numpy(), r) for t, n, r in zip(batch["t"], batch["n"], batch["rest"].to_pylist())]
            votes = [v for v, _ in shared.value.votes(vectors, ks, [shared.value.where.get(i) for i in batch["id"].to_pylist()], batch["y"].to_pylist())]
            for c, k in enumerate(ks):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(votes), pa.int32()), pa.array([round(v[c], 3) for v in votes], pa.float64()), batch["y"]], ["k", "raw", "y"])

    votes = examples.mapInArrow(alone, "k int, raw double, y int").groupBy("k", "raw").agg(F.sum("y").alias("hits"), F.count("*").alias("rows")).collect()
    fits = []
    for k in ks:
        raw, hits, rows = (np.array([float(v[c]) for v in votes if v["k"] == k]) for c in ("raw", "hits", "rows"))
        xs, ys = isotonic(raw, hits, rows) if len(raw) else (np.zeros(1), np.zeros(1))
        sure = np.clip(np.interp(raw, xs, ys), 1e-3, 1 - 1e-3)
        fits.append((-(hits * np.log(sure) + (rows - hits) * np.log(1 - sure)).sum(), k, xs, ys))
    _, best, xs, ys = min(fits, key=lambda fit: fit[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        counter = TermCounter(place.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            keys = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]  # copies are scored once
            if len(known) > COPIES:
                known.clear()
            new = iter({k: t for k, t in zip(keys, texts) if k not in known}.items())
            while some := dict(islice(new, BATCH)):
                for k, ((raw,), evidence) in zip(some, shared.value.votes(list(counter.count(some.values())), (best,))):
                    known[k] = float(np.interp(raw, xs, ys)), [{"id": i, "similarity": s, "toxic": y} for i, s, y in evidence]
            found = [known[k] for k in keys]
            kinds = pa.list_(pa.struct([("id", arrow_kind), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], kinds)], ["id", "score", "evidence"])

    scored = named.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:{kind},similarity:double,toxic:int>>")
    return scored.withColumnRenamed("id", id_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
