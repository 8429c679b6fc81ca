"""Operator 11: conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows, in the order of their turns, span a lattice: a node is (rows consumed, state), the state what the
roles so far allow next (nothing yet, after a system row, after a user row, after an assistant row). Arcs are the edits:
keep, rerole and delete consume a row, insert does not. Costs are whole numbers and no cycle is free.

The auction works on node prices p with p(i) <= cost(i, j) + p(j) for every arc. From an origin it extends a path along
arcs that hold with equality; where none does, the last node's price rises to its least bid and the path contracts by
that node. It ends on a node whose price is known to be its exact distance to the end, and then the prices of the whole
path are exact too. Origins are taken every ``EVERY`` rows from the back; prices begin there with each row's least possible
cost, summed onto the least exact price behind, so a war of bids stays among so few rows and the work grows in proportion
to the rows. Then the cheapest edits are traced from the front over tight arcs, the smallest letter first; an arc that looks tight counts once the
auction has converged its head.

Scale. Equal rows of a conversation and turn are counted before anything else (all but the first are deleted anyway, as
one arc). Rows are then put in order by ranges of (conversation, turn, role, text), so a conversation of any share of the
table spreads over tasks, and are cut into pieces of at most ``ROWS`` rows or ``BYTES`` bytes. A conversation inside one
piece is done there. Pieces of longer ones, or at a range's edge, first give the costs between the states at their two
ends; a pass over those numbers from the back gives each piece the exact prices behind it, a pass over the traced exits
from the front its entry; then pieces are traced in parallel. Their repaired texts run through one hash a conversation, in
order and piece by piece (a hash cannot be split); nothing else of a conversation comes together in one task.
An earlier equal role and text is found by aggregation of hashes, and only rows that may have one are joined.

Defined results: null role or text is one space, a null conversation or turn is one space in the damage key, null turns
come first, equal turns by role, then text. An empty role has no initial and fits nothing. A conversation without rows
after the damage has zeros, an empty audit and the hash of the empty string; so has one whose rows are all deleted, but
for its counts and cost. A null conversation id is a conversation. An empty table gives no rows. Of the input only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, sieve, sift, table, written

#: Costs of edits; what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Most rows and bytes of text of a piece; rows between origins of the auction.
ROWS, BYTES, EVERY = 1024, 1 << 20, 16

START, SYSTEM, USER, DONE = range(4)
#: State after a row with the role that a state wants (user, but assistant after user); after a kept initial.
STEP = (USER, USER, DONE, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
ROLE = ("user", "user", "assistant", "user")
#: Cost from each state to the end when no row is left.
CLOSE = (0, 2 * INSERT, INSERT, 0)
#: A run of rows that must go; the codes of other rows are their initial or o, upper case if truncated.
GONE = "x"


def _moves(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, step to the head) of the arcs of a node before a row, in the order of the letters."""
    out = [("D", DELETE, 4), ("I", INSERT, STEP[state] - state)]
    if code != GONE:
        more = TRUNCATED if code.isupper() else 0
        if (kept := KEPT.get((state, code.lower()))) is not None:
            out.append(("K", more, 4 + kept - state))
        out.append(("R", REROLE + more, 4 + STEP[state] - state))
    return tuple(out)


MOVES = {c: tuple(_moves(c, s) for s in range(4)) for c in "suaoSUAOx"}
#: Least cost of a row in any state.
LEAST = {c: min(cost for s in range(4) for edit, cost, _ in MOVES[c][s] if edit != "I") for c in MOVES}


class Lattice:
    """Rows (codes, and how many rows each stands for) and the exact prices of the four states behind them."""

    def __init__(self, codes: str, runs: list[int], exits: tuple[int, ...] | list[int] = CLOSE):
        n = len(codes)
        self.codes, self.runs, self.steps = codes, runs, 0
        self.price = [0] * (4 * n) + list(exits)
        self.exact = bytearray(4 * n) + bytearray(b"\1\1\1\1")
        end = n
        for begin in range((n - 1) // EVERY * EVERY, -1, -EVERY):
            low = min(self.price[4 * end : 4 * end + 4])  # exact: converged before, or exits
            for i in range(end - 1, begin - 1, -1):
                low += LEAST[codes[i]] * runs[i]
                self.price[4 * i : 4 * i + 4] = [low] * 4
            for state in range(4):
                self.converge(4 * begin + state)
            end = begin

    def arcs(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, head) of a node before some row, in the order of the letters."""
        row, state = divmod(node, 4)
        code = self.codes[row]
        for edit, cost, step in MOVES[code][state]:
            yield edit, cost * self.runs[row] if step == 4 and code == GONE else cost, node + step

    def converge(self, origin: int) -> int:
        """The exact distance of ``origin``: extends and contracts a path until it meets an exact price."""
        price, exact, path = self.price, self.exact, [origin]
        while not exact[path[-1]]:
            self.steps += 1
            node = path[-1]
            bid, head = min((cost + price[j], j) for _, cost, j in self.arcs(node))
            if bid > price[node]:
                price[node] = bid
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            exact[node] = 1
        return price[origin]

    def trace(self, entry: int = START) -> tuple[list[str], int]:
        """The ASCII-least cheapest edits from ``entry`` (one a row or insertion) and the state behind the last row."""
        self.converge(entry)
        node, end, edits = entry, 4 * len(self.codes), []
        while node < end:
            for edit, cost, head in self.arcs(node):
                if cost + self.price[head] == self.price[node] and cost + self.converge(head) == self.price[node]:
                    edits.append(edit)
                    node = head
                    break
        return edits, node - end


def ends_to_ends(codes: str, runs: list[int]) -> list[int]:
    """Cheapest costs from each state before the rows to each state behind them, 4 x 4; -1: not to be reached."""
    out = [-1] * 16
    for target, exits in ((USER, (INSERT, INSERT, 0, INSERT)), (DONE, (2 * INSERT, 2 * INSERT, INSERT, 0))):
        found = Lattice(codes, runs, exits)
        for state in range(4):
            out[4 * state + target] = found.converge(state) if codes else exits[state]
    # nothing but deletions leaves these two states, and one kept row leads from the first to the second
    gone = DELETE * sum(runs)
    out[4 * START + START] = out[4 * SYSTEM + SYSTEM] = gone
    first = [TRUNCATED if c == "S" else 0 for c in set(codes) & set("sS")]
    if first:
        out[4 * START + SYSTEM] = gone - DELETE + min(first)
    return out


def _solve(codes: str, runs: tuple[int, ...], exits: tuple[int, ...], entry: int) -> tuple[str, int, int]:
    found = Lattice(codes, list(runs), exits)
    edits, state = found.trace(entry)
    return "".join(edits), state, found.price[entry] - found.price[4 * len(codes) + state]


_remembered = functools.lru_cache(1 << 16)(_solve)


def solve(codes: str, runs: list[int], exits: list[int], entry: int) -> tuple[str, int, int]:
    """(edits, state behind, cost); short conversations of one shape are solved once a worker."""
    return (_remembered if len(codes) <= 64 else _solve)(codes, tuple(runs), tuple(exits), entry)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the contract's damage by CRC-32 of ``conv_id:turn``; n: how often a row stands."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    gone = kind == 0
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(gone, "").when(kind == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


#: First fault of a row.
FINE, BLANK, AGAIN, CUT = range(4)


def judged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, and ``fault``: the first fault of the first of them (n = 0: no row)."""
    space = " \t\n\x0b\x0c\r"
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    blank = ~F.col("text").rlike(WORD)
    last = F.substring(F.rtrim("text", F.lit(space)), -1, 1)
    mark = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"), 256))
    one = one.withColumn("fault", F.when(F.col("n") == 0, FINE).when(blank, BLANK).when(~last.isin(*".!?"), CUT).otherwise(FINE).cast("int"))
    one = written(one.withColumn("mark", F.when((F.col("n") > 0) & (F.col("fault") != BLANK), mark)), "repair-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = one.filter("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("rows"), F.min(order).alias("first")).filter("rows > 1").select("mark", "first")
    again = written(again, "repair-repeats")
    spotted = sift(one, sieve(again, "mark"), "mark")
    hits = spotted.filter("_hit").join(again, "mark", "left").withColumn("fault", F.when(F.col("first").isNotNull() & (F.col("first") != order), AGAIN).otherwise(F.col("fault")).cast("int"))
    cols = ["conv_id", "turn", "role", "text", "n", "fault"]
    return spotted.filter("NOT _hit").select(*cols).unionByName(hits.select(*cols))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
PIECE = "part bigint, piece bigint, open boolean, codes string, runs array<bigint>, roles array<string>, texts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, rows bigint, head string, tail string, first bigint, last bigint, turns bigint"
LEGAL = ("su", "ua", "au")


class _Piece:
    """Rows of one conversation that stand together in a range."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.runs: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.rows = self.turns = self.bytes = 0
        self.head = self.tail = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int) -> None:
        if not n:
            return
        initial = role[:1]
        self.counts["illegal"] += n - 1 + (self.rows > 0 and self.tail + initial not in LEGAL)
        self.head, self.tail, self.rows = initial if self.head is None else self.head, initial, self.rows + n
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.counts["blank"] += n * (fault == BLANK)
        self.counts["duplicate"] += 0 if fault == BLANK else n - (fault != AGAIN)
        self.counts["truncated"] += fault == CUT
        gone = n
        if fault in (FINE, CUT):
            code = initial if initial in ("s", "u", "a") else "o"
            self.codes.append(code.upper() if fault == CUT else code)
            self.runs.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
            gone -= 1
        if gone:
            if self.codes and self.codes[-1] == GONE:
                self.runs[-1] += gone
            else:
                self.codes.append(GONE)
                self.runs.append(gone)


def pieces(rows: DataFrame, size: int = ROWS, most: int = BYTES) -> DataFrame:
    """Conversations in order, as pieces; ``open``: the conversation may have rows in other pieces."""
    kind = rows.schema["conv_id"].dataType
    names = [f.split()[0] for f in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, at, first, parts, held = TaskContext.get().partitionId(), 0, object(), True, 0, None
        ready: list[tuple] = []
        schema = None

        def close(p: _Piece, open_: bool) -> None:
            nonlocal serial
            ready.append((at, part, serial, open_, "".join(p.codes), p.runs, p.roles, p.texts, *p.counts.values(), p.rows, p.head, p.tail, p.first, p.last, p.turns))
            serial += 1

        def shipped() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], schema=schema)
            ready.clear()
            return out

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *_fields(PIECE)])
            columns = [batch["conv_id"], batch["turn"], batch["role"], batch["text"], batch["n"], batch["fault"]]
            for conv, *row in zip(*(c.to_pylist() for c in columns)):
                if held is None or conv != at:
                    if held is not None:
                        close(held, first or parts > 0)
                        first = False
                    at, parts, held = conv, 0, _Piece()
                elif len(held.codes) >= size or held.bytes >= most:
                    close(held, True)
                    parts, held = parts + 1, _Piece()
                held.add(*row)
                if len(ready) >= 1000 or (ready and held.bytes >= most):
                    yield shipped()
            if ready:
                yield shipped()
        if held is not None:
            close(held, True)  # the next range may go on with it
            yield shipped()

    ordered = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, {PIECE}")
    return written(out.select("conv_id", *names), "repair-pieces")


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))]


def joined_up(parts: DataFrame) -> DataFrame:
    """Open pieces with ``exits`` (exact prices behind them), ``entry`` (state before them) and ``final`` (nothing follows)."""
    key = ["part", "piece"]
    kind = parts.schema["conv_id"].dataType.simpleString()

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [ends_to_ends(c, r) for c, r in zip(b["codes"].to_pylist(), b["runs"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], b["piece"], pa.array(found, pa.list_(pa.int64()))], ["conv_id", *key, "costs"])

    def backward(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "descending"), ("piece", "descending")])
        price, exits = list(CLOSE), []
        for m in rows["costs"].to_pylist():
            exits.append(price)
            price = [min(m[4 * s + t] + price[t] for t in range(4) if m[4 * s + t] >= 0) for s in range(4)]
        return rows.select(["conv_id", *key]).append_column("exits", pa.array(exits, pa.list_(pa.int64()))).append_column("final", pa.array([k == 0 for k in range(len(exits))]))

    def exits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[solve(c, r, e, s)[1] for s in range(4)] for c, r, e in zip(*(b[n].to_pylist() for n in ("codes", "runs", "exits")))]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], b["piece"], pa.array(found, pa.list_(pa.int64()))], ["conv_id", *key, "to"])

    def forward(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("piece", "ascending")])
        state, entries = START, []
        for to in rows["to"].to_pylist():
            entries.append(state)
            state = to[state]
        return rows.select(key).append_column("entry", pa.array(entries, pa.int64()))

    base = f"conv_id {kind}, part bigint, piece bigint"
    narrow = parts.select("conv_id", *key, "codes", "runs")
    prices = written(narrow.mapInArrow(costs, base + ", costs array<bigint>").groupBy("conv_id").applyInArrow(backward, base + ", exits array<bigint>, final boolean"), "repair-prices")
    traced = narrow.join(prices.drop("conv_id"), key).mapInArrow(exits_of, base + ", to array<bigint>")
    entries = written(traced.groupBy("conv_id").applyInArrow(forward, "part bigint, piece bigint, entry bigint"), "repair-entries")
    return parts.join(prices.drop("conv_id"), key).join(entries, key)


def solved(rows: DataFrame, size: int = ROWS, most: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(pieces that hold a whole conversation, pieces of others), ready to be traced. ``rows``: conv_id, turn, role, text, n."""
    cut = pieces(judged(rows), size, most)
    whole = cut.filter("NOT open").withColumns({"exits": F.array(*[F.lit(c).cast("bigint") for c in CLOSE]), "entry": F.lit(START).cast("bigint"), "final": F.lit(True)})
    return whole, joined_up(cut.filter("open"))


def _edits(row: dict) -> tuple[Iterator[tuple[str, str, str, int]], int]:
    """(edit, role, text, how often) in order and the cost, of one piece that is ready to be traced."""
    edits, state, cost = solve(row["codes"], row["runs"], row["exits"], row["entry"])
    if row["final"]:
        edits, cost = edits + "I" * (CLOSE[state] // INSERT), cost + CLOSE[state]

    def run() -> Iterator[tuple[str, str, str, int]]:
        s, i, k = row["entry"], 0, 0
        for e in edits:
            if e == "I":
                yield e, ROLE[s], "", 1
                s = STEP[s]
                continue
            gone = row["codes"][i] == GONE
            role, text = (None, None) if gone else (row["roles"][k], row["texts"][k])
            if e == "D":
                yield e, role, text, row["runs"][i]
            elif e == "R":
                yield e, ROLE[s], text, 1
                s = STEP[s]
            else:
                yield e, role, text, 1
                s = KEPT[s, role[:1]]
            i, k = i + 1, k + (not gone)

    return run(), cost


def repaired_turns(rows: DataFrame, size: int = ROWS, most: int = BYTES) -> DataFrame:
    """(conv_id, part, piece, place, edit, role, text): the rows of the repaired conversations, in the order of part, piece, place."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                kept = [(p, *e[:3]) for p, e in enumerate(_edits(row)[0]) if e[0] != "D"]
                place, edit, role, text = zip(*kept) if kept else ([], [], [], [])
                ids = b["conv_id"].take(pa.array([k] * len(kept), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in (([row["part"]] * len(kept), pa.int64()), ([row["piece"]] * len(kept), pa.int64()), (place, pa.int64()), (edit, pa.string()), (role, pa.string()), (text, pa.string())))], ["conv_id", "part", "piece", "place", "edit", "role", "text"])

    whole, parts = solved(rows, size, most)
    return whole.unionByName(parts).mapInArrow(run, f"conv_id {kind}, part bigint, piece bigint, place bigint, edit string, role string, text string")


#: What a traced piece has for the conversation's result, besides its counts.
TRACED = "part bigint, piece bigint, cost bigint, audit string, lines string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, rows bigint, head string, tail string, first bigint, last bigint, turns bigint"
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair(rows: DataFrame, size: int = ROWS, most: int = BYTES) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit (an edit's letter a row or insertion) and the repaired hash."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    kept = [f.split()[0] for f in TRACED.split(", ")]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                edits, cost = _edits(row)
                audit, lines = [], []
                for e, role, text, n in edits:
                    audit.append(e * n)
                    if e != "D":
                        lines.append(f"{role}:{text}")
                out.append({**row, "cost": cost, "audit": "".join(audit), "lines": "\n".join(lines) if lines else None})
            fields = _fields(TRACED)
            yield pa.RecordBatch.from_arrays([b["conv_id"], *(pa.array([r[n] for r in out], t) for n, t in fields)], ["conv_id", *kept])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a conversation, which stand together and in order, into its result."""
        at, first, held = object(), None, None
        schema = pa.schema(_fields(RESULT))

        def result() -> tuple:
            h = held
            gaps = 0 if h["first"] is None else h["last"] - h["first"] + 1 - h["turns"]
            return (gaps, *(h[c] for c in COUNTS), h["cost"], "".join(h["audit"]), h["hash"].hexdigest())

        def ship(ids: list[pa.Array], done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, f.type) for c, f in zip(zip(*done), schema))], ["conv_id", *schema.names])

        for b in batches:
            ids, done = [], []
            for k, row in enumerate(b.to_pylist()):
                conv = row["conv_id"]
                if held is None or conv != at:
                    if held is not None:
                        ids.append(first)
                        done.append(result())
                    at, first = conv, b["conv_id"][k : k + 1]
                    held = {**dict.fromkeys([*COUNTS, "cost", "rows", "turns"], 0), "first": None, "last": None, "tail": None, "audit": [], "hash": hashlib.sha256(), "begun": False}
                for c in (*COUNTS, "cost", "turns"):
                    held[c] += row[c]
                if row["rows"]:
                    held["illegal"] += held["rows"] > 0 and held["tail"] + row["head"] not in LEGAL
                    held["rows"], held["tail"] = held["rows"] + row["rows"], row["tail"]
                if row["first"] is not None:
                    held["turns"] -= held["last"] == row["first"]
                    held["first"], held["last"] = row["first"] if held["first"] is None else held["first"], row["last"]
                held["audit"].append(row["audit"])
                if row["lines"] is not None:
                    held["hash"].update(("\n" if held["begun"] else "").encode() + row["lines"].encode())
                    held["begun"] = True
            if done:
                yield ship(ids, done)
        if held is not None:
            yield ship([first], [result()])

    whole, parts = solved(rows, size, most)
    done = whole.mapInArrow(lambda b: fold(trace(b)), f"conv_id {kind}, {RESULT}")
    traced = parts.mapInArrow(trace, f"conv_id {kind}, {TRACED}").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return done.unionByName(traced.mapInArrow(fold, f"conv_id {kind}, {RESULT}"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
