"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from touchline.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def broken(rows):
    """{conv_id: rows after the damage, in order}."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        part = out[conv]
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        part.extend([(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    for part in out.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute(rows):
    """The contract, row by row; of each state the cheapest, then least, edits so far."""
    blank = dup = cut = illegal = 0
    seen, faults = set(), []
    for _, role, text in rows:
        f = "blank" if not WORD.search(text) else "dup" if (role, text) in seen else "cut" if WORD.findall(text)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(f)
        blank, dup, cut = blank + (f == "blank"), dup + (f == "dup"), cut + (f == "cut")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wants = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for s, (c, audit, out) in list(best.items()):
                new = (c + 3, audit + "I", (*out, wants[s] + ":"))
                s2 = wants[s][0]
                if s2 not in best or new < best[s2]:
                    best[s2] = new
        return best

    for (_, role, text), f in zip(rows, faults):
        best, nxt = inserted(best), {}
        more = 3 if f == "cut" else 0
        for s, (c, audit, out) in best.items():
            options = [(s, (c + 4, audit + "D", out))]
            if f not in ("blank", "dup"):
                w = wants[s]
                options.append((w[0], (c + 3 + more, audit + "R", (*out, f"{w}:{text}"))))
                if role[:1] == w[0] or (s == "" and role[:1] == "s"):
                    options.append((role[:1], (c + more, audit + "K", (*out, f"{role}:{text}"))))
            for s2, new in options:
                if s2 not in nxt or new < nxt[s2]:
                    nxt[s2] = new
        best = nxt
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def check(df, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    want = {c: brute(part) for c, part in broken(rows).items()}
    assert got == want and len(want) > 0


def invented(seed=0, convs=300, most=30):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "What?", "more text here!", "Größe.", "x" * 300 + "."]
    rows = []
    for c in range(convs):
        for t in range(rnd.choice([1, 2, 3, most])):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"]) if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rnd.choice([t, t, t, t + 1, t * 3, None]), role, rnd.choice(texts + [f"t{rnd.random()}."] * 12) if rnd.random() < 0.95 else None))
    return rows


@pytest.fixture(scope="module")
def rows():
    return [*invented(), *invented(1, 3, 400), (None, None, None, None), (None, 1, "user", "hi."), *[(7, 3, "user", "same text.")] * 50, *[(8, None, "user", " ")] * 5]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_query(spark, sf):
    check(repair.op11_conversation_repair(spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])


def test_odd_rows_and_long_conversations(spark, rows):
    """Whole conversations in a piece and conversations in pieces of few rows give the same."""
    df = repair.damaged(frame(spark, rows).repartition(7))
    check(repair.repair(df), rows)
    check(repair.repair(df, size=3), rows)
    check(repair.repair(df, size=5, most=200), rows)


def test_repaired_turns_alternate(spark, rows):
    out = defaultdict(list)
    for r in sorted(repair.repaired_turns(repair.damaged(frame(spark, rows)), size=4).collect(), key=lambda r: (r["part"], r["piece"], r["place"])):
        out[r["conv_id"]].append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in part)) for part in out.values())
    want = {c: brute(part)[-1] for c, part in broken(rows).items()}
    assert {c: hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in part).encode()).hexdigest() for c, part in out.items()} == {c: h for c, h in want.items() if c in out}


def test_one_conversation_with_most_rows_is_spread(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(6000)] + [(2 + c, t, ("user", "assistant")[t % 2], f"c {c} {t}.") for c in range(1000) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with data that fill the ranges
    cut = repair.pieces(repair.judged(repair.damaged(frame(spark, rows))), size=64)
    held = cut.filter("conv_id = 1").groupBy("part").sum("rows").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 1 and max(r[1] for r in held) < 4500
    check(repair.repair(repair.damaged(frame(spark, rows)), size=64), rows)


def test_nothing_and_other_columns(spark, rows):
    df = frame(spark, rows[:200]).selectExpr("*", "1 AS n", "'x' AS mark", "2 AS fault", "3 AS part", "4 AS codes")
    check(repair.repair(repair.damaged(df)), rows[:200])
    assert repair.repair(repair.damaged(df.filter("false"))).collect() == []
    named = df.withColumn("conv_id", df["conv_id"].cast("string"))
    assert {r["conv_id"]: r["audit"] for r in repair.repair(repair.damaged(named)).collect()} == {None if r["conv_id"] is None else str(r["conv_id"]): r["audit"] for r in repair.repair(repair.damaged(df)).collect()}


def test_prices_are_distances_and_work_is_linear():
    rnd = random.Random(5)
    steps = []
    for n in (500, 2000):
        codes = "".join(rnd.choice("uauauauasoUAx") for _ in range(n))
        found = repair.Lattice(codes, [1] * n)
        back = list(repair.CLOSE)
        for i in range(n - 1, -1, -1):
            arcs = [[(c, j) for _, c, j in found.arcs(4 * i + s)] for s in range(4)]
            now = [min(c + back[j - 4 * i - 4] for c, j in a if j >= 4 * i + 4) for a in arcs]
            for _ in range(2):
                now = [min([now[s]] + [c + now[j - 4 * i] for c, j in arcs[s] if j < 4 * i + 4]) for s in range(4)]
            assert all(found.price[4 * i + s] <= now[s] for s in range(4)) and all(found.price[4 * i + s] == now[s] for s in range(4) if found.exact[4 * i + s])
            back = now
        steps.append(found.steps)
    assert steps[1] < 6 * steps[0]
