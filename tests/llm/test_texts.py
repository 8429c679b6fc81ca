"""PII, SimHash and the pipeline against brute force."""

import functools
import hashlib
import math
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import dedup, pii, simhash
from touchline.llm.common import sieve, sift

from .conftest import TEXTS

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


def check_pii(rows, texts):
    for r in rows:
        want = brute_spans(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k, v in want.items() for a, b in v]
        assert [r[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert r["spans"].split(",")[: len(listed)] == listed or not listed


def test_base_spans(spark, texts, odd, tmp_path):
    check_pii(pii.op9_pii(spark, "/root/testdata/sf0.001").collect(), texts)
    odd.filter("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.op9_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) - 1
    check_pii(rows, {i: t for i, t, _, _ in TEXTS})


def test_long_runs_of_digits_and_letters(spark):
    texts = {1: "1" * 100_000, 2: "1 2-" * 30_000, 3: "a" * 200_000 + "@b.c", 4: "+1" + " " * 100_000, 5: "1." * 50_000, 6: "a@b" * 20_000, 7: "(" * 50_000 + "1"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: {k: [(x["start"], x["end"]) for x in r[f"_pii_{k}"]] for k in pii.BASE} for r in pii.find_spans(df).collect()}
    assert got == {i: brute_spans(t) for i, t in texts.items()}


def test_many_matches_in_one_text(spark):
    """A text of a megabyte that is all numbers, or all addresses, takes seconds."""
    texts = {1: "12, " * 260_000, 2: "a@b.co, " * 130_000, 3: "+1 555 123 4567; " * 3000 + "x" * 300 + "1a2b3c4d5e"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_spans(df, weights=[-2.0, *[1.0] * 12]).collect()}
    assert {i: {k: [(x["start"], x["end"]) for x in r[f"_pii_{k}"]] for k in pii.BASE} for i, r in got.items()} == {i: brute_spans(t) for i, t in texts.items()}
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[1] == texts[1] and out[2] == "<email>, " * 130_000 and out[3].startswith("<phone>; <phone>; ") and out[3].count("<phone>") == 3000
    assert time.time() - began < 60


def test_many_added_spans_in_one_text(spark, tmp_path):
    """A megabyte of base and added spans in turn: the query, the masked text, and the added spans alone."""
    mixed = "a@b.co tok1a2b3c4d5e6f7g8 " * 40_000
    docs = spark.createDataFrame([(1, mixed), (2, "tok1a2b3c4d5e6f7g8 " * 1000)], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    weights = pii.fit_spans(docs)[0]
    pii.redacted(docs.limit(0)).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    first, began = time.time() - began, time.time()
    assert (got[1]["n_email"], got[1]["n_secret"], got[2]["n_secret"]) == (40_000, 40_000, 1000)
    alone = pii.find_spans(docs, weights=weights).select(F.size("_pii_added").alias("n")).orderBy("n").collect()
    second, began = time.time() - began, time.time()
    assert [r["n"] for r in alone] == [1000, 40_000]
    assert pii.redacted(docs).filter("doc_id = 1").first()["text"] == "<email> <secret> " * 40_000
    third = time.time() - began
    print("seconds: query, added spans alone, masked text:", round(first), round(second), round(third))
    assert max(first, second, third) < 60


def test_added_spans_stay_apart_from_base_spans(spark):
    """Against a plain loop, with spans of any length and order of kinds."""
    rnd = np.random.default_rng(4)
    rows = []
    for k in range(40):
        at = np.cumsum(rnd.integers(0, 9, 500))
        base = [[(int(a), int(a + rnd.integers(1, 8))) for a in at[j::20]] for j in range(2)]
        rows.append((k, [(int(a), int(a + rnd.integers(1, 12))) for a in np.sort(rnd.integers(0, at[-1], 300))], base[0], base[1]))
    span = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"k int, added {span}, a {span}, b {span}")
    for r in df.withColumn("got", pii.apart(F.col("added"), [F.col("a"), F.col("b")])).collect():
        assert r["got"] == [x for x in r["added"] if not any(x["start"] < y["end"] and y["start"] < x["end"] for y in [*r["a"], *r["b"]])]


def test_long_tokens_are_candidates(spark):
    token = "a1B2" * 75
    df = spark.createDataFrame([(k, f"session token: {token}{k} end") for k in range(20)], "doc_id bigint, text string")
    assert all(t == f"session token: <secret> end" for t in (r["text"] for r in pii.redacted(df).collect()))


def test_estimated_reliabilities_order_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    vote = lambda right: np.where(rng.random(5000) < right, 1, -1) * np.where(truth, 1, -1)
    rows, n = np.unique(np.stack([vote(0.95), vote(0.8), vote(0.6)], 1), axis=0, return_counts=True)
    right, p = pii.estimate([(tuple(map(int, r)), int(c)) for r, c in zip(rows, n)])
    assert right[0] > right[1] > right[2] > 0.5
    weights = pii.train([(list(map(int, r)), q, int(c)) for r, q, c in zip(rows, p, n)])
    assert weights[1] > weights[3] > 0
    assert pii.train([]) == [] and pii.estimate([]) == ([], [])


def test_added_spans_keep_the_labelers_meaning(spark):
    good = [f'set token = "{hashlib.sha1(str(k).encode()).hexdigest()}" here' for k in range(30)]
    bad = [f"number {4000000000000001 + 7 * k} in a text" for k in range(30)]
    bad = [t for t in bad if not luhn(t.split()[1])] + ["just-some-long-hyphenated-words here 2024"] * 5
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id bigint, text string")
    got = {r["doc_id"]: [x["text"] for x in r["_pii_added"]] for r in pii.find_spans(df).collect()}
    assert all(len(got[k]) == 1 and len(got[k][0]) == 40 for k in range(len(good))) and not any(got[k] for k in range(len(good), len(df.collect())))


def test_redaction(spark, odd, none):
    out = {r["doc_id"]: r for r in pii.redacted(odd).collect()}
    assert out[7]["text"].endswith("mail me at <email> or <phone> now") and out[3]["text"] is None and out[4]["text"] == ""
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(none).count() == 0
    assert "x@y.z" not in out[8]["text"] and "q.r" not in out[8]["text"]
    one = spark.createDataFrame([("pay 4111 1111 1111 1111, 10.0.0.1",)], "text string")
    assert pii.redacted(one).first()[0] == "pay <card>, <ip>"


def brute_fingerprint(text, words=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(marks, radius):
    """Smallest id reachable, by repeated sweeps."""
    ids = list(marks)
    root = {i: i for i in ids}
    near = {a: [b for b in ids if (marks[a] ^ marks[b]).bit_count() <= radius] for a in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            least = min(root[b] for b in near[a])
            if least < root[a]:
                root[a], changed = least, True
    return root


def test_simhash(spark, sf, texts):
    rows = simhash.op10_simhash(spark, sf).collect()
    marks = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(marks, 4)


def test_links_in_tiles_and_chains(spark):
    rng = np.random.default_rng(5)
    marks = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for _ in range(6):  # chains of steps of up to four bits, and one large group of near copies
        m = marks[rng.integers(len(marks))]
        for _ in range(20):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                m ^= 1 << int(b)
            marks.append(m)
    unique = sorted(set(marks), key=lambda m: (m * 2654435761) % (1 << 61))
    classes = spark.createDataFrame([(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(unique)], "key bigint, f0 bigint")
    want = brute_components(dict(enumerate(unique)), 4)
    for tile in (40, 1 << 15):
        got = {r["key"]: r["root"] for r in simhash.components(simhash.class_edges(classes, 1, 4, tile)).collect()}
        assert {k: got.get(k, k) for k in want} == want
    sizes = rng.integers(1, 60, len(unique))
    got = sum(len(i) for i, _ in simhash.links(np.array(unique, np.uint64)[:, None], None, 12, (sizes, None), 0.8))
    assert got == sum(bin(a ^ b).count("1") <= 12 and min(sizes[k], sizes[j]) >= 0.8 * max(sizes[k], sizes[j]) for k, a in enumerate(unique) for j, b in enumerate(unique[:k])) > 0
    i, j = (np.concatenate(x) for x in zip(*simhash.links(np.array(unique, np.uint64)[:, None], None, 4)))
    assert len(i) == sum(bin(a ^ b).count("1") <= 4 for k, a in enumerate(unique) for b in unique[:k])


def test_links_of_classes_that_agree_in_blocks(spark, monkeypatch):
    """Every link is met in tiles that a choice of blocks makes, also where one tile is crowded; far fewer pairs are compared."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 3_000, dtype=np.uint64)
    turned = base[:300].copy()
    for k, m in enumerate(turned):
        for b in rng.choice(64, 1 + k % 6, replace=False):
            turned[k] ^= np.uint64(1) << np.uint64(b)
    crowd = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    unique = rng.permutation(np.unique(np.concatenate([base, turned, crowd])))
    classes = spark.createDataFrame(list(enumerate(unique.view(np.int64).tolist())), "key bigint, f0 bigint")
    n, parent = len(unique), {}
    pairs = list(simhash.links(unique[:, None], None, 4))
    member, root = simhash.forest(n, iter(pairs))
    parent = dict(zip(member.tolist(), root.tolist()))
    for classes_at_size in (n, 1 << 40, 1 << 45):  # one, two and three blocks agree
        choices = simhash.agreements(classes_at_size, 1, 4)
        assert len(choices) == {n: 5, 1 << 40: 35, 1 << 45: 35}[classes_at_size]
    assert len(simhash.agreements(1 << 25, 1, 4)) == 15 and simhash.agreements(n, 2, 30) == [] and len(simhash.agreements(n, 2, 4)) >= 5
    for choices, most in ((simhash.agreements(n, 1, 4), 1 << 12), (simhash.agreements(1 << 25, 1, 4), 100), (simhash.agreements(n, 1, 4), 100)):
        monkeypatch.setattr(simhash, "HELD", 500)
        got = {r["key"]: r["root"] for r in simhash.components(simhash.agreeing_edges(classes, n, 1, 4, choices, most)).collect()}
        assert got == parent
    monkeypatch.setattr(simhash, "tiled_edges", None)  # a small radius needs no pairs of whole tiles
    assert {r["key"]: r["root"] for r in simhash.components(simhash.class_edges(classes, 1, 4)).collect()} == parent
    small = simhash.class_edges(classes.limit(0), 1, 4)
    assert small.count() == 0


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["f0"] == by[4]["f0"] == by[5]["f0"] == 0 and by[5]["component_id"] == 3 and by[2]["component_id"] == 1
    assert simhash.near_duplicates(none).count() == 0


@functools.cache
def shingle_memo(text):
    return simhash.shingles(text, 5)


def jaccard(a, b):
    a, b = (set(shingle_memo(t or "")) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_without_copies(spark, documents, texts, odd, none):
    words = " ".join(texts.values()).split()
    base = " ".join(words[:400])
    changed = lambda k: " ".join(w if n % 97 != k else f"other{k}" for n, w in enumerate(words[:400]))
    far = " ".join(w if n % 9 else "away" for n, w in enumerate(words[:400]))
    more = {9000: base, 9001: changed(1), 9002: changed(2), 9003: base, 9004: far}
    df = documents.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more.items()], documents.schema))
    everything = texts | more
    root = {i: i for i in everything}
    near = [(a, b) for a in everything for b in everything if b < a and abs(len(everything[a]) - len(everything[b])) <= 0.25 * max(len(everything[a]), 60) and jaccard(everything[a], everything[b]) >= 0.8]
    for _ in range(20):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    for block in (4096, 3):  # one task, and blocks of three texts
        gone = {r["id"]: r["lead"] for r in dedup.copies(df, block=block).collect()}
        assert gone == {i: r for i, r in root.items() if i != r}
    assert {9001, 9002, 9003} <= set(gone) and 9004 not in gone
    stay = dedup.without_copies(odd)
    assert stay.columns == odd.columns and sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 1, 3, 6, 7, 8, 9, 10]  # both rows of id 10 have one text
    assert dedup.without_copies(none).count() == 0
    same = spark.createDataFrame([(None, base), (None, changed(1)), ("b", changed(2)), ("a", base), (None, far)], "doc_id string, text string")
    assert sorted(r["doc_id"] or "" for r in dedup.without_copies(same).collect()) == ["", "a"]


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "key")
    got = sift(spark.range(60_000).withColumnRenamed("id", "key"), sieve(keys)).collect()
    hit = {r["key"] for r in got if r["_hit"]}
    assert len(got) == 60_000 and hit >= set(range(0, 30_000, 3)) and len(hit) < 10_000 + 60
    assert not sift(keys, sieve(keys.filter("false"))).filter("_hit").count()


def test_links_across_blocks(spark, texts):
    """Groups cut into blocks of a few texts: a chain of drifting copies, and a group around one text, give what all pairs give."""
    rng = np.random.default_rng(9)
    words = " ".join(texts.values()).split()
    made, last = {}, words[:300]
    for k in range(60):  # each is near the one before, the ends are far apart
        made[k] = " ".join(last)
        last = [w if rng.random() > 0.012 else f"new{k}" for w in last]
    for k in range(60, 120):
        made[k] = " ".join(w if rng.random() > 0.02 else f"other{k}" for w in words[400:700])
    root = {i: i for i in made}
    near = [(a, b) for a in made for b in range(a) if jaccard(made[a], made[b]) >= 0.8]
    for _ in range(60):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    want = {i: r for i, r in root.items() if i != r}
    assert len(want) > 60
    for block in (5, 16, 4096):
        assert {r["id"]: r["lead"] for r in dedup.copies(df, block=block).collect()} == want


def test_copies_of_few_words_are_found_exactly(spark):
    """Sets of 4 to 13 shingles, all links between them counted by all pairs; fingerprints alone lose some."""
    rng = np.random.default_rng(17)
    made = {}
    for g in range(400):
        base = [f"w{x}" for x in rng.integers(0, 10**9, rng.integers(8, 18))]
        for k in range(3):  # a word more at an end, a word fewer, another word at an end
            made[4 * g + k] = " ".join([base + ["more"], base[1:], ["else"] + base[1:]][k])
        made[4 * g + 3] = " ".join(base)
    root = {i: i for i in made}
    for g in range(400):
        near = [(a, b) for a in range(4 * g, 4 * g + 4) for b in range(4 * g, a) if jaccard(made[a], made[b]) >= 0.8]
        for _ in range(4):
            for a, b in near:
                root[a] = root[b] = min(root[a], root[b])
    want = {i: r for i, r in root.items() if i != r}
    assert len(want) > 600 and len(want) < 1200
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    assert {r["id"]: r["lead"] for r in dedup.copies(df).collect()} == want


def linked(texts, similarity=0.8):
    """Root of each id's group by every link of the whole table: sets that are alike share one of their rarest shingles."""
    sets = {}
    for i, t in sorted(texts.items()):
        sets.setdefault(frozenset(shingle_memo(t or "")), []).append(i)
    root = {i: ids[0] for ids in sets.values() for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    often = Counter(x for s in sets for x in s)
    order = sorted(sets, key=len)
    places, links = defaultdict(list), 0
    for s in order:
        few = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]
        for other in {o for x in few for o in places[x]}:
            if len(other) >= similarity * len(s) and len(s & other) >= similarity * len(s | other):
                links += 1
                a, b = find(sets[s][0]), find(sets[other][0])
                root[max(a, b)] = min(a, b)
        for x in few:
            places[x].append(s)
    return {i: find(i) for i in root}, links


def test_copies_of_a_whole_table(spark, sf):
    """No link of sf0.01 is lost and none is made up."""
    docs = spark.read.parquet(f"{os.path.dirname(sf)}/sf0.01/documents.parquet")
    root, links = linked({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    want = {i: r for i, r in root.items() if i != r}
    assert links and len(want) > 50
    assert {r["id"]: r["lead"] for r in dedup.copies(docs).collect()} == want


def test_copies_with_a_repeated_footer(spark, texts):
    words = " ".join(texts.values()).split()
    made, size, footer = {}, 0, "read more about this and other things on our page"
    for k, n in enumerate((400, 400, 700, 1000)):
        base = " ".join(words[size : size + n])
        size += n
        for j, times in enumerate((0, 10, 20, 50)):
            made[10 * k + j] = base + f" {footer}" * times
    assert all(jaccard(made[10 * k], made[10 * k + j]) >= 0.8 for k in range(4) for j in range(1, 4))
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    assert {r["id"]: r["lead"] for r in dedup.copies(df).collect()} == {i: i // 10 * 10 for i in made if i % 10}


def test_pipeline(spark, sf, odd, none, tmp_path):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns[0] == "doc_id" and rows.count() > 0
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
