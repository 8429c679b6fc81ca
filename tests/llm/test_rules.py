"""URL filters, mixing, quality rules, toxicity."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import mixing, quality, registry, toxicity, url_filters

from .conftest import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql(name, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c.sql(registry.SQL[name])


@pytest.mark.parametrize("name", list(registry.SQL))
def test_sql_agrees(spark, sf, name):
    want = sql(name, sf)
    df = registry.QUERIES[name](spark, sf)
    got = sorted(map(repr, (tuple(r) for r in df.select(want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall()))


def brute_rule(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_url_filters_against_brute_force(spark):
    rules = [*url_filters.RULES, ("a.b.c.d", "", "block"), ("co.uk", "/x", "allow"), ("NET", "/fr/", "block")]
    urls = ["http://WWW.Example.COM/en/1", "https://example.com/en", "https://example.com/en/", "http://notexample.com/en/", "x.com/en/", None, "", "http://", "http://com/", "ftp://a.net/es/q?x=://b.com/en/", "http://a.net/fr/#a",
            "http://z.a.b.c.d", "http://b.c.d/", "http://s.co.uk/xy", "http://example.com?u=/en/", "http://İ.com/", "a\nb://q.com/\n/en", "http://u@example.com/en/", "http://example.com:80/en/", "http://" + "a." * 5000 + "net/es/"]
    urls += urls[:3]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id int, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.filter_urls(df, table).collect()}
    lower = [(h.lower(), p, v) for h, p, v in rules]
    assert got == {k: brute_rule(u, lower) for k, u in enumerate(urls)}
    assert {r["verdict"] for r in url_filters.filter_urls(df, table.filter("false")).collect()} == {"allow"}
    assert url_filters.filter_urls(df.filter("false"), table).count() == 0


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by repeated resharing; taken by hash order."""
    size = {}
    for _, s, n, _ in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    left = share * sum(size.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * size[s]}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = most * size[s]
        left -= sum(target[s] for s in over)
        free -= over
    return size, target


def test_mixing(spark, odd, none, documents):
    for docs in (odd, documents):
        rows = mixing.mix(docs).collect()
        size, target = brute_mix([(r[0], r["source"], r["size"], None) for r in rows])
        taken = {}
        for r in rows:
            assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"])
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s in size:
            largest = max(r["size"] for r in rows if r["source"] == s)
            assert abs(taken[s] - target[s]) <= max(1, 2 * largest)
        again = mixing.mix(docs.repartition(5)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        assert mixed.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_smaller_mix_is_part_of_a_larger_one(documents):
    small, large = ({r["doc_id"]: r["copies"] for r in mixing.mix(documents, share=s).collect()} for s in (0.3, 0.9))
    assert all(small[k] <= large[k] for k in small)


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics(odd, none, texts):
    some = [t for t in texts.values() if len(t) < 3000][:120] + [t for _, t, _, _ in TEXTS if len(t or "") < 3000] + ["a b c a b c", "a b", " \n \nx\nx", "#*$%&|<>"]
    for t in some:
        assert quality.stats(t)[:5] == brute_stats(t)
    rows = quality.text_stats(odd, keep=("doc_id", "id")).collect()
    assert len(rows) == len(TEXTS) and {r["id"] for r in rows} == {"clash"}
    assert quality.text_stats(none, keep=("doc_id",)).count() == 0


def test_decision_list_learns_conjunctions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] < 0.3)) | (x[:, 2] > 0.95)
    rules = quality.learn_rules(x, bad, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.holds(x, ["a", "b", "c"])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * len(x)
    assert quality.learn_rules(x, np.zeros(len(x), bool), ["a", "b", "c"]) == []


def test_quality_keeps_good_and_rejects_bad(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op5_quality_rules(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r["doc_id"]]["base_failed"]]
    bad, good = [r["doc_id"] for r in labels if r["quality"] == 0], [r["doc_id"] for r in labels if r["quality"] == 1]
    assert sum(got[i]["kept"] for i in good) >= 0.98 * len(good) and sum(got[i]["kept"] for i in bad) <= 0.3 * len(bad)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit_rules(quality.text_stats(odd, keep=("doc_id",)), quality.known_labels(none)) == []
    many = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert sorted(map(tuple, quality.known_labels(many).collect())) == [(1, 0), (2, 1)]
    kept = quality.good_documents(odd, none)
    assert kept.columns == odd.columns and kept.count() < len(TEXTS)


def test_repeated_labelled_rows_teach_once(spark, monkeypatch):
    """However often a labelled document stands in the table, the driver gets one row of it."""
    rows = [(1, f"some good text {k % 3} " * 30) for k in range(500)] + [(2, "another text of words " * 20)]
    seen = []
    monkeypatch.setattr(quality, "learn_rules", lambda x, bad, names: seen.append(len(x)) or [])
    monkeypatch.setattr(quality, "base_failed", lambda prefix="": F.lit(False))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert quality.good_documents(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id bigint, quality int")).count() == 501 and seen == [2]


@pytest.mark.parametrize("block,common,terms", [(8, 5, 40), (64, 0, 40), (16, 30, 400), (4, 1024, 40)])
def test_nearest_examples_are_exact(monkeypatch, block, common, terms):
    """Whatever is skipped, the nearest of each label are those of all cosines."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "FIRST", 2)
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(1500):
        low = rng.integers(0, terms - 20)  # topics: like examples share terms
        t = sorted((low + rng.choice(20, rng.integers(0, 7), replace=False)).tolist())
        vectors.append((t, rng.integers(1, 4, len(t)).tolist()))
    idf, labels = rng.random(terms) + 0.5, rng.integers(0, 2, 1500)
    index = toxicity.ExampleIndex(list(range(1500)), labels.tolist(), vectors, idf)

    def dense(v):
        out = np.zeros(terms)
        if v[0]:
            at, w = index.unit(*v)
            out[at] = w
        return out

    whole = np.array([dense(v) for v in vectors])
    for k in range(0, 1500, 9):
        if not vectors[k][0]:
            continue
        sims = whole @ dense(vectors[k])
        places, got = index.nearest(*vectors[k])
        found = {index.ids[p] for p in places}
        assert np.allclose(got, sims[[index.ids[p] for p in places]], atol=2e-6) and (np.diff(got) <= 0).all()
        for y in (0, 1):
            every = sorted((round(s, 6) for s, l in zip(sims, labels) if l == y and s > 1e-12), reverse=True)
            cut = every[min(15, len(every)) - 1]
            want = {i for i, s in enumerate(sims) if labels[i] == y and s > 1e-12 and round(s, 6) >= cut - 1e-9}
            mine = {i for i in found if labels[i] == y}
            assert all(abs(sims[i] - cut) <= 2e-6 for i in want ^ mine) and len(mine) >= min(15, len(every))  # at the cut rounding may differ
    if common < 1024:
        assert index.opened < index.blocks and index.read < index.postings


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 2, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert (np.diff(ys) >= 0).all() and ys[0] == 0 and ys[-1] == 1


def test_toxicity_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [i for i in labels if got[i]["held_out"]]
    right = [got[i]["predicted"] == labels[i] for i in test]
    hit = [got[i]["predicted"] for i in test if labels[i]]
    assert sum(right) >= 0.9 * len(right) and sum(hit) >= 0.8 * len(hit)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    other = [got[i]["predicted"] for i in test if labels[i] and lang[i] != "en"]
    assert sum(other) >= 0.6 * len(other)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score_toxicity(odd, empty).collect()] == [0.0] * len(TEXTS)
    assert toxicity.score_toxicity(none, spark.read.parquet(f"{sf}/labels.parquet")).count() == 0


def brute_votes(docs, labels, k):
    """Votes of the k nearest of each label by plain dictionaries: id -> share of toxic neighbours, or None without a common term."""
    def terms(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        return Counter([*words, *(w[:n] + "-" for w in words for n in (4, 5) if len(w) >= n)])

    counts = {i: terms(t) for i, t in docs.items()}
    teach = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    na, n = sum(teach.values()), len(teach)
    df, toxic = Counter(t for i in teach for t in counts[i]), Counter(t for i in teach if teach[i] for t in counts[i])

    def lean(t):
        d, a = df[t], toxic[t]
        b = d - a
        if d and a * (n - na) > b * na:
            return math.sqrt(n * (a * (n - na - b) - b * (na - a)) ** 2 / (d * max(n - d, 0.5) * na * (n - na)))
        return 0.0

    vectors = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + (df[t] or 1))) + 1) for t, k in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[i] = {t: x / length for t, x in v.items()}
    out, share, leaning = {}, na / n, {t: lean(t) for t in df}
    for i, v in vectors.items():
        near = []
        for label in (0, 1):
            sims = [(round(sum(x * vectors[j].get(t, 0) for t, x in v.items()), 6), j) for j, y in teach.items() if y == label]
            sims = sorted((s for s in sims if s[0] > 0), reverse=True)
            near += [s for s in sims if s[0] >= sims[min(k, len(sims)) - 1][0]]
        w = [(1 + sum(x * vectors[j].get(t, 0) * leaning.get(t, 0) for t, x in v.items()) / s) ** 2 / (1.05 - min(s, 1)) for s, j in near]
        out[i] = (sum(a * teach[j] for a, (_, j) in zip(w, near)) + 0.5 * share) / (sum(w) + 0.5) if near else None
    return out


def test_toxicity_against_brute_force(spark, sf, documents, texts):
    """Scores are a non-decreasing function of the votes that plain dictionaries give; evidence is the nearest example."""
    labels = {r["doc_id"]: int(r["toxic"] > 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in texts and r["toxic"] is not None}
    got = {r["doc_id"]: r["score"] for r in toxicity.op7_toxicity(spark, sf).collect()}

    def rises(k):
        want, best = brute_votes(texts, labels, k), -1.0
        assert set(got) == set(want)
        for _, score in sorted((v, got[i]) for i, v in want.items() if v is not None):
            if score < best - 2e-3:
                return False
            best = max(best, score)
        return True

    assert [k for k in toxicity.KS if rises(k)]
    for k in toxicity.KS:
        one = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents, spark.read.parquet(f"{sf}/labels.parquet"), ks=(k,)).collect()}
        got = one
        assert rises(k)
    got = {r["doc_id"]: r["score"] for r in toxicity.op7_toxicity(spark, sf).collect()}
    renamed = documents.withColumn("doc_id", -F.col("doc_id"))  # other ids, the same teachers: scores stay as they are
    teach = [(-i, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2]
    known = spark.createDataFrame(teach, "doc_id bigint, toxic int")
    keep, toxicity.held_out = toxicity.held_out, lambda key: F.lit(False)
    try:
        again = {-r["doc_id"]: r["score"] for r in toxicity.score_toxicity(renamed, known).collect()}
    finally:
        toxicity.held_out = keep
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got)


def test_labelled_copies_teach_once_and_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("a", "bad bad words")] * 50 + [("b", "good words here"), ("c", "bad words"), (None, "good")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("b", 0), (None, 1)], "doc_id string, toxic int")
    keep, toxicity.held_out = toxicity.held_out, lambda key: F.lit(False)
    try:
        assert toxicity.teaching_rows(docs.withColumnRenamed("doc_id", "id"), labels, "doc_id", "toxic", 100).count() == 2
        assert toxicity.teaching_rows(docs.withColumnRenamed("doc_id", "id"), labels, "doc_id", "toxic", 100, chars=1).count() < 2
        rows = toxicity.score_toxicity(docs, labels).collect()
    finally:
        toxicity.held_out = keep
    assert len(rows) == 53 and {e["id"] for r in rows for e in r["evidence"]} == {"a", "b"}


def test_the_driver_holds_neither_terms_nor_vectors(spark, monkeypatch):
    """Tasks sort and pack the postings; the driver only deals places, and knows terms by their hashes."""

    def fail(*_):
        raise AssertionError("the driver built the index")

    docs = spark.createDataFrame([(k, f"word{'abcdefghij'[k % 10]} and {'good' if k % 3 else 'bad'} ones") for k in range(60)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic")
    for name in ("__init__", "unpack"):
        monkeypatch.setattr(toxicity.ExampleIndex, name, fail)
    assert toxicity.score_toxicity(docs, labels).count() == 60
    place, *_ = toxicity.weigh_terms(docs.selectExpr("text", "cast(doc_id % 3 = 0 as int) AS y"))
    assert len(place) == place.high.nbytes // 8 and place.high.nbytes + place.low.nbytes == 16 * len(place)
    assert sorted(place.numbers(["bad", "good", "ones", "and", "ones-", "worda", "word-"]))[0] >= 0 and place.numbers(["none", "", "bad-"]) == [-1] * 3


def test_terms_that_share_half_a_hash():
    high, low = toxicity.term_hashes(["some", "other"])
    twice = toxicity.Places(np.repeat(np.sort(high), 3), np.array([1, 2, low[high.argsort()[0]], 3, 4, low[high.argsort()[1]]], np.uint64))
    assert sorted(twice.numbers(["some", "other"])) == [2, 5] and twice.numbers(["else"]) == [-1]


def test_postings_read_straight_give_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(np.sort(rng.choice(900, 12, replace=False)), rng.integers(1, 4, 12)) for _ in range(600)]
    monkeypatch.setattr(toxicity, "COMMON", 20)
    got = []
    for straight in (0.0, 9.0):
        monkeypatch.setattr(toxicity, "STRAIGHT", straight)
        index = toxicity.ExampleIndex(list(range(600)), [k % 2 for k in range(600)], vectors, rng.random(900) * 0 + 1.5)
        assert index.straight == (straight == 0)
        got.append([v[0] for v, _ in index.votes([(*v, 0.0) for v in vectors[:50]], (5,))])
    assert np.allclose(*got, atol=1e-5)


def test_words_are_those_of_the_pattern_and_numbered_together(monkeypatch):
    texts = ["".join(map(chr, range(256))), "".join(f"a{chr(k)}B " for k in range(256)), "Größe ß ÜÑÏ école", "日本 текст x², _a1b", "İstanbul µ ª º ÿ Ÿ", "", None]
    assert [toxicity.letters(t) for t in texts] == [toxicity.LETTERS.findall((t or "").lower()) for t in texts]
    asked, find = [], toxicity.Places.find
    monkeypatch.setattr(toxicity.Places, "find", lambda self, terms: asked.append(len(terms)) or find(self, terms))
    many = [f"text of word{'abcdefghij'[k % 10]}x and {'klmnopqrst'[k // 10]}" for k in range(100)]
    for memory in (math.inf, 7):
        counter = toxicity.TermCounter(toxicity.Places(*(h[toxicity.term_hashes(["of"])[0].argsort()] for h in toxicity.term_hashes(["of"]))), memory)
        found = list(counter.count(many))
        assert all(at.tolist() == [0] and n.tolist() == [1] for at, n, _ in found) and {rest for *_, rest in found} == {7.0}  # text text-, word.x word- word.-, and, one letter
        assert memory == 7 or len(asked) == 1


def test_each_tile_has_its_own_common_terms(monkeypatch):
    """Two vocabularies: a matrix holds the terms of its own examples, and the nearest are those of all cosines."""
    monkeypatch.setattr(toxicity, "TILE", 100)
    rng = np.random.default_rng(4)
    vectors = [(np.sort(rng.choice(60, 20, replace=False)) + 60 * (k % 2), np.ones(20, int)) for k in range(400)]
    idf = rng.random(120) + 1
    index = toxicity.ExampleIndex(list(range(400)), [k // 200 for k in range(400)], vectors, idf)
    assert len(index.tiles) == 4 and sum(m.size for m in index.matrices) <= 0.7 * 400 * 120
    whole = np.zeros((400, 120))
    for row, v in zip(whole, vectors):
        at, w = index.unit(*v)
        row[at] = w
    for k in (0, 1, 250, 399):
        places, got = index.nearest(*vectors[k])
        sims = whole @ whole[k]
        assert np.allclose(got, sims[[index.ids[p] for p in places]], atol=2e-6)
        for y in (0, 1):
            mine = [s for p, s in zip(places, got) if index.labels[p] == y]
            assert np.allclose(mine[:15], np.sort(sims[200 * y : 200 * y + 200])[::-1][:15], atol=2e-6)


def test_common_words_count(spark):
    rows = [(k, f"{'good' if k % 2 else 'fair'} day number{'abcdefghij'[k % 10]} all", int(k % 2 == 0)) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "all that is new"), (101, "123")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert got[100]["evidence"] and 0 < got[100]["evidence"][0]["similarity"] < 0.5 and not got[101]["evidence"]
