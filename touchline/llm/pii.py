"""Operator 9: personal data by weak supervision (DataFrame and SQL functions only).

Base spans (email, ip, card, phone) are found by fixed patterns. Further candidates are tokens with an ``@``, runs of
digits and long tokens that mix letters and digits. Labelers vote on every candidate of the corpus: patterns and check
digits, gazetteers of words before it and of mail domains, and its shape. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability and each pattern's probability without any labels; a logistic span
classifier is trained on these probabilities over the candidate's features and decides as one Spark expression.

Scale: candidates are found row by row, without a shuffle, and only texts with the needed characters run the patterns.
Training sees counts of vote and feature patterns (each a small number of settings: at most 3^7 x 2^5), summed before
they are shuffled, so what the driver gets is bounded whatever the corpus. Long texts: patterns are possessive and
anchored at run starts, so they take linear time and no recursion; matches are put together in pieces of ``PIECE``, so a
text with k of them costs k x PIECE steps, not k x k. The parts of an address with ``@`` that are read as a ``mail``
candidate have at most 64 and 255 characters, a ``number`` 7 to 25 digits.

The labelers' meaning is given, not learnt: a reliability stays between 0.55 and 0.99, and what no labeler speaks for is
taken as not personal, so no label is needed.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows give
repeated results; a corpus without candidates adds nothing. Added spans never overlap base spans; added spans of
different kinds may overlap one another (a long token inside an address is both), those of one kind do not. Ties
(probability exactly one half) are added. Internal columns start with ``_pii``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed patterns of the base kinds. ``\\G`` is the end of the match before: only there may a run be entered midway.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
MORE = {
    "mail": r"(?<![^\s,;:<>()\[\]\"'])[^\s@,;:<>()\[\]\"']{1,64}+@[^\s@,;:<>()\[\]\"']{1,255}+",
    "number": r"(?<![A-Za-z0-9.])[0-9(](?:[ .()-]{0,2}[0-9]){6,24}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Gazetteers (fixed word lists): words that announce personal data, and words that announce other numbers.
ANNOUNCE = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|telephone|call|fax|mobile|cell|whatsapp|card|visa|mastercard|credit|iban|account|acct|ssn|passport|token|key|secret|password|passwd|pwd|api|auth|login|user)\b"
OTHER = r"(?i)\b(?:isbn|issn|doi|version|page|pages|line|chapter|section|figure|item|order|ref|lot|year|vol|no|id)\b"
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu|us|ca|ch|at|be|nl)$"
VOTES = ["v_pattern", "v_check", "v_before", "v_other", "v_domain", "v_shape", "v_mix"]
FEATURES = ["f_mail", "f_secret", "f_before", "f_plain", "f_long"]
ROUNDS, STEPS, RATE = 50, 400, 0.5
SPAN = "array<struct<start:int,end:int,text:string,before:string>>"
#: Matches of a text that are put together at a time.
PIECE = 64


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    step = lambda acc, i: acc + F.when(i % 2 == 1, F.substring(back, i, 1).cast("int")).otherwise(
        F.when(F.substring(back, i, 1).cast("int") > 4, F.substring(back, i, 1).cast("int") * 2 - 9).otherwise(F.substring(back, i, 1).cast("int") * 2))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(items: Column) -> Column:
    """``items`` in runs of at most PIECE."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PIECE).cast("int")), lambda k: F.slice(x, k * PIECE + 1, PIECE))
    return let(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), 1, 0)))


def running(items: Column, kind: str, size: Callable[[Column], Column], join: Callable[[Column, Column], Column], step: Callable[[Column, Column, Column], Column], enter: Callable[[Column, Column], Column] = lambda at, piece: at) -> Column:
    """A fold from place 0: ``step(at, context, item)`` gives struct<at, new: array of ``kind``'s elements>; all new ones in order.

    The place at which each piece begins comes first, from each piece's ``size`` and ``join`` (of places and sizes), so pieces
    are folded apart and arrays grow inside a piece only. ``enter(at, piece)`` is the piece's context.
    """

    def one(about: Column) -> Column:
        first = F.struct(about["at"].alias("at"), F.array().cast(kind).alias("out"))
        grow = lambda a, x: let(step(a["at"], about["context"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["new"]).alias("out")))
        return F.aggregate(about["piece"], first, grow, lambda a: a["out"])

    def all_(cut: Column) -> Column:
        starts = F.aggregate(F.transform(cut, size), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(join(F.element_at(acc, -1), n))))
        whole = F.arrays_zip(cut.alias("piece"), F.slice(starts, 1, F.size(cut)).alias("at"))
        return F.flatten(F.transform(whole, lambda p: let(F.struct(p["piece"].alias("piece"), p["at"].alias("at"), enter(p["at"], p["piece"]).alias("context")), one)))

    return let(pieces(items), all_)


def spans(text: Column, pattern: str, needs: str) -> Column:
    """All matches with their places and the 24 characters before. Gaps and matches alternate, so places are running sums."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def step(at: Column, _: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"), F.right(pair["gap"], F.lit(24)).alias("before"))
        return F.struct(end.alias("at"), F.array(span).alias("new"))

    total = lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
    pairs = let(hits, lambda h: F.arrays_zip(F.slice(gaps, 1, F.size(h)).alias("gap"), h.alias("hit")))
    return F.when(text.rlike(needs) & text.rlike(pattern), running(pairs, SPAN, total, lambda at, n: at + n, step)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each base kind, in order."""
    n = lambda x: F.length(digits_of(x["text"]))
    good = {
        "email": None,
        "ip": lambda x: x["text"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "card": lambda x: F.when(n(x).between(13, 19), luhn(digits_of(x["text"]))).otherwise(False),
        "phone": lambda x: n(x).between(9, 15),
    }
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    return {k: spans(text, p, needs[k]) if good[k] is None else F.filter(spans(text, p, needs[k]), good[k]) for k, p in BASE.items()}


def votes(kind: Column, text: Column, before: Column) -> dict[str, Column]:
    """The labelers: 1 personal, -1 not, 0 no opinion."""
    d = F.length(digits_of(text))
    mail, number, secret = kind == "mail", kind == "number", kind == "secret"
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    both = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    return {
        "v_pattern": sign(mail & text.rlike(rf"^{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"), mail | (secret & ~both)),
        "v_check": F.when(number & d.between(13, 19), F.when(luhn(digits_of(text)), 1).otherwise(-1)).otherwise(0),
        "v_before": F.when(before.rlike(ANNOUNCE), 1).otherwise(0),
        "v_other": F.when(before.rlike(OTHER), -1).otherwise(0),
        "v_domain": F.when(mail, F.when(text.rlike(DOMAINS), 1).otherwise(-1)).otherwise(0),
        "v_shape": sign(number & d.between(9, 12) & text.rlike("[ .()-]"), number & (d < 9)),
        "v_mix": F.when(secret, F.when(both & text.rlike("[0-9].*[A-Za-z].*[0-9].*[A-Za-z].*[0-9]"), 1).otherwise(-1)).otherwise(0),
    }


def features(kind: Column, text: Column, before: Column) -> dict[str, Column]:
    yes = lambda c: F.when(c, 1).otherwise(0)
    return {"f_mail": yes(kind == "mail"), "f_secret": yes(kind == "secret"), "f_before": yes(before.rlike(r"[:=]\s*[\"']?$") | before.rlike(ANNOUNCE)), "f_plain": yes(~text.rlike("[0-9]")), "f_long": yes(F.length(text) > 15)}


def candidates(text: Column) -> Column:
    """Array of struct<kind, start, end, text, before> of all further candidates."""
    needs = {"mail": "@", "number": "[0-9]", "secret": "[0-9]"}

    def tagged(kind: str) -> Column:
        return F.transform(spans(text, MORE[kind], needs[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["before"].alias("before")))

    return F.concat(*[tagged(k) for k in MORE])


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over (votes, count): how often each labeler is right where it votes, and each pattern's
    probability of being personal.

    Abstaining says nothing. A labeler starts at 0.8, counts as four votes of that, and stays between 0.55 and 0.99, so
    that votes keep their meaning. A candidate for which no labeler speaks is taken as not personal.
    """
    right = [0.8] * (len(patterns[0][0]) if patterns else 0)
    prior, p = 0.5, []
    for _ in range(rounds):
        p = []
        for v, _ in patterns:
            z = math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, right))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))) if 1 in v else min(0.05, prior))
        for k in range(len(right)):
            hits = sum(n * (q if v[k] > 0 else 1 - q) for q, (v, n) in zip(p, patterns) if v[k])
            right[k] = min(0.99, max(0.55, (hits + 3.2) / (4 + sum(n for v, n in patterns if v[k]))))
        total = sum(n for _, n in patterns)
        prior = min(0.9, max(0.1, sum(q * n for q, (_, n) in zip(p, patterns)) / total)) if total else prior
    return right, p


def train(rows: list[tuple[list[int], float, int]], steps: int = STEPS) -> list[float]:
    """Logistic weights (the first is the constant) from (inputs, probability, count), by gradient steps."""
    if not rows:
        return []
    w, total = [0.0] * (1 + len(rows[0][0])), sum(n for _, _, n in rows)
    for _ in range(steps):
        g = [0.001 * x for x in w]
        for x, q, n in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x))
            e = (1 / (1 + math.exp(-max(-30, min(30, z)))) - q) * n / total
            g[0] += e
            for k, b in enumerate(x):
                g[k + 1] += e * b
        w = [a - RATE * b * 4 for a, b in zip(w, g)]
    return w


def fit_spans(docs: DataFrame, text_col: str = "text") -> tuple[list[float], list[float]]:
    """(weights of the span classifier, reliabilities of the labelers) from all texts of ``docs``."""
    c = docs.select(F.explode(candidates(F.col(text_col).cast("string"))).alias("c")).select("c.*")
    named = {**votes(F.col("kind"), F.col("text"), F.col("before")), **features(F.col("kind"), F.col("text"), F.col("before"))}
    got = c.select(*[v.alias(k) for k, v in named.items()]).groupBy(*named).count().orderBy(*named).collect()  # bounded: a row a pattern
    right, p = estimate([(tuple(r[v] for v in VOTES), r["count"]) for r in got])
    return train([([r[k] for k in (*VOTES, *FEATURES)], q, r["count"]) for r, q in zip(got, p)]), right


def probability(weights: list[float], kind: Column, text: Column, before: Column) -> Column:
    inputs = {**votes(kind, text, before), **features(kind, text, before)}
    z = F.lit(weights[0])
    for w, c in zip(weights[1:], inputs.values()):
        z = z + F.lit(w) * c
    return 1 / (1 + F.exp(-z))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _runs(items: Column, name: str) -> Column:
    """``items`` (with start and end) in pieces, each with the range that it covers."""
    return F.transform(pieces(items), lambda p: F.struct(F.array_min(F.transform(p, lambda x: x["start"])).alias("start"), F.array_max(F.transform(p, lambda x: x["end"])).alias("end"), p.alias(name)))


def apart(added: Column, base: list[Column]) -> Column:
    """``added`` without the spans that meet one of ``base`` (arrays in order of place).

    Pieces of added spans meet runs of runs of base spans, then runs, then spans, each inside the piece's range only. Spans
    of a piece are near one another, so a text's base spans are looked at about PIECE times in all, whatever their number.
    All arrays are bound once, so no lambda computes them anew.
    """

    def left(held: Column) -> Column:
        def one(p: Column) -> Column:
            runs = F.flatten(F.transform(F.filter(held["base"], lambda b: _meets(b, p)), lambda b: b["runs"]))
            near = F.flatten(F.transform(F.filter(runs, lambda r: _meets(r, p)), lambda r: r["spans"]))
            return let(near, lambda n: F.filter(p["spans"], lambda x: ~F.exists(n, lambda b: _meets(b, x))))

        return F.flatten(F.transform(_runs(held["added"], "spans"), one))

    return let(F.struct(added.alias("added"), F.concat(*[_runs(_runs(b, "spans"), "runs") for b in base]).alias("base")), left)


def find_spans(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """``docs`` with ``_pii_email``, ``_pii_ip``, ``_pii_card``, ``_pii_phone`` (base) and ``_pii_added`` (struct<kind, start, end, ...>)."""
    weights = fit_spans(docs, text_col)[0] if weights is None else weights
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({f"_pii_{k}": v for k, v in base_spans(text).items()})
    if not weights:
        return out.withColumn("_pii_added", F.array().cast("array<struct<kind:string,start:int,end:int,text:string,before:string>>"))
    # delimiters end both a mail candidate and an email, so an email that meets one lies inside it
    good = lambda x: (probability(weights, x["kind"], x["text"], x["before"]) >= 0.5) & ~((x["kind"] == "mail") & x["text"].rlike(BASE["email"]))
    return out.withColumn("_pii_added", apart(F.filter(candidates(text), good), [F.col(f"_pii_{k}") for k in BASE]))


def _places(spans_: Column, kind: str) -> Column:
    return F.transform(spans_, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def _of(kind: str) -> Column:
    return F.filter("_pii_added", lambda x: x["kind"] == kind)


def _plain(spans_: Column, kind: str) -> Column:
    return F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[_places(F.col(f"_pii_{k}"), k) for k in BASE])
    added = F.concat(*[_places(_of(k), k) for k in MORE])
    return found.select(
        "doc_id", *[F.size(f"_pii_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
        *[F.size(_of(k)).cast("bigint").alias(f"n_{k}") for k in MORE],
    )


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, e.g. ``<email>``; where spans overlap, the union
    is replaced once, by the kind of the one that starts first (base before added)."""
    found = find_spans(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = F.array_sort(F.concat(*[_plain(F.col(f"_pii_{k}"), k) for k in BASE], *[_plain(_of(k), k) for k in MORE]))

    def enter(at: Column, piece: Column) -> Column:  # the piece's own part of the text
        return F.struct(at.alias("from"), F.substring(text, at + 1, F.array_max(F.transform(piece, lambda x: x["end"])) - at).alias("part"))

    def step(at: Column, about: Column, x: Column) -> Column:
        gap = F.substring(about["part"], at - about["from"] + 1, x["start"] - at)
        new = F.array(gap, F.concat(F.lit("<"), x["kind"], F.lit(">")))
        return F.struct(F.greatest(at, x["end"]).alias("at"), F.when(x["start"] >= at, new).otherwise(F.array().cast("array<string>")).alias("new"))

    end = lambda piece: F.array_max(F.transform(piece, lambda x: x["end"]))
    last = end(F.col("_pii_spans"))
    parts = F.concat(running(F.col("_pii_spans"), "array<string>", end, F.greatest, step, enter), F.array(F.substring(text, last + 1, F.length(text))))
    masked = found.withColumn("_pii_spans", ordered)
    value = F.when(F.size("_pii_spans") > 0, F.array_join(parts, "")).otherwise(F.col(text_col))
    return masked.select(*[value.alias(c) if c == text_col else F.col(c) for c in docs.columns])
