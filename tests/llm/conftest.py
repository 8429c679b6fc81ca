import pytest

LONG = "alpha beta gamma delta " * 9_000 + "mail me at a.b@c.de or +49 (30) 1234567 now"
TEXTS = [
    (1, "one two three four five six\nseven eight\none two three four five six\n", "en", "a"), (2, "one two three four five six\nseven eight\none two three four five six\n", "en", "a"),
    (3, None, None, None), (4, "", "", ""), (5, " \t\n\x0b\x0c\r ", "en", "b"), (6, "Größe ß Ünïcode 日本語 текст école  x\x1cy <|endoftext|> don't", "de", "b"),
    (7, LONG, "en", None), (8, "x@y.z_w@q.r 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 4111 1111 1111 1111 4111-1111-1111-1112 +1 555 123 4567 +12", "en", "c"),
    (9, "a@@b.c %+-@d-.e 😀a@b.co 😀", "en", "c"), (10, "stupid clown " * 30, "en", "c"), (None, "no id here at all", "en", "d"), (10, "stupid clown " * 30, "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(i, t, a, s, len(t) if t is not None else None, "clash", 1, 2) for i, t, a, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size int, media int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
