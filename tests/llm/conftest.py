import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, id long, score double, words array<string>, kept boolean"


def make(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 0.5, ["w"], True) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, very long, repeated and tied rows, odd characters."""
    words = [f"w{n % 977}é" for n in range(60_000)]
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "Same text here, again and again."), (4, "Same text here, again and again."),
        (4, "Same text here, again and again."), (5, " ".join(words)), (6, "İstanbul ẞ 日本語 😀 a\x1cb \x85c\xa0d"), (7, "one"),
        (8, "two words"), (9, "MIT License. Apache license, general public license"), (None, "a row without id"), (10, "a" * 3000),
        (11, 'say password = "Xk29fQ81kdPz" twice, token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" end'),
        (12, "<|endoftext|> special <|startoftext|>x"), (13, "x  y \n z\r\n"), (14, "9 8 7 , . ; :"),
        (15, "mid <|endoftext|> of, x<|endoftext|>y (z) \"q\", it's. it' a\0b\0, \0c ñ, ſ. ², ٣!"), (16, "a-b- c_d__ e.f. 1, 2.5. ×, ÷. ª; ß? Ɏ,"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
