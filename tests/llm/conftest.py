import pytest

#: Odd rows for every operator on documents, and columns whose names operators might use inside.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of this text is here.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of this text is here.", "en"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nSecond line of this text is here.", "en"),
    (3, None, None), (4, "", "en"), (5, "   \n\t\n ", None), (6, "word", "en"), (None, "a null id with some words in it", "en"), (None, None, None),
    (7, "x" * 60_000, "en"), (8, "lorem ipsum dolor sit amet " * 6_000, "en"), (9, "ÄÖÜ ß ñ 日本語 \U0001f600 end", None), (10, "12345 --- !!!", None), (11, "a\x00b c", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, "src", 1, 2, 3, 4, 5) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, key long, held_out int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def counts(rows):
    out: dict = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


@pytest.fixture
def same_ids(odd):
    """Checks that a result has a row for each of the odd rows."""

    def check(df):
        assert counts(r[0] for r in df.select("doc_id").collect()) == counts(i for i, _, _ in ODD)

    return check
