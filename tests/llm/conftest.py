import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, id string, n_words int, size int, `__x` int"
LONG = "a very long line that all of these documents hold, in full"


def words(n, k=0):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, columns with clashing names."""
    texts = [None, "", " \t\n ", "one", "One", "one  two", "one two", "one\ntwo", words(40), words(40), "x " + words(40), words(20) + " \u00e9\u00e8 " + words(30, 1), "\u0085a\u00a0b c", words(30, 1), "y " * 3000, words(5000, 3), words(5000, 3) + " end"]
    texts += [f"{LONG}\nown {i}\n  {LONG.upper()}\t" for i in range(6)] + ["a\n\nb\n"]
    rows = [(i, t, "en", ("s1", "s2", None, "s0")[i % 4], len(t or ""), "x", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(None, words(40), None, None, None, None, None, None, None), (40, None, None, "s1", None, None, None, None, None), (9, texts[9], "en", "s2", 3, "x", 1, 2, 3)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
