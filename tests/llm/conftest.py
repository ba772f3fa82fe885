import pytest

#: Columns whose names the operators might use for themselves.
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, ids string, verdict string, digests string, host_ string, left_ string, fp string, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and clashing columns."""
    prose = "Rain fell on the harbour all morning, and the boats stayed in; nobody minded much.\nThere was work to do on land."
    texts = [
        (1, None), (2, ""), (3, prose), (3, prose), (4, prose), (None, prose), (None, None), (5, "word " * 40_000), (6, "x" * 300_000), (7, "9" * 50_000 + "@" * 10),
        (8, "\n\n \t\n"), (9, 'é ß 日本 token = "abcdef123456"'), (10, "A" * 50), (11, "<|endoftext|> it's  a   test ​<|endoftext|>"), (5, "another text of id five"),
    ]
    rows = [(i, t, None, "s" if n % 2 else None, None, *[None] * 8) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
