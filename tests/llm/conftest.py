import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null fields, empty and long texts, ties, repeated rows, and columns with the names of results."""
    passage = " ".join(f"word{i}" for i in range(60))
    prose = " ".join(f"Satz{i % 37} und{i % 11} noch{i % 5}" for i in range(40))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, passage, "en", "a"), (5, passage, "en", "b"),
        (5, passage, "en", "b"), (6, passage.replace("word3 ", "other "), "en", "a"), (7, prose, "de", "b"), (8, "kurz", "de", "b"),
        (9, "x " * 40_000, "en", "c"), (None, prose + " Ende", "de", None), (10, "kurz", "fr", "b"), (11, "1 2 3 ...", None, "c"),
        (12, passage + "\n" + prose, "en", "a"), (13, "é ß 日本 🙂 <|endoftext|> [INST] </s>", "en", "a"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr("*", "1 as score", "'x' as kept", "2 as size", "3 as n_bytes", "4 as component_id", "5 as token_ids")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")
