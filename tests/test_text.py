"""Cleaning and chunking: literal edge rows and properties."""

from itertools import groupby, takewhile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectide.functions import text as tx
from vectide.functions.numbers import sig3
from vectide.operators.chunking import chunk_text, dense_starts, with_dense_ids

# Input and expected output of the cleaner.
CLEANED = [
    ("a-b-c", "ab-c"),
    ("x (cid:12) a-b-c", "x abc"),
    ("  \n  \n  a", "a"),
    ("end- of", "end- of"),
    ("-a", "-a"),
    ("..,,", "..,"),
    ("a.\n,b", "a.b"),
    ("a.\t,b", "a.,b"),
    ("(c-i-d:5)", "(ci-d:5)"),
    ("²-é", "²é"),
    ("(cid:٣) z", "z"),
    ("  ", ""),
    ("", ""),
    ("a--b", "a--b"),
    ("a-b-c-d-e", "ab-cd-e"),
    ("  a", "a"),
    ("a  b", "a  b"),
]


def joined_words(text: str) -> str:
    """Walk over runs of word and other characters; a lone hyphen between two words joins them."""
    runs = [(word, "".join(run)) for word, run in groupby(text, lambda c: c == "_" or c.isalnum())]
    result, at = [], 0
    while at < len(runs):
        three = runs[at:at + 3]
        if len(three) == 3 and three[0][0] and three[1][1] == "-":
            result += [three[0][1], three[2][1]]
            at += 3
        else:
            result.append(runs[at][1])
            at += 1
    return "".join(result)


def without_marks(text: str) -> str:
    """A mark is its opening, decimal digits and a bracket; each leaves one space."""
    first, *rest = text.split("(cid:")
    result = first
    for part in rest:
        digits = "".join(takewhile(str.isdecimal, part))
        closed = digits and part[len(digits):].startswith(")")
        result += " " + part[len(digits) + 1:] if closed else "(cid:" + part
    return result


def by_rule(text: str) -> str:
    """The cleaning rule step by step and without patterns, for comparison."""
    again = True
    while again:
        single = "".join(c for c, before in zip(text, "x" + text) if (c, before) != (" ", " "))
        repaired = "".join(single.split("\n")).split(".,")
        text = without_marks(joined_words("".join(".".join(repaired).split("\t"))))
        again = text.find(" " * 2) >= 0
    return text.removeprefix(" ")


def apply(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[1] for r in sorted(rows.select("i", expression(F.col("text"))).collect())]


def test_edge_rows(spark):
    assert apply(spark, [t for t, _ in CLEANED], tx.clean_text) == [c for _, c in CLEANED]


def test_edge_rows_by_rule():
    assert [by_rule(t) for t, _ in CLEANED] == [c for _, c in CLEANED]


NOISE = st.lists(
    st.text(st.sampled_from(" -ab1.,\n\t:()cidé٣"), max_size=40)
    | st.sampled_from(["(cid:7)", "(c-i-d:7)", " (c-i-d-:8) ", "  ", "a-b-c-d-e-f-g-h-i", "(cid:1-2-3-4-5)", " (c-id:9)"]),
    max_size=8,
).map("".join)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NOISE, min_size=40, max_size=80))
def test_clean_equals_rule(spark, texts):
    assert apply(spark, texts, tx.clean_text) == [by_rule(t) for t in texts]


def test_cleaning_needs_many_passes(spark):
    # Each pass completes one more placeholder, which asks for another pass.
    levels = ["(c%sid:1) " % "".join(f"-{c}" for c in "x" * (2 ** n - 1)) for n in range(1, 7)]
    deep = " ".join("(cid:" + "-".join("1" * (2 ** n)) + ") " for n in range(9)) + " ".join(levels)
    assert apply(spark, [deep], tx.clean_text) == [by_rule(deep)]


def test_cleaning_a_long_word_is_linear(spark):
    word = "x" * 300_000
    assert apply(spark, [word + " a-b"], tx.clean_text) == [word + " ab"]


def test_newline_option(spark):
    assert apply(spark, ["a\nb"], lambda c: tx.clean_text(c, newline=" ")) == ["a b"]


@pytest.mark.parametrize("length,count", [(0, 0), (1, 1), (980, 1), (981, 2), (1000, 2), (1960, 2), (1961, 3)])
def test_chunk_counts(spark, length, count):
    rows = spark.createDataFrame([("x" * length,)], "text string")
    assert rows.select(F.size(tx.chunk_array(F.col("text"))), tx.chunk_count(F.col("text"))).first() == (count, count)


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (0, 0), (5, -1)])
def test_chunk_parameters_are_checked(size, overlap):
    with pytest.raises(ValueError):
        tx.chunk_array(F.lit("x"), size, overlap)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(st.sampled_from("ab\n é\U0001f600"), max_size=60), min_size=1, max_size=20),
    st.integers(1, 12), st.integers(0, 11),
)
def test_chunks_equal_the_loop(spark, texts, size, overlap):
    if overlap >= size:
        overlap = size - 1
    expected = [
        [t[start:start + size] for start in range(0, len(t), size - overlap)] for t in texts
    ]
    assert apply(spark, texts, lambda c: tx.chunk_array(c, size, overlap)) == expected


def test_chunks_rebuild_the_text(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    chunks = chunk_text(documents, size=100, overlap=30).toPandas().sort_values(["doc_id", "chunk"])
    rebuilt = chunks.groupby("doc_id")["text"].apply(lambda p: "".join([p.iloc[0], *[t[30:] for t in p.iloc[1:]]]))
    assert rebuilt.to_dict() == dict(documents.where("text <> ''").collect())


def test_drop_overlap_tail(spark):
    rows = spark.createDataFrame([("x" * 1000,), ("y" * 15,)], "text string")
    counts = rows.select(F.size(tx.chunk_array(F.col("text"), drop_overlap_tail=True))).collect()
    assert [c[0] for c in counts] == [1, 1]


def test_dense_ids_are_consecutive(spark):
    documents = spark.createDataFrame([(f"d{i:03}", "x" * (i * 37 % 300)) for i in range(200)], "name string, text string")
    chunks = with_dense_ids(
        chunk_text(documents, size=50, overlap=5), dense_starts(documents, "name", size=50, overlap=5), "name"
    ).toPandas()
    ordered = chunks.sort_values(["name", "chunk"])["id"].astype(int)
    assert list(ordered) == list(range(len(chunks)))


# File names and their sidecar keys.
@pytest.mark.parametrize("name,digest,strict", [
    ("abc.pdf", "abc", "abc"), ("mydata.pdf", "my", "mydata"), ("a.pdf.pdf", "a", "a.pdf"), ("data\\x.pdf", "x", "x"),
])
def test_digest(spark, name, digest, strict):
    assert apply(spark, [name], tx.digest_of) == [digest]
    assert apply(spark, [name], lambda c: tx.digest_of(c, strict=True)) == [strict]


# Numbers and their three-digit form.
@pytest.mark.parametrize("value,rounded", [
    (593.2, 593.0), (0.0978, 0.0978), (0.00148, 0.00148), (2310.4, 2310.0), (160.2, 160.0), (0.0, 0.0),
    (-0.012345, -0.0123), (99.96, 100.0), (1.0, 1.0),
])
def test_three_digits(spark, value, rounded):
    assert spark.range(1).select(sig3(F.lit(value))).first()[0] == rounded
