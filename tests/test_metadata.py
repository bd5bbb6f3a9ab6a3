"""Free metadata and filter descriptions."""

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.metadata import free_value, metadata_filter, variant_path
from vectide.operators import layouts
from vectide.operators.layouts import to_namespaced_layout, to_payload_layout, to_typed_layout
from vectide.plans.ingest import IngestOptions, ingest_run
from vectide.plans.retrieval import query
from vectide.session import scratch_path
from vectide.sources.collections import fan_out, open_collection

ROWS = {
    "1": {"lang": "en", "year": 2020, "open": True, "a.b": "dot", "who": {"name": "Ann"}},
    "2": {"lang": "fr", "year": 2021.5, "open": False, "it's": 1},
    "3": {"lang": "en", "year": "2022", "who": {"name": "Bob"}},
    "4": {"lang": None, "year": -1},
    "5": {},
    "6": None,
    "7": {"lang": 5, "year": [1, 2], "not": "x"},
    "8": {"lang": "5", "year": 2020.0},
}
PROMOTED = {"lang": "string", "year": "double", "open": "boolean"}
# What each description finds, worked out by hand.
CASES = [
    ({}, "12345678"),
    ({"lang": "en"}, "13"),
    ({"lang": ["en", "fr"]}, "123"),
    ({"lang": []}, ""),
    ({"lang": "5"}, "78"),
    ({"lang": 5}, "78"),
    ({"lang": ["en", 5]}, "1378"),
    ({"lang": None}, "456"),
    ({"lang": {"ne": "en"}}, "245678"),
    ({"lang": {"ne": None}}, "12378"),
    ({"year": 2020}, "18"),
    ({"year": {"gte": 2020, "lt": 2022}}, "128"),
    ({"year": {"gt": 2021}}, "23"),
    ({"year": {"lte": 0}}, "4"),
    ({"open": True}, "1"),
    ({"open": {"ne": True}}, "2345678"),
    ({"a.b": "dot"}, "1"),
    ({"it's": 1}, "2"),
    ({("who", "name"): "Bob"}, "3"),
    ({("not",): "x"}, "7"),
    ({"lang": "en", "year": 2020}, "1"),
    ({"any": [{"lang": "fr"}, {"year": -1}]}, "24"),
    ({"any": []}, ""),
    ({"all": [{"lang": "en"}, {"not": {"year": 2020}}]}, "3"),
    ({"not": {"lang": "en"}}, "245678"),
    ({"not": {"any": [{"lang": "en"}, {"open": False}]}}, "45678"),
    ({"filename": "f3"}, "3"),
    ({"size": {"gt": 10}}, "345678"),
    ({"chunk": [1, 4], "lang": {"ne": "fr"}}, "14"),
    ({"text": "t5"}, "5"),
]


def records(spark, rows=ROWS):
    """Records with the rows' free metadata; sizes are 8, 9, 11 and up."""
    data = [(i, [float(i), 1.0, 0.0], (f"f{i}", str(int(i) + 7 + (int(i) > 2)), "2024-01-01", int(i), f"t{i}"),
             None if extra is None else json.dumps(extra)) for i, extra in rows.items()]
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("values", layouts.VECTOR),
                           T.StructField("metadata", layouts.METADATA), T.StructField("extra", T.StringType())])
    return spark.createDataFrame(data, schema).withColumn("extra", F.parse_json("extra"))


def new_table(spark, layout, promoted=PROMOTED):
    return open_collection(spark, scratch_path(spark, layout)).create(layout, dim=3, promoted=promoted)


def found(table, description):
    rows = table.search_rows().where(table.condition(description)).select(F.col("id").cast("string")).collect()
    return "".join(sorted(r[0] for r in rows))


@pytest.mark.parametrize("layout", layouts.SCHEMAS)
def test_descriptions(spark, layout):
    tables = [new_table(spark, layout), new_table(spark, layout, {})]
    fan_out(records(spark), tables)
    for table in tables:
        # All descriptions in one pass.
        flags = [F.coalesce(table.condition(d), F.lit(False)).alias(str(i)) for i, (d, _) in enumerate(CASES)]
        rows = table.search_rows().select(F.col("id").cast("string").alias("id"), *flags).collect()
        for i, (description, expected) in enumerate(CASES):
            assert "".join(sorted(r["id"] for r in rows if r[str(i)])) == expected, description


def pushed(df):
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line for line in plan.splitlines() if line.startswith("PushedFilters")]


def test_promoted_and_fixed_fields_reach_the_scan(spark):
    table = new_table(spark, "payload")
    fan_out(records(spark), [table])
    table.compact()
    rows = table.search_rows()
    assert "EqualTo(promoted.lang,en)" in pushed(rows.where(table.condition({"lang": "en"})).select("id"))[0]
    ranges = pushed(rows.where(table.condition({"year": {"gte": 2020, "lt": 2022}})).select("id"))[0]
    assert "GreaterThanOrEqual(promoted.year,2020.0)" in ranges and "LessThan(promoted.year,2022.0)" in ranges
    assert "Not(EqualTo(promoted.lang,en))" in pushed(rows.where(table.condition({"lang": {"ne": "en"}})).select("id"))[0]
    assert "EqualTo(payload.metadata.filename,f3)" in pushed(rows.where(table.condition({"filename": "f3"})).select("id"))[0]
    assert "lang" not in pushed(rows.where(table.condition({"lang": 5})).select("id"))[0]


def test_promoted_filter_reads_no_free_metadata(spark):
    table = new_table(spark, "payload")
    fan_out(records(spark), [table])
    table.compact()
    chosen = table.search_rows().where(table.condition({"lang": "en"})).select("id", "values")
    schemas = re.findall(r"ReadSchema: (\S+)", chosen._jdf.queryExecution().executedPlan().toString())
    assert "struct<id:bigint,vector:array<float>,promoted:struct<lang:string>>" in schemas
    assert not any("extra" in schema or "text" in schema for schema in schemas)


@pytest.mark.parametrize("layout", layouts.SCHEMAS)
def test_free_metadata_outlive_changes(spark, layout):
    table = new_table(spark, layout)
    assert found(table, {"lang": "en"}) == ""
    fan_out(records(spark), [table])
    if layout != "typed":
        fan_out(records(spark, {"1": {"lang": "de"}, "9": {"lang": "en"}, "2": None}), [table])
        for _ in range(2):
            assert found(table, {"lang": "en"}) == "39" and found(table, {"lang": None}) == "2456"
            assert found(table, {"lang": "de", "year": None}) == "1"
            table.compact()
    table.clear()
    assert found(table, {}) == ""


def test_rows_without_free_metadata_fit_in(spark):
    table = new_table(spark, "namespaced")
    fan_out(records(spark).drop("extra"), [table])
    assert found(table, {"lang": None}) == "12345678" and found(table, {"lang": "en"}) == ""
    # Rows read from a table can be written to it again.
    table.upsert(table.read())
    assert found(table, {"lang": None}) == "12345678"


def test_nothing_is_lost_silently(spark):
    plain, free = (open_collection(spark, scratch_path(spark, "t")).create("payload", dim=3, promoted=p) for p in (None, {}))
    fan_out(records(spark).drop("extra"), [plain, free])
    with pytest.raises(ValueError, match="no free metadata"):
        fan_out(records(spark, {"20": {"lang": "en"}}), [free, plain])
    with pytest.raises(ValueError, match="no free metadata"):
        plain.upsert(to_payload_layout(records(spark)))
    documents = spark.createDataFrame([(1, "f.pdf", "text")], "doc_id long, filename string, text string")
    sidecar = spark.createDataFrame([("f", 1, "2024-01-01", 1, "en")], "digest string, file_size long, date string, pos long, lang string")
    with pytest.raises(ValueError, match="no free metadata"):
        ingest_run(documents, sidecar, [free, plain], IngestOptions(dim=3, free=("lang",)))
    # No table was touched or emptied.
    assert found(free, {}) == found(plain, {}) == "12345678"
    with pytest.raises(ValueError, match="no key 'lang'"):
        plain.condition({"lang": "en"})
    with pytest.raises(ValueError, match="fixed field"):
        ingest_run(documents, sidecar, [free], IngestOptions(dim=3, free=("text",)))


def test_ingest_keeps_the_first_row_and_drops_nulls(spark):
    table = new_table(spark, "namespaced")
    documents = spark.createDataFrame([(1, "a.pdf", "one"), (2, "b.pdf", "two"), (3, "c.pdf", "three")], "doc_id long, filename string, text string")
    sidecar = spark.createDataFrame(
        [("a", 1, "2024-01-01", 1, "en", 7), ("a", 1, "2024-01-01", 2, "fr", 8), ("b", 2, None, 3, None, None)],
        "digest string, file_size long, date string, pos long, lang string, `year` int")
    rejects = ingest_run(documents, sidecar, [table], IngestOptions(dim=3, free=("lang", "year")))
    assert [(r["doc_id"], r["reason"]) for r in rejects.collect()] == [(3, "no_metadata")]
    assert sorted((r[0], r[1]) for r in table.search_rows().select("text", F.to_json("extra")).collect()) == [
        ("one", '{"lang":"en","year":7}'), ("two", "{}")]


def test_query_by_description(spark):
    table = new_table(spark, "namespaced")
    fan_out(records(spark), [table])
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, vector array<float>")
    hits = query(table, asked, 5, pre_vectorized=True, where={"lang": "en"}).collect()
    assert [h["id"] for h in hits] == ["3", "1"]
    assert json.loads(hits[0]["extra"].toJson()) == ROWS["3"]
    bare = query(table, asked, 5, pre_vectorized=True, where={"lang": "en"}, include_metadata=False, include_text=False)
    assert "extra" not in bare.columns and [h["id"] for h in bare.orderBy("rank").collect()] == ["3", "1"]
    assert query(table, asked, 5, pre_vectorized=True, where={"lang": "xx"}).count() == 0


def test_wrong_descriptions(spark):
    field = lambda key, kind: free_value("extra", key, kind)
    for wrong in ({"a": {"like": "x"}}, {"a": {"gt": None}}, {"a": 1 << 60}, {"a": b"x"}, {"a": {"in": [None]}}):
        with pytest.raises(ValueError):
            metadata_filter(wrong, field)
    assert variant_path(("a.b", "it's", "why?")) == """$['a.b']["it's"].why?"""
    for hopeless in ("", "?.", "?["):
        with pytest.raises(ValueError):
            variant_path(hopeless)
    for promoted in ({"a": "int"}, {"text": "string"}, {"a": "string", "A": "double"}, {"a`": "string"}):
        with pytest.raises(ValueError):
            open_collection(spark, scratch_path(spark, "t")).create("typed", promoted=promoted)


def test_layouts_carry_free_metadata(spark):
    rows = records(spark)
    for made in (to_typed_layout(rows), to_payload_layout(rows), to_namespaced_layout(rows)):
        assert isinstance(made.schema["extra"].dataType, T.VariantType)
    assert "extra" not in to_typed_layout(rows.drop("extra")).columns
