"""The given tables, and inputs derived from them, for the registered queries.

Each derived input has a Spark form here and the same definition in SQL beside
it, over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.operators.ordering import spread

# Declared schemas of the given tables.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is costly per text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# Text with every kind of noise the cleaner removes; a deeper hyphen chain in
# longer documents makes the number of cleaning rounds differ between rows.
NOISE_SQL = """(
  select doc_id, lang, source,
    text || '  (cid:' || doc_id || ') a-b-c' || chr(9) || ' .,' || chr(10) || ',x (c-i-d:7) end'
         || case when n_chars > 500 then ' (c-i-d-:8)  (c-i-d:' || (n_chars % 10) || '-4) p-q-r-s-t-u' else '' end as text
  from documents
)"""


def noisy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = F.concat(
        F.lit("  (cid:"), F.col("doc_id"), F.lit(") a-b-c\t .,\n,x (c-i-d:7) end"),
        F.when(
            F.col("n_chars") > 500,
            F.concat(F.lit(" (c-i-d-:8)  (c-i-d:"), F.col("n_chars") % 10, F.lit("-4) p-q-r-s-t-u")),
        ).otherwise(F.lit("")),
    )
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.concat("text", noise).alias("text"))


# One sidecar row per labelled document; toxic ones have a second, later row
# that "first match" must ignore.
SIDECAR_SQL = """(
  select cast(d.doc_id as varchar) as digest, d.n_chars + copy as file_size,
    '2024-01-' || lpad(cast(1 + d.doc_id % 28 as varchar), 2, '0') || 'T00:00:00' as date,
    d.doc_id + 1000000 * copy as pos
  from documents d join labels l on d.doc_id = l.doc_id
  join (select 0 as copy union all select 1) copies on copy <= l.toxic
)"""


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id"
    )
    copies = labelled.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.col("toxic"))).alias("copy"))
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return copies.select(
        F.col("doc_id").cast("string").alias("digest"),
        (F.col("n_chars") + F.col("copy")).alias("file_size"),
        F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00")).alias("date"),
        (F.col("doc_id") + 1_000_000 * F.col("copy").cast("bigint")).alias("pos"),
    )


# The sidecar with columns beyond the fixed ones; later rows of a digest say so.
FREE_SIDECAR_SQL = f"""(
  select s.*, d.lang, l.quality, case when l.quality >= 3 then d.source end as source, s.pos >= 1000000 as later
  from {SIDECAR_SQL} s join documents d on s.digest = cast(d.doc_id as varchar) join labels l on l.doc_id = d.doc_id
)"""


def free_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("digest"), "lang", "quality",
        F.when(F.col("quality") >= 3, F.col("source")).alias("source"),
    )
    return sidecar(spark, sf_dir).join(known, "digest").withColumn("later", F.col("pos") >= 1_000_000)


def free_vector_records(spark: SparkSession, sf_dir: str, shift: int = 0, mark: str = "first") -> DataFrame:
    """Vectors as records with free metadata; those of the second version are all in one group."""
    number = F.col("id").cast("bigint")
    group = F.concat(F.lit("g"), F.col("metadata.chunk") % 3) if mark == "first" else F.lit("g1")
    free = F.struct(
        group.alias("group"), F.col("metadata.chunk").alias("label"),
        F.when(number % 2 == 0, number * F.lit(0.5)).alias("weight"),
        F.struct((number % 3 == 0).alias("third")).alias("tags"),
    )
    return vector_records(spark, sf_dir, shift, mark).withColumn("extra", F.parse_json(F.to_json(free)))


# The same after the second version, moved by 100, has replaced what it shares with the first.
FREE_VECTORS_SQL = """(
  select id, values, label, grp, case when id % 2 = 0 then id * 0.5 end as weight, id % 3 = 0 as third from (
    select vec_id + 100 as id, embedding as values, label, 'g1' as grp from embeddings
    union all
    select vec_id, embedding, label, 'g' || (label % 3) from embeddings
    where vec_id not in (select vec_id + 100 from embeddings)
  )
)"""


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the file name they would have had."""
    return documents(spark, sf_dir).withColumn("filename", F.concat("doc_id", F.lit(".pdf")))


# Documents of low quality stand for files from which no text came.
EXTRACTED_SQL = """(
  select d.doc_id, d.lang, case when l.quality = 0 then '' else d.text end as text
  from documents d left join labels l on d.doc_id = l.doc_id
)"""


def extracted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    return graded.select("doc_id", "lang", F.when(F.col("quality") == 0, "").otherwise(F.col("text")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors: ``id, values, label``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


# The given vectors have unit length; scaling makes inner product and cosine
# rank differently.
SCALED_SQL = """(
  select vec_id as id, label,
    list_transform(embedding, lambda x: cast(cast(x as double) * (1 + label) as float)) as values
  from embeddings
)"""


def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.col("label") + 1
    return vectors(spark, sf_dir).withColumn(
        "values", F.transform("values", lambda x: (x.cast("double") * factor).cast("float"))
    )


def vector_records(spark: SparkSession, sf_dir: str, shift: int = 0, mark: str = "first") -> DataFrame:
    """The vectors as records; ``shift`` moves the ids so that two versions overlap."""
    source = vectors(spark, sf_dir)
    return source.select(
        (F.col("id") + shift).cast("string").alias("id"),
        "values",
        F.struct(
            F.concat(F.lit("set"), F.col("label")).alias("filename"),
            F.size("values").cast("string").alias("size"),
            F.lit("2024-01-01").alias("created_at"),
            F.col("label").cast("int").alias("chunk"),
            F.concat(F.lit(f"{mark} "), F.col("id")).alias("text"),
        ).alias("metadata"),
        F.concat(F.lit("label"), F.col("label")).alias("namespace"),
    )


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as request timings: the type is the database, the value the seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("database"),
        F.when(F.col("user_id") % 2 == 0, "quality").otherwise("threaded").alias("phase"),
        F.col("ts").alias("started"),
        F.col("value").alias("seconds"),
    )


LATENCY_SQL = """(
  select event_type as database, case when user_id % 2 = 0 then 'quality' else 'threaded' end as phase,
    ts as started, value as seconds
  from events
)"""

# Event types that stand for databases.
DATABASES = ["click", "error", "purchase", "signup", "view"]
