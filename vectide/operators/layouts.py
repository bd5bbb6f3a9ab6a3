"""Record layouts of the vector tables and their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.metadata import TYPES, free_value

# Declared limits, default namespace and default metrics.
DEFAULT_DIM = 768
MAX_TEXT = 5000
DEFAULT_NAMESPACE = "development"
DEFAULT_METRIC = {"typed": "ip", "namespaced": "cosine", "payload": "cosine"}

METADATA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
VECTOR = T.ArrayType(T.FloatType())

SCHEMAS = {
    "typed": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("embedding", VECTOR),
        T.StructField("metadata", T.StringType()),
        T.StructField("text", T.StringType()),
    ]),
    "namespaced": T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("values", VECTOR),
        T.StructField("metadata", METADATA),
        T.StructField("namespace", T.StringType()),
    ]),
    "payload": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("vector", VECTOR),
        T.StructField("payload", T.StructType([
            T.StructField("metadata", METADATA),
            T.StructField("chunk_part", T.IntegerType()),
            T.StructField("document_id", T.StringType()),
        ])),
    ]),
}
VECTOR_COLUMN = {"typed": "embedding", "namespaced": "values", "payload": "vector"}
TEXT_COLUMN = {"typed": "text", "namespaced": "metadata.text", "payload": "payload.metadata.text"}
#: Column of free metadata, and the struct of those of its keys that are stored as columns.
EXTRA, PROMOTED = "extra", "promoted"
KEYS = {"typed": ["id"], "namespaced": ["namespace", "id"], "payload": ["id"]}


def table_schema(layout: str, promoted: dict[str, str] | None = None) -> T.StructType:
    """Columns of a layout; a table with free metadata, which ``promoted`` says, holds them after the layout's own."""
    fields = list(SCHEMAS[layout].fields)
    if promoted is not None:
        fields.append(T.StructField(EXTRA, T.VariantType()))
        if promoted:
            fields.append(T.StructField(PROMOTED, T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in promoted.items()))))
    return T.StructType(fields)


def checked_promotion(promoted: dict[str, str]) -> dict[str, str]:
    """The keys to promote with their types, unless a name or type is not allowed."""
    fixed = set(METADATA.names)
    for key, kind in promoted.items():
        if kind not in set(TYPES.values()):
            raise ValueError(f"cannot promote {key!r} to {kind!r}")
        if key in fixed or "`" in key:
            raise ValueError(f"{key!r} cannot be a promoted key")
    if len({key.lower() for key in promoted}) < len(promoted):
        raise ValueError("promoted keys may not differ in case alone")
    return promoted


def with_promoted(rows: DataFrame, promoted: dict[str, str]) -> DataFrame:
    """Add the struct of promoted keys, read from the free metadata; a value of another type is null there."""
    if not promoted:
        return rows
    return rows.withColumn(PROMOTED, F.struct(*[free_value(EXTRA, key, kind).alias(key) for key, kind in promoted.items()]))


def _own(records: DataFrame) -> list[str]:
    return [EXTRA] if EXTRA in records.columns else []


def to_records(chunks: DataFrame, filename: str = "filename") -> DataFrame:
    """Chunk rows as ``id, values, metadata`` records, and ``extra`` where the chunks hold it, as JSON text or VARIANT."""
    free = []
    if EXTRA in chunks.columns:
        given = F.col(EXTRA)
        free.append((F.parse_json(given) if isinstance(chunks.schema[EXTRA].dataType, T.StringType) else given).alias(EXTRA))
    metadata = F.struct(
        F.col(filename).cast("string").alias("filename"),
        F.col("size").cast("string").alias("size"),
        F.col("created_at").cast("string").alias("created_at"),
        F.col("chunk").cast("int").alias("chunk"),
        F.col("text").alias("text"),
    )
    return chunks.select(F.col("id").cast("string").alias("id"), F.col("values").cast(VECTOR), metadata.alias("metadata"), *free)


def to_typed_layout(records: DataFrame) -> DataFrame:
    """Integer id, vector, metadata as JSON without text and date, text apart."""
    return records.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("values").alias("embedding"),
        F.to_json(F.col("metadata").dropFields("text", "created_at")).alias("metadata"),
        F.col("metadata.text").alias("text"),
        *_own(records),
    )


def to_payload_layout(records: DataFrame) -> DataFrame:
    """Integer id, vector, and a payload that promotes chunk number and file name."""
    payload = F.struct(
        F.col("metadata"),
        F.col("metadata.chunk").alias("chunk_part"),
        F.col("metadata.filename").alias("document_id"),
    )
    return records.select(F.col("id").cast("bigint").alias("id"), F.col("values").alias("vector"), payload.alias("payload"), *_own(records))


def to_namespaced_layout(records: DataFrame, namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
    """Records unchanged, with their namespace."""
    return records.select("id", "values", "metadata", F.lit(namespace).alias("namespace"), *_own(records))


LAYOUTS = {
    "typed": to_typed_layout,
    "namespaced": to_namespaced_layout,
    "payload": to_payload_layout,
}


def violation(values: str, text: str, dim: int, max_text: int = MAX_TEXT) -> Column:
    """Which declared limit a row breaks; null for a row within them. No vector is a wrong one."""
    return (
        F.when(F.coalesce(F.size(values), F.lit(-1)) != dim, F.lit("wrong_dimension"))
        .when(F.length(text) > max_text, F.lit("text_too_long"))
    )


def guarded(rows: DataFrame, layout: str, dim: int) -> DataFrame:
    """Rows of a layout that fail the job that writes them where a limit is broken."""
    vector = VECTOR_COLUMN[layout]
    reason = violation(vector, TEXT_COLUMN[layout], dim)
    message = F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(": "), reason)
    return rows.withColumn(vector, F.when(reason.isNull(), F.col(vector)).otherwise(F.raise_error(message)))


def split_constraints(records: DataFrame, dim: int = DEFAULT_DIM, max_text: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    """Records within the declared limits, and the others with a ``reason``."""
    tagged = records.withColumn("reason", violation("values", "metadata.text", dim, max_text))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def check_constraints(
    records: DataFrame, dim: int = DEFAULT_DIM, max_text: int = MAX_TEXT
) -> tuple[DataFrame, DataFrame]:
    """Records within the declared limits, and rejects ``id, reason`` for the others."""
    kept, refused = split_constraints(records, dim, max_text)
    return kept, refused.select("id", "reason")


def searchable(rows: DataFrame, layout: str) -> DataFrame:
    """Rows of a layout with ``id, values, metadata, text`` for search and shaping, and their free metadata."""
    free = [name for name in (EXTRA, PROMOTED) if name in rows.columns]
    if layout == "typed":
        return rows.select("id", F.col("embedding").alias("values"), "metadata", "text", *free)
    if layout == "payload":
        return rows.select(
            "id", F.col("vector").alias("values"), F.col("payload.metadata").alias("metadata"),
            F.col("payload.metadata.text").alias("text"), *free,
        )
    return rows.select("id", "values", "metadata", F.col("metadata.text").alias("text"), "namespace", *free)
