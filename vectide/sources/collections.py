"""Vector tables on parquet: create, append, upsert, namespaces, clear.

A table is one folder::

    properties/           one row per switch of the snapshot; the latest counts
    snapshot=<name>/      stored rows, by namespace where the layout has one;
                          absent while nothing is stored
    changes/batch=<n>/    upserts and namespace clears newer than the snapshot

An upsert writes its batch and nothing else. Reading lets the newest row of a
key win: the snapshot is anti-joined with the keys of the changes, which Spark
broadcasts while they are few, so an untouched table is a plain scan.
``compact`` folds the changes into a new snapshot. Files in use are never
overwritten. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.functions.metadata import Key, free_value, metadata_filter
from vectide.operators.layouts import (
    DEFAULT_DIM, DEFAULT_METRIC, DEFAULT_NAMESPACE, EXTRA, KEYS, LAYOUTS, METADATA, PROMOTED, SCHEMAS, VECTOR_COLUMN,
    checked_promotion, guarded, searchable, split_constraints, table_schema, to_namespaced_layout, with_promoted,
)
from vectide.operators.ordering import first_ranked
from vectide.session import materialize

PROPERTIES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("layout", T.StringType()),
    T.StructField("dim", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("snapshot", T.StringType()),
    T.StructField("folded", T.LongType()),
    # Promoted keys and their types as JSON; null for a table without free metadata.
    T.StructField("promoted", T.StringType()),
])
PUT, CLEAR = "put", "clear"


def _read_if_present(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    path: str

    # -- properties ---------------------------------------------------------

    def properties(self) -> dict | None:
        """Current properties, or ``None`` if the table does not exist."""
        rows = _read_if_present(self.spark, PROPERTIES, f"{self.path}/properties")
        latest = rows.orderBy(F.col("seq").desc()).first() if rows is not None else None
        return latest.asDict() if latest else None

    @property
    def layout(self) -> str:
        return self._require()["layout"]

    def _require(self) -> dict:
        found = self.properties()
        if found is None:
            raise ValueError(f"no collection at {self.path}")
        return found

    def require_free_metadata(self) -> None:
        """Fail where free metadata would be lost."""
        if _promoted(self._require()) is None:
            raise ValueError(f"the table at {self.path} keeps no free metadata; create it with promoted={{}}")

    def _switch(self, properties: dict, **changes) -> None:
        row = {**properties, **changes, "seq": properties["seq"] + 1}
        values = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in PROPERTIES]
        self.spark.range(0, 1, 1, 1).select(*values).write.mode("append").parquet(f"{self.path}/properties")

    def _snapshot(self, name: str) -> str:
        return f"{self.path}/snapshot={name}"

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        writer = rows.write.mode(mode)
        if "namespace" in rows.columns:
            writer = writer.partitionBy("namespace")
        writer.parquet(path)

    # -- lifecycle ----------------------------------------------------------

    def create(
        self, layout: str, dim: int = DEFAULT_DIM, metric: str | None = None, promoted: Mapping[str, str] | None = None
    ) -> "Collection":
        """Make the table unless it is there already.

        With ``promoted``, keys and types (``string``, ``double``, ``boolean``),
        which may be empty, the table keeps free metadata. Promoted keys are
        stored as columns as well, so that filters on them reach the scan.
        """
        if self.properties() is None:
            if layout not in SCHEMAS:
                raise ValueError(f"unknown layout {layout!r}")
            free = None if promoted is None else json.dumps(checked_promotion(dict(promoted)))
            start = {"seq": 0, "layout": layout, "dim": dim, "metric": metric or DEFAULT_METRIC[layout], "promoted": free}
            self._switch(start, snapshot=uuid.uuid4().hex, folded=0)
        return self

    def clear(self) -> None:
        """Empty the table; layout, dimension and metric stay."""
        found = self._require()
        self._switch(found, snapshot=uuid.uuid4().hex, folded=self._last(found))

    def clear_namespace(self, namespace: str) -> None:
        """Delete all rows of one namespace by a one-row marker."""
        found = self._require()
        if "namespace" not in SCHEMAS[found["layout"]].names:
            raise ValueError(f"layout {found['layout']} has no namespaces")
        if self._last(found) == found["folded"] and self._stored(found) is None:
            return
        marker = self.spark.range(0, 1, 1, 1).select(F.lit(CLEAR).alias("op"), F.lit(namespace).alias("namespace"))
        self._change(found, marker, None)

    def compact(self) -> None:
        """Fold all changes into a new snapshot."""
        found, name = self._require(), uuid.uuid4().hex
        rows = self.read()
        if "namespace" in rows.columns:
            # Few files per namespace; AQE splits a large one over several tasks.
            rows = rows.hint("rebalance", "namespace")
        self._write(rows, self._snapshot(name), "errorifexists")
        self._switch(found, snapshot=name, folded=self._last(found))

    # -- writing ------------------------------------------------------------

    def append(self, rows: DataFrame) -> None:
        """Plain insert without a key check: equal ids may coexist.

        Earlier upserts and clears are folded in first, so that they do not
        hide the new rows.
        """
        found = self._require()
        if self._last(found) > found["folded"]:
            self.compact()
            found = self._require()
        self._write(self._checked(found, rows), self._snapshot(found["snapshot"]), "append")

    def _checked(self, properties: dict, rows: DataFrame) -> DataFrame:
        """The table's columns; a row beyond its declared limits fails the write."""
        layout, promoted = properties["layout"], _promoted(properties)
        own = rows.select(*SCHEMAS[layout].names)
        if promoted is not None:
            free = EXTRA if EXTRA in rows.columns else F.lit(None).cast(T.VariantType()).alias(EXTRA)
            own = with_promoted(rows.select(*SCHEMAS[layout].names, free), promoted)
        elif EXTRA in rows.columns:
            self.require_free_metadata()
        return guarded(own, layout, properties["dim"])

    def upsert(self, rows: DataFrame, batch: int | None = None, order: str | None = None) -> None:
        """Insert or replace by key.

        Within a batch the row with the greatest ``order`` wins; without an
        order the batch is written as it is, and reading keeps one row of each
        key. Writing a given ``batch`` number again replaces that batch, so a
        batch that is delivered twice counts once. Numbers at or below a fold
        are ignored, as they are stored already; numbers start at 1.
        """
        if batch is not None and batch < 1:
            raise ValueError("batch numbers start at 1")
        found = self._require()
        layout = found["layout"]
        if order:
            rows = first_ranked(rows, KEYS[layout], [F.col(order).desc(), F.xxhash64(VECTOR_COLUMN[layout]).desc()])
        self._change(found, self._checked(found, rows).withColumn("op", F.lit(PUT)), batch)

    def load(self, rows: DataFrame) -> None:
        """Rows with unused, unique keys: one write without a shuffle into an
        empty table, an upsert otherwise."""
        found = self._require()
        if self._last(found) == found["folded"] and self._stored(found) is None:
            self._write(self._checked(found, rows), self._snapshot(found["snapshot"]), "append")
        else:
            self.upsert(rows)

    def _change(self, properties: dict, rows: DataFrame, batch: int | None) -> None:
        number = self._last(properties) + 1 if batch is None else batch
        if number <= properties["folded"]:
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{self.path}/changes/batch={number}"
        )

    def _stored(self, properties: dict) -> DataFrame | None:
        return _read_if_present(self.spark, _schema(properties), self._snapshot(properties["snapshot"]))

    def _changes(self, properties: dict) -> DataFrame | None:
        schema = T.StructType([
            *_schema(properties).fields,
            T.StructField("op", T.StringType()),
            T.StructField("batch", T.LongType()),
        ])
        changes = _read_if_present(self.spark, schema, f"{self.path}/changes")
        return None if changes is None else changes.where(F.col("batch") > properties["folded"])

    def last_batch(self) -> int:
        """Greatest batch number used so far."""
        return self._last(self._require())

    def _last(self, properties: dict) -> int:
        number = T.StructType([T.StructField("batch", T.LongType())])
        changes = _read_if_present(self.spark, number, f"{self.path}/changes")
        latest = changes.agg(F.max("batch")).first()[0] if changes is not None else None
        return max(latest or 0, properties["folded"])

    # -- reading ------------------------------------------------------------

    def read(self) -> DataFrame:
        """Current rows in the table's layout."""
        found = self._require()
        schema, keys = _schema(found), KEYS[found["layout"]]
        stored = self._stored(found)
        if stored is None:
            stored = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        changes = self._changes(found)
        if changes is None:
            return stored
        puts = changes.where(F.col("op") == PUT).drop("op")
        if "namespace" in schema.names:
            clears = (
                changes.where(F.col("op") == CLEAR)
                .groupBy("namespace").agg(F.max("batch").alias("_cleared"))
            )
            # One row per clear, each a call of its own; joined by a shuffle, all rows of a namespace would meet in one task.
            clears = F.broadcast(clears)
            stored = stored.join(clears, "namespace", "left_anti")
            puts = (
                puts.join(clears, "namespace", "left")
                .where(F.col("batch") > F.coalesce("_cleared", F.lit(-1))).drop("_cleared")
            )
        newest = first_ranked(
            puts, keys, [F.col("batch").desc(), F.xxhash64(VECTOR_COLUMN[found["layout"]]).desc()]
        ).drop("batch")
        kept = stored.join(puts.select(*keys), keys, "left_anti")
        return kept.select(*schema.names).unionByName(newest.select(*schema.names))

    def next_id(self, namespace: str | None = None) -> int:
        """One more than the greatest integer id in use, within a namespace if one is given; 0 if there is none."""
        rows = self.read()
        if namespace is not None and "namespace" in rows.columns:
            rows = rows.where(F.col("namespace") == namespace)
        greatest = rows.agg(F.max(F.col("id").try_cast("bigint"))).first()[0]
        return 0 if greatest is None else greatest + 1

    def search_rows(self) -> DataFrame:
        """Rows as ``id, values, metadata, text`` (and ``namespace``, free metadata and their promoted keys)."""
        return searchable(self.read(), self.layout)

    def condition(self, description: Mapping) -> Column:
        """A filter description (see :mod:`vectide.functions.metadata`) as a predicate on :meth:`search_rows`.

        Fixed fields and promoted keys are columns, so comparisons with values
        of their type are left to the scan; other keys are taken out of the
        free metadata of the rows that are left.
        """
        found = self._require()
        promoted = _promoted(found)

        def field(key: Key, kind: str) -> Column:
            if isinstance(key, str) and key in METADATA.names:
                if key == "text":
                    return F.col("text").try_cast(kind)
                held = F.get_json_object("metadata", f"$.{key}") if found["layout"] == "typed" else F.col(f"metadata.{key}")
                return held if kind == "string" and key != "chunk" else held.try_cast(kind)
            if promoted is None:
                raise ValueError(f"the table keeps no free metadata, so it has no key {key!r}")
            if isinstance(key, str) and promoted.get(key) == kind:
                return F.col(PROMOTED)[key]
            return free_value(EXTRA, key, kind)

        return metadata_filter(description, field)


def _promoted(properties: dict) -> dict[str, str] | None:
    return None if properties.get("promoted") is None else json.loads(properties["promoted"])


def _schema(properties: dict) -> T.StructType:
    return table_schema(properties["layout"], _promoted(properties))


def open_collection(spark: SparkSession, path: str) -> Collection:
    return Collection(spark, path.rstrip("/"))


def fan_out(
    records: DataFrame, collections: list[Collection], namespace: str = DEFAULT_NAMESPACE, unique: bool = False
) -> DataFrame:
    """Write the same records to every table in its own layout; returns the rejects ``layout, id, filename, reason``.

    A record beyond the declared limits of a table is kept out of that one.
    The limits are the tables' own, so no option of a load can loosen them.

    Several tables read one written copy; a single table is written directly.
    ``unique`` says that no key repeats in the records. The typed layout
    inserts without a key check, the others insert or replace.
    """
    if EXTRA in records.columns:
        for collection in collections:
            collection.require_free_metadata()
    shared = materialize(records, "fan-out") if len(collections) > 1 else records
    refused = []
    for collection in collections:
        found = collection._require()
        layout = found["layout"]
        kept, rejects = split_constraints(shared, found["dim"])
        refused.append(rejects.select(F.lit(layout).alias("layout"), F.col("id").cast("string").alias("id"), F.col("metadata.filename").alias("filename"), "reason"))
        rows = to_namespaced_layout(kept, namespace) if layout == "namespaced" else LAYOUTS[layout](kept)
        if layout == "typed":
            collection.append(rows)
        elif unique:
            collection.load(rows)
        else:
            collection.upsert(rows)
    return reduce(DataFrame.unionByName, refused)


def fan_out_clear(collections: list[Collection], namespace: str = DEFAULT_NAMESPACE) -> None:
    """Empty the tables a load goes into; of a table with namespaces only the one that is loaded."""
    for collection in collections:
        if collection.layout == "namespaced":
            collection.clear_namespace(namespace)
        else:
            collection.clear()
