"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at rows that an earlier step could not tell apart. The
first two work on two numbers a row. Rows that share both with another row are
found by a join with the shared pairs themselves, so that no other row is ever
hashed in full, however many rows there are. The pairs are sent to the tasks
only if counting shows that they are few; otherwise the join is an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import fresh, quoted, whole_text
from vectide.session import drop_scratch, materialize

#: Shared pairs of length and prefix hash that are sent to every task at most; 16 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Groups of equal texts that are sent to every task at most; about 120 bytes each.
BROADCAST_GROUPS = 100_000
#: Characters that the prefix hash covers.
PREFIX = 64


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=None,
                carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``carry`` plus ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after ``normalise`` (a function of a column;
    no change unless given). Of equal texts the row with the largest id stays.
    ``carry`` names the columns to return (all columns of ``docs`` unless given;
    then the three new columns get a trailing ``_`` where names clash).

    Edge cases: a null text counts as empty, and all empty texts are equal. A
    null id is smaller than any other. Of rows with the same id and text one
    stays, and it does not matter which. An empty table gives no rows.
    """
    content = whole_text(text) if normalise is None else normalise(whole_text(text))
    if carry is None:
        carry = {name: quoted(name) for name in docs.columns}
    keep_id, group_size, kept = fresh(carry, "keep_id", "group_size", "kept")
    at, id_, size, prefix, digest, body = fresh(
        [*carry, *docs.columns, keep_id, group_size, kept], "at", "id", "size", "prefix", "digest", "body")
    keys = [size, prefix, digest]

    rows = docs.withColumn(body, content)
    rows = rows.withColumns({size: F.octet_length(body), prefix: F.xxhash64(F.substring(F.col(body), 1, PREFIX))})
    narrow = materialize(rows.select(F.col(size).alias("size"), F.col(prefix).alias("prefix")), "lengths")
    by_size = narrow.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    by_prefix = narrow.join(by_size, "size", "left_semi").groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(by_prefix.select(F.col("size").alias(f"{size}__"), F.col("prefix").alias(f"{prefix}__")), "shared")
    drop_scratch(narrow)
    if shared.count() <= BROADCAST_PAIRS:
        shared = F.broadcast(shared)
    pair = [F.col(key) == F.col(f"{key}__") for key in (size, prefix)]

    # Full contents are hashed only where length and prefix are shared, and only those rows are written down.
    hashed = rows.join(shared, pair, "left_semi").select(
        *[column.alias(name) for name, column in carry.items()], F.monotonically_increasing_id().alias(at),
        quoted(doc_id).alias(id_), size, prefix, F.unhex(F.sha2(F.col(body), 256)).alias(digest))
    hashed = materialize(hashed, "hashed")
    best = F.max(F.struct(F.col(id_), F.col(at)))
    groups = hashed.groupBy(*keys).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    # Written down, so that the join below shuffles both sides itself and can split a hot group.
    groups = materialize(groups.filter("n > 1"), "groups").select(
        *[F.col(key).alias(f"{key}__") for key in keys], F.col("best").alias(f"best{at}"), F.col("n").alias(f"n{at}"))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)  # the copies' texts stay where they are

    shown = [quoted(name) for name in carry]
    alone = [F.col(f"{id_}").alias(keep_id), F.lit(1).cast("long").alias(group_size), F.lit(True).alias(kept)]
    found = F.col(f"best{at}").isNotNull()
    grouped = [
        F.when(found, F.col(f"best{at}")[id_]).otherwise(F.col(id_)).alias(keep_id),
        F.coalesce(F.col(f"n{at}"), F.lit(1)).cast("long").alias(group_size),
        F.when(found, F.col(f"best{at}")[at] == F.col(at)).otherwise(F.lit(True)).alias(kept),
    ]
    on = [F.col(key) == F.col(f"{key}__") for key in keys]
    copies = hashed.join(groups, on, "left").select(*shown, *grouped)
    rest = rows.join(shared, pair, "left_anti")
    single = rest.select(*[column.alias(name) for name, column in carry.items()], quoted(doc_id).alias(id_)).select(*shown, *alone)
    return single.unionByName(copies)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=None) -> DataFrame:
    """The rows of ``docs`` that :func:`mark_copies` keeps, with the columns of ``docs``."""
    marked = mark_copies(docs, text, doc_id, normalise)
    return marked.filter(quoted(marked.columns[-1])).select(*[quoted(name) for name in docs.columns])
