"""Bit tables of id sets: rows that are in no such set go before they are shuffled.

A set of ids becomes one bit an id, by hash, in bitmaps of fixed length that an
aggregate builds next to the data. The table of bitmaps is broadcast, as its
size is known from the number of ids; a row looks up the one bit of its id.
Rows of the set always pass, of the others about ``1 / BITS_PER_ID`` do, so an
exact join still has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS_PER_ID = 16
#: Largest table of bitmaps that is sent to the tasks: 32 million ids. Beyond it rows go unfiltered.
MOST_BYTES = 64 << 20
# Fixed value: bits in a bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768
#: Types whose equal values have equal hashes.
HASHED = (T.StringType, T.LongType, T.IntegerType)


def table_bits(count: int) -> int:
    """Bits for so many ids, in whole bitmaps."""
    return -(-max(count, 1) * BITS_PER_ID // BITMAP_BITS) * BITMAP_BITS


def _slot(column: Column, bits: int) -> Column:
    """Place of an id, from 1, as the bitmap functions count."""
    return F.pmod(F.xxhash64(column), F.lit(bits)) + 1


def id_bitmaps(ids: DataFrame, bits: int) -> DataFrame:
    """``_bucket, _bits`` of a table with the column ``id``; nulls are left out."""
    placed = ids.where(F.col("id").isNotNull()).select(_slot(F.col("id"), bits).alias("slot"))
    return placed.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))


def may_contain(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """Rows whose ``id`` may be among ``ids``, of which there are ``count``; without a shuffle of ``rows``.

    All rows, where the bitmaps would be larger than ``MOST_BYTES`` or the two
    columns differ in type. Rows without an id go.
    """
    bits = table_bits(count)
    kind = rows.schema["id"].dataType
    if bits // 8 > MOST_BYTES or kind != ids.schema["id"].dataType or not isinstance(kind, HASHED):
        return rows
    slot = _slot(F.col("id"), bits)
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(slot))
    found = placed.join(F.broadcast(id_bitmaps(ids, bits)), "_bucket")
    # The id that leaves depends on the bit: a plain one would let the optimizer move a later semi join below this one.
    passed = F.when(F.getbit(byte, (position % 8).cast("int")) == 1, F.col("id")).alias("id")
    return found.select(*[passed if c == "id" else f"`{c}`" for c in rows.columns]).where(F.col("id").isNotNull())
