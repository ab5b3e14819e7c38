"""A table of marked hash slots, of fixed size whatever the input: the first step of a semi-join that shuffles only what passes.

It may pass rows that aren't meant (two values in one slot), so the exact join follows; the more
values are marked, the more pass, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import written

SLOT_BITS = 26


def slot(*values: Column) -> Column:
    """1 to 2**SLOT_BITS."""
    return F.pmod(F.xxhash64(*values), F.lit(1 << SLOT_BITS)) + 1


def marks(slots: DataFrame) -> DataFrame:
    """(bucket, marks) of ``slots`` (_slot): at most 2**SLOT_BITS bits, one row for each 32,768 of them."""
    bucket, at = F.call_function("bitmap_bucket_number", F.col("_slot")), F.call_function("bitmap_bit_position", F.col("_slot"))
    return written(slots.groupBy(bucket.alias("_bucket")).agg(F.call_function("bitmap_construct_agg", at).alias("_marks")), "marks")


def with_mark(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` (_slot, ...) with ``_mark``, whether their slot is in ``marked``. Broadcasts 2**SLOT_BITS bits (8 MB) at most."""
    bucket, at = F.call_function("bitmap_bucket_number", F.col("_slot")), F.call_function("bitmap_bit_position", F.col("_slot"))
    byte = F.conv(F.hex(F.substring("_marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(marked), "_bucket", "left")
    return found.withColumn("_mark", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_marks")
