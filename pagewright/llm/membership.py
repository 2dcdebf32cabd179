"""A bitmap of fixed size that tells which keys cannot be in a set.

It spares shuffles: rows that surely have no partner stay where they are. ``BITS`` bounds what is
sent to the driver and the workers, whatever the data's size; a fuller bitmap lets more rows
through and changes no result, since an exact join follows.

``split`` does it with DataFrame functions alone: the bitmap is a table of at most SPLIT_BITS / SLOT
rows, joined by broadcast. ``bitmap`` and ``maybe`` are for functions over Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import fresh, stored

BITS = 1 << 27
SPLIT_BITS = 1 << 26
SLOT = 32768  # bits of one row of bitmap_construct_agg


def _places(key: Column) -> Column:
    """Two places for each 64-bit key."""
    other = F.shiftrightunsigned(key, 32)
    return F.array(key.bitwiseAND(F.lit(BITS - 1)), other.bitwiseXOR(key).bitwiseAND(F.lit(BITS - 1)))


def bitmap(keys: DataFrame, key: str):
    """A broadcast of the bitmap's bytes for the LONG column ``key``; at most BITS / 8 bytes."""
    places = keys.select(F.explode(_places(F.col(key).cast("long"))).alias("p"))
    rows = (
        places.select((F.col("p") / SLOT).cast("long").alias("slot"), (F.col("p") % SLOT).alias("bit"))
        .distinct()
        .repartition("slot")
        .groupBy("slot")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    whole = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        whole[r.slot * (SLOT // 8) : r.slot * (SLOT // 8) + len(part)] = part
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def maybe(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit keys: False where a key is surely not in the set."""
    table = np.frombuffer(bits, np.uint8)
    found = np.ones(len(keys), bool)
    for p in (keys & np.uint64(BITS - 1), ((keys >> np.uint64(32)) ^ keys) & np.uint64(BITS - 1)):
        p = p.astype(np.int64)
        found &= (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found


def split(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a partner, rows that surely have none): ``key`` is a LONG of the rows, ``keys``
    a table of one LONG column. Of either's rows and columns nothing else is changed."""
    slot, bits, place = fresh(df, "slot", "bits", "place")
    at = F.col(keys.columns[0]).bitwiseAND(F.lit(SPLIT_BITS - 1))
    marked = keys.select((at / SLOT).cast("int").alias(slot), (at % SLOT).alias("bit")).groupBy(slot).agg(F.bitmap_construct_agg("bit").alias(bits))
    table = F.broadcast(stored(marked, "bitmap"))  # at most SPLIT_BITS / SLOT rows of SLOT bits
    placed = df.withColumn(place, key.bitwiseAND(F.lit(SPLIT_BITS - 1))).withColumn(slot, (F.col(place) / SLOT).cast("int"))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) % SLOT / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.col(place) % 8).cast("int")) > 0
    found = placed.join(table, slot, "left").withColumn(bits, F.coalesce(bit, F.lit(False)))
    return found.where(F.col(bits)).select(*(f"`{c}`" for c in df.columns)), found.where(~F.col(bits)).select(*(f"`{c}`" for c in df.columns))
