"""Bit tables: small arrays of bits that keep most rows out of a shuffle, on DataFrame operations alone."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise


def ones(bits: int) -> Column:
    """A long whose lowest ``bits`` bits are set."""
    return F.lit((1 << bits) - 1)


def dense(cells: DataFrame, n: int, label: str) -> DataFrame:
    """One row with an array ``values`` of ``n`` longs from (cell, value) rows; cells without a row are 0."""
    every = cells.sparkSession.range(n).withColumnRenamed("id", "cell").join(cells, "cell", "left").select("cell", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    def joined(key: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])

    runs = every.groupBy(F.shiftright("cell", 9).alias("run")).agg(joined("cell", "value").alias("values"))
    return materialise(runs.agg(F.flatten(joined("run", "values")).alias("values")), label)


def bit_table(hashes: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A table of 2**bits bits, in which those of the longs of the one column are set; 16 bits for each, between 2**15 and 2**26 (8 MB)."""
    bits = min(26, max(15, ceil(log2(16 * max(1, count)))))
    spot = F.col(hashes.columns[0]).bitwiseAND(ones(bits))
    mark = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int")))
    return dense(hashes.groupBy(F.shiftright(spot, 6).alias("cell")).agg(mark.alias("value")), 1 << (bits - 6), "bits"), bits


def marked(hash_: Column, table: tuple[DataFrame, int]) -> Column:
    """Whether the hash's bit is set; it is for all that the table was made of, and for few others unless they are very many."""
    values, bits = table
    spot = hash_.bitwiseAND(ones(bits))
    return F.getbit(F.get(values.scalar(), F.shiftright(spot, 6).cast("int")), spot.bitwiseAND(F.lit(63)).cast("int")) == 1


def without_rows(df: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose id and text's hash are in ``gone`` (id, text_hash; nulls count as equal).

    Only rows that a bit table can't tell from gone ones are shuffled. All columns stay, whatever their names.
    """
    gone = materialise(gone.select("id", "text_hash").distinct(), "gone")
    text_hash = F.xxhash64(F.col(f"`{text_col}`"))
    if gone.isEmpty():
        return df
    doubtful = marked(F.xxhash64(F.col(f"`{id_col}`").cast("long"), text_hash), bit_table(gone.select(F.xxhash64(F.col("id").cast("long"), "text_hash").alias("spot")), gone.count()))
    rows = df.filter(doubtful).select(F.struct("*").alias("row"))
    on = F.col(f"row.`{id_col}`").eqNullSafe(F.col("gone.id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("gone.text_hash"))
    kept = rows.join(gone.select(F.struct("*").alias("gone")), on, "left_anti")
    return df.filter(~doubtful).unionByName(kept.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns]))
