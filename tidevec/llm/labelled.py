"""Which rows may teach a model, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text. Fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def held_out(id_col: Column) -> Column:
    return fold(id_col) == 0


def bounded_sample(df: DataFrame, label: str, id_col: str, per_class: int) -> DataFrame:
    """Rows of each label, about ``per_class`` of them at most, chosen by a hash of the id (the same rows every time).

    Only ids and labels are read to count the labels; every label is taught.
    """
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.least(F.lit(1.0), per_class / F.count(F.lit(1))).alias("_share"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    drawn = df.join(F.broadcast(counts), F.col(label) == F.col("_label"))
    return drawn.filter(draw < F.floor(F.col("_share") * F.lit(1 << 30))).select(*[df[f"`{c}`"] for c in df.columns])
