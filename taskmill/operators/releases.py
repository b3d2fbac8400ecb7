"""What changed between two releases of a task relation. The definition is our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def release_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, n_old, n_new, change, fields: a row for each key of either release.

    change is `added` or `removed` where one release hasn't the key, `same` where both have the same
    rows as often, `repeated` where they have the same rows but not as often, else `changed`.
    fields are the columns, in order, that differ where each has one row. Null is a key, and
    equals null in every column. Columns of one release only are null in the other.

    Rows of both are counted together by key and content, then by key: copies are one row before
    they are shuffled, and a key with very many rows is summed where they are.
    """
    names = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    kinds = {**dict(old.dtypes), **dict(new.dtypes)}

    def side(df: DataFrame, is_new: int) -> DataFrame:
        cells = [(df[c] if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names]
        return df.select(df[key].alias("k"), F.struct(*cells).alias("row"), F.lit(1 - is_new).cast("long").alias("o"), F.lit(is_new).cast("long").alias("n"))

    rows = side(old, 0).unionByName(side(new, 1)).groupBy("k", "row").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    keys = rows.groupBy("k").agg(
        F.sum("o").alias("n_old"), F.sum("n").alias("n_new"), F.bool_and(F.col("o") == F.col("n")).alias("same"), F.bool_and((F.col("o") > 0) & (F.col("n") > 0)).alias("known"),
        F.max(F.when(F.col("o") > 0, F.col("row"))).alias("before"), F.max(F.when(F.col("n") > 0, F.col("row"))).alias("after"),
    )
    change = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when(F.col("same"), "same").when(F.col("known"), "repeated").otherwise("changed")
    differ = F.array_compact(F.array(*[F.when(~F.col("before")[c].eqNullSafe(F.col("after")[c]), F.lit(c)) for c in names]))
    fields = F.when((change == "changed") & (F.col("n_old") == 1) & (F.col("n_new") == 1), differ)
    return keys.select(F.col("k").alias(key), "n_old", "n_new", change.alias("change"), fields.alias("fields"))
