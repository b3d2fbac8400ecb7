"""Ordered equality of sequences of any length, by digests that are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taskmill.tables import written

# Fixed choice: two primes below 2^31 and a base for each, so that products fit a long.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069))
_DIGIT, _DIGITS = 8, 5


def _power(base: int, modulus: int, exponent: Column) -> Column:
    """base ^ exponent modulo modulus, for exponents below 2^40: a table for each 8 bits of them."""
    out = None
    for k in range(_DIGITS):
        step = pow(base, 1 << (_DIGIT * k), modulus)
        table = F.array(*[F.lit(pow(step, i, modulus)).cast("long") for i in range(1 << _DIGIT)])
        digit = F.shiftright(exponent, _DIGIT * k).bitwiseAND(F.lit((1 << _DIGIT) - 1)).cast("int")
        factor = F.get(table, digit)
        out = factor if out is None else out * factor % modulus
    return out


def id_hash(id_: Column) -> Column:
    """28 bits of an id, null apart from all texts' usual values; SQL engines have md5."""
    return F.coalesce(F.conv(F.substring(F.md5(id_.cast("string")), 1, 7), 16, 10).cast("long"), F.lit(1 << 28)) + 1


def placed(sequence: DataFrame, by: list[str]) -> DataFrame:
    """by, place (from 0), id of (by, ord, id), in the order of (ord, id), as a written table.

    Rows are sorted in range partitions, whatever the length of a sequence. A row's place is its number
    in its partition and the rows of its sequence in those before, of which one row each is counted.
    """
    rows = sequence.select(*by, "ord", "id").repartitionByRange(*by, "ord", "id").sortWithinPartitions(*by, "ord", "id")
    mark = F.monotonically_increasing_id()
    there = written(rows.select(*by, "id", F.shiftright(mark, 33).alias("part"), mark.bitwiseAND(F.lit((1 << 33) - 1)).alias("number")), "ordered")
    counts = there.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row for each sequence and partition.
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("part").alias("_part"), (before - F.col("first")).alias("shift"))
    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return there.join(offsets, same).select(*by, (F.col("number") + F.col("shift")).alias("place"), "id")


def digests(places: DataFrame, by: list[str]) -> DataFrame:
    """by, n, d1, d2 of placed(): the sum of hash(id) * base ^ place for each modulus. Digests of
    parts of a sequence add up, so that rows are summed before they are shuffled."""
    sums = [(F.sum((id_hash(F.col("id")) * _power(base, p, F.col("place")) % p).cast("decimal(20,0)")) % p).cast("long").alias(f"d{i}") for i, (p, base) in enumerate(MODULI, 1)]
    return places.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def sequence_digests(sequence: DataFrame, by: list[str]) -> DataFrame:
    """digests() of each sequence of (by, ord, id). Null ids and keys count; equal ord by id."""
    return digests(placed(sequence, by), by)


def same_order(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row, matches: whether two (ord, id) relations of any size agree in order; null where
    `actual` has no rows.

    Lengths and digests are compared first. Only where they agree are the rows, place by place:
    so unequal sequences cost no join, and equal ones are not taken on trust.
    """
    both = actual.select(F.lit(0).alias("side"), "ord", F.col("id").cast("string").alias("id")).unionByName(expected.select(F.lit(1).alias("side"), "ord", F.col("id").cast("string").alias("id")))
    places = written(placed(both, ["side"]), "places")
    told = {r.side: (r.n, r.d1, r.d2) for r in digests(places, ["side"]).collect()}  # a row for each side
    if 0 not in told:
        matches = None
    elif told[0] != told.get(1):
        matches = False
    else:
        side = lambda k: places.filter(F.col("side") == k).select("place", F.col("id").alias(f"id{k}"))
        matches = side(0).join(side(1), "place").filter(~F.col("id0").eqNullSafe(F.col("id1"))).isEmpty()
    return actual.sparkSession.range(0, 1, 1, 1).select(F.lit(matches).cast("boolean").alias("matches"))
