"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from taskmill.llm.common import drop_written, free_name, text_of, written

#: Expected copies are held as whole multiples of 1 / SCALE, so that prefix sums are exact.
SCALE_BITS = 24
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, size: str) -> DataFrame:
    """docs with the number of words between white space of each text (null: 0)."""
    return docs.withColumn(size, F.regexp_count(text_of(docs), F.lit(WORD)).cast("long"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size, target words and place.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times
    all sizes. A target stops at `most` times its source's size; what it leaves is shared by
    weight among the others until none is above. In order of cap to weight the capped
    sources come first, so that one pass of prefix sums finds the final level.
    sizes: source, source_size, a row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    level = W.orderBy(F.col("cap") / F.col("weight"), "place")
    done, rest, everything = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(0, W.unboundedFollowing), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    walked = ranked.withColumn("spent", F.coalesce(F.sum("cap").over(done), F.lit(0.0))).withColumn("left_weight", F.sum("weight").over(rest)).withColumn("pot", F.lit(share) * F.sum("source_size").over(everything))
    walked = walked.withColumn("full", F.col("cap") * F.col("left_weight") <= (F.col("pot") - F.col("spent")) * F.col("weight"))
    open_ = F.when(~F.col("full"), F.struct("left_weight", "spent"))
    # The first open source, which has the most weight left, fixes the level of all open ones.
    walked = walked.withColumn("first", F.max(open_).over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", (F.col("pot") - F.col("first.spent")) * F.col("weight") / F.col("first.left_weight")))
    return walked.select("source", "source_size", target.alias("target"))


def offset(seed: str, source: str = "source"):
    """A number from 0 to 2^SCALE_BITS - 1 for each source, from the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 6), 16, 10).cast("long")


def mix_sources(docs: DataFrame, size: str = "_size", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with source_size, target, copies (how often the mix takes the row) and taken.

    Systematic sampling within each source: rows in order of size and doc_id (null first)
    have target / source_size expected copies each; one random offset is added to their
    prefix sum, and a row is emitted once for each whole number that the sum passes. Order by
    size makes neighbours alike, so that the words taken miss the target by about one row's.
    All arithmetic is on integers: no row is taken more than `most` times, reruns agree.

    The rank of a row in its source comes from range partitions: rows are dealt by (source,
    size, doc_id), each partition is sorted, and only the counts by partition and source are
    summed up. A source of any share of the rows is spread over many partitions.

    size: a column of docs, as sized() adds it; write docs first if that is costly, as the sort
    reads its keys twice. Null sources are a source of their own, the last; null sizes count as
    0; rows that agree in all keys are in order of a hash of all their columns, so that reruns
    take the same; empty input gives no rows. Columns of docs are kept, but for the four that are
    returned.
    """
    docs = docs.drop(*ADDED)
    keyed = docs.withColumn(size, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    name = lambda x: free_name(keyed, f"_mix_{x}")
    at, tie = name("at"), name("tie")
    keys = ("source", size, "doc_id", tie)
    every = [F.col(f"`{c}`") for c in keyed.columns]
    rows = keyed.withColumn(tie, F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(keyed.schema[n].dataType, T.MapType) else c for n, c in zip(keyed.columns, every, strict=True)]))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()), "mix")
    part = F.shiftright(at, 33)
    runs = written(rows.groupBy("source", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.sum(size).alias("size")), "mix-runs")
    goals = targets(runs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << SCALE_BITS))).otherwise(0).cast("long")
    ahead = runs.withColumn("before", before).select(F.col("source").alias("_s"), "part", "low", "before")
    ahead = ahead.join(goals, ahead["_s"].eqNullSafe(goals["source"])).select("_s", "part", "low", "before", "source_size", "target", rate.alias("rate"))
    ahead = written(ahead, "mix-goals").withColumn("u", offset(seed, "_s"))
    ahead = ahead.select(*[F.col(c).alias(name(c)) for c in ("_s", "part", "low", "before", "rate", "u", "source_size", "target")])
    out = rows.join(ahead, (part == ahead[name("part")]) & rows["source"].eqNullSafe(ahead[name("_s")]))
    rank, of = F.col(name("before")) + F.col(at) - F.col(name("low")), F.col(name("rate"))
    copies = F.shiftright((rank + 1) * of + F.col(name("u")), SCALE_BITS) - F.shiftright(rank * of + F.col(name("u")), SCALE_BITS)
    out = out.select(*every, F.col(name("source_size")).alias("source_size"), F.col(name("target")).alias("target"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col(size))


#: Columns that mix_sources() adds.
ADDED = ("source_size", "target", "copies", "taken")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes."""
    name = free_name(mixed, "_copy")
    return mixed.filter("copies > 0").select(*[F.col(f"`{c}`") for c in columns], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(name)).drop(name)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, by the number of its words; columns as
    they were, also those named as what mix_sources() adds."""
    size = free_name(docs, "_mix_size")
    held = {c: free_name(docs, f"_mix_own_{c}") for c in docs.columns if c.lower() in ADDED}
    # Written, as the sort by ranges looks at its keys twice.
    rows = written(sized(docs, size).withColumnsRenamed(held), "sizes")
    names = [held.get(c, c) for c in docs.columns]
    mixed = mix_sources(rows, size, **options)
    drop_written(rows)  # mix_sources() reads its own table from here on
    return repeated(mixed, names).withColumnsRenamed({v: k for k, v in held.items()})
