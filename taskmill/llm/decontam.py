"""Benchmark decontamination: size-partitioned MinHash containment search.

Spark SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import free_name, text_of, written

WORDS, CONTAINMENT = 5, 0.8
OUT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def with_shingles(df: DataFrame, text: Column, name: str, lengths: list[int]) -> DataFrame:
    """df with the hashes of all runs of k words of a text, as an array name<k> for each length k (repeats kept)."""
    hashed = F.transform(F.array_remove(F.split(F.lower(text), OUT), ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_wh", hashed)

    def runs(k: int) -> Column:
        last = F.size("_wh") - k
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + j) for j in range(k)]))
        return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))

    return df.withColumns({f"{name}{k}": runs(k) for k in lengths}).drop("_wh")


def sketches(items: DataFrame, words: int, containment: float) -> DataFrame:
    """items with their distinct shingles, n, need, size partition and bottom-k MinHash sketch.

    An item of fewer than `words` words has one shingle, of all its words; length tells of how
    many words an item's shingles are.

    A text that holds at least need = ceil(containment * n) shingles of an item lacks at most
    n - need of them, so that it holds one of any n - need + 1. The sketch is the
    n - need + 1 smallest hashes; no item is missed.
    """
    hashed = F.transform(F.array_remove(F.split(F.lower(text_of(items)), OUT), ""), lambda w: F.xxhash64(w))
    found = items.select(items["item_id"], text_of(items).alias("_t"), F.least(F.size(hashed), F.lit(words)).alias("length")).filter("length > 0")
    found = with_shingles(found, F.col("_t"), "all", [words]).withColumnRenamed(f"all{words}", "all")
    whole = [F.when(F.col("length") == k, F.xxhash64(*[F.get("_own", F.lit(j)) for j in range(k)])) for k in range(1, words)]
    found = found.withColumn("_own", F.transform(F.array_remove(F.split(F.lower("_t"), OUT), ""), lambda w: F.xxhash64(w)))
    found = found.withColumn("all", F.when(F.col("length") < words, F.array(F.coalesce(*whole))).otherwise(F.col("all"))) if whole else found
    found = found.select("item_id", "length", F.array_sort(F.array_distinct("all")).alias("set")).withColumn("n", F.size("set"))
    found = found.withColumn("need", F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int"))
    found = found.withColumn("part", F.floor(F.log2("n")).cast("int")).withColumn("sketch", F.slice("set", F.lit(1), F.col("n") - F.col("need") + 1))
    return written(found.withColumn("ikey", F.monotonically_increasing_id()), "bench")


def lookups(keyed: DataFrame, item: DataFrame, lengths: list[int]) -> DataFrame:
    """(tkey, hash) that each text looks up: for each length of runs those up to the greatest bound
    of the partitions that the text is long enough for."""
    # One row per power of two, at most 31, and one for each length of fewer words.
    parts = item.groupBy("length", "part").agg(F.max(F.element_at("sketch", -1)).alias("bound"), F.min("need").alias("need")).collect()

    def low(k: int) -> Column:
        least = F.lit(-(1 << 63))
        bound = F.greatest(least, least, *[F.when(F.size(f"all{k}") >= r["need"], F.lit(r["bound"])) for r in parts if r["length"] == k])
        return F.filter(f"all{k}", lambda h: h <= bound)

    return keyed.select("tkey", F.explode(F.concat(*map(low, lengths))).alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, words: int = WORDS, containment: float = CONTAINMENT, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment, text_id) of each row of docs and item
    such that the text holds at least `containment` of the item's distinct shingles.

    Items are partitioned by the binary logarithm of their size. Each has a bottom-k MinHash
    sketch, whose k follows from its size; each partition has a bound, the largest hash of its
    sketches. A text looks up each of its hashes once, if it is below the bound of any partition
    that the text is long enough for; hashes of runs of each length have bounds of their own.
    Texts that share a hash with a sketch are verified: all shingles of the items that a text
    may hold are joined with its own, and counted. So a text may hold any number of items.

    Words are runs of letters, digits and characters beyond ASCII, in lower case. An item of
    fewer than `words` words has one shingle of all of them: it is found where they stand
    consecutively. Items without words and null texts are never found. Repeated rows give a row
    each; ids may be null; other columns don't matter.
    """
    item = sketches(items, words, containment)
    lengths = sorted({words, *(r["length"] for r in item.select("length").distinct().collect())})  # `words` at most
    text = text_of(docs)
    keyed = with_shingles(docs.select(F.xxhash64(text).alias("tkey"), text.alias("_t")), F.col("_t"), "all", lengths)
    probes = lookups(keyed, item, lengths)
    entries = written(item.select("ikey", F.explode("sketch").alias("hash")), "bench-sketch")
    pairs = written(probes.join(entries, "hash").select("tkey", "ikey").distinct(), "bench-pairs")
    some = docs.select(F.col(id_col), text.alias("_t"), F.xxhash64(text).alias("tkey")).join(pairs.select("tkey").distinct(), "tkey", "left_semi")
    texts = some.groupBy(F.md5("_t").alias("text_id")).agg(F.first("tkey").alias("tkey"), F.first("_t").alias("_t"))
    all_ = F.concat(*[F.col(f"all{k}") for k in lengths])
    own = with_shingles(texts, F.col("_t"), "all", lengths).select("text_id", "tkey", F.explode(F.array_distinct(all_)).alias("hash"))
    asked = written(pairs.join(item.select("ikey", F.explode("set").alias("hash")), "ikey"), "bench-asked")
    shared = own.join(asked, ["tkey", "hash"]).groupBy("text_id", "ikey").agg(F.count(F.lit(1)).alias("n_shared"))
    held = shared.join(item.select("ikey", "item_id", "n", "need"), "ikey").filter("n_shared >= need")
    held = written(held.select("text_id", "item_id", "n_shared", F.col("n").cast("long").alias("n_item")), "bench-held")
    rows = docs.select(F.col(id_col), F.md5(text).alias("text_id")).join(held, "text_id")
    return rows.select(id_col, "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"), "text_id")


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose texts hold an item; null texts are kept."""
    found = contained_items(docs, items, **options).select(F.col("text_id").alias("_dc_text")).distinct()
    key = free_name(docs, "_dc_key")
    keyed = docs.withColumn(key, F.md5(text_of(docs)))
    found = written(found, "bench-found")
    return keyed.join(found, keyed[key] == found["_dc_text"], "left_anti").drop(key)
