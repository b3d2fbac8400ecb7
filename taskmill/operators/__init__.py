"""Operators over tasks, methods and databases: (DataFrame, parameters) to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill import sources
from taskmill.functions import is_ready, same_sequence

SUMMARY = "available boolean, path string, task_count bigint, database_count bigint, databases array<string>, tasks_per_database map<string,bigint>, robustness_task_count bigint, balanced_110 boolean, error string"


def group_count(tasks: DataFrame, key: str = "db_key") -> DataFrame:
    """(db_key, n): tasks per key."""
    return tasks.groupBy(F.col(key).alias("db_key")).agg(F.count(F.lit(1)).alias("n"))


def is_uniform(counts: DataFrame, size: int) -> DataFrame:
    """One row: whether there are groups and each has `size` rows."""
    return counts.agg(F.coalesce((F.min("n") == size) & (F.max("n") == size), F.lit(False)).alias("uniform"))


def _summary(by_key: DataFrame, group_size: int, *more) -> DataFrame:
    """The one-row summary of (db_key, n, flags), a row for each key, and more aggregates of it."""
    entries = F.array_sort(F.collect_list(F.when(F.col("db_key").isNotNull(), F.struct("db_key", "n"))))
    one = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("task_count"), F.count(F.lit(1)).alias("database_count"), entries.alias("e"), F.coalesce(F.sum("flags"), F.lit(0)).alias("robustness_task_count"), F.coalesce((F.min("n") == group_size) & (F.max("n") == group_size), F.lit(False)).alias("balanced_110"), *more)
    names = one.columns[5:]
    return one.select("task_count", "database_count", F.col("e.db_key").alias("databases"), F.map_from_entries("e").alias("tasks_per_database"), "robustness_task_count", "balanced_110", *names)


def summarise(tasks: DataFrame, group_size: int = 110) -> DataFrame:
    """The one-row summary of a task relation (db_key, has_colloquial).

    Counts and flags are aggregated by key at once, then over the keys: one shuffle by key.
    """
    return _summary(tasks.groupBy("db_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_colloquial").alias("flags")), group_size)


def load_summary(spark: SparkSession, path: str, strict: bool = True, group_size: int = 110) -> DataFrame:
    """summarise() of a task file; unavailable with zero counts if it is missing, and with the
    error too if it can't be parsed. Errors are rows of the reader, aggregated with the others;
    other failures are raised. The row has an entry per key, so that a file's keys must fit one row."""
    gone = {"available": False, "path": str(path), "task_count": 0, "database_count": 0, "databases": None, "tasks_per_database": {}, "robustness_task_count": None, "balanced_110": None, "error": None}
    if sources.is_task_file(spark, path):
        tasks = sources.read_tasks(spark, path, strict)
        fine = F.col("error").isNull()
        by_key = tasks.groupBy("db_key").agg(F.count_if(fine).alias("n"), F.count_if(fine & F.col("has_colloquial")).alias("flags"), F.min("error").alias("error"))
        row = _summary(by_key, group_size, F.min("error").alias("wrong")).first().asDict()
        error = row.pop("wrong")
        gone |= {"error": error} if error is not None else {"available": True} | row
    return spark.createDataFrame([tuple(gone.values())], SUMMARY)


def ids_of_family(methods: DataFrame, family: str = "baseline") -> DataFrame:
    return methods.filter(F.col("family") == family).select("ord", "id")


def ids_in_order(ids: DataFrame) -> DataFrame:
    """One row: the ids as an array, by ord."""
    return ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def matches_in_order(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: whether two (ord, id) relations agree in order; null if `actual` is empty."""
    a, b = ids_in_order(actual).select(F.col("ids").alias("a")), ids_in_order(expected).select(F.col("ids").alias("b"))
    return a.crossJoin(b).select(same_sequence(F.col("a"), F.col("b")).alias("matches"))  # one row each


def user_databases(inventory: DataFrame, system=sources.SYSTEM_DATABASES) -> DataFrame:
    return inventory.filter(F.col("db").isNotNull() & ~F.col("db").isin(*system))


def inventory_summary(inventory: DataFrame, system=sources.SYSTEM_DATABASES) -> DataFrame:
    """One row: available, message, database_count, collection_count, databases (sorted)."""
    by_db = user_databases(inventory, system).groupBy("db").agg(F.count("collection").alias("n"))
    one = by_db.agg(F.count(F.lit(1)).alias("database_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("collection_count"), F.array_sort(F.collect_list("db")).alias("databases"))
    return one.select(F.lit(True).alias("available"), F.lit("The catalog responded.").alias("message"), "database_count", "collection_count", "databases")


def catalog_health(spark: SparkSession, load=sources.inventory) -> DataFrame:
    """inventory_summary() of a catalog, zeroed with the message if it can't be listed."""
    try:
        return inventory_summary(load(spark))
    except sources.CatalogError as error:
        return spark.createDataFrame([(False, str(error), 0, 0, [])], "available boolean, message string, database_count bigint, collection_count bigint, databases array<string>")


def catalogue(spark: SparkSession, path: str, upstream_dir: str | None = None, commit: str | None = None, official: DataFrame | None = None) -> DataFrame:
    """The catalogue document: methods, tracks, dataset, upstream; one nested row."""
    listed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("x"))
    m, t = sources.methods(spark), sources.tracks(spark)
    official = spark.createDataFrame([], "ord int, id string") if official is None else official
    there = bool(upstream_dir) and sources.path_kind(spark, upstream_dir) == "directory"
    upstream = ids_in_order(official).crossJoin(matches_in_order(official, ids_of_family(m)))
    upstream = upstream.select(F.struct(F.lit(there).alias("available"), F.lit(upstream_dir).cast("string").alias("source_dir"), F.lit(commit or None).cast("string").alias("commit"), F.when(F.size("ids") > 0, F.col("ids")).alias("official_baseline_ids"), F.col("matches").alias("catalog_matches_upstream")).alias("upstream"))
    data = load_summary(spark, path).select(F.struct("*").alias("dataset"))
    return listed(m).select(F.col("x").alias("methods")).crossJoin(listed(t).select(F.col("x").alias("tracks"))).crossJoin(data).crossJoin(upstream)  # one row each


def health(spark: SparkSession, path: str, upstream_dir: str | None = None, settings=None, load=sources.inventory) -> DataFrame:
    """The health document: ready only if databases, dataset and upstream are available."""
    from taskmill.config import Settings

    settings = settings or Settings()
    doc = catalogue(spark, path, upstream_dir).crossJoin(catalog_health(spark, load).select(F.struct("*").alias("databases")))
    provider = F.struct(F.lit(settings.api_key_configured).alias("configured"), F.lit(settings.base_url).alias("base_url"), F.lit(settings.model).alias("model"), F.lit(settings.reasoning_effort).alias("reasoning_effort"))
    return doc.select(is_ready(F.col("databases.available"), F.col("dataset.available"), F.col("upstream.available")).alias("status"), "databases", "dataset", "upstream", provider.alias("provider"), F.struct(F.lit(settings.concurrency).alias("concurrency")).alias("defaults"))


def defaults_document(spark: SparkSession, settings=None) -> DataFrame:
    """The defaults document, one row: what may be shown of the settings, never the key."""
    from taskmill.config import Settings

    s = settings or Settings()
    shown = {"provider": "openai-compatible", "model": s.model, "reasoning_effort": s.reasoning_effort, "concurrency": s.concurrency, "api_key_configured": s.api_key_configured}
    return spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in shown.items()])


def identity_document(spark: SparkSession) -> DataFrame:
    """name and version of this library, one row."""
    import taskmill

    return spark.range(0, 1, 1, 1).select(F.lit(taskmill.__name__).alias("name"), F.lit(taskmill.__version__).alias("version"))


def as_json(df: DataFrame) -> DataFrame:
    """One column json: each row as a JSON object, nested columns as objects and arrays. Null
    fields are left out, so that an unavailable summary shows what it has only."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """as_json() as text files, an object per line; an earlier result at the path is replaced."""
    as_json(df).write.mode("overwrite").text(path)


def planned_workload(methods: DataFrame, tracks: DataFrame, tasks: DataFrame | int | None, fallback: int = 1210) -> DataFrame:
    """One row planned_tasks: methods x tracks x tasks. `fallback` stands in only where tasks
    is None (nothing loaded); a count of 0 plans 0."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(methods, "m").crossJoin(n(tracks, "t"))  # one row each
    one = one.crossJoin(n(tasks, "k")) if isinstance(tasks, DataFrame) else one.withColumn("k", F.lit(fallback if tasks is None else tasks).cast("long"))
    return one.select((F.col("m") * F.col("t") * F.col("k")).alias("planned_tasks"))


def result_rollup(results: DataFrame, by=("method", "track", "db_key"), scores=("score",)) -> DataFrame:
    """Our own definition: number of results and mean of each caller's score, by group."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"avg_{s}") for s in scores])


def outcome_table(results: DataFrame, axis: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """Our own definition: per value of the axis a column for each of the caller's outcomes, its count."""
    return results.groupBy(axis).agg(*[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def self_consistency_runs(methods: DataFrame, samples: int) -> DataFrame:
    """Our own definition: (id, sample): `samples` runs of a method that supports them, one of others."""
    n = F.when(F.col("supports_self_consistency"), samples).otherwise(1)
    return methods.select("id", F.explode(F.sequence(F.lit(1), n)).alias("sample"))
