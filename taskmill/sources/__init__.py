"""Sources: task files, method and track relations, catalogued databases."""

from __future__ import annotations

import json

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.functions import UNKNOWN, key_or_unknown, truthy_text
from taskmill.sources import json_array

TASKS = T.StructType([T.StructField("ord", T.LongType()), T.StructField("db_key", T.StringType()), T.StructField("has_colloquial", T.BooleanType())])
FILE_TASKS = T.StructType([T.StructField("file", T.StringType()), *TASKS.fields, T.StructField("error", T.StringType())])
METHODS = T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("id", "title", "family", "description")], T.StructField("supports_self_consistency", T.BooleanType())])
TRACKS = T.StructType([T.StructField("ord", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("id", "field", "title", "description")]])
IDS = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("id", T.StringType())])

# The ten methods, in order.
METHOD_ROWS = (
    ("direct_nlq_only", "NLQ-only floor", "baseline", "Question only; no schema, samples, database access, or repair.", True),
    ("schema_direct", "Released-schema direct", "baseline", "One-shot generation using the sanitized released schema.", True),
    ("direct", "Direct NL-to-MQL", "baseline", "One-shot generation using a small document sample.", True),
    ("data_rich_direct", "Data-rich direct", "baseline", "One-shot generation using a larger document sample.", True),
    ("sql_pivot", "SQL pivot workflow", "baseline", "Draft a SQL sketch and translate it to MQL.", True),
    ("plan_then_mql", "Plan then MQL", "baseline", "Create a compact plan and convert it to MQL.", True),
    ("react_lite", "Pure ReAct-lite", "baseline", "One reasoning turn followed by final MQL.", True),
    ("static_self_debug", "Static self-debug", "baseline", "Draft, receive static feedback, and repair once.", True),
    ("react_informed", "Fair ReAct (informed)", "baseline", "Bounded read-only ReAct loop with collection names.", False),
    ("sag_v3", "SAG v3", "sag", "Full Schema-as-Data Grounding solver with result consistency.", False),
)
# The two tracks and the field of a task that each asks.
TRACK_ROWS = (
    ("canonical", "NLQ", "Canonical", "Official benchmark questions."),
    ("robustness", "NLQ_colloquial", "Colloquial robustness", "Paraphrased user-style questions."),
)
# Databases that belong to the system.
SYSTEM_DATABASES = ("admin", "config", "local")
#: White space of JSON.
_BLANK = b" \t\n\r"


class TaskFileError(ValueError):
    """A task file that is no JSON array of objects."""


def parse_tasks(raw: bytes, key: str = "db_id", flag: str = "NLQ_colloquial") -> list[tuple[int, str, bool]]:
    """(ord, key, flag) of each object in a strict UTF-8 JSON array.

    A falsy key of any JSON type is `unknown`, others are as Python writes them; the flag is
    Python's truth of its value. An empty object as root has no rows; other roots, elements
    that are no objects and bytes that are no UTF-8 raise TaskFileError.
    """
    try:
        root = json.loads(raw.decode("utf-8"))
    except ValueError as error:
        raise TaskFileError(str(error)) from None
    if root == {}:
        return []
    if not isinstance(root, list) or not all(isinstance(x, dict) for x in root):
        raise TaskFileError("the file is not an array of objects")
    return [(i, str(x.get(key) or UNKNOWN), bool(x.get(flag))) for i, x in enumerate(root)]


def path_status(spark: SparkSession, path: str):
    """What Spark's file system tells of a path (isFile(), getLen(), ...); None if nothing is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(place) if system.exists(place) else None


def path_kind(spark: SparkSession, path: str) -> str | None:
    """"file", "directory" or None, on any file system that Spark knows."""
    status = path_status(spark, path)
    return None if status is None else "file" if status.isFile() else "directory"


def is_task_file(spark: SparkSession, path: str) -> bool:
    """A directory is none."""
    return path_kind(spark, path) == "file"


def parse_element(raw: bytes, first: bool, last: bool, key: str = "db_id", flag: str = "NLQ_colloquial") -> list[tuple[str, bool]]:
    """(key, flag) of an element of json_array.elements(), as parse_tasks() has them; an array
    or an object without any has one element and no row."""
    text = raw.strip(_BLANK)
    if first and last and not text.startswith(b"["):
        return [x[1:] for x in parse_tasks(raw, key, flag)]
    if first and not text.startswith(b"[") or last and not text.endswith(b"]"):
        raise TaskFileError("the file is not an array of objects")
    text = text[1 if first else 0 : len(text) - last]
    if first and last and not text.strip(_BLANK):
        return []
    try:
        item = json.loads(text.decode("utf-8"))
    except (ValueError, RecursionError) as error:
        raise TaskFileError(str(error)) from None
    if not isinstance(item, dict):
        raise TaskFileError("the file is not an array of objects")
    return [(str(item.get(key) or UNKNOWN), bool(item.get(flag)))]


def _parser(key: str, flag: str):
    def parse(batches):
        for batch in batches:
            rows = []
            for file, at, last, raw in (r for lo in range(0, batch.num_rows, 500) for r in zip(*(c.slice(lo, 500).to_pylist() for c in batch.columns), strict=True)):
                try:
                    # Half of a surrogate pair is no character of a Spark string.
                    rows += [(file, at, name.encode("utf-8", "replace").decode(), is_set, None) for name, is_set in parse_element(raw, at == 0, last, key, flag)]
                except TaskFileError as wrong:
                    rows.append((file, None, None, None, f"element {at}: {wrong}"[:500]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], FILE_TASKS.names)

    return parse


def read_task_files(spark: SparkSession, path: str, key: str = "db_id", flag: str = "NLQ_colloquial") -> DataFrame:
    """file, ord, db_key, has_colloquial, error of task files: one, a folder or a pattern of names.

    Parsed as the format demands, in as many tasks as Spark splits the files into (see
    json_array; a first pass runs at once). Each element that isn't as it should be has a row
    with an error and nothing else, and so has a file that begins with a byte order mark or is
    compressed: a file with any such row can't be parsed. Spark doesn't list files of no
    bytes, so that these have no row. Other failures are raised.
    """
    arrays = json_array.scan(spark, path)
    rows = json_array.elements(spark, path, arrays).mapInArrow(_parser(key, flag), FILE_TASKS)
    wrong = literal_rows(spark, [(name, None, None, None, what) for name, what in arrays.wrong.items()], FILE_TASKS)
    return rows.unionByName(wrong) if arrays.wrong else rows


def read_tasks(spark: SparkSession, path: str, strict: bool = True, key: str = "db_id", flag: str = "NLQ_colloquial") -> DataFrame:
    """ord, db_key, has_colloquial, error of a task file, on any file system that Spark knows.

    strict reads by read_task_files(). Otherwise Spark's own JSON reader is used; it accepts more
    than the strict one, keeps `0` and `false` as keys of that text, and can't split; a file
    that it can't parse has one row with an error and nothing else.
    """
    if strict:
        status = path_status(spark, path)
        if status is not None and status.isFile() and not status.getLen():
            return literal_rows(spark, [(None, None, None, "the file is empty")], T.StructType(FILE_TASKS.fields[1:]))
        return read_task_files(spark, path, key, flag).drop("file")
    wrong = F.col("_wrong")
    rows = spark.read.schema(f"`{key}` string, `{flag}` string, _wrong string").option("multiLine", True).option("columnNameOfCorruptRecord", "_wrong").json(str(path))
    whole = lambda c: F.when(wrong.isNull(), c)
    return rows.select(whole(F.monotonically_increasing_id()).alias("ord"), whole(key_or_unknown(F.col(key))).alias("db_key"), whole(truthy_text(F.col(flag))).alias("has_colloquial"), F.substring(wrong, 1, 500).alias("error"))


def literal_rows(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A few rows as literals of the plan, which the optimizer sees."""
    if not rows:
        return spark.createDataFrame([], schema)
    made = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(r, schema, strict=True)]) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(made))


def methods(spark: SparkSession, rows=METHOD_ROWS) -> DataFrame:
    return literal_rows(spark, [(i, *r) for i, r in enumerate(rows)], METHODS)


def tracks(spark: SparkSession, rows=TRACK_ROWS) -> DataFrame:
    return literal_rows(spark, [(i, *r) for i, r in enumerate(rows)], TRACKS)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id) of a JSON array of ids, read as data; no rows where there is no such file or
    its root is no array."""
    found = None
    if is_task_file(spark, path):
        text = spark.read.text(str(path), wholetext=True).first()
        try:
            found = json.loads(text[0]) if text else None
        except ValueError:
            found = None
    return literal_rows(spark, [(i, str(x)) for i, x in enumerate(found)] if isinstance(found, list) else [], IDS)


class CatalogError(RuntimeError):
    """The catalog can't be listed."""


def inventory(spark: SparkSession) -> DataFrame:
    """(db, collection) of the session's catalog; a database without tables has a null one."""
    try:
        rows = [(d.name, t) for d in spark.catalog.listDatabases() for t in ([x.name for x in spark.catalog.listTables(d.name) if not x.isTemporary] or [None])]
    except (PySparkException, Py4JError) as error:
        raise CatalogError(str(error)) from error
    return spark.createDataFrame(rows, "db string, collection string")
