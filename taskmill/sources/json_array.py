"""Files of one JSON array each as a source that can be split, whatever file system they are on.

Spark's text reader, with `}` for a line end, deals the bytes of a file to tasks in ranges. Where
a range begins is not known to lie in a string or at which depth. So a first pass finds for
each range what it does to either state; composed in file order these give the state that each
range begins in, and the number of elements before it. A second pass cuts the ranges at the
commas of depth 1. What lies before a range's first such comma and behind its last one are
parts of elements that go on in other ranges; they are put together by their element's number.

The elements, joined by commas, are the file again. So if each of them is JSON between the
brackets of the first and the last, the file is, and if it is not, one of them is not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends a record of the text reader: each object has one, and a record then never ends escaped.
SEPARATOR = "}"
#: Bytes that are scanned at once, about.
RUN_BYTES = 1 << 20
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_RANGES = "file string, block bigint, records bigint, bytes bigint, flips boolean, outside bigint, inside bigint, outside_commas map<bigint,bigint>, inside_commas map<bigint,bigint>"


@dataclass
class Arrays:
    """What the first pass tells: how each range (file, first byte) begins (in a string, depth, elements
    before it), the number of elements of each file, the last range of each with whether the
    file ends with the separator, and what is wrong with files that can't be read."""

    starts: dict[tuple[str, int], tuple[bool, int, int]] = field(default_factory=dict)
    elements: dict[str, int] = field(default_factory=dict)
    ends: dict[tuple[str, int], bool] = field(default_factory=dict)
    wrong: dict[str, str] = field(default_factory=dict)


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", SEPARATOR).text(str(path))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _streams(batches):
    """((file, range), its next bytes, records): ranges come one after the other, each in the order
    of its bytes."""
    end = ord(SEPARATOR)
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        files, blocks = names.indices.to_numpy(), batch.column(1).to_numpy()
        edges = (np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if lo == hi:
                continue
            values = batch.column(2).slice(lo, hi - lo)
            wide = pa.types.is_large_binary(values.type)
            _, where, data = values.buffers()
            offs = np.frombuffer(where, np.int64 if wide else np.int32)[values.offset : values.offset + hi - lo + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            name, first = (names.dictionary[int(files[lo])].as_py(), int(blocks[lo])), 0
            while first < hi - lo:  # a few MB at once, one record at least
                last = max(first + 1, int(np.searchsorted(offs, offs[first] + RUN_BYTES, side="right")) - 1)
                yield name, np.insert(raw[offs[first] : offs[last]], offs[first + 1 : last + 1] - offs[first], end), last - first
                first = last


def _in_string(stream: np.ndarray) -> np.ndarray:
    """Whether an odd number of quotes stands up to each byte; a quote behind an odd number of
    backslashes is none. (Outside of strings there are no backslashes in JSON.)"""
    quote = stream == 0x22
    slash = stream == 0x5C
    if slash.any():
        at = np.flatnonzero(quote)
        other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(stream))))
        before = np.where(at > 0, (at - 1) - other[at - 1], 0)
        quote[at[before % 2 == 1]] = False
    return np.bitwise_xor.accumulate(quote)


def _transitions(batches):
    def row(block, seen):
        records, size, flips, depth, commas = seen
        return {"file": block[0], "block": block[1], "records": records, "bytes": size, "flips": flips, "outside": depth[0], "inside": depth[1], "outside_commas": list(commas[0].items()), "inside_commas": list(commas[1].items())}

    held = None
    kind = pa.map_(pa.int64(), pa.int64())
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("flips", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64()), ("outside_commas", kind), ("inside_commas", kind)])
    for block, stream, records in _streams(batches):
        if held is None or held[0] != block:
            if held is not None:
                yield pa.RecordBatch.from_pylist([row(*held)], schema)
            held = block, [0, 0, False, [0, 0], [{}, {}]]
        seen = held[1]
        string = _in_string(stream) ^ seen[2]
        step, comma = _STEP[stream], stream == 0x2C
        for begun in (0, 1):  # outside, inside of a string
            bare = string == bool(begun)
            depth = seen[3][begun] + np.cumsum(np.where(bare, step, 0), dtype=np.int64)
            for level, n in zip(*(x.tolist() for x in np.unique(depth[comma & bare], return_counts=True)), strict=True):
                seen[4][begun][level] = seen[4][begun].get(level, 0) + n
            seen[3][begun] = int(depth[-1])
        seen[0], seen[1], seen[2] = seen[0] + records, seen[1] + len(stream) - records, bool(string[-1])
    if held is not None:
        yield pa.RecordBatch.from_pylist([row(*held)], schema)


def scan(spark: SparkSession, path: str) -> Arrays:
    """The first pass over a file, a folder or a pattern of names. A row for each range and for
    each file comes to the driver, as when Spark lists files."""
    listed = spark.read.format("binaryFile").load(str(path)).select("_metadata.file_path", "_metadata.file_size").collect()
    rows = sorted(_records(spark, path).mapInArrow(_transitions, _RANGES).collect(), key=lambda r: (r.file, r.block))
    ranges: dict[str, list] = {r.file_path: [] for r in listed}
    for r in rows:
        ranges[r.file].append(r)
    found = Arrays()
    for name, size in listed:
        string, depth, elements = False, 0, 0
        for r in ranges[name]:
            found.starts[name, r.block] = string, depth, elements
            commas = r.inside_commas if string else r.outside_commas
            elements += commas.get(1 - depth, 0)
            depth += r.inside if string else r.outside
            string ^= r.flips
        missing = size + 1 - sum(r.bytes + r.records for r in ranges[name])
        if missing not in (0, 1):  # the text reader left out bytes
            found.wrong[name] = "the file has a byte order mark, or is compressed"
        else:
            found.elements[name] = elements + 1
            found.ends[name, ranges[name][-1].block] = missing == 1
    return found


def _cutter(arrays: Arrays, whole: bool):
    """(file, ord, last, block, element): elements that lie whole in a range, or the parts of others."""
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())

    def cut(batches):
        block, string, depth, at, first, held, out, size = None, False, 0, 0, True, [], [], 0

        def put(at):
            nonlocal size
            element = b"".join(held)
            out.append((block[0], at, at == arrays.elements[block[0]] - 1, block[1], element))
            size += len(element)

        def close():
            if block in arrays.ends and not arrays.ends[block]:
                held[-1] = held[-1][:-1]  # the separator that the file's last record has been given
            put(at)

        for here, stream, _ in _streams(batches):
            if here[0] in arrays.wrong:
                continue
            if here != block:
                if block is not None and not whole:
                    close()
                block, first, held = here, True, []
                string, depth, at = arrays.starts[block]
            inside = _in_string(stream) ^ string
            levels = depth + np.cumsum(np.where(inside, 0, _STEP[stream]), dtype=np.int64)
            string, depth = bool(inside[-1]), int(levels[-1])
            lo = 0
            for hi in np.flatnonzero((stream == 0x2C) & ~inside & (levels == 1)).tolist():
                held.append(stream[lo:hi].tobytes())
                if first != whole:
                    put(at)
                held, first, at, lo = [], False, at + 1, hi + 1
            held.append(stream[lo:].tobytes())
            if size > 4 << 20:
                yield _batch(out, kinds)
                out, size = [], 0
        if block is not None and not whole:
            close()
        if out:
            yield _batch(out, kinds)

    return cut


def _batch(rows: list[tuple], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "ord", "last", "block", "element"])


def elements(spark: SparkSession, path: str, arrays: Arrays) -> DataFrame:
    """file, ord, last, element: the bytes between the commas of depth 1, with the array's brackets on
    the first and the last one. Files are read twice, the second time for the parts of elements
    that ranges part; only those are shuffled. An element must fit a row."""
    kind = "file string, ord bigint, last boolean, block bigint, element binary"
    inner = _records(spark, path).mapInArrow(_cutter(arrays, True), kind).select("file", "ord", "last", "element")
    parts = _records(spark, path).mapInArrow(_cutter(arrays, False), kind)
    joined = parts.groupBy("file", "ord", "last").agg(F.array_sort(F.collect_list(F.struct("block", "element"))).alias("parts"))
    return inner.unionByName(joined.select("file", "ord", "last", F.expr("aggregate(parts, X'', (have, part) -> concat(have, part.element))").alias("element")))


def write_arrays(df: DataFrame, path: str) -> None:
    """df as files of one JSON array each, a file for each partition that has rows."""

    def lines(batches):
        ahead = "["
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = batch.column(0).slice(lo, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([(ahead if i == 0 else ",") + row for i, row in enumerate(rows)])], ["line"])
                ahead = ","
        if ahead == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["line"])

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).mapInArrow(lines, "line string").write.text(str(path))
