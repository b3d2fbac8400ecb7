"""Token counts from flat, unindexed token files, by a scan for end-of-document ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taskmill.llm.common import dealt, encoder, new_path, open_fs, text_of, with_end, written

#: Ids of a block that is searched at once.
BLOCK_IDS = 4 << 20


def _flat_writer(folder: str, tokenizer: str, end_id: int, kind: str):
    def write(batches):
        import uuid

        encode = encoder(tokenizer)
        if max(encode.size - 1, end_id) > np.iinfo(kind).max:
            raise ValueError(f"ids up to {max(encode.size - 1, end_id)} do not fit {kind}")
        out = path = None
        at = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.ids"
                    fs, inner = open_fs(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner)
                names, texts = batch.column(0), batch.column(1)
                for _, ids, counts in encode.runs(texts):
                    out.write(with_end(ids.astype(kind), counts, end_id).tobytes())
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), names], ["path", "ordinal", "id"])
                at += n
        finally:
            if out is not None:
                out.close()

    return write


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u2", folder: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Write the ids of whole texts, end_id after each, to flat files without any index.

    One file per input partition, in its order. Returns path, ordinal (the document's place
    in its file) and id: which document is where, no sizes. end_id must not stand in texts:
    special tokens' strings are encoded as ordinary text. kind: numpy's name of the integers.
    """
    folder = folder or new_path(docs.sparkSession, "flat")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs).alias("text"))
    return written(rows.mapInArrow(_flat_writer(folder, tokenizer, end_id, kind), "path string, ordinal bigint, id bigint"), "flat-files")


def _blocks(width: int, block_ids: int):
    def cut(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_fs(path)
                size = fs.get_file_info(inner).size
                if size % width:
                    raise ValueError(f"{path} ends within an id")
                lows = list(range(0, size // width, block_ids)) or []
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lows), pa.string()), pa.array(lows, pa.int64()), pa.array([min(block_ids, size // width - x) for x in lows], pa.int64())], ["path", "low", "n"])

    return cut


def _searcher(kind: str, end_id: int):
    width = np.dtype(kind).itemsize

    def search(batches):
        for batch in batches:
            for path, low, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as f:
                    f.seek(low * width)
                    ids = np.frombuffer(f.read(n * width), kind)
                ends = np.flatnonzero(ids == end_id) + low
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([low]), pa.array([n]), pa.array([ends], pa.list_(pa.int64()))], ["path", "low", "n", "ends"])

    return search


def scan_flat(paths: DataFrame, end_id: int, kind: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """path, ordinal, start, n_tokens, ended of each document of flat token files.

    Files are cut into blocks that are searched independently. A prefix scan over the blocks
    of a file (how many ends stand before, where the last of them is) stitches documents that
    cross blocks. n_tokens is without the end id. Ids after a file's last end are one more
    document, whose `ended` is false. An empty file has no document.
    paths: a column path; repeats count once.
    """
    width = np.dtype(kind).itemsize
    found = paths.select("path").distinct().mapInArrow(_blocks(width, block_ids), "path string, low bigint, n bigint")
    found = written(found, "flat-blocks")
    found = dealt(found).mapInArrow(_searcher(kind, end_id), "path string, low bigint, n bigint, ends array<bigint>")
    found = written(found, "flat-ends")
    runs = found.select("path", "low", "n", F.size("ends").alias("k"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    earlier = W.partitionBy("path").orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("path", "low", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("first"), (F.coalesce(F.max("last").over(earlier), F.lit(-1)) + 1).alias("begin"))
    both = found.join(runs, ["path", "low"])
    one = both.select("path", "first", "begin", F.posexplode("ends").alias("i", "end"), F.col("ends"))
    one = one.select("path", (F.col("first") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("begin")).otherwise(F.get("ends", F.col("i") - 1) + 1).alias("start"), "end")
    ended = one.select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = found.groupBy("path").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")) + 1, F.lit(0)).alias("start"), F.max(F.col("low") + F.col("n")).alias("size"))
    rest = rest.filter("size > start").select("path", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int = 50256, kind: str = "<u2", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens of each row of docs: written flat, then found again by the scan.

    Null texts are empty (0 tokens); null and repeated ids give a row each.
    """
    placed = write_flat(docs, tokenizer, end_id, kind, None, id_col)
    counts = scan_flat(placed.select("path"), end_id, kind)
    return placed.join(counts, ["path", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
