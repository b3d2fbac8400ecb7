"""What several operators share: written tables, worker state, word hashes, token ids."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on a local master, where it may be unset (tests), a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="taskmill-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/taskmill/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Rows, about, of a file of a table of narrow rows (some numbers each).
FILE_ROWS = 1 << 18


def written(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    Cuts the lineage so that a lost executor costs no recomputation of what stands before,
    fixes what is not deterministic, and lets Spark know the table's size: a small one is
    then broadcast below spark.sql.autoBroadcastJoinThreshold and joined by shuffle beyond.
    rows: the most that df can have; then its last stage has a task and a file for `each` of them, though
    one a core at least and no more than without, as a file costs more than its first thousands of rows.
    """
    path = new_path(df.sparkSession, name)
    few(df, rows, each).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def few(df: DataFrame, rows: int | None, each: int = FILE_ROWS) -> DataFrame:
    """df, of that many rows at most, in a partition for `each` of them, one a core at least; see written()."""
    return df if rows is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by written(), once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Partitions, at most, that rows with a task's work each are dealt to.
MOST_TASKS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """df, whose rows each stand for much work (a block, a file), a row to each partition up to
    MOST_TASKS partitions, and evenly beyond."""
    return df.repartition(max(1, min(MOST_TASKS, df.count())))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_taskmill_worker", types.ModuleType("_taskmill_worker"))
    return holder.__dict__.setdefault("state", {})


# ---------------------------------------------------------------- bytes of a text column


def string_parts(column: pa.Array, limit: int = 1 << 21):
    """Yield (first row, data, offsets) of runs of rows with about `limit` bytes each.

    data is the run's UTF-8 as a uint8 array, offsets has one entry more than rows.
    """
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + 60_000, n)
        yield lo, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _table(chars, value=True, kind=bool, base=None):
    t = np.zeros(256, kind) if base is None else base.copy()
    t[list(chars)] = value
    return t


#: Bytes of words: digits, letters and whatever is not ASCII.
WORD_BYTES = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bytes of words between white space.
VISIBLE_BYTES = ~_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    state = worker_state()
    have = state.get("powers")
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n).bit_length())
        have = np.full(size, 0x5851F42D4C957F2D, np.uint64)
        have[0] = 1
        have = state["powers"] = np.multiply.accumulate(have)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place of a hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offs: np.ndarray, member=WORD_BYTES, mapped=LOWER, collapse: bool = False):
    """(hash, row) of every maximal run of member bytes; runs end where a row ends.

    mapped replaces each byte first; collapse counts equal neighbours once.
    """
    inside = member[data]
    pos = np.flatnonzero(inside)
    if not len(pos):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offs[:-1][offs[:-1] < len(data)]
    first[rows] = inside[rows]
    byte = mapped[data[pos]]
    begins = first[pos]
    where = pos[begins]
    if collapse:
        keep = begins.copy()
        keep[1:] |= byte[1:] != byte[:-1]
        keep[0] = True
        byte, begins = byte[keep], begins[keep]
    at = np.flatnonzero(begins)
    sizes = np.diff(np.append(at, len(byte)))
    inner = np.arange(len(byte)) - np.repeat(at, sizes)
    value = powers(int(sizes.max()) + 1)[inner]
    value *= byte.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value, at)), np.searchsorted(offs, where, side="right") - 1


def shingles(hashes: np.ndarray, row: np.ndarray, k: int):
    """(hash, row) of every k words in a row; a row of fewer words has one shingle of all."""
    n = len(hashes) - k + 1
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        whole = row[:n] == row[k - 1 :]
        x = np.zeros(n, np.uint64)
        for j in range(k):
            x = x * _MULTIPLIER + hashes[j : j + n]
        out, at = mix(x)[whole], row[:n][whole]
    if len(row):
        ids, first, count = np.unique(row, return_index=True, return_counts=True)
        few = np.flatnonzero(count < k)
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = count[few] > j
                short[has] = short[has] * _MULTIPLIER + hashes[first[few[has]] + j]
            out = np.concatenate([out, mix(short + np.uint64(1))])
            at = np.concatenate([at, ids[few]])
    return out, at


# ---------------------------------------------------------------- token ids


#: Classes of bytes for the cuts of Encoder: 0 beyond ASCII, 1 Latin letter, 2 digit, 3 mark, 4 apostrophe,
#: 5 space, 6 other white space, 7 what may be or begin a character that counts as white space,
#: 8 first byte of a Latin letter of two bytes, 9 a later byte of a character.
_KINDS = bytearray(256)
for _c in range(256):
    _KINDS[_c] = 1 if 0x41 <= _c <= 0x5A or 0x61 <= _c <= 0x7A else 2 if 0x30 <= _c <= 0x39 else 4 if _c == 0x27 else 5 if _c == 0x20 else 6 if 0x09 <= _c <= 0x0D else 7 if _c < 0x20 or _c in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) else 3 if _c < 0x7F else 9 if _c < 0xC0 else 8 if 0xC3 <= _c <= 0xC8 else 0
_KINDS = bytes(_KINDS)
_SHOWN = (0, 1, 2, 3, 4, 8)


def _pair(one: int, two: int) -> int:
    """What two neighbouring bytes of these classes allow: 1 a cut before the first, 2 a cut
    between them, 4 a cut between them if there is one before the first."""
    ends = {1: (2, 3, 4, 5, 6), 2: (1, 3, 4, 5, 6), 3: (1, 2, 5, 6), 4: (5, 6)}
    return (one == 5 and two in _SHOWN) | (two in ends.get(one, ())) << 1 | (one == 6 and two in _SHOWN) << 2


_PAIRS = bytes(_pair(c >> 4, c & 15) for c in range(256))

#: Whether a piece is Latin letters alone, maybe behind a space: one part of the pattern.
_one_word = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+").fullmatch


def _byte_signs() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


class Encoder:
    """Token ids of whole texts, by the tokenizers library, with a memory of pieces.

    A byte-level pre-tokenizer parts a text by a pattern that never looks back. So a text can be
    cut, and the pieces encoded on their own, where one of its parts always ends: before a
    space in front of a visible character, behind a run of Latin letters, of digits or of marks,
    and around a single line break. Pieces of many texts are told apart at once, each
    distinct one is encoded once while the memory holds it. Those seen twice are kept apart from the
    many that are not; each of the two starts anew at its share of `most` pieces.
    A piece of letters goes to the library's model at once, as its pattern would leave it whole.
    Texts with names of added tokens, and all texts of other tokenizers, are one piece each.
    None of this changes ids.

    With plain, the names of special tokens in a text are encoded as any other characters;
    without, as the library does by default, each is its one id.
    """

    def __init__(self, path: str, most: int = 250_000, run_bytes: int = 4 << 20, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        self.model.no_truncation()
        self.model.no_padding()
        self.size = self.model.get_vocab_size()
        self.most, self.run_bytes = most, run_bytes
        self.memory: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}  # pieces that have been seen once, for a while
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values() if not (plain and t.special)]
        form = json.loads(self.model.to_str())
        pre, line = form["pre_tokenizer"] or {}, self.model.encode("\n", add_special_tokens=False).ids
        self.cuts = form["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(line) == 1
        self.line = line[0] if line else -1

    def _cut(self, data: np.ndarray, offs: np.ndarray, whole: list[int]) -> np.ndarray:
        """Places where pieces begin; each row that isn't empty begins one."""
        n = len(data)
        mask = np.zeros(n + 1, bool)
        if self.cuts and n > 1:
            raw = data.tobytes()
            kind = np.frombuffer(raw.translate(_KINDS), np.uint8).copy()
            kind[1:] -= (kind[:-1] == 8).view(np.uint8) << 3  # the second byte of a Latin letter: 9 to 1
            for sign in (b"\xc3\x97", b"\xc3\xb7"):  # two signs among them that are no letters
                at = raw.find(sign)
                while at >= 0:
                    kind[at + 1] = 9
                    at = raw.find(sign, at + 2)
            pair = np.frombuffer(((kind[:-1] << 4) | kind[1:]).tobytes().translate(_PAIRS), np.uint8)
            before = (pair & 1).view(bool)
            before[(offs[1:] - 1)[(offs[1:] > 0) & (offs[1:] < n)]] = False  # the next byte is another text's
            mask[1:n] = (pair & 2).view(bool)
            mask[1:n] |= np.append(False, mask[1 : n - 1] & (pair[1:] & 4).view(bool))
            mask[: n - 1] |= before
            for row in whole:
                mask[offs[row] : offs[row + 1]] = False
        mask[offs] = True
        return np.flatnonzero(mask[:n])

    def _holds_added(self, raw: bytes) -> bool:
        return any(x in raw for x in self.added)

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        """Rows that hold the name of an added token."""
        raw, rows = data.tobytes(), set()
        for name in self.added:
            at = raw.find(name)
            while at >= 0:
                rows.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(name, at + len(name))
        return sorted(rows)

    def _learn(self, new: list[bytes], odd_names: bool) -> dict[bytes, bytes]:
        """Ids of pieces. Those without white space, but for a space ahead, are encoded many in one
        text with line breaks between them, each of which is a part of its own."""
        found: dict[bytes, bytes] = {}
        if self.cuts:
            words = [p for p in new if _one_word(p) and not (odd_names and self._holds_added(p))]
            if words:
                signs, tokenize = b"\n".join(words).decode("latin-1").translate(_BYTE_SIGNS), self.model.model.tokenize
                flat, ends = [], [0]
                for word in signs.split(chr(_BYTE_SIGNS[0x0A])):
                    flat.extend([t.id for t in tokenize(word)])
                    ends.append(4 * len(flat))
                raw = np.array(flat, "<u4").tobytes()
                found = {p: raw[a:b] for p, a, b in zip(words, ends, ends[1:], strict=False)}
        fit, odd = [], []
        for p in new:
            if p in found:
                continue
            s = p.decode("utf-8", "replace")
            bare = s[1:] if s[0] == " " else s
            (fit if self.cuts and bare.split() == [bare] and not (odd_names and self._holds_added(p)) else odd).append((p, s))
        for lo in range(0, len(fit), 4000):
            runs = [fit[i : i + 500] for i in range(lo, min(lo + 4000, len(fit)), 500)]
            for run, e in zip(runs, self.model.encode_batch_fast(["\n".join([s for _, s in r]) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(ids == self.line)
                if len(at) != len(run) - 1:
                    odd += run
                    continue
                raw = ids.tobytes()
                for (p, _), a, b in zip(run, [0, *(at * 4 + 4).tolist()], [*(at * 4).tolist(), len(raw)], strict=True):
                    found[p] = raw[a:b]
        for lo in range(0, len(odd), 500):
            part = odd[lo : lo + 500]
            for (p, _), e in zip(part, self.model.encode_batch_fast([s for _, s in part], add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, "<u4").tobytes()
        return found

    def _run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = self._whole(data, offs) if self.added else []
        begins = self._cut(data, offs, whole)
        if not len(begins):
            return np.zeros(0, "<u4"), np.zeros(len(offs) - 1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]).dictionary_encode()
        at, edges = pieces.indices.to_numpy(), np.frombuffer(pieces.dictionary.buffers()[1], np.int64)[: len(pieces.dictionary) + 1].tolist()
        raw = pieces.dictionary.buffers()[2].to_pybytes()
        distinct = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if len(self.memory) > self.most * 4 // 5:
            self.memory = {}
        if len(self.once) > self.most * 2 // 5:
            self.once = {}
        ids = list(map(self.memory.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        if self.once:
            for i in new:
                ids[i] = x = self.once.pop(distinct[i], None)
                if x is not None:
                    self.memory[distinct[i]] = x
            new = [i for i in new if ids[i] is None]
        found = self._learn([distinct[i] for i in new], bool(whole))
        counts = np.bincount(at, minlength=len(distinct))
        for i in new:
            p = distinct[i]
            ids[i] = found[p]
            if len(p) <= 64:
                (self.memory if counts[i] > 1 else self.once)[p] = ids[i]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        each = size[at]
        ends = np.cumsum(each)
        place = np.repeat(start[at] - (ends - each), each)
        place += np.arange(ends[-1])
        out = flat[place]
        upto = np.append(0, ends)[np.searchsorted(begins, offs)]
        return out, np.diff(upto)

    def runs(self, texts: pa.Array):
        """Yield (first row, ids of the rows one after the other, their numbers) of runs of rows."""
        for lo, data, offs in string_parts(texts, self.run_bytes):
            yield lo, *self._run(data, offs)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """ids with end_id behind each row's."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = ids
    return out


def encoder(path: str, plain: bool = True) -> Encoder:
    state = worker_state()
    if ("encoder", path, plain) not in state:
        state["encoder", path, plain] = Encoder(path, 400_000, 3 << 20, plain)
    return state["encoder", path, plain]


def open_fs(path: str):
    """(file system, path in it) of a URI, by pyarrow; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
