"""Token-id files: an adaptive context-mixing range coder in independent, checksummed blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taskmill.llm.common import dealt, encoder, new_path, open_fs, text_of, with_end, written

BLOCK_IDS, LANE_IDS, MOST_LANES = 1 << 20, 256, 4096
#: Ids must be below this, so that order 0 can give a share to each and predictions keep theirs.
MOST_VOCABULARY = 1 << 22
#: Least bits of the shares of ids in order 0; the shares of the three predictions have the rest of 32.
_ID_BITS = 20
_HASH_BITS = 18
#: Steps that each renew order 0; later ones do so once half as many more are over.
_EAGER = 8
_WORD, _HALF = np.uint64(32), np.uint64(0xFFFFFFFF)
#: Forms of the head of a block and of the end of a file.
_BLOCK, _TAIL = "<4sIIIIII", "<QII8s"
_HEAD_BYTES, _TAIL_BYTES = struct.calcsize(_BLOCK), struct.calcsize(_TAIL)


def _trust_steps() -> tuple[np.ndarray, ...]:
    """For each slot (trusts of orders 2 and 1, whether they agree, which was right): whether
    an entry stays, and by how much it changes, of order 2 and of order 1."""
    slot = np.arange(128)
    kind, same, one, two = slot & 3, slot >> 2 & 1, slot >> 3 & 3, slot >> 5
    out = []
    for trust, hit in ((two, kind == 0), (one, (kind == 1) | (kind == 0) & (same == 1))):
        out += [hit | (trust > 1), np.where(hit, trust < 3, -1).astype(np.int32)]
    return tuple(out)


_STAYS_TWO, _STEP_TWO, _STAYS_ONE, _STEP_ONE = _trust_steps()


class Mixture:
    """Predictions of orders 0 to 2, the same for the coder and the decoder.

    Orders 1 and 2 each name one id, the one that last proved right after the last one or two
    ids, with a trust from 0 to 3; a table holds 4 x id + trust. For each pair of trusts the
    mixture learns how often either is right; what is left goes to order 0, the counts of the
    ids that neither foretold. All lanes of a block code one id per step and share the model.

    A slot is 4 x context + kind: kind 0 is order 2's id, 1 order 1's, 2 any other. It has a
    start and a size in shares, and so has each id in order 0; the id behind the last
    stands for all of them, where a guess is right.
    """

    def __init__(self, vocabulary: int, lanes: int, inverse: bool = False):
        self.v = vocabulary
        self.id_bits = max(_ID_BITS, vocabulary.bit_length() + 1)
        self.mix_bits = 32 - self.id_bits
        self.count = np.ones(vocabulary, np.int64)
        self.one, self.two = np.zeros(vocabulary + 1, np.int32), np.zeros(1 << _HASH_BITS, np.int32)
        self.weights = np.tile(np.array([2, 1, 4, 0], np.int64), 32)
        self.p1, self.p2 = np.full(lanes, vocabulary, np.intp), np.full(lanes, vocabulary, np.intp)
        self.low, self.width = np.zeros(vocabulary + 1, np.uint64), np.full(vocabulary + 1, 1 << self.id_bits, np.uint64)
        self.start, self.size = np.zeros(128, np.uint64), np.zeros(128, np.uint64)
        self.missed, self.step, self.renew = [], 0, 0
        self.inverse = np.zeros(0, np.int32) if inverse else None
        self._order_zero()
        self._mix()

    def _order_zero(self) -> None:
        """Shares of ids in order 0, at least 1 each, with the sum 2^id_bits."""
        if self.missed:
            self.count += np.bincount(np.concatenate(self.missed), minlength=self.v + 1)[: self.v] * 16
            self.missed = []
        free = (1 << self.id_bits) - self.v
        share = self.count * free // int(self.count.sum()) + 1
        share[-1] += (1 << self.id_bits) - share.sum()
        self.width[:-1] = share
        np.cumsum(share[:-1], out=self.low[1:-1].view(np.int64))
        if self.inverse is not None:
            self.inverse = np.repeat(np.arange(self.v, dtype=np.uint16 if self.v <= 1 << 16 else np.int32), share)

    def _mix(self) -> None:
        """Shares of the kinds in each context, at least 1 each, with the sum 2^mix_bits."""
        w = self.weights.reshape(32, 4)
        share = w[:, :2] * ((1 << self.mix_bits) - 3) // w.sum(1, keepdims=True) + 1
        start, size = self.start.reshape(32, 4), self.size.reshape(32, 4)
        size[:, :2] = share
        start[:, 1], start[:, 2] = share[:, 0], share[:, 0] + share[:, 1]
        size[:, 2] = (1 << self.mix_bits) - share[:, 0] - share[:, 1]
        start <<= np.uint64(self.id_bits)

    def predict(self, k: int) -> np.ndarray:
        """The first slot of each lane's context; guesses in self.a and self.b.

        What numpy takes for places (h, p1, slots, y) is kept as intp; it would convert other
        integers at each use.
        """
        p1 = self.p1[:k]
        self.h = (p1 * 0x9E3779B1 + self.p2[:k] * 0x297A2D39) >> (32 - _HASH_BITS) & (1 << _HASH_BITS) - 1
        self.at_two, self.at_one = self.two[self.h], self.one[p1]
        self.a, self.b = self.at_two >> 2, self.at_one >> 2
        context = ((self.at_two & 3) << 5) + ((self.at_one & 3) << 3)
        context += (self.a == self.b).view(np.uint8) << 2
        return context.astype(np.intp)

    def learn(self, x: np.ndarray, y: np.ndarray, slot: np.ndarray) -> None:
        """x: the ids; y: the same in order 0, the id behind the last where a guess was right."""
        self.weights += np.bincount(slot, minlength=128) * 2
        self.missed.append(y)
        self.step += 1
        if self.step <= _EAGER or self.step >= self.renew:
            self.renew = self.step + self.step // 2
            self._order_zero()
        if self.step <= 4 * _EAGER or self.step % 4 == 0:
            w = self.weights.reshape(32, 4)
            full = w.sum(1) > 1 << 15
            w[full] = (w[full] >> 1) | np.array([1, 1, 1, 0])
            self._mix()
        k = len(x)
        p1, fresh = self.p1[:k], (x << 2) + 1
        self.two[self.h] = np.where(_STAYS_TWO[slot], self.at_two + _STEP_TWO[slot], fresh)
        self.one[p1] = np.where(_STAYS_ONE[slot], self.at_one + _STEP_ONE[slot], fresh)
        self.p2[:k] = p1
        self.p1[:k] = x


def _settle(low, rng):
    """Lanes whose ranges fell below 2^32, and their settled words; the ranges are widened.

    A range that would carry into the settled word is cut there, so low + rng stays in 64 bits.
    """
    at = np.flatnonzero(rng <= _HALF)
    lo, rg = low[at], rng[at]
    rng[at] = np.minimum(rg, (_HALF - (lo & _HALF)) + np.uint64(1)) << _WORD
    low[at] = lo << _WORD
    return at, lo >> _WORD


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(MOST_LANES, -(-n // LANE_IDS)))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def encode_block(ids: np.ndarray) -> bytes:
    """A block of up to BLOCK_IDS ids; readable without any other block."""
    n = len(ids)
    vocabulary = int(ids.max()) + 1
    if vocabulary > MOST_VOCABULARY:
        raise ValueError(f"ids must be below {MOST_VOCABULARY}")
    if n > BLOCK_IDS:
        raise ValueError(f"a block holds at most {BLOCK_IDS} ids")
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    model = Mixture(vocabulary, lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF))
    width = steps + 1
    words = np.zeros(lanes * width, "<u4")
    begin = np.arange(lanes) * width
    place = begin.copy()
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        x = grid[t, :k]
        context = model.predict(k)
        kind = (x != model.a).view(np.uint8) * ((x != model.b).view(np.uint8) + np.uint8(1))
        slot = context + kind
        y = np.where(kind == 2, x, np.int32(vocabulary)).astype(np.intp)
        size = model.size[slot]
        lo, rg = low[:k], rng[:k]
        r = rg >> _WORD
        lo += r * (model.start[slot] + size * model.low[y])
        np.multiply(r, size * model.width[y], out=rg)
        at, word = _settle(lo, rg)
        words[place[at]] = word
        place[at] += 1
        model.learn(x, y, slot)
    # The first word in the range that needs no more bits; those behind it are read as 0.
    words[place] = (low + _HALF) >> _WORD
    used = place + 1 - begin
    body = used.astype("<u2").tobytes() + words.reshape(lanes, width)[np.arange(width)[None, :] < used[:, None]].tobytes()
    return struct.pack(_BLOCK, b"MIXC", n, lanes, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), len(body), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if its checksum or form is wrong."""
    if len(block) < _HEAD_BYTES:
        raise ValueError("a token block is cut off")
    magic, n, lanes, vocabulary, crc, size, whole = struct.unpack_from(_BLOCK, block)
    if magic != b"MIXC" or len(block) < _HEAD_BYTES + size or not n or lanes != _lanes(n)[0] or zlib.crc32(block[_HEAD_BYTES : _HEAD_BYTES + size]) != whole:
        raise ValueError("not a whole token block")
    steps = _lanes(n)[1]
    used = np.frombuffer(block, "<u2", lanes, _HEAD_BYTES).astype(np.int64)
    words = np.append(np.frombuffer(block, "<u4", (size - 2 * lanes) // 4, _HEAD_BYTES + 2 * lanes), np.zeros(1, "<u4")).astype(np.uint64)
    end = np.cumsum(used)
    place = end - used
    last = n - (lanes - 1) * steps
    model = Mixture(vocabulary, lanes, inverse=True)
    most = np.uint64((1 << model.id_bits) - 1)
    low, rng, code = np.zeros(lanes, np.uint64), np.full(lanes, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(lanes, np.uint64)
    nothing, start_one, start_two = len(words) - 1, model.start[1:], model.start[2:]

    def following(at):
        p = place[at]
        place[at] = p + 1
        return words[np.where(p < end[at], p, nothing)]

    everyone = np.arange(lanes)
    for _ in range(2):
        code = (code << _WORD) | following(everyone)
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        context = model.predict(k)
        lo, rg, cd = low[:k], rng[:k], code[:k]
        r = rg >> _WORD
        v = np.minimum((cd - lo) // r, _HALF)
        kind = (v >= start_one[context]).view(np.uint8) + (v >= start_two[context]).view(np.uint8)
        slot = context + kind
        size, start = model.size[slot], model.start[slot]
        other = kind == 2
        rest = model.inverse[np.minimum((v - start) // size, most).view(np.intp)].astype(np.int32)
        x = np.where(other, rest, np.where(kind == 1, model.b, model.a))
        y = np.where(other, rest, np.int32(vocabulary)).astype(np.intp)
        lo += r * (start + size * model.low[y])
        np.multiply(r, size * model.width[y], out=rg)
        at, _ = _settle(lo, rg)
        cd[at] = (cd[at] << _WORD) | following(at)
        model.learn(x, y, slot)
        grid[t, :k] = x
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the checksum of a token block is wrong")
    return ids


def write_file(out, runs) -> tuple[int, int]:
    """Write runs of documents (their ids or None, all token ids one after the other, how many
    each document has); number of documents and ids.

    A file is blocks, then the table of documents (ids and sizes) and of blocks, packed and
    checksummed, then where that table begins.
    """
    held, have, places, at = [], 0, [], 0
    names, known, sizes = [], [], []

    def flush(final: bool):
        nonlocal held, have, at
        ids, lo = np.concatenate(held) if held else np.zeros(0, "<u4"), 0
        while len(ids) - lo >= BLOCK_IDS or final and lo < len(ids):
            block = encode_block(ids[lo : lo + BLOCK_IDS])
            out.write(block)
            places.append(at)
            at += len(block)
            lo += BLOCK_IDS
        held, have = [ids[lo:]], max(0, len(ids) - lo)

    for ids_of, tokens, counts in runs:
        names.append(np.array([0 if x is None else x for x in ids_of], "<i8"))
        known.append(np.array([x is not None for x in ids_of], "<i8"))
        sizes.append(np.asarray(counts, "<i8"))
        held.append(np.asarray(tokens, "<u4"))
        have += len(tokens)
        if have >= BLOCK_IDS:
            flush(False)
    flush(True)
    columns = [np.concatenate(x) if x else np.zeros(0, "<i8") for x in (names, known, sizes)]
    table = zlib.compress(b"".join(x.tobytes() for x in (np.array([len(columns[0]), len(places)], "<i8"), *columns, np.array(places, "<i8"))), 1)
    out.write(table + struct.pack(_TAIL, at, len(table), zlib.crc32(table), b"MIXFILE1"))
    return len(columns[0]), int(columns[2].sum())


def _table(source) -> tuple[np.ndarray, ...]:
    """Document ids, whether each is known, numbers of ids, and where blocks begin (and the last ends)."""
    size = source.size()
    source.seek(size - _TAIL_BYTES)
    end, length, crc, magic = struct.unpack(_TAIL, source.read(_TAIL_BYTES))
    source.seek(end)
    packed = source.read(length)
    if magic != b"MIXFILE1" or zlib.crc32(packed) != crc:
        raise ValueError("not a whole token file")
    table = np.frombuffer(zlib.decompress(packed), "<i8")
    n = int(table[0])
    names, known, sizes, places = np.split(table[2:], [n, 2 * n, 3 * n])
    return names, known, sizes, np.append(places[: int(table[1])], end)


def read_block(source, block: int):
    """Yield (number in the file, doc_id or None, start, n_tokens, ids of it here, crc32 of those)
    of the documents that have ids in a block of a seekable file; one without any ids stands in
    the block of its start, or the last. Nothing of other blocks is read but the file's table.
    """
    names, known, sizes, places = _table(source)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total, blocks = int(ends[-1]) if len(ends) else 0, max(1, len(places) - 1)
    lo, hi = block * BLOCK_IDS, min(total, (block + 1) * BLOCK_IDS)
    ids = b""
    if hi > lo:
        source.seek(int(places[block]))
        ids = memoryview(decode_block(source.read(int(places[block + 1] - places[block]))).astype("<u4").tobytes())
    if len(ids) != 4 * (hi - lo):
        raise ValueError("a token block has not the ids that its file's table tells")
    mine = (starts < hi) & (ends > lo) | (sizes == 0) & (np.minimum(starts // BLOCK_IDS, blocks - 1) == block)
    for d in np.flatnonzero(mine).tolist():
        one, two = max(lo, int(starts[d])), min(hi, int(ends[d]))
        yield d, int(names[d]) if known[d] else None, int(starts[d]), int(sizes[d]), max(0, two - one), zlib.crc32(ids[4 * (one - lo) : 4 * (two - lo)] if two > one else b"")


def joined_crc(one: int, two: int, size: int, zeros: bytes = bytes(1 << 16)) -> int:
    """crc32 of two parts one after the other by those of each; size: bytes of the second."""
    none = 0
    for lo in range(0, size, len(zeros)):
        some = zeros[: size - lo]
        one, none = zlib.crc32(some, one), zlib.crc32(some, none)
    return one ^ none ^ two


def _writer(folder: str, tokenizer: str, end_id: int, plain: bool):
    def write(batches):
        import uuid

        from pyspark import TaskContext

        fs = path = out = None
        encode = encoder(tokenizer, plain)

        def documents(first):
            for batch in first:
                for lo, ids, counts in encode.runs(batch.column(1)):
                    yield batch.column(0).slice(lo, len(counts)).to_pylist(), with_end(ids, counts, end_id), counts + 1

        import itertools

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        # A name of its own for each attempt: the manifest holds those of tasks that ended well.
        part = TaskContext.get().partitionId()
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.mix"
        fs, inner = open_fs(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            n, ids = write_file(out, documents(itertools.chain([head], batches)))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n], "n_ids": [ids]})

    return write


_DOCUMENT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_PIECE = f"{_DOCUMENT}, part bigint, number bigint, block bigint, here bigint"


def _read(batches):
    names = [x.split()[0] for x in _PIECE.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            fs, inner = open_fs(row["path"])
            with fs.open_input_file(inner) as source:
                got = [(name, row["before"] + start, size, crc, row["part"], number, row["block"], here) for number, name, start, size, here, crc in read_block(source, row["block"])]
            for lo in range(0, len(got), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got[lo : lo + 10_000], strict=True)], names)


def _stitch(table):
    """The row of a document whose ids stand in several blocks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    value = rows[0]["ids_crc32"]
    for r in rows[1:]:
        value = joined_crc(value, r["ids_crc32"], 4 * r["here"])
    if sum(r["here"] for r in rows) != rows[0]["n_tokens"]:
        raise ValueError("a document lacks ids of a block")
    return pa.table({c: pa.array([value if c == "ids_crc32" else rows[0][c]], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")})


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", plain: bool = True) -> DataFrame:
    """Encode whole texts and write their ids in ascending order of doc_id; the manifest.

    Each range partition becomes one file under folder (default: a new one in the shared
    folder). Manifest: part (the file's place in the order), path, n_docs, n_ids, before (ids
    of all files before it). Each document ends with end_id. Null texts are empty texts; null
    ids come first; equal ids are in order of their texts. A lost executor's files are written
    again under other names; only files that the manifest names count. plain: see Encoder.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    files = written(dealt.mapInArrow(_writer(folder, tokenizer, end_id, plain), "part bigint, path string, n_docs bigint, n_ids bigint"), "token-files")
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("before", before)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    Each block of a file is decoded on its own, so that a long file is read by many tasks. The
    checksums of documents that blocks part are joined from narrow rows, one for each block.
    """
    last = F.greatest(F.ceil(F.col("n_ids") / BLOCK_IDS), F.lit(1)) - 1
    blocks = manifest.select("part", "path", "before", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))
    pieces = written(dealt(blocks).mapInArrow(_read, _PIECE), "token-pieces")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = pieces.filter("here = n_tokens").select(*names)
    return whole.unionByName(pieces.filter("here < n_tokens").groupBy("part", "number").applyInArrow(_stitch, _DOCUMENT))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", plain: bool = True) -> DataFrame:
    """write_tokens(), then read_tokens(). Empty input gives no files and no rows."""
    return read_tokens(write_tokens(docs, tokenizer, None, end_id, id_col, plain))
