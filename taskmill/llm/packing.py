"""Vector bin packing of tokenized examples into sequences of limited tokens, segments and loss."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import Encoder, text_of, with_end, worker_state

CAPACITY, SEGMENTS = 2048, 256
#: Padding that a sequence may keep before an example is cut to fill it, at most 1 in 128 of it.
SLACK = CAPACITY // 128
# Fixed value: the pattern of the pre-tokenizer by which texts are cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Tokens of examples that are packed together.
BLOCK_TOKENS = 1 << 22


#: Classes of bytes for the cuts of SpaceEncoder: 0 none, 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 white.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x27] = 4
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = 5
#: Whether a part always ends between two neighbours: behind a digit, where letters and marks
#: meet (an apostrophe may begin a part of letters), and where white space ends.
_PARTED = np.zeros((8, 8), bool)
_PARTED[1, [2, 3, 4]] = _PARTED[2, 1:5] = _PARTED[3, [1, 2]] = _PARTED[5, :5] = True
_PARTED = _PARTED.ravel()


class SpaceEncoder(Encoder):
    """An Encoder for tokenizers that lower-case, drop white space and never join what it parts.

    Texts are cut where a part of the pre-tokenizer's pattern always ends, and white space is
    left out; capitals without a combining mark are lower-cased first. (What has composed
    forms is a character and the marks behind it, which are never cut from it; only ASCII
    follows a cut inside a word.) Each distinct piece is encoded once while it is known. In a
    text with the name of an added token, in any case, only white space parts pieces.
    """

    def __init__(self, path: str, **more):
        super().__init__(path, plain=False, **more)
        probe = "A b'\u0301\t\u03a3 1.x\n<|endoftext|> \u0301e"
        parts = [i for p in probe.split() for i in self.model.encode(p, add_special_tokens=False).ids]
        self.parted = self.model.encode(probe, add_special_tokens=False).ids == parts and not any(c in x for x in self.added for c in (b" ", b"\t", b"\n", b"\r"))
        # The pattern and the normal form that the finer cuts go by.
        form = json.loads(self.model.to_str())
        pattern = [p.get("pattern", {}).get("Regex") for p in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        normal = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        self.fine = pattern[:1] == [PATTERN] and normal == ["NFC", "Replace", "Lowercase"]

    def _run(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._begins = np.unique(offs[:-1][offs[:-1] < n])
        if self.parted and n > 1:
            kind = _KIND[data]
            white = kind == 5
            first = kind.copy()
            first[1:][(data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)] = 1  # a Latin letter's second byte
            cut = _PARTED[(first[:-1] << 3) | kind[1:]]
            capital = (data[:-1] >= 0x41) & (data[:-1] <= 0x5A) & (data[1:] < 0x80)
            lowered = data.copy()
            lowered[:-1][capital] += 0x20
            for row in range(len(offs) - 1) if not self.fine else self._named(data, offs):
                a, b = offs[row], offs[row + 1]
                cut[a : b - 1] = white[a : b - 1] & ~white[a + 1 : b]
                lowered[a:b] = data[a:b]
            before = np.append(0, np.cumsum(~white))
            mask = np.zeros(before[-1] + 1, bool)
            mask[before[1:-1][cut]] = True
            mask[before[offs]] = True
            data, offs = lowered[~white], before[offs]
            self._begins = np.flatnonzero(mask[:-1])
        return super()._run(data, offs)

    def _cut(self, data: np.ndarray, offs: np.ndarray, whole: list[int]) -> np.ndarray:
        return self._begins

    def _named(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        """Rows that hold the name of an added token in any case."""
        raw, rows = bytes(data).lower(), set()
        for name in self.added:
            at = raw.find(name.lower())
            while at >= 0:
                rows.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(name.lower(), at + len(name))
        return sorted(rows)

    def _whole(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        return []

    def _learn(self, new: list[bytes], odd_names: bool) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            for p, e in zip(part, self.model.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, "<u4").tobytes()
        return found


def space_encoder(path: str) -> SpaceEncoder:
    state = worker_state()
    if ("space", path) not in state:
        state["space", path] = SpaceEncoder(path)
    return state["space", path]


def _fits(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


class Packer:
    """Packs examples, a block at a time, under limits on tokens, segments and loss tokens.

    The dot-product heuristic fills one sequence after the other: of the examples that fit,
    it takes the one whose (tokens, 1, loss) has the largest dot product with what is left of
    the limits, each dimension in units of its limit and weighed by the block's demand for
    it. So a dimension that is scarce, or that the sequence has more of left, counts more.
    Examples of equal tokens and loss are one kind, so that a choice looks at kinds only.

    Where no example fits and more than `slack` tokens are left, one is cut to fill them (only
    with `cut`; longer examples than a sequence are cut at any rate). A sequence that is still
    short gives tokens back until it has a power of two, which needs no padding.
    """

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True, slack: int = SLACK):
        self.limits = np.array([capacity, segments, capacity if loss is None else loss], float)
        if self.limits.min() < 1:
            raise ValueError("limits must be positive")
        self.capacity, self.segments, self.loss, self.cut, self.slack = capacity, segments, int(self.limits[2]), cut, slack

    def _most(self, prefix: np.ndarray | None, start: int, end: int, tokens: int, loss: int) -> int:
        """How many ids from start on have at most so many tokens and loss tokens."""
        most = min(end - start, tokens)
        if prefix is None:
            return min(most, loss)
        return min(most, int(np.searchsorted(prefix, prefix[start] + loss, side="right")) - 1 - start)

    def pack(self, sizes: list[int], prefixes: list[np.ndarray | None]):
        """Yield sequences, lists of (example, start, end). prefixes: of each example the
        numbers of loss tokens before each id and in all; None where every id bears loss."""
        left: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

        def weigh(i: int, a: int, b: int) -> int:
            return b - a if prefixes[i] is None else int(prefixes[i][b] - prefixes[i][a])

        rest = []
        for i, n in enumerate(sizes):
            at = 0
            while n - at > self.capacity or weigh(i, at, n) > self.loss:
                step = self._most(prefixes[i], at, n, self.capacity, self.loss)
                if step == self.capacity or self._padding(step) <= self.slack:
                    yield [(i, at, at + step)]
                else:
                    rest.append((i, at, at + step))
                at += step
            if n > at:
                rest.append((i, at, n))
        for piece in rest:
            left.setdefault((piece[2] - piece[1], weigh(*piece)), []).append(piece)
        if not left:
            return
        kinds = np.array(sorted(left), np.int64)
        waiting = np.array([len(left[tuple(k)]) for k in kinds.tolist()])
        need = np.column_stack([kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]])
        share = need / self.limits
        demand = (share * waiting[:, None]).sum(axis=0)
        weight = share * (demand / demand.sum())
        place = {tuple(k): j for j, k in enumerate(kinds.tolist())}
        open_kinds = int(waiting.sum())
        odd: list[tuple[int, int, int]] = []  # what is left of examples that were cut, of no kind yet

        while open_kinds or odd:
            room = np.array([self.capacity, self.segments, self.loss], np.int64)
            bin_: list[tuple[int, int, int]] = []
            while room[1] > 0 and room[0] > 0:
                # What cuts have left goes first, so that it doesn't pile up.
                piece = next((p for p in odd if p[2] - p[1] <= room[0] and weigh(*p) <= room[2]), None)
                if piece is not None:
                    odd.remove(piece)
                else:
                    fit = (waiting > 0) & (need <= room).all(axis=1)
                    if not fit.any():
                        break
                    value = np.where(fit, weight @ (room / self.limits), -1.0)
                    j = len(value) - 1 - int(np.argmax(value[::-1]))  # ties: the longer
                    piece = left[tuple(kinds[j].tolist())].pop()
                    waiting[j] -= 1
                    open_kinds -= 1
                bin_.append(piece)
                room -= (piece[2] - piece[1], 1, weigh(*piece))
            if self.cut and room[0] > self.slack and room[1] > 0 and room[2] > 0 and (odd or open_kinds):
                # Nothing fits: the longest that waits fills the rest.
                if odd:
                    piece = odd.pop()
                else:
                    j = int(np.flatnonzero(waiting > 0)[-1])
                    piece = left[tuple(kinds[j].tolist())].pop()
                    waiting[j] -= 1
                    open_kinds -= 1
                i, a, b = piece
                step = self._most(prefixes[i], a, b, int(room[0]), int(room[2]))
                if step:
                    bin_.append((i, a, a + step))
                    room -= (step, 1, weigh(i, a, a + step))
                    a += step
                if a < b:
                    odd.append((i, a, b))
            used = self.capacity - int(room[0])
            if self.cut and self._padding(used) > self.slack:
                for piece in self._shorten(bin_, _fits(used)):
                    key = piece[2] - piece[1], weigh(*piece)
                    if key in place:
                        left[key].append(piece)
                        waiting[place[key]] += 1
                        open_kinds += 1
                    else:
                        odd.append(piece)
            yield bin_

    def _padding(self, used: int) -> int:
        return 0 if used == _fits(used) else self.capacity - used

    @staticmethod
    def _shorten(pieces: list[tuple[int, int, int]], tokens: int) -> list[tuple[int, int, int]]:
        """Take pieces off the end until `tokens` are left; what is taken off."""
        have, off = sum(b - a for _, a, b in pieces), []
        while have > tokens:
            i, a, b = pieces.pop()
            keep = max(0, tokens - (have - (b - a)))
            if keep:
                pieces.append((i, a, a + keep))
            off.append((i, a + keep, b))
            have -= b - a - keep
        return off


_SCHEMA = "id bigint, start bigint, length bigint, ids binary, example_tokens bigint, sequence_id bigint, offset bigint"


def _emit(packer: Packer, names: list, ids: list[np.ndarray], prefixes: list, part: int, number: int):
    """Yield batches of a block's pieces; returns the next sequence number."""
    rows: list[tuple] = []
    held = 0
    for sequence in packer.pack([len(x) for x in ids], prefixes):
        offset = 0
        for i, a, b in sequence:
            rows.append((names[i], a, b - a, ids[i][a:b].tobytes(), len(ids[i]), (part << 32) + number, offset))
            offset += b - a
            held += b - a
        number += 1
        if held >= BLOCK_TOKENS // 4:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)
    return number


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "start", "length", "ids", "example_tokens", "sequence_id", "offset"])


def _in_blocks(examples, packer: Packer, block: int):
    """Pieces of examples (name, ids, loss prefix or None), a block of about `block` ids at once."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    names, ids, prefixes, held = [], [], [], 0
    for name, x, prefix in examples:
        if not len(x):
            continue
        names.append(name)
        ids.append(x)
        prefixes.append(prefix)
        held += len(x)
        if held >= block:
            number = yield from _emit(packer, names, ids, prefixes, part, number)
            names, ids, prefixes, held = [], [], [], 0
    if names:
        yield from _emit(packer, names, ids, prefixes, part, number)


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", packer: Packer | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """Encode whole texts, end each with end_id, and pack them: a row for each piece.

    id, start and length in its example, ids (little-endian unsigned 32-bit), example_tokens,
    sequence_id and offset in the sequence. A null text is empty, so its one id is end_id; a
    row without an id is packed too, repeated rows are each packed, other columns are left
    out. An empty table gives no rows. Every id bears loss. Each task packs its own rows in
    blocks, so nothing is shuffled and no task holds more than a block, or its longest text;
    sequences do not span tasks, and end at a power of two where a block runs out.
    """
    packer = packer or Packer()

    def run(batches):
        def examples():
            encode = space_encoder(tokenizer)
            for batch in batches:
                names = batch.column(0)
                for lo, ids, counts in encode.runs(batch.column(1)):
                    flat = with_end(ids, counts, end_id)
                    ends = np.cumsum(counts + 1).tolist()
                    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        yield names[lo + k].as_py(), flat[a:b], None

        yield from _in_blocks(examples(), packer, block)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs).alias("text")).mapInArrow(run, _SCHEMA)


def pack_examples(examples: DataFrame, packer: Packer, id_col: str = "id", ids_col: str = "ids", loss_col: str = "loss", block: int = BLOCK_TOKENS) -> DataFrame:
    """As pack_texts(), of examples that are encoded: arrays of ids and of flags, equally long,
    that tell which ids bear loss (instruction data: those of answers). Null flags are
    false, a null array of flags stands for all true, null ids for no ids (no piece)."""

    def run(batches):
        def rows():
            for batch in batches:
                for name, ids, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    x = np.array(ids or [], "<u4")
                    if loss is not None and len(loss) != len(x):
                        raise ValueError("an example's flags must be as many as its ids")
                    yield name, x, None if loss is None else np.append(0, np.cumsum([bool(v) for v in loss], dtype=np.int64))

        yield from _in_blocks(rows(), packer, block)

    return examples.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"), F.col(loss_col).cast("array<boolean>").alias("loss")).mapInArrow(run, _SCHEMA)


def pack_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pack_texts() of documents, with a checksum in place of the ids."""
    out = pack_texts(docs, tokenizer)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")
