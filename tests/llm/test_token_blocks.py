"""Blocks of a token file are read on their own."""

import io
import zlib

import numpy as np
import pytest

from taskmill.llm import token_codec


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def token_file(sizes, seed=5):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, sum(sizes)) % 50_000).astype("<u4")
    out = io.BytesIO()
    token_codec.write_file(out, [([None, *range(1, len(sizes))], ids, sizes)])
    return ids, out.getvalue()


def test_checksums_of_parts_are_joined():
    data = np.random.default_rng(2).bytes(300_001)
    for cut in (0, 1, 65_536, 299_999, 300_001):
        assert token_codec.joined_crc(zlib.crc32(data[:cut]), zlib.crc32(data[cut:]), len(data) - cut) == zlib.crc32(data)


def test_each_block_alone():
    block = token_codec.BLOCK_IDS
    sizes = [7, 0, block - 7, 0, 5, 2 * block, 3, 0]
    ids, raw = token_file(sizes)
    starts = np.cumsum([0, *sizes])
    got = {}
    for b in reversed(range(4)):
        for number, name, start, size, here, crc in token_codec.read_block(Source(raw), b):
            got.setdefault(number, []).insert(0, (name, start, size, here, crc))
    assert sorted(got) == list(range(len(sizes)))
    for number, parts in got.items():
        value = parts[0][4]
        for p in parts[1:]:
            value = token_codec.joined_crc(value, p[4], 4 * p[3])
        assert parts[0][:3] == (number or None, starts[number], sizes[number]) and sum(p[3] for p in parts) == sizes[number]
        assert value == zlib.crc32(ids[starts[number] : starts[number + 1]].tobytes())
    assert [len(got[n]) for n in (0, 1, 2, 5)] == [1, 1, 1, 3]
    no_ids = token_file([0, 0])[1]
    assert [x[:5] for x in token_codec.read_block(Source(no_ids), 0)] == [(0, None, 0, 0, 0), (1, 1, 0, 0, 0)]
    with pytest.raises(ValueError):
        list(token_codec.read_block(Source(raw[:200] + b"x" + raw[201:]), 0))


def test_documents_over_several_blocks(spark, tmp_path):
    """One file of documents that blocks part gives the rows that the ids have."""
    sizes = [10, token_codec.BLOCK_IDS + 50, 1, token_codec.BLOCK_IDS * 2, 4]
    ids, raw = token_file(sizes)
    (tmp_path / "one.mix").write_bytes(raw)
    manifest = spark.createDataFrame([(0, str(tmp_path / "one.mix"), 100, sum(sizes))], "part long, path string, before long, n_ids long")
    starts = np.cumsum([0, *sizes]).tolist()
    want = {(n or None, 100 + starts[n], sizes[n], zlib.crc32(ids[starts[n] : starts[n + 1]].tobytes())) for n in range(len(sizes))}
    got = token_codec.read_tokens(manifest).collect()
    assert len(got) == len(sizes) and {tuple(r) for r in got} == want
