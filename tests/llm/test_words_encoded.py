"""Pieces of letters are encoded by the library's model at once."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from taskmill.llm import common, queries


class Watched:
    """A tokenizer that notes the texts that pass its pre-tokenizer."""

    def __init__(self, model):
        self.inner, self.seen = model, []

    def encode_batch_fast(self, texts, **more):
        self.seen += texts
        return self.inner.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def encoded(encoder, texts):
    out = []
    for _, ids, counts in encoder.runs(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("plain", [True, False])
def test_words_pass_no_pattern(plain):
    model = Tokenizer.from_file(queries.tokenizer_path())
    model.encode_special_tokens = plain
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x240)) if c not in (0xD7, 0xF7)]
    rng = np.random.default_rng(4)
    words = letters + ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(2000)]
    texts = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    mine = common.Encoder(queries.tokenizer_path(), plain=plain)
    mine.model = Watched(mine.model)
    assert encoded(mine, texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert mine.model.seen == []
    odd = ["a×b c÷d", "x<|endoftext|>y z", "endoftext", "it's 4 o'clock\nnow"]
    assert encoded(mine, odd) == [e.ids for e in model.encode_batch(odd, add_special_tokens=False)]


def test_added_names_of_letters_keep_their_ids(tmp_path):
    """A name of an added token that is letters alone, inside and as a whole text."""
    model = Tokenizer.from_file(queries.tokenizer_path())
    model.add_tokens(["stopword"])
    path = str(tmp_path / "more.json")
    model.save(path)
    texts = ["stopword", "a stopwords b", "stop word", " stopword"]
    assert encoded(common.Encoder(path, plain=False), texts) == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
