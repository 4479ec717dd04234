"""Letters that change in lower case."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from taqlspark.llm import pieces


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_letters(name, words):
    made = ["İstanbul", "visit İstanbul, now"]
    made += [t for c in map(chr, range(0xC0, 0x250)) for t in (c, f"a{c}b", f"x {c}{c}A, y")]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(made, add_special_tokens=False)]
    assert pieces.PieceEncoder.of(public_tokenizers.path(name), words).ids(made) == want
