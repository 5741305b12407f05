"""Words that are learned without a pattern: the same ids as the library's, and no pattern run on plain ones."""

import numpy as np
import public_tokenizers
import pytest

from tracewell.llm.tokenizing import BYTE_BPE, WORD_BPE, ChunkEncoder


@pytest.mark.parametrize("which", [WORD_BPE, BYTE_BPE])
def test_plain_words_go_straight_to_the_merges(which, monkeypatch):
    enc = ChunkEncoder(public_tokenizers.path(which[0]), which[1])
    asked = []
    own = enc.is_word
    enc.is_word = lambda chunk: asked.append(chunk) or own(chunk)
    texts = ["the Words anreiheionen.", "Ünder élan naïve ÿ.", "KKelvin ſet ªº µm x", "a1 ª. b", "x" * 70 + " y.", " ", ""]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert asked and not [c for c in asked if c.isascii() and c.strip().isalpha()]
