"""The memo gives what the tokenizer gives, on texts made to be hard."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from chronoply.llm import tokens

HARD = [
    "", " ", "\n", "a", "don't stop, it's 'tis 's", "  two  spaces\n\n\tTab ", "A.B..C,,D ,. ...", "été É, Ünï ß İstanbul ΣΊΣΥΦΟΣ ς", "x² 5½ ٣٤ 10,000.5", "«quoted», “curly”… €5",
    "a\xa0b c 　 d", "é café à,", "한국어 日本語 русский", "word###&&& %%% $$$", "<|endoftext|> <|startoftext|>", "\x1c\x1d x\x85y", "it'll WE'RE i'D ''s", "tab\tnew\r\nline \x0b\x0c end  ",
]


@pytest.mark.parametrize(("path", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_is_the_tokenizer(path, spaces):
    rng = random.Random(3)
    signs = "ab Ab,.!'s#\n\t 5é«ßσΣ½\xa0"
    texts = HARD + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(1500)]
    code = tokens.Coder(public_tokenizers.path(path), spaces, 50)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for t, a, b in zip(texts, code.encode(texts), want, strict=True):
        assert a == b, t
    assert code.encode([None]) == [b""]
