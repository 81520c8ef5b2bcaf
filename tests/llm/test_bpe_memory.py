"""What a worker's encoder keeps is bounded, and what comes often is not forgotten at the bound."""

import numpy as np
import pyarrow as pa

from corvane.llm import bpe
from corvane.llm.queries import tokenizer_path


def _letters(i: int) -> str:
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_words_of_two_turns_are_kept(monkeypatch):
    monkeypatch.setattr(bpe, "TIGHT_WORDS", 50)
    encoder, asked = bpe.TextEncoder(tokenizer_path(), tight=True), []
    encode = bpe._Pieces.encode_word
    monkeypatch.setattr(bpe._Pieces, "encode_word", lambda self, word: asked.append(word) or encode(self, word))
    for turn in range(40):
        text = "at common " + " ".join(_letters(20 * turn + i) for i in range(20))
        for _, ids in encoder.encode_batch(pa.array([text])):
            assert np.array_equal(ids, np.frombuffer(encoder.whole(text), "<u4"))
        assert sum(len(x) for x in (encoder.words, encoder.words.old, encoder.pieces, encoder.pieces.old)) <= 2 * (50 + 25)
    assert asked.count("common") == 1 and encoder.words.old  # forty turns would forget it twenty times


def test_slices_bound_what_is_encoded_together():
    texts = pa.array(["word " * 100_000] * 20)  # 10 MB
    encoder = bpe.TextEncoder(tokenizer_path(), tight=True)
    parts = [len(sizes) for sizes, _ in encoder.encode_batch(texts)]
    assert sum(parts) == 20 and max(parts) * 500_000 <= 3 << 20
