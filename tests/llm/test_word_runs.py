"""Ids by runs between white space: as the library gives them, with few calls of it, and with a small memory."""

import random

import public_tokenizers
import pytest

from patchloom.llm import word_bpe

BPE = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *args, **kwargs):
        self.calls += 1
        return self.tokenizer.encode(*args, **kwargs)


@pytest.mark.parametrize("kept", [1_200_000, 40])
def test_many_texts_take_few_calls(monkeypatch, kept):
    monkeypatch.setattr(word_bpe, "KEPT_WORDS", kept)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgÄéß'0129.,!|<>") for _ in range(rng.randint(1, 7)))
    texts = [rng.choice(" \n\t").join(word() for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [None, "", "don't we'll", "  a,b ", "<|endoftext|>x", "Σίσυφος 中文"]
    ids = word_bpe.WordIds(BPE, 2)
    want = [[*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    ids.tokenizer = Counted(ids.tokenizer)
    got = list(ids.encode_all(texts))
    assert [[a | b << 8 for a, b in zip(x[::2], x[1::2], strict=True)] for x in got] == want
    assert [ids.encode(t) for t in texts[-60:]] == got[-60:]
    if kept > 40:
        assert ids.tokenizer.calls < 20
