"""Token ids of the word-level BPE vocabulary, with the ids kept for what was seen before.

The vocabulary merges inside words only, and no word has white space in it, so the ids of
a text are those of what stands between its white space, one after another; each such run is cut
into words once, when it is first seen. Texts with characters outside `PLAIN`, where lower-casing
or normalisation could depend on the context, or with the text of a special
token, are given to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np
from tokenizers import Tokenizer

#: Characters whose lower case and normal form do not depend on their neighbours: ASCII, Latin-1 and Latin Extended-A.
_CHARS = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x180), 9, 10, 13) if c not in (0xAD, 0x130)]
_LOWER = [c for c in _CHARS if c == c.lower()]
_CLASS = lambda kind: "".join(re.escape(c) for c in _LOWER if unicodedata.category(c)[0] == kind)
_L, _N = _CLASS("L"), _CLASS("N")
PLAIN = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]*")
SPECIAL = re.compile(r"<\|(startoftext|endoftext)\|>", re.IGNORECASE)
#: The pattern by which the vocabulary file cuts words, for lower-cased plain texts.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
#: Runs and words whose ids are kept at most, texts that are looked up at a time, by characters, and words that are encoded as one text.
KEPT_WORDS, AT_ONCE, WORDS_AT_ONCE = 1_200_000, 1 << 20, 500


class WordIds:
    """Encodes texts as unsigned 16-bit ids; `end` is appended to each."""

    def __init__(self, path: str, end: int):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = np.array([end], dtype="<u2").tobytes()
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes many words as one text: the last token of every word, and no other, ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u2")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word was cut anew")
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (2 * ends).tolist(), strict=True):
            self.known[word] = raw[at:end]
            at = end

    def _meet(self, fresh: set[str]) -> None:
        """Makes the ids of runs known that were not; all others may be forgotten."""
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
        cut = {r: WORD.findall(r) for r in fresh}
        words = list(set(chain.from_iterable(cut.values())).difference(self.known))
        for at in range(0, len(words), WORDS_AT_ONCE):
            self._learn(words[at : at + WORDS_AT_ONCE])
        for run, parts in cut.items():
            if len(parts) > 1:
                self.known[run] = b"".join(map(self.known.__getitem__, parts))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 16-bit ids of each text, with the end id; a null text counts as empty."""
        at = 0
        while at < len(texts):
            runs: list[list[str] | None] = []
            chars = 0
            while at + len(runs) < len(texts) and chars < AT_ONCE:
                text = texts[at + len(runs)] or ""
                plain = PLAIN.fullmatch(text) and not ("<|" in text and SPECIAL.search(text))
                runs.append(text.lower().split() if plain else None)
                chars += len(text)
            found = [list(map(self.known.get, r or ())) for r in runs]
            fresh = set(chain.from_iterable(compress(r, map(not_, f)) for r, f in zip(runs, found, strict=True) if None in f))
            if fresh:
                self._meet(fresh)
            for i, (r, f) in enumerate(zip(runs, found, strict=True), at):
                if r is None:
                    yield np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u2").tobytes() + self.end
                else:
                    yield b"".join([x or self.known[w] for w, x in zip(r, f, strict=True)] if None in f else f) + self.end
            at += len(runs)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def word_ids(path: str, end: int) -> WordIds:
    return WordIds(path, end)
