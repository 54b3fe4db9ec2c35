"""Token ids of whole texts, by word: one dictionary look-up for each word seen before.

The tokenizer drops white space and never merges across it, so the ids of a text are those of its words in
turn.  A word that ends in ASCII punctuation after an ASCII letter or digit is likewise its two parts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Words kept by a Python worker; beyond it the cache starts afresh, so its memory does not grow with the corpus.
CACHE_WORDS = 800_000
_PUNCTUATION = b".,!?*$%&#|;:"
_CHUNK = 128


class WordTokens:
    """``ids(text)``: the tokenizer's ids of a text, as uint16 or uint32 by the size of the vocabulary."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache_words = cache_words
        self.cache: dict[bytes, bytes] = {}
        ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith("</w>")
        self.ends = ends

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _learn(self, missing: Iterable[bytes]) -> None:
        cache, parts, plain, odd = self.cache, {}, set(), set()
        for word in missing:
            core = word.rstrip(_PUNCTUATION)
            last = core[-1:]
            if core and core != word and last.isalnum():
                parts[word] = (core, word[len(core) :])
                todo: tuple[bytes, ...] = parts[word]
            else:
                todo = (word,)
            for x in todo:
                if x not in cache:
                    (plain if x.decode().isalpha() else odd).add(x)
        plain_list = list(plain)
        chunks = [plain_list[i : i + _CHUNK] for i in range(0, len(plain_list), _CHUNK)]
        if chunks:
            found = self.tokenizer.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False)
            for chunk, e in zip(chunks, found, strict=True):
                ids = np.asarray(e.ids, np.int64)
                stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
                if len(stops) != len(chunk) or stops[-1] != len(ids):
                    odd.update(chunk)
                    continue
                packed, at, width = ids.astype(self.dtype).tobytes(), 0, self.dtype.itemsize
                for word, stop in zip(chunk, (stops * width).tolist(), strict=True):
                    cache[word] = packed[at:stop]
                    at = stop
        if odd:
            odd_list = list(odd)
            for word, e in zip(odd_list, self.tokenizer.encode_batch_fast([w.decode() for w in odd_list], add_special_tokens=False), strict=True):
                cache[word] = self._pack(e.ids)
        for word, (a, b) in parts.items():
            cache[word] = cache[a] + cache[b]

    def ids(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        found = raw.split() if b"<|" in raw else raw.lower().split()  # special tokens are spelt in lower case
        cache = self.cache
        try:
            return np.frombuffer(b"".join(map(cache.__getitem__, found)), self.dtype)
        except KeyError:
            pass
        if len(cache) > self.cache_words:
            cache.clear()
        self._learn({w for w in found if w not in cache})
        return np.frombuffer(b"".join(map(cache.__getitem__, found)), self.dtype)


_held: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, which serves many tasks."""
    if path not in _held:
        _held[path] = WordTokens(path)
    return _held[path]
