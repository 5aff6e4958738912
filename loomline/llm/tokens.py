"""Token ids of whole texts through the tokenizers library, at the cost of each distinct word once.

Where a tokenizer never joins what white space parts, the ids of a text are the ids of its words one after another.
So a worker keeps the ids of the words it has met, as bytes, and asks the library, in batches, only for new ones.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

#: Bytes of words and their ids that a worker keeps, beyond which those met longest ago go, and what an entry takes besides.
CACHED_BYTES, ENTRY_BYTES = 128 << 20, 180
#: Longer words (of texts without blanks, encoded data) hardly come again: they are not kept.
LONGEST_KEPT = 64


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return array("I", ids).tobytes() if array("I").itemsize == 4 and np.little_endian else np.array(ids, "<u4").tobytes()


class WordCache:
    """ids(texts): for each text its ids, packed.

    split: the words of a text; encode: the packed ids of each of several words. It holds for any text that the ids of
    the text are the ids of its words joined, which the caller vouches for. At most CACHED_BYTES are kept from one call to the next: the words met
    last, and those met before them, of which one that is met again stays.
    """

    def __init__(self, split: Callable[[str], list], encode: Callable[[list], Iterable[bytes]], most: int = CACHED_BYTES):
        self.split, self.encode, self.most = split, encode, most
        self.known, self.before, self.held = {}, {}, 0

    def _keep(self, word, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES

    def ids(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        new = set(chain.from_iterable(words)).difference(self.known)
        for word in new & self.before.keys():
            self._keep(word, self.before.pop(word))
        new = list(new.difference(self.known))
        passing = []
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for word, ids in zip(part, self.encode(part), strict=True):
                if len(word) > LONGEST_KEPT:
                    passing.append(word)
                    self.known[word] = ids
                else:
                    self._keep(word, ids)
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for word in passing:
            del self.known[word]
        if self.held > self.most // 2:
            self.known, self.before, self.held = {}, self.known, 0
        return out


#: Latin letters, then signs but the apostrophe: in a tokenizer that parts letters from signs, two words of one pre-token each.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Plain parts that are encoded as one text, as the library is quicker over a long text than over many short ones.
TOGETHER = 400


class PartEncoder:
    """Packed ids of words; those of plain letters and signs by their two parts, each new part once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.parts, self.held = tokenizer, {b"": b""}, 0
        vocab = tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a pre-token
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def __call__(self, words: list[bytes]) -> list[bytes]:
        split = [m.groups() if len(w) <= LONGEST_KEPT and (m := PLAIN.fullmatch(w)) else None for w in words]
        if self.held > CACHED_BYTES // 2:
            self.parts, self.held = {b"": b""}, 0
        new = list(set(chain.from_iterable(filter(None, split))).difference(self.parts))
        groups = [new[at : at + TOGETHER] for at in range(0, len(new), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            data = packed(e.ids)
            at = [0, *(4 * np.flatnonzero(self.last[np.frombuffer(data, "<u4")]) + 4).tolist()]
            if len(at) != len(group) + 1 or at[-1] != len(data):
                raise AssertionError("each part is one pre-token")
            self.parts.update(zip(group, (data[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
            self.held += len(data) + sum(map(len, group)) + ENTRY_BYTES * len(group)
        odd = iter(self.tokenizer.encode_batch_fast([w.decode() for w, s in zip(words, split, strict=True) if s is None], add_special_tokens=False))
        return [packed(next(odd).ids) if s is None else self.parts[s[0]] + self.parts[s[1]] for s in split]


@functools.cache
def word_bpe(path: str) -> WordCache:
    """Of a tokenizers file with word ends whose normaliser is NFC and lower case and whose pre-tokenizer drops white space and parts letters, digits and signs.

    Words are runs of anything but ASCII white space, which is white space for the tokenizer as well. ASCII capitals
    are lower-cased first, unless the text has what may be a special token, which is one in small letters only.
    """
    from tokenizers import Tokenizer

    encode = PartEncoder(Tokenizer.from_file(path))
    return WordCache(lambda text: (text.encode() if "<|" in text else text.encode().lower()).split(), encode)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
