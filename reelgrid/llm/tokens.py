"""Token ids of whole texts by the tokenizers library, with the ids of words that recur kept in the worker."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Words kept per worker before it starts anew: about 150 bytes each.
KEPT_WORDS = 1_000_000
#: Units encoded as one text.
TOGETHER = 256
_SPACE_RUN = re.compile(r" \s")
_COMBINING = re.compile("[̀-ͯ]")
_BEFORE_STOP = re.compile(rb"(?<=[a-z0-9])(?=[.,])")
_encoders: dict = {}


def encoder(path: str, unit: str) -> Encoder:
    """The worker's own encoder for a vocabulary file; it and its kept words outlive a task."""
    if (path, unit) not in _encoders:
        _encoders[path, unit] = Encoder(path, unit)
    return _encoders[path, unit]


class Encoder:
    """Ids of texts as bytes of little-endian unsigned integers (dtype).

    unit tells where a text may be cut without changing its ids, so that a unit seen before need not be encoded again:
    "space" for byte-level vocabularies whose pieces start with one space; "word" for vocabularies that drop white space
    and case; "text" cuts nowhere. All ids come from the library, as loaded; texts with runs of white space that could bind
    two units (or combining marks, for "word"), or with the string of an added token in either case, are encoded whole.
    """

    def __init__(self, path: str, unit: str = "text"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.unit = unit
        self.kept: dict = {}
        fold = str.lower if unit == "word" else str
        self._added = [fold(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary, end = self.tokenizer.get_vocab(), "</w>" if unit == "word" else ""
        self._sizes, self._final = np.zeros(max(vocabulary.values()) + 1, np.int64), np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():  # one character stands for one byte
            self._final[i] = token.endswith(end)
            self._sizes[i] = len(token.removesuffix(end))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _units(self, text: str) -> list | None:
        folded = text.lower() if self.unit == "word" else text
        if any(a in folded for a in self._added):
            return None
        if self.unit == "space" and not _SPACE_RUN.search(text):
            if "\0" not in text:
                units = text.replace(" ", "\0 ").split("\0")
                return units if units[0] else units[1:]
        if self.unit == "word" and (text.isascii() or not _COMBINING.search(text)):
            return _BEFORE_STOP.sub(b" ", text.encode().lower()).split()
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [self._units(t) for t in texts]
        fresh = set(chain.from_iterable(u for u in units if u is not None)).difference(self.kept)
        if fresh:
            if len(self.kept) + len(fresh) > KEPT_WORDS:
                self.kept.clear()
                fresh = set(chain.from_iterable(u for u in units if u is not None))
            self._learn(fresh)
        get = self.kept.__getitem__
        return [self._whole(t) if u is None else b"".join(map(get, u)) for t, u in zip(texts, units, strict=True)]

    def _learn(self, fresh: set) -> None:
        """Ids of new units. Units are encoded some at a time as one text, which costs the library far less than one by one; the tokens' lengths in bytes tell where each unit's ids end. A text whose tokens do not end where its units do is encoded unit by unit."""
        if self.unit == "space":
            whole = [w for w in fresh if w[0] == " " and not w[-1].isspace()]
            alone = [w for w in fresh if w[0] != " " or w[-1].isspace()]
            sizes = [len(w) if w.isascii() else len(w.encode()) for w in whole]
            glue, texts = "", whole
        else:
            whole, alone = list(fresh), []
            texts = [w.decode() for w in whole]
            sizes = [len(w) if w.isascii() else len(unicodedata.normalize("NFC", t).lower().encode()) for w, t in zip(whole, texts, strict=True)]
            glue = " "
        starts = range(0, len(whole), TOGETHER)
        for a, found in zip(starts, self._encode([glue.join(texts[a : a + TOGETHER]) for a in starts]), strict=True):
            ids = np.array(found, np.int64)
            ends = np.cumsum(sizes[a : a + TOGETHER])
            at = np.cumsum(self._sizes[ids])
            cuts = np.searchsorted(at, ends)
            if len(at) and at[-1] == ends[-1] and (at[cuts] == ends).all() and self._final[ids[cuts]].all():
                data = ids.astype(self.dtype).tobytes()
                to = ((cuts + 1) * self.dtype.itemsize).tolist()
                self.kept.update(zip(whole[a : a + TOGETHER], map(data.__getitem__, map(slice, [0, *to[:-1]], to)), strict=True))
            else:
                alone += whole[a : a + TOGETHER]
        texts = [w.decode() for w in alone] if self.unit == "word" else alone
        self.kept.update((w, np.array(i, self.dtype).tobytes()) for w, i in zip(alone, self._encode(texts), strict=True))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
