"""Exact encoding with the tokenizers library, fast for text that repeats its words.

A byte-level BPE never merges across the borders of its pre-tokens, so a text
is cut where such a border is certain (at a single space or line feed between
other characters) and each distinct piece is encoded once a worker.  Texts with
other white space next to a cut go to a cut that is certain there too.  Pieces
are encoded in batches, joined by a separator that is a token of its own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import accumulate, chain, filterfalse

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

#: Pieces that a worker remembers at most, in two generations.
REMEMBERED = 600_000
_BATCH = 64
_SURE = re.compile(r"(?<=[^\s])(?= [^\s])")
_SPACES = tuple("\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_WIDE = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _parts(texts: list, size: int = 100_000):
    """Consecutive texts of about that many characters together, so that their pieces fit in memory (and mostly in cache)."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _plain(text: str) -> bool:
    """White space is only single spaces and line feeds, each between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n" or "\x00" in text:
        return False
    if any(c in text for c in _SPACES):
        return False
    return text.isascii() or not any(c in text for c in _WIDE)


class _Pieces:
    """What is known of pieces, in two generations: when the younger is full it becomes the elder one, whose place it takes;
    pieces that are met again come back to the younger.  So frequent pieces stay and rare ones go; memory is bounded by
    REMEMBERED and the pieces of one part of texts."""

    def __init__(self) -> None:
        self.known: dict = {}
        self._elder: dict = {}

    def _learn(self, pieces: list) -> None:
        raise NotImplementedError

    def _values(self, cut: list[list]) -> list[list]:
        """What is known of each piece of each text; new pieces are learnt."""
        flat = list(chain.from_iterable(cut))
        out = list(map(self.known.get, flat))
        if missing := [i for i, v in enumerate(out) if v is None]:
            new = {flat[i] for i in missing}
            if len(self.known) + len(new) > REMEMBERED // 2:
                self.known, self._elder = {}, self.known
            back = list(filter(self._elder.__contains__, new))
            self.known.update(zip(back, map(self._elder.__getitem__, back)))
            if rest := list(filterfalse(self._elder.__contains__, new)):
                self._learn(rest)
            for i in missing:
                out[i] = self.known[flat[i]]
        ends = list(accumulate(map(len, cut)))
        return [out[a:z] for a, z in zip([0, *ends], ends, strict=False)]


class Encoder(_Pieces):
    """ids of texts by a byte-level BPE without normalizer whose regular expression is the usual one (byte_bpe_50k)."""

    def __init__(self, path: str, dtype: str = "<u2"):
        super().__init__()
        self.tokenizer, self.dtype = _tokenizer(path), dtype
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        """A piece that starts with NUL stands for itself, others follow a space."""
        whole = [p[1:] if p[:1] == "\x00" else " " + p for p in pieces]
        sep = [i for i, p in enumerate(whole) if not p or p.isspace() or "\n" in p]
        odd = set(sep)
        rest = [i for i in range(len(whole)) if i not in odd]
        groups = [rest[k : k + _BATCH] for k in range(0, len(rest), _BATCH)]
        texts = ["\n".join([whole[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            if len(ends) != len(g):  # cannot be for pieces without white space inside; stay exact if it is
                odd.update(g)
                continue
            for i, end in zip(g, ends, strict=True):
                self.known[pieces[i]] = raw[start * width : end * width]
                start = end + 1
        for i in odd:
            self.known[pieces[i]] = np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if _plain(text):
            return ("\x00" + text.replace("\n", " \x00\n \x00")).split(" ")
        return ["\x00" + p for p in _SURE.split(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        return [x for part in _parts(texts) for x in self._encode(part)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return list(map(b"".join, self._values([self.cut(t) for t in texts])))


class Counter(_Pieces):
    """Numbers of tokens by a tokenizer that drops white space between words (word_bpe_49k)."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.mark_text = "<|startoftext|>"
        self.mark = self.tokenizer.token_to_id(self.mark_text)

    def _learn(self, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        plain = [i for i, t in enumerate(texts) if "<|" not in t]
        groups = [plain[k : k + _BATCH] for k in range(0, len(plain), _BATCH)]
        joined = [f" {self.mark_text} ".join([texts[i] for i in g]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            at = np.flatnonzero(np.array([-1, *e.ids, -1]) == self.mark)
            counts = (np.diff(np.concatenate(([0], at, [len(e.ids) + 1]))) - 1).tolist()
            for i, n in zip(g, counts, strict=True):
                self.known[pieces[i]] = n
        for i, t in enumerate(texts):
            if "<|" in t:
                self.known[pieces[i]] = len(self.tokenizer.encode(t, add_special_tokens=False).ids)

    def count(self, texts: list[bytes]) -> list[int]:
        """Of UTF-8 texts; pieces are cut at ASCII white space."""
        return [n for part in _parts(texts) for n in self._count(part)]

    def _count(self, texts: list[bytes]) -> list[int]:
        return list(map(sum, self._values([t.split() for t in texts])))
