"""Exact token ids at the speed of a dictionary.

A text is cut at places where the tokenizer always cuts too, and a piece met
before is not encoded again.  Pieces come from the tokenizers library, many in
one call, parted by the vocabulary's own special token.  A text in which the
cut could differ from the library's goes to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than blank, tab, line feed and carriage return.
ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
ODD_WIDE = ODD_ASCII + (
    "\x85\xa0 ᠎         "
    "  ​    ⁠　﻿"
)

# A word of one or two pre-tokens in vocabularies that drop blanks; lower-casing
# and composing leave these letters letters.
PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?").fullmatch


def file_digest(path: str) -> str:
    """The version of a tokenizer: sha256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _odd(text: str) -> bool:
    return "<|" in text or any(c in text for c in (ODD_ASCII if text.isascii() else ODD_WIDE))


class PieceEncoder:
    """Ids of texts by a tokenizers file, with a bounded memory of pieces.

    ``spaces_kept`` tells whether a blank belongs to the word after it
    (byte-level vocabularies) or is dropped.  At most ``2 * keep`` pieces of at
    most ``longest`` characters are remembered: when the young half is full it
    becomes the old one.
    """

    def __init__(self, path: str, spaces_kept: bool, counts_only: bool = False,
                 keep: int = 600_000, longest: int = 40):
        self.tokenizer = load(path)
        self.spaces_kept, self.counts_only = spaces_kept, counts_only
        self.keep, self.longest = keep, longest
        self.young: dict = {}
        self.old: dict = {}
        special = self.tokenizer.get_added_tokens_decoder()
        self.sep_id, self.sep = next(
            (i, t.content) for i, t in special.items() if t.content == "<|endoftext|>"
        )
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(
            string.ascii_uppercase) == string.ascii_lowercase
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if spaces_kept else token.endswith("</w>")

    def _library(self, text: str) -> np.ndarray:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=np.uint32)

    def _pieces(self, text: str) -> list[str] | None:
        """Pieces in order, or None when only the library knows.  A key that
        starts with NUL stands for the piece after it without a blank before."""
        if _odd(text) or "\x00" in text:
            return None
        if not self.spaces_kept:
            return text.split()
        if ("  " in text or " \n" in text or "\n " in text or "\n\n" in text
                or "\t" in text or "\r" in text
                or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")):
            return None
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\x00" + keys[0]
        return keys

    def _values(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
        if self.counts_only:
            return (ends - starts).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    def _encode(self, keys: list[str]) -> dict:
        """Values of new pieces.  Plain ones go in one text whose pieces show in
        the ids: a kept blank starts a token, and a plain word of a vocabulary
        without blanks is one or two pre-tokens, each closed by a word end."""
        known, plain, rest = {}, [], []
        for key in keys:
            if self.spaces_kept:
                (rest if key[0] in "\x00\n" else plain).append(key)
            else:
                (plain if PLAIN_WORD(key) else rest).append(key)
        for i in range(0, len(plain), 4000):
            part = plain[i:i + 4000]
            joined = " ".join(part)
            ids = self._library(" " + joined if self.spaces_kept else joined)
            edges = np.flatnonzero(self.edge[ids])
            if self.spaces_kept:
                starts, ends = edges, np.append(edges[1:], len(ids))
            else:
                width = np.array([2 if w[-1] in ".," else 1 for w in part])
                ends = edges[np.cumsum(width) - 1] + 1
                starts = np.append(0, ends[:-1])
            known.update(zip(part, self._values(ids, starts, ends)))
        for i in range(0, len(rest), 4000):
            part = rest[i:i + 4000]
            ids = self._library(self.sep.join(k[1:] if k[0] == "\x00" else k for k in part))
            cuts = np.flatnonzero(ids == self.sep_id)
            starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            known.update(zip(part, self._values(ids, starts, ends)))
        return known

    def _missing(self, keys: Iterable[str]) -> dict:
        """Values of pieces that the young half does not hold; it learns them."""
        old = self.old
        found = {k: old[k] for k in keys if k in old} if old else {}
        new = [k for k in keys if k not in found] if found else list(keys)
        if new:
            found |= self._encode(new)
        self.young.update((k, v) for k, v in found.items() if len(k) <= self.longest)
        return found

    def each(self, texts: list[str]) -> list:
        """Per text the number of ids, or the ids as little-endian bytes."""
        if self.spaces_kept or self.counts_only:
            return self._by_text(texts)
        plain = [bool(t) and not _odd(t) and "\x00" not in t for t in texts]
        if not any(plain):
            return [self._library(t).tobytes() if t else b"" for t in texts]
        found = iter(self._together([t for t, p in zip(texts, plain) if p]))
        return [next(found) if p else self._library(t).tobytes() if t else b""
                for t, p in zip(texts, plain)]

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without odd white space.  Their pieces are numbered by
        Arrow, so that each different piece of all texts is looked up once."""
        split = pc.ascii_split_whitespace(self._lowered(pa.array(texts, pa.large_string())))
        coded = pc.dictionary_encode(split.flatten())
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = [b"" if not k else self.young.get(k) for k in keys]
        missing = [k for k, v in zip(keys, values) if v is None]
        if missing:
            fresh = self._missing(missing)
            values = [fresh[k] if v is None else v for k, v in zip(keys, values)]
        self._turn()
        ids = np.frombuffer(b"".join(values), dtype="<u4")
        width = np.fromiter(map(len, values), np.int32, len(values)) // 4
        first = np.cumsum(width, dtype=np.int32) - width
        codes = coded.indices.to_numpy()
        widths = width[codes]
        ends = np.append(np.int32(0), np.cumsum(widths, dtype=np.int32))
        at = np.repeat(first[codes] - ends[:-1], widths)
        at += np.arange(len(at), dtype=np.int32)
        raw = ids[at].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()].astype(np.int64)).tolist()
        return (raw[a:b] for a, b in zip(bounds, bounds[1:]))

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """A-Z lower-cased, where the tokenizer lower-cases them too, so that fewer
        pieces differ.  It composes letters and marks first, and some marks compose
        with small letters only: texts with marks (lead bytes CC, CD) stay."""
        if not self.lowers:
            return texts
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        if ((raw == 0xCC) | (raw == 0xCD)).any():
            return texts
        return pc.ascii_lower(texts)

    def _by_text(self, texts: list[str]) -> list:
        """Each piece is looked up once; what is not known yet is encoded for all
        texts together and put in its places.
        """
        get, missing = self.young.get, set()
        pieces, values = [], []
        for text in texts:
            keys = self._pieces(text) if text else []
            found = None if keys is None else list(map(get, keys))
            if found and None in found:
                missing.update([k for k, v in zip(keys, found) if v is None])
            else:
                keys = None
            pieces.append(keys)
            values.append(found)
        fresh, out = self._missing(missing) if missing else {}, []
        for text, keys, found in zip(texts, pieces, values):
            if found is None:
                ids = self._library(text)
                out.append(len(ids) if self.counts_only else ids.tobytes())
                continue
            if keys is not None:
                found = [fresh[k] if v is None else v for k, v in zip(keys, found)]
            out.append(sum(found) if self.counts_only else b"".join(found))
        self._turn()
        return out

    def _turn(self) -> None:
        """A full young half becomes the old one."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}


_ENCODERS: dict = {}


def encoder(path: str, spaces_kept: bool, counts_only: bool = False,
            keep: int = 600_000) -> PieceEncoder:
    """One encoder per worker process, kept between tasks."""
    key = (path, spaces_kept, counts_only, keep)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def slices(texts: list[str], most: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of texts that together hold about ``most`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
