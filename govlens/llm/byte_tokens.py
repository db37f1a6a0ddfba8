"""Token ids with a byte-level BPE file whose word pattern leaves a single space at the front of the next word.

A space before a character that isn't white space always begins a new word of that pattern, and so does a line feed between two
such characters. Texts are cut there, each distinct unit is encoded once per worker, many at once, and looked up after that.
Texts with other white space are cut before every run of it; those with a special string or with the separators that count as
white space in one place and not in another are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that one worker remembers in each of two generations; longer ones are encoded each time.
MAX_UNITS, LONG_UNIT, RUN = 400_000, 48, 512
#: White space of other kinds, or more than one of it, as bytes.
_ODD = [a + b for a in (b" ", b"\n") for b in (b" ", b"\n")] + [b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_SEPARATORS = re.compile(rb"[\x1c-\x1f]")
_RUNS = re.compile(r"\s*\S+|\s+")
#: Keys that are encoded many at once: a line feed or nothing, then a character that is no white space, and no more of it.
_JOINED = re.compile(rb"\n?[!-~\xc3-\xdf][^\s\xc2\xe1-\xe3]{0,%d}" % LONG_UNIT)
#: In front of a key that is text as it stands. Other keys are words, with a line feed or else a space before them in the text.
_AS_IS = b"  "


def _spelled(key: bytes) -> bytes:
    return key[2:] if key[:2] == _AS_IS else key if key[:1] == b"\n" else b" " + key


def _key(unit: bytes) -> bytes:
    return unit[1:] if unit[:1] == b" " and _JOINED.fullmatch(unit, 1) and unit[1:2] != b"\n" else _AS_IS + unit


class ByteCodec:
    """Encodes texts with one byte-level file, unit by unit."""

    _made: dict[str, "ByteCodec"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        level = {k: (spec.get("pre_tokenizer") or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        self.known_kind = level == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and spec.get("normalizer") is None and not spec["model"].get("dropout")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space or a line feed, in the file's spelling
        self.opens[[i for t, i in vocabulary.items() if t[:1] in "ĠĊ"]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def get(cls, path: str) -> "ByteCodec":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def units(self, text: bytes) -> list[bytes]:
        """The keys of the units that a text is cut into; one key where no cut is known to be safe."""
        if not text:
            return []
        if not self.known_kind or any(t in text for t in self.special) or _SEPARATORS.search(text):
            return [_AS_IS + text]
        if text[:1] in b" \n" or text[-1:] in b" \n" or any(t in text for t in _ODD):
            return [_key(u.encode()) for u in _RUNS.findall(text.decode())]
        found = text.replace(b"\n", b" \n").split(b" ")
        found[0] = _AS_IS + found[0]
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        cut = [self.units(t) for t in texts]
        passing = self._learn(set().union(*cut) if cut else set())
        look = self.known.__getitem__
        for units in cut:
            yield b"".join(map(look, units))
        for unit in passing:
            self.known.pop(unit, None)

    def _learn(self, new: set[bytes]) -> list[bytes]:
        """Put the ids of all these keys into known; the long ones among them, to be forgotten."""
        if len(self.known) > MAX_UNITS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        fresh = []
        for key in new:
            if key not in known:
                if key in older:
                    known[key] = older[key]
                else:
                    fresh.append(key)
        rest, joined = [], []
        for key in fresh:
            (joined if _JOINED.fullmatch(key) else rest).append(key)
        for at in range(0, len(joined), RUN):
            part = joined[at : at + RUN]
            whole = b"".join([k if k[:1] == b"\n" else b" " + k for k in part])
            ids = np.asarray(self.tokenizer.encode_batch_fast([whole.decode()], add_special_tokens=False)[0].ids, "<u4")
            starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(starts) == len(part):
                data = ids.tobytes()
                known.update(zip(part, [data[s:e] for s, e in zip(starts, [*starts[1:], len(data)])]))
            else:
                rest += part
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for key, found in zip(part, self.tokenizer.encode_batch_fast([_spelled(k).decode() for k in part], add_special_tokens=False)):
                known[key] = np.asarray(found.ids, "<u4").tobytes()
        return [k for k in rest if len(k) > LONG_UNIT]


def encoded(column: pa.Array, path: str) -> Iterator[bytes]:
    """For each text its ids as little-endian unsigned 32-bit numbers; null is empty."""
    column = column.fill_null("") if column.null_count else column
    yield from ByteCodec.get(path).encode(pc.cast(column, pa.large_binary()).to_pylist())
