"""Token ids and counts with a public tokenizer file, word by word.

Splitting at ASCII white space is safe for tokenizers that drop white space (no token, normalisation or special string
crosses it), so each distinct word is encoded once per worker and looked up after that. Most words are lower-case letters
with a few marks behind them. Where the file's normaliser and word pattern are known to leave such letters whole and as they
are, the file's own model encodes them alone, many at once, and the marks are a word of their own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes

#: Words that one worker remembers in each of two generations; those used in the younger one stay.
MAX_WORDS = 400_000
#: Longer words are encoded each time.
LONG_WORD = 48
#: Words given to the model at once.
RUN = 512
#: Lower-case Latin letters (they stay as they are, each is a letter), then ASCII marks up to the word's end.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
#: Fixed value: the word pattern that keeps runs of letters whole.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_codecs: dict[str, "WordCodec"] = {}


class WordCodec:
    """Encodes white-space separated words with one tokenizer file and remembers them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.passing: list[bytes] = []
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.letters = self._of_letters(spec)

    def _of_letters(self, spec: dict):
        """The file's model for space-separated runs of letters, where its other parts leave those as they are; else None."""
        from tokenizers import Tokenizer

        normal, before, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
        steps = before.get("pretokenizers", [{}])
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        known = (
            {n["type"] for n in normal.get("normalizers", ())} == {"NFC", "Replace", "Lowercase"}
            and steps[0] == {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}
            and steps[1:] == [level]
            and model["type"] == "BPE"
            and bool(model["end_of_word_suffix"])
            and not any(_PLAIN.fullmatch(t.decode()) or t.split() != [t] for t in self.special)
        )
        if not known:
            return None
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
        found = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": split}))
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        return found

    @staticmethod
    def get(path: str) -> "WordCodec":
        if path not in _codecs:
            _codecs[path] = WordCodec(path)
        return _codecs[path]

    def split(self, text: bytes) -> list[bytes]:
        """The words of a text, in lower case where that changes no id."""
        if self.letters is None or b"\xcc" in text or b"\xcd" in text:
            return text.split()  # combining marks may compose with upper and lower case in different ways
        lower = text.lower()
        return text.split() if any(t[:1].lower() in lower and t.lower() in lower for t in self.special) else lower.split()

    def learn(self, texts: list[list[bytes]]) -> None:
        new = set().union(*texts) if texts else set()
        if len(self.known) > MAX_WORDS:
            self.older, self.known = self.known, {}
        new = new.difference(self.known)  # looks new up in known; difference_update would go through all of known
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new -= again
        self.passing = [w for w in new if len(w) > LONG_WORD]
        self._encode(new)

    def _encode(self, new: set[bytes]) -> None:
        """Put the ids of all new words into known."""
        parts: list[tuple[bytes, bytes, bytes]] = []
        stems, others = set(), set()
        for word in new:
            found = _PLAIN.fullmatch(word.decode()) if self.letters is not None and len(word) <= LONG_WORD else None
            if found is None:
                others.add(word)
                continue
            stem, tail = found[1].encode(), found[2].encode()
            stems.add(stem)
            if tail:
                others.add(tail)
                parts.append((word, stem, tail))
        self._run(list(stems - self.known.keys()))
        rest = list(others - self.known.keys())
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = np.asarray(found.ids, "<u4").tobytes()
        for word, stem, tail in parts:
            self.known[word] = self.known[stem] + self.known[tail]

    def _run(self, stems: list[bytes]) -> None:
        for at in range(0, len(stems), RUN):
            part = stems[at : at + RUN]
            joined = b" ".join(part).decode()
            ids = np.asarray(self.letters.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer has letters without an id")
            data = ids.tobytes()
            self.known.update((w, data[s:e]) for w, s, e in zip(part, [0, *ends], ends))

    def forget_long(self) -> None:
        """Drop the long words of the last call of learn."""
        for word in self.passing:
            self.known.pop(word, None)
        self.passing = []


def encoded(column: pa.Array, path: str) -> Iterator[bytes]:
    """For each text its ids as little-endian unsigned 32-bit numbers; null is empty."""
    codec = WordCodec.get(path)
    column = column.fill_null("") if column.null_count else column
    texts = [codec.split(text) for text in pc.cast(column, pa.large_binary()).to_pylist()]
    codec.learn(texts)
    look = codec.known.__getitem__
    for text in texts:
        yield b"".join(map(look, text))
    codec.forget_long()


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: (key, n_bytes, n_tokens, over_limit).

    Batches are cut at about equal bytes, and a long text is encoded in pieces that end at white space. A null or empty
    text has 0 bytes and 0 tokens; rows with equal or null keys each give their own row; further columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n_tokens = np.array([len(ids) // 4 for ids in encoded(batch.column("text"), path)], np.int64)
            n_bytes = pc.cast(pc.binary_length(batch.column("text")).fill_null(0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    arrow_bounds(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
