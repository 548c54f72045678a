"""Ids of byte-level BPE tokenizers, given as a ``tokenizers`` JSON file, at the speed of a cached lookup."""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Word pieces an encoder remembers; it starts anew beyond that.
REMEMBERED = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Pieces(dict):
    """Ids of a word and the space before it, made when first asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit words, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    This pattern family starts a new piece at every space before something else than white space, so a
    text is looked up word by word. Texts with other runs of spaces are encoded as a whole by the same
    merges, and texts that hold a special token's string, or any text if the file is not a plain
    byte-level BPE, by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        vocabulary, symbol = spec["model"]["vocab"], _byte_of_symbol()
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.uneven = re.compile(r" (?:\s|\Z)")
        self.lengths = np.ones(max([*vocabulary.values(), *added.values()]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        for token, i in added.items():
            self.lengths[i] = len(token.encode())
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ordered = all(vocabulary.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        plain = (spec.get("normalizer"), (spec.get("pre_tokenizer") or {}).get("type")) == (None, "ByteLevel")
        plain = plain and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
        if not (ordered and plain and spec["model"]["type"] == "BPE"):
            self.special = re.compile("")
            return
        import public_tokenizers

        ranks = {bytes(symbol[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        encoding = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.whole = lambda text: _packed(encoding.encode_ordinary(text))
        self.pieces = _Pieces(self.whole)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.uneven.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.pieces.__getitem__, words))

    def byte_lengths(self, ids: bytes) -> np.ndarray:
        """How many bytes of the text each token covers."""
        return self.lengths[np.frombuffer(ids, "<u4")]
