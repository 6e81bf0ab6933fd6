"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words per worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The pre-tokenizer of byte-level BPE, with its classes spelt out for the code points below 256.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\\t-\\r \\x85\\xa0"
WORDS = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\\x01-\\xff]")
CACHED_WORDS = 400_000


def printed_bytes() -> dict[str, int]:
    """Character -> byte in a byte-level vocabulary: printable bytes stand for themselves, the others for 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _merge_ranks(model: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if its merges are in the order of their ids; else None."""
    to_byte = printed_bytes()
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    if model.get("type") != "BPE" or any(x >= y for x, y in zip(ids, ids[1:])) or ids[:1] != [256]:
        return None
    made = set(ids)
    return {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if i < 256 or i in made}


class TokenIds:
    """Encodes texts to little-endian ids of `dtype`.

    Texts of code points below 256 are cut into words here; a word's ids are looked up, or merged anew by the file's own
    ranks. Other texts, texts that hold an added token, and files of another kind go through the tokenizer whole. Both give
    the same ids. With `special_as_text` the strings of special tokens are text like any other.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        added = [t["content"] for t in parts.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        pre = parts.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        ranks = _merge_ranks(parts["model"]) if plain and not parts.get("normalizer") else None
        self.words = ranks and tiktoken.Encoding("file", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.zero = ranks[b"\0"] if ranks else -1
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Merge several words in one call; a zero character, which none of them holds, stands between them."""
        ids = np.array(self.words.encode_ordinary("\0".join(words)), dtype=self.dtype)
        ends = np.append(np.flatnonzero(ids == self.zero), len(ids)) * self.dtype.itemsize
        packed, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = packed[start:end]
            start = end + self.dtype.itemsize

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null counts as empty."""
        if not isinstance(text, str) or not text:
            return np.empty(0, dtype=self.dtype)
        if not self.words or BEYOND.search(text) or (self.added and self.added.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = WORDS.findall(text)
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({word for word, ids in zip(words, found) if ids is None}))
            found = map(self.known.__getitem__, words)
        return np.frombuffer(b"".join(found), dtype=self.dtype)


@lru_cache(maxsize=2)
def token_ids(path: str, special_as_text: bool = False) -> TokenIds:
    """One encoder per worker, file and way to read special tokens."""
    return TokenIds(path, special_as_text)
