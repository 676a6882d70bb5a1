"""Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re
import zlib
from functools import cached_property

import numpy as np

#: How GPT-2's pre-tokenizer cuts a text; the byte-level pre-tokenizer of the library uses the same.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that ``tiktoken``'s regular expressions, which backtrack, may not get through.
_LONG_BLANK = re.compile(r"\s{10000}")
_ENCODERS: dict[int, Encoder] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """``ids(text)`` equals the library's ``encode(text, add_special_tokens=False)``.

    Where the vocabulary is plain byte-level BPE whose ids follow the order of its merges, the merges are done by ``tiktoken`` with those
    ids as ranks, which gives the same ids at a quarter of the time. Texts that hold an added token or a very
    long run of white space, and other vocabularies, go to the library itself.
    """

    def __init__(self, tokenizer_json: str):
        self.json = tokenizer_json
        parts = json.loads(tokenizer_json)
        added = parts.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        self.fast = self._ranked(parts)
        most = max([t["id"] for t in added] + list(parts["model"]["vocab"].values())) if self.fast else 1 << 16
        self.dtype = np.dtype("<u2") if most < 1 << 16 else np.dtype("<u4")

    @cached_property
    def library(self):
        """The library's tokenizer, which most workers never need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)

    @staticmethod
    def _ranked(parts: dict):
        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or parts.get("normalizer") or before.get("type") != "ByteLevel" or before.get(
            "add_prefix_space"
        ) or not before.get("use_regex", True):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        special, alphabet = {t["content"] for t in parts.get("added_tokens") or []}, byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(a in text for a in self.added) and not (len(text) >= 10_000 and _LONG_BLANK.search(text)):
            return np.array(self.fast.encode_ordinary(text), self.dtype)
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)


def encoder(tokenizer_json: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]
