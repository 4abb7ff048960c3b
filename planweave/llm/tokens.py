"""Byte-level BPE ids of whole texts, with the byte length of every id.

The ids are those of the ``tokenizers`` library for the vocabulary's JSON file. Texts of Latin
characters without a special token go to ``tiktoken`` with the same vocabulary and the same splitting
pattern, which gives the same ids in half the time; all others go to ``tokenizers`` itself, and so do texts
with runs of blanks that ``tiktoken`` cannot split.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
_NOT_LATIN = re.compile("[^\x00-ɏ]")


class Ids:
    """``of(text)``: the ids as an array of unsigned 32-bit numbers. ``lengths[id]``: bytes of an id."""

    def __init__(self, folder_of=None, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = folder_of or public_tokenizers.path
        self._tokenizer = Tokenizer.from_file(path(f"{vocabulary}.json"))
        with open(path(f"{vocabulary}.json"), encoding="utf-8") as file:
            described = json.load(file)
        with open(path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        self._fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        added = {x["id"]: x["content"].encode() for x in described["added_tokens"]}
        self._special = [x.decode() for x in added.values()]
        sizes = {n: len(x) for x, n in ranks.items()} | {n: len(x) for n, x in added.items()}
        self.lengths = np.zeros(max(sizes) + 1, np.int64)
        self.lengths[list(sizes)] = list(sizes.values())

    def of(self, text: str) -> np.ndarray:
        if not (any(x in text for x in self._special) or _NOT_LATIN.search(text)):
            try:
                return self._fast.encode_to_numpy(text).astype(np.uint32, copy=False)
            except ValueError:
                pass  # its pattern runs out of stack in very long runs of blanks
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: list[Ids] = []


def worker_ids() -> Ids:
    """The tokenizer of this Python worker, loaded once."""
    if not _loaded:
        _loaded.append(Ids())
    return _loaded[0]
