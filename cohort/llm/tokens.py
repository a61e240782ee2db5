"""Token ids of whole texts.

The vocabulary is one byte-level BPE given in two files: the tokenizer file and the same merges as ranks. Ranks are several
times faster to apply and give the same ids (the tests compare the two), so the workers use them.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import tiktoken

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary
# Fixed value: the pattern that splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by the rank file; a special token written in a text becomes its id, as the tokenizer file has it."""

    def __init__(self, ranks: str | None = None) -> None:
        with open(ranks or vocabulary_path(RANKS), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all")

    def count(self, text: str) -> int:
        return len(self._encoding.encode_to_numpy(text, allowed_special="all"))


@cache
def encoder(ranks: str | None = None) -> Encoder:
    """One encoder for each worker."""
    return Encoder(ranks)
