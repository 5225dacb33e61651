"""Whole texts to arrays of token ids, as the tokenizers library gives them by default."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from .bpe import latin
from .token_counts import special_strings, tokenizer


def encode_text(path: str, text: str) -> np.ndarray:
    """Ids (uint32) without added special tokens; strings of special tokens in the text become those."""
    if not text:
        return np.empty(0, np.uint32)
    fast = latin(path)
    if fast and fast.takes(text) and not any(s in text for s in special_strings(path)):
        return fast.array(text)
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of the tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
