"""A second, faster reader of the tokenizer files for Latin-1 text; anything else goes to the library itself.

The merges of a byte-pair file, in order, are ranks of byte strings, which tiktoken merges several times
faster than the library does. Where a file's ids don't follow its merges, or a text has characters beyond
Latin-1 (whose classes may differ between Unicode versions), the library is used.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import tiktoken

_END = "</w>"
#: Stands for the end of a word; texts that hold it go to the library.
_END_MARK = "\0"
#: Fixed by the byte-level vocabularies: how they split a text.
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without two white-space characters in a row; it needs no looking ahead.
_NO_RUNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
_SPACE_RUN = re.compile(r"\s\s")


def _latin_class(kind: str) -> str:
    return "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _latin_class("L"), _latin_class("N")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\t-\\r \\x85\\xa0{_L}{_N}]+")
_PLAIN_WORDS = re.compile(_WORDS.pattern[len("'s|'t|'re|'ve|'m|'ll|'d|") :])


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LatinBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = _byte_alphabet(), spec["model"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.word_ends = model["end_of_word_suffix"] == _END
        raw = lambda t: bytes(alphabet[c] for c in t)
        whole = lambda t: raw(t.removesuffix(_END)) + _END_MARK.encode() if self.word_ends and t.endswith(_END) and t != _END else raw(t)
        ranks = {whole(t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        if merged != sorted(merged) or len(ranks) < 256:
            raise ValueError(f"the ids of {path} don't follow its merges")
        made = lambda pattern: tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode, self.encode_no_runs = (made(r"[^\x00]+\x00"),) * 2 if self.word_ends else (made(_BYTE_LEVEL), made(_NO_RUNS))

    def takes(self, text: str) -> bool:
        return is_latin(text) and not (self.word_ends and _END_MARK in text)

    def ids(self, text: str) -> list[int]:
        """Ids of a text that this reader takes and that has no special strings."""
        if self.word_ends:  # Latin-1 is in composed form already
            words = (_WORDS if "'" in text else _PLAIN_WORDS).findall(text.lower())
            return self.encode(_END_MARK.join([*words, ""]))
        return self.encode(text) if _SPACE_RUN.search(text) else self.encode_no_runs(text)

    def array(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.ids(text)), np.uint32)


@lru_cache(maxsize=4)
def latin(path: str) -> LatinBpe | None:
    try:
        return LatinBpe(path)
    except ValueError:
        return None
