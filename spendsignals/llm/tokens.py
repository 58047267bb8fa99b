"""Exact byte-level BPE encoding.

Texts are encoded whole by the ranks of the vocabulary file. The pre-tokenizer never joins a non-space character with
white space after it, so a very long text is cut at such places and the ids of the parts joined. ``tests/llm`` holds the
ids against the ``tokenizers`` library, and an encoder checks a sample against it before use.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np

#: Unicode white space as the pattern's \s has it (Python's own \s also takes \x1C-\x1F). Fixed values.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WS}])[{_WS}]")
PART_CHARS = 500_000
#: The pre-tokenizer's pattern of this vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAMPLE = "The cañón's 42nd; don't\n\n  stop -- über_all!  x\t1.5e3 你好 ́ we'll go "


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which the vocabulary file writes its tokens."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class FastEncoder:
    """``encode_bytes(text)``: the ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {a["content"] for a in spec["added_tokens"]}
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._special = sorted(special)
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        library = Tokenizer.from_file(path)
        same = library.encode(_SAMPLE, add_special_tokens=False).ids == self._own.encode_ordinary(_SAMPLE)
        self._library = library
        self._ids = self._own.encode_ordinary if same else lambda s: library.encode(s, add_special_tokens=False).ids

    def encode_bytes(self, text: str) -> bytes:
        if any(s in text for s in self._special):     # the library's own reading of such strings
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([np.array(self._ids(part), dtype="<u4").tobytes() for part in parts(text)])


def parts(text: str) -> list[str]:
    """``text`` cut where its ids can be joined, each part a little over ``PART_CHARS`` long at most, unless it holds no
    white space to cut at."""
    out, at = [], 0
    while len(text) - at > PART_CHARS:
        m = _CUT.search(text, at + PART_CHARS)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def shared_encoder(path: str) -> FastEncoder:
    """The encoder of this worker process: built once, though the package's functions reach each task as copies."""
    kept = sys.modules.setdefault("_shared_encoders", types.ModuleType("_shared_encoders")).__dict__
    if path not in kept:
        kept[path] = FastEncoder(path)
    return kept[path]
