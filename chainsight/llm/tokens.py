"""Byte-level BPE ids of whole texts, one encoder per worker process.

``ids`` equals ``tokenizers``' ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``. The bulk goes
through tiktoken, which has the same vocabulary as ranks and is several times faster; a text that holds the
vocabulary's special string, or one that tiktoken's pattern cannot match (very long runs of white space exceed its
backtracking stack), goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os

import numpy as np

SPECIAL = "<|endoftext|>"
_made: dict = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers as p
    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")


def encoder(paths: tuple[str, str] | None = None):
    """A function from text to uint32 ids; ``paths``: the vocabulary as JSON and as ranks."""
    if paths not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as p
        import tiktoken
        from tokenizers import Tokenizer
        json_path, rank_path = paths or default_paths()
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = []

        def whole(text: str) -> np.ndarray:
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        def ids(text: str) -> np.ndarray:
            if SPECIAL in text:
                return whole(text)
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:
                return whole(text)

        _made[paths] = ids
    return _made[paths]
