"""Encoders from tokenizer files whose places are parameters."""

from __future__ import annotations

import re
from functools import cache


def byte_bpe(json_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """A function that gives, in a task, an encoder with the ids of the tokenizer in ``json_path``.

    With the same vocabulary as ranks, ordinary Latin text takes the faster coder: the split pattern and the merges are the
    same, so the ids are. Text with other letters (classes may differ between Unicode versions) or with the special
    string is always encoded by the file itself.
    """

    def encoder():
        if ranks_path is None:
            return _from_json(json_path)
        return _mixed(json_path, ranks_path, pattern)

    return encoder


@cache
def _from_json(json_path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(json_path)
    return lambda text: coder.encode(text, add_special_tokens=False).ids


@cache
def _mixed(json_path: str, ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    other = re.compile(r"[^\x00-ɏ‐-…]|<\|").search

    def encode(text: str):
        return _from_json(json_path)(text) if other(text) else fast.encode_to_numpy(text, disallowed_special=())

    return encode
