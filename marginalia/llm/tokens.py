"""Byte-level BPE ids from a public vocabulary file, in bounded time and memory."""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as ``tokenizers`` gives them for ``vocabulary`` with add_special_tokens=False.

    The same merges are applied by the faster library from the same
    vocabulary's rank file; what the two could split differently - text that
    spells a special token, or control characters - is given to ``tokenizers``
    itself.  Loaded on first use in each worker; only the paths are pickled.
    """

    def __init__(self, vocabulary_file: str | None = None, ranks_file: str | None = None, end_id: int = 2):
        self.vocabulary_file = vocabulary_file
        self.ranks_file = ranks_file
        self.end_id = end_id

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("vocabulary_file", "ranks_file", "end_id")}

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary_file or vocabulary("byte_bpe_50k.json"))

    @cached_property
    def specials(self) -> list[str]:
        return [t.content for t in self.exact.get_added_tokens_decoder().values()]

    @cached_property
    def fast(self):
        import public_tokenizers
        import tiktoken

        path = self.ranks_file or vocabulary("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def odd(self):
        """What is left to the exact library: characters that only some engines count as white space, and long runs."""
        import re

        specials = "|".join(map(re.escape, self.specials))
        return re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f᠎ -‏ -  -⁯　﻿]|\s{5000}" + (f"|{specials}" if specials else ""))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for text in texts:
            text = text or ""
            ids = self.exact.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.fast.encode_ordinary(text)
            made = np.empty(len(ids) + 1, dtype=np.uint32)
            made[:-1] = ids
            made[-1] = self.end_id
            out.append(made)
        return out
