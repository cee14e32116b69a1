"""The byte-level BPE: texts to ids and back.

``tiktoken`` reads the same vocabulary as ranks, gives the ids that ``tokenizers`` gives
with its file, about four times as fast, and tests hold one against the other. A text on
which it fails (its pattern engine gives up on some extreme runs) goes to ``tokenizers``.
Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np


class Codec:
    def __init__(self, ranks_file: str | None = None, json_file: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_file = json_file or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = {i: b for b, i in ranks.items()}
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # what a panic of the library is, and no Exception
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_file)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode()
