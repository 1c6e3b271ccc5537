"""Token ids of whole texts from a public tokenizer file, fast enough for a corpus.

The vocabulary of a byte-level BPE file is handed to ``tiktoken``, which gives
the ids of ``tokenizers`` several times faster (a test compares the two). A
text that spells a special token is encoded by ``tokenizers`` itself, which
gives such a string its own id.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files spell bytes as printable characters: the printable
    ones as themselves, the others in ascending order from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids and byte lengths of tokens; one per task, from the file at ``path``."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        byte_of = _byte_of_char()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(path)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for token, i in self.special.items():
            self.lengths[i] = len(token.encode())

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)

    def plain(self, text: str) -> list[int]:
        """Ids, strings of special tokens being plain text."""
        return self._fast.encode_ordinary(text)


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def default_file() -> tuple[str, str]:
    """Path and split pattern of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
