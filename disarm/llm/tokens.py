"""Byte-level BPE ids of many texts."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import tiktoken


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name lies; another path may be given to every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_signs() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable signs: those of Latin-1 as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    signs = {chr(b): b for b in plain}
    return signs | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary in ``path`` (JSON of the tokenizers library), loaded once in a process, with its added tokens."""
    import public_tokenizers

    with open(path, encoding="utf-8") as source:
        read = json.load(source)
    signs = _bytes_of_signs()
    ranks = {bytes(signs[c] for c in token): rank for token, rank in read["model"]["vocab"].items()}
    added = {t["content"]: t["id"] for t in read["added_tokens"]}
    return tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, special_tokens=added,
        mergeable_ranks={t: r for t, r in ranks.items() if r not in added.values()})


def added_tokens(path: str) -> list[str]:
    return sorted(encoding(path).special_tokens_set)


def encoded(text: str, path: str) -> list[int]:
    """Ids of a text as the ``tokenizers`` library gives them; where an added token is written out, it is one id."""
    return encoding(path).encode(text, allowed_special="all")


def token_ids(text: str, path: str) -> array:
    """The same as unsigned 32-bit numbers."""
    return array("I", encoded(text, path))


def little_endian(ids: array) -> bytes:
    if memoryview(array("I", [1])).tobytes()[0] != 1:
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()
