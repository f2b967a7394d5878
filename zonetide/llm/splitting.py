"""Words of the public tokenizer files, and what the tokenizers library makes of one word.

Texts whose characters all lie in a range where the character classes are plain
split by one ``re`` pattern; all other texts go through the library's own
normalizer and splitter, so both ways agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# White space, letters and numbers as the tokenizer files mean them, below U+0250 and in U+2000-206F.
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
UNUSUAL = re.compile("[^\x00-\u024f\u2000-\u206f\u20ac]")
WORD_END = re.compile(f"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
BYTE_LEVEL = re.compile(f"{ENDINGS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@lru_cache(maxsize=4)
def tokenizer(file: str) -> Tokenizer:
    """The tokenizer of a file's content, without truncation and padding."""
    out = Tokenizer.from_str(file)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, dict[str, int]]:
    """The letter that stands for each byte in byte-level vocabularies, and back: printable
    Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    letters = "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))
    return letters, {c: b for b, c in enumerate(letters)}


def splitter(file: str) -> Callable[[str], list[str]]:
    """text -> its words, in order; special tokens in the text are words of their own."""
    tok = tokenizer(file)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    around = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    lower = tok.normalizer is not None
    pattern = WORD_END if lower else BYTE_LEVEL
    _, back = byte_letters()

    def plain(text: str) -> list[str]:
        if UNUSUAL.search(text) is None:
            return pattern.findall(text.lower() if lower else text)
        if lower:
            text = tok.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if around is None or "<|" not in text:
            return plain(text)
        parts = around.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else plain(p) if p else [])]

    return split


def word_ids(file: str) -> Callable[[str], list[int]]:
    """word -> ids of its pieces."""
    tok = tokenizer(file)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    letters, _ = byte_letters()

    def ids(word: str) -> list[int]:
        if word in special:
            return [special[word]]
        return [t.id for t in tok.model.tokenize("".join(letters[b] for b in word.encode()))]

    return ids


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
