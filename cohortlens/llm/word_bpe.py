"""Token ids of whole texts under a lower-casing word tokenizer, one white-space run at a time.

The tokenizer drops white space before its merges, so no token spans two chunks between white space
and a text's ids are the ids of its chunks, joined. Chunks repeat, so each worker encodes a chunk
once and keeps the result in a bounded cache.

A chunk of ASCII and Latin-1 letters is cut into pre-tokens here (``PRE_TOKEN``) and each pre-token
goes to the library's merge model. Any other chunk, and any that may hold a special string, goes
through the whole library.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The white space of the Unicode property, which the library drops.
WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Python's ``str.split`` drops these as well; the library keeps them.
SEPARATORS = re.compile("[\x1c-\x1f]")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The pre-token pattern of the word tokenizer, for lower-case plain chunks.
PRE_TOKEN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"
)


def chunks(text: str) -> list[str]:
    """The runs of ``text`` between white space."""
    if SEPARATORS.search(text):
        return [chunk for chunk in WHITE_SPACE.split(text) if chunk]
    return text.split()


def pre_tokens(chunk: str) -> list[str] | None:
    """The pre-tokens of a plain chunk; None if the library has to cut it."""
    if PLAIN.fullmatch(chunk) and "<|" not in chunk:
        return PRE_TOKEN.findall(chunk.lower())
    return None


def byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (byte for byte in range(256) if byte not in printable)
    return {b: b for b in printable} | {byte: 0x100 + k for k, byte in enumerate(others)}


LETTERS = byte_letters()


class WordEncoder:
    """The library's ids of pre-tokens and chunks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize

    def pre_token_ids(self, pre_token: str) -> list[int]:
        letters = pre_token.encode().decode("latin-1").translate(LETTERS)
        return [token.id for token in self.merge(letters)]

    def chunk_ids(self, chunk: str) -> list[int]:
        parts = pre_tokens(chunk)
        if parts is None:
            return self.library.encode(chunk, add_special_tokens=False).ids
        return [i for part in parts for i in self.pre_token_ids(part)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, loaded once per worker."""
    return WordEncoder(path)
