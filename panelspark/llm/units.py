"""Token ids of whole texts, stretch by stretch.

A stretch ends before a single space that stands between two characters that
are no white space. There byte-level pre-tokenisation always cuts, whatever
stands before, and a piece vocabulary cuts too as long as no piece has a space
after another character. So a text's tokens are those of its stretches, one
after the other, and no tokenizer holds a whole long text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

#: Python counts all that Unicode calls white space as such, and a few characters more, where no cut is made.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are looked at together.
SPAN = 1 << 18


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """The text in stretches of ``size`` characters, or up to the next cut after that."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def raw(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteLevel:
    """A byte-level tokenizer file. ``special``: whether the strings of special tokens in a text are such tokens.

    tiktoken merges with the file's own vocabulary, some four times as fast as
    the tokenizers library, which takes stretches with special tokens. The ids
    are the same.
    """

    def __init__(self, path: str, special: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not special
        added = {t.content: i for i, t in self._whole.get_added_tokens_decoder().items()}
        self.bytes = token_bytes(self._whole, added)
        self._special = tuple(added) if special else ()
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in added.values()}
        self._fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, span: str) -> list[int]:
        if any(x in span for x in self._special):
            return self._whole.encode(span, add_special_tokens=False).ids
        return self._fast(span)


def token_bytes(tokenizer, added: dict[str, int]) -> list[bytes]:
    """The bytes of each id: a byte-level entry has a printable character for each byte, an added one stands for itself."""
    # Fixed by the format: printable bytes stand for themselves, the others in order for characters from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    out = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for entry, i in tokenizer.get_vocab().items():
        out[i] = entry.encode() if entry in added else bytes(byte[ch] for ch in entry)
    return out
