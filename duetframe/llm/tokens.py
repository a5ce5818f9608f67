"""Byte-level BPE of a ``tokenizers`` file: the file's own library where it matters, quicker equals where they agree.

Texts of Latin letters and everyday signs are split by ``re`` and encoded by ``tiktoken`` built from the same file; any
text with another character, or with the text of a special token, goes through the file's own library whole.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts without ODD characters.
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on whose class (letter, number, white space) libraries may differ, as \w, \d and \s have them.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ–—‘’“”…€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable ones for themselves, the rest from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """What one worker holds of a tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        pieces = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in pieces.items()}, special_tokens=dict(self.special))
        pieces |= {i: t.encode() for t, i in self.special.items()}
        #: id to piece, as bytes
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    @cached_property
    def own(self):
        """The file's own library; loaded when a text needs it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        return own

    def plain(self, text: str) -> bool:
        return not ODD.search(text) and not any(s in text for s in self.special)

    def words(self, text: str) -> list[str]:
        """The text cut into the words within which BPE merges; a special token is a word."""
        if self.plain(text):
            return PLAIN.findall(text)
        out, at = [], 0
        for piece in re.split(f"({'|'.join(map(re.escape, self.special))})", text):
            out += [piece] if piece in self.special else [piece[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(piece)]
        return out

    def encode(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.plain(text) else self.own.encode(text, add_special_tokens=False).ids

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)
