"""Splitting text into the pre-tokens of byte-level vocabularies, in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import tiktoken

PIECE_CHARS = 1 << 20
CACHE_ENTRIES = 600_000

# Below this code point one character set tells classes quickly; texts beyond it take longer.
PLAIN_END = 0x530
CLASSES = {r"\p{L}": "letters", r"\p{N}": "numbers", r"\s": "spaces"}

_SAFE_CUT = re.compile(r"\S(?= \S)")
_BEYOND_PLAIN = re.compile(f"[^\x00-{chr(PLAIN_END - 1)}]")


@lru_cache(maxsize=8)
def members(name: str, end: int) -> str:
    """The body of a character set with the code points below ``end`` that are of a class.

    The tokenizer libraries carry Unicode tables of their own, so the class is asked of one of them.
    """
    single = {bytes([b]): b for b in range(256)}
    only = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
    every = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    found = sorted(map(ord, only.decode(only.encode_ordinary(every))))
    runs: list[list[int]] = []
    for c in found:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=8)
def _compiled(pattern: str, end: int):
    """``pattern`` with its classes spelled out for code points below ``end``."""
    inner = {name: members(name, end) for name in CLASSES}

    def spell(match: re.Match) -> str:
        inside = match[0].startswith("[")
        if inside:
            body = match[0][1:-1]
            for name, chars in inner.items():
                body = body.replace(name, chars)
            return f"[{body}]"
        if match[0] == r"\S":
            return f"[^{inner[chr(92) + 's']}]"
        return f"[{inner[match[0]]}]"

    return re.compile(re.sub(r"\[\^?[^\]]*\]|\\p\{[LN]\}|\\s|\\S", spell, pattern)).findall


def split(text: str, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    """All pre-tokens of a text, in order."""
    end = 0x110000 if _BEYOND_PLAIN.search(text) else PLAIN_END
    return _compiled(pattern, end)(text)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts that split into the same pre-tokens as the whole.

    A pre-token never crosses a place where a single space follows a non-space and precedes
    another, so long texts are cut there and only one part's pre-tokens are held at a time.
    """
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE_CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:] if begin else text


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, get the characters
    from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
