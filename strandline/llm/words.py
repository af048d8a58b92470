"""Words of a text: runs of bytes other than 0x20 and 0x09-0x0D, ASCII letters in lower case."""

from __future__ import annotations

from collections.abc import Iterator

#: The same words as a pattern for Spark's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
RUN_BYTES = 1 << 22


def word_runs(text: bytes, overlap: int = 0, size: int = RUN_BYTES) -> Iterator[list[bytes]]:
    """The words in lists, so that a very long text needs little memory at once.

    Each list after the first begins with the last ``overlap`` words before it.
    ``bytes.split`` parts at exactly the six bytes above, and ``bytes.lower``
    changes A-Z alone.
    """
    if len(text) <= size:
        if words := text.lower().split():
            yield words
        return
    at, tail, begun = 0, [], False
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in SPACES:
            end += 1
        words = tail + text[at:end].lower().split()
        at = end
        if len(words) > overlap:
            yield words
            begun, tail = True, words[-overlap:] if overlap else []
        else:
            tail = words
    if tail and not begun:
        yield tail
