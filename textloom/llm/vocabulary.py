"""What the tokenizer operators share: numbers for distinct pre-tokens, and blocks of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Characters of a block of texts; a longer text is a block of its own.
BLOCK_CHARS = 2_000_000


#: Characters and number of pre-tokens that a task remembers; it forgets all when it has more, and at its end.
MOST_CHARS, MOST_PRETOKENS = 16_000_000, 200_000


class Numbers(dict):
    """Pre-token to its number; a new one gets the next number and waits."""

    def __init__(self):
        self.waiting: list[str] = []
        self.chars = 0

    def full(self, chars: int, most: int) -> bool:
        return self.chars > chars or len(self) > most

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.chars += len(word)
        self.waiting.append(word)
        return n


def blocks(texts: Iterable[str], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, up to ``most`` characters or one text at a time."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
