"""A bounded memo for words: two generations, so that frequent words survive and memory stays level."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """word -> bytes.  Holds at most twice `room` words; words used lately stay."""

    def __init__(self, code: Callable[[str], bytes], room: int = 300_000):
        super().__init__()
        self.code, self.room, self.old = code, room, {}

    def forget(self) -> None:
        """Frees the memory: of a task's words few come back in the next one."""
        self.clear()
        self.old = {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.code(word)
        if len(word) <= 64:  # a longer one hardly comes back
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found
