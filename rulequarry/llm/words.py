"""Splitting texts for byte-level BPE and keeping what each distinct word gives."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)


class WordCache:
    """Maps each word to what ``encode(list of new words)`` gives for it.

    Words are held in two generations of at most ``most`` words and ``room`` characters each (or those of one lookup, if these are more). When the newer
    one is full it becomes the older one; words that are looked up again move over, so that common words stay and rare ones go.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 300_000, room: int = 1 << 24):
        self.encode, self.most, self.room = encode, most, room
        self.known, self.before, self.size = {}, {}, 0

    def _learn(self, new: list[str]) -> None:
        """Take in words that the newer generation lacks."""
        self.size += sum(map(len, new))
        before = self.before
        self.known.update([(w, before[w]) for w in new if w in before])
        if new := [w for w in new if w not in before]:
            self.known.update(zip(new, self.encode(new), strict=True))

    def _turn(self, new: list[str]) -> None:
        """Begin another generation if the newer one has no room for these words."""
        if len(self.known) + len(new) > self.most or self.size + sum(map(len, new)) > self.room:
            self.before, self.known, self.size = self.known, {}, 0

    def lookup(self, words_of: list[list[str]]) -> dict:
        """A mapping that holds every word of the given lists."""
        every = set().union(*words_of)
        self._turn([w for w in every if w not in self.known])
        self._learn([w for w in every if w not in self.known])
        return self.known

    def values(self, words_of: list[list[str]]) -> list[list]:
        """What each word of the given lists gives; it is never None."""
        out = [list(map(self.known.get, words)) for words in words_of]
        gaps = [[i for i, x in enumerate(own) if x is None] for own in out]
        if any(gaps):
            new = list({words[i] for words, own in zip(words_of, gaps, strict=True) for i in own})
            self._turn(new)
            self._learn(new)
            for words, values, own in zip(words_of, out, gaps, strict=True):
                for i in own:
                    values[i] = self.known[words[i]]
        return out


#: Characters of the texts that are split at a time.
STRETCH = 1 << 20


def stretches(texts: list[str], most: int = STRETCH):
    """Runs ``(first, last + 1)`` of texts of about ``most`` characters; a text is never cut."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
