"""A bounded table of distinct words and their encoded bytes, for encoders that never
cross a word's end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

DOOR_CELLS = 1 << 22
GROUP_CHARS = 1 << 16


class WordTable:
    """Word, as text or bytes -> encoded bytes.

    A word is kept from its second appearance on (a one-byte cell for its hash remembers the
    first), so that the many words that occur once do not push out the others.  Kept words
    live in two generations of at most `bound` words; when the younger is full the older is
    dropped.  Neither rule changes a result: a word that is not kept is encoded again.
    """

    def __init__(self, encode_words: Callable[[list], list[bytes]], bound: int):
        self.encode_words, self.bound = encode_words, bound
        self.young: dict = {}
        self.old: dict = {}
        self.door = bytearray(DOOR_CELLS)

    def lookup(self, words: list) -> list[bytes]:
        """The encoded bytes of each word, by position."""
        if len(self.young) > self.bound:
            self.old, self.young, self.door = self.young, {}, bytearray(DOOR_CELLS)
        young, old, door = self.young, self.old, self.door
        found = list(map(young.get, words))
        gaps = [i for i, known in enumerate(found) if known is None]
        if not gaps:
            return found
        coded, missing = {}, []
        for word in {words[i] for i in gaps}:
            known = old.get(word)
            if known is None:
                missing.append(word)
            else:
                young[word] = coded[word] = known
        if missing:
            for word, own in zip(missing, self.encode_words(missing), strict=True):
                coded[word] = own
                cell = hash(word) % DOOR_CELLS
                if door[cell]:
                    young[word] = own
                else:
                    door[cell] = 1
        for i in gaps:
            found[i] = coded[words[i]]
        return found


def encode_texts(
    texts: list, split: Callable[[str], list] | Callable[[bytes], list], table: WordTable
) -> Iterator[bytes]:
    """The joined bytes of each text's words; short texts are looked up together."""
    words: list = []
    ends: list[int] = []
    chars = 0
    for text in texts:
        words += split(text)
        ends.append(len(words))
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield from _joined(table.lookup(words), ends)
            words, ends, chars = [], [], 0
    yield from _joined(table.lookup(words), ends)


def _joined(coded: list[bytes], ends: list[int]) -> Iterator[bytes]:
    begin = 0
    for end in ends:
        yield b"".join(coded[begin:end])
        begin = end
