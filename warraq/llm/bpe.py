"""Byte-level BPE by depth-first traversal of the trie of distinct words (problems 4, 8 and 9).

The last token of a prefix fixes its whole encoding: a token is the last one
of a prefix exactly if it ends the prefix and may stand after the last token of
what is before it. So the distinct words are taken in byte order, which is a
depth-first walk of their trie; the walk keeps the last token of each prefix on
its path, a prefix shared by words is solved once, and a word's encoding is
read off by stepping back along the path. Two tokens may stand together if
merging their joint bytes by rank gives just the two.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import regex

#: Words whose encoding a task remembers; beyond it the memory starts afresh, which costs time and changes no result.
REMEMBERED = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Encoder and counter for one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.piece = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.words = regex.compile(pattern)
        self.together: dict[tuple[int, int], bool] = {}
        self.ids: dict[str, list[int]] = {}
        self.counts: dict[str, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a short byte string by its merges, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.together.get(key)
        if known is None:
            if len(self.together) > 4_000_000:
                self.together.clear()
            # a = -1 stands for the start: the token must then be its own encoding
            known = self.merged(self.piece[b]) == [b] if a < 0 else self.may_follow(-1, b) and self.merged(self.piece[a] + self.piece[b]) == [a, b]
            self.together[key] = known
        return known

    def walk(self, words: list[str]) -> dict[str, list[int]]:
        """Encodings of distinct words: one depth-first pass over their trie."""
        out: dict[str, list[int]] = {}
        rank, longest = self.rank, self.longest
        path = [-1]  # last token of each prefix on the path
        before = b""
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            top = min(len(data), len(before))
            while shared < top and data[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    token = rank.get(data[start:end])
                    if token is not None and self.may_follow(path[start], token):
                        path.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids = []
            at = len(data)
            while at:
                ids.append(path[at])
                at -= len(self.piece[path[at]])
            ids.reverse()
            out[word] = ids
            before = data
        return out

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        if fresh:
            found = self.walk(fresh)
            self.ids |= found
            self.counts |= {w: len(ids) for w, ids in found.items()}

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text; NULL has none. All of them are learned."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.counts.clear()
        split = [self.words.findall(t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        return split

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids = self.ids
        return [[i for w in words for i in ids[w]] for words in self.split(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        split = self.split(texts)
        get = self.counts.__getitem__
        return [sum(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str | None = None) -> Bpe:
    """One encoder for each vocabulary and worker process."""
    return Bpe(path, pattern)
