"""Byte-pair merging by a heap over a linked list of symbols, and the split of texts into words.

The vocabulary is a byte-level BPE file (``tokenizers`` JSON: byte-level pre-tokenizer with its
own pattern, merges in rank order, added special tokens that are cut out first).
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import regex

#: The fixed byte-level split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols of a word that merges without a heap.
SHORT = 40
_RANK = 1 << 40  # heap entries are rank * 2^40 + position


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by pair of ids, single-byte ids, the bytes of every id, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = [ids[symbols[b]] for b in range(256)]
        back = {s: b for b, s in symbols.items()}
        self.size = max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        #: left id * size + right id -> rank * size + merged id
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault(ids[a] * self.size + ids[b], rank * self.size + ids[a + b])
        self._words = regex.compile(PATTERN)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; a special string stands as itself (see :meth:`is_special`)."""
        if self._special is None or not any(s in text for s in self.special):
            return self._words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self._special.split(text)):
            out.extend([SPECIAL + part] if i % 2 else self._words.findall(part))
        return out

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word: the lowest-rank adjacent pair merges first, the leftmost among equals."""
        symbols = [self.byte_id[b] for b in word]
        if len(symbols) <= SHORT:
            return self._merged_short(symbols)
        return [symbols[i] for i in self._run(symbols)]

    def _merged_short(self, symbols: list[int]) -> list[int]:
        """The same for a few symbols: the least of a short list is found faster by looking than by a heap."""
        size, none, get = self.size, 1 << 62, self.merges.get
        pairs = [get(a * size + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            m = min(pairs)
            if m == none:
                break
            i = pairs.index(m)
            symbols[i : i + 2] = [m % size]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(symbols[i] * size + symbols[i + 1], none)
            if i:
                pairs[i - 1] = get(symbols[i - 1] * size + symbols[i], none)
        return symbols

    def count(self, word: bytes) -> int:
        """Number of ids of a word: its bytes less the merges; no ids are listed."""
        return len(word) - self._run([self.byte_id[b] for b in word], counting=True)

    def _run(self, symbols: list[int], counting: bool = False):
        n, size, merges = len(symbols), self.size, self.merges
        get, push, pop = merges.get, heapq.heappush, heapq.heappop
        heap = []
        for i in range(n - 1):
            m = get(symbols[i] * size + symbols[i + 1])
            if m is not None:
                heap.append(m // size * _RANK + i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            entry = pop(heap)
            i = entry % _RANK
            left = symbols[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            m = get(left * size + symbols[j])
            if m is None or m // size != entry // _RANK:
                continue  # the pair at this place has changed since
            done += 1
            symbols[i], symbols[j] = m % size, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = get(symbols[i] * size + symbols[k])
                if m is not None:
                    push(heap, m // size * _RANK + i)
            h = before[i]
            if h >= 0:
                m = get(symbols[h] * size + symbols[i])
                if m is not None:
                    push(heap, m // size * _RANK + h)
        if counting:
            return done
        i, alive = 0, []
        while i < n:
            alive.append(i)
            i = after[i]
        return alive


#: Leads a special string among words; no text of valid UTF-8 holds a lone surrogate.
SPECIAL = "\ud800"


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each Python worker."""
    return Vocabulary(path)
