"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

The frequent words of the corpus are compiled into an automaton that shares prefixes and
suffixes; the addends on the arcs of a path sum to the word's number, which points at its ids.
Workers map the compiled file into memory and walk all new words of a batch together; words
that it lacks are merged exactly.  The lexicon changes speed only, never the ids.

Null texts are empty.  Special strings inside a text get their own id.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPECIAL, Vocabulary, vocabulary
from .common import slices, stash, table, utf8, with_columns, worker_cache

#: Words in the lexicon, and the bytes of the longest; together they bound what is broadcast (about 4 MB).
LEXICON_WORDS, WORD_BYTES = 50_000, 48
CACHED_WORDS = 600_000
_COUNTED = 300_000
_ARRAYS = ("base", "final", "owner", "target", "addend", "offsets", "ids")


class _Node:
    __slots__ = ("arcs", "final", "number")

    def __init__(self):
        self.arcs: dict[int, _Node] = {}
        self.final = False
        self.number = -1


def automaton(words: list[bytes]) -> _Node:
    """The minimal automaton of sorted distinct words, built word by word with a register of finished states."""
    root, register, path = _Node(), {}, []

    def finish(keep: int) -> None:
        while len(path) > keep:
            parent, byte, child = path.pop()
            key = (child.final, tuple((b, id(n)) for b, n in child.arcs.items()))
            parent.arcs[byte] = register.setdefault(key, child)

    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        finish(common)
        node = path[-1][2] if path else root
        for byte in word[common:]:
            child = _Node()
            node.arcs[byte] = child
            path.append((node, byte, child))
            node = child
        node.final = True
        previous = word
    finish(0)
    return root


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file image: arcs of state s lie at ``base[s] + byte`` where ``owner`` says s, with target and addend."""
    words = sorted(w for w in entries if w)
    root = automaton(words)
    order: list[_Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.number < 0:
            node.number = len(order)
            order.append(node)
            todo.extend(node.arcs.values())
    below: dict[int, int] = {}

    def count(start: _Node) -> None:
        stack = [start]
        while stack:
            node = stack[-1]
            missing = [c for c in node.arcs.values() if c.number not in below]
            if missing:
                stack.extend(missing)
            else:
                below[stack.pop().number] = node.final + sum(below[c.number] for c in node.arcs.values())

    count(root)
    n = len(order)
    base, final = np.zeros(n, np.int32), np.zeros(n, np.int32)
    slots = 256 + sum(len(x.arcs) for x in order)
    owner, target, addend = np.full(2 * slots + 256, -1, np.int32), np.zeros(2 * slots + 256, np.int32), np.zeros(2 * slots + 256, np.int32)
    taken = np.zeros(2 * slots + 256, bool)
    free = 0
    # states of many arcs first; each takes the first place where all its arcs fit, the last ones fill the gaps
    for node in sorted(order, key=lambda x: -len(x.arcs)):
        s = node.number
        final[s] = node.final
        if not node.arcs:
            continue
        keys = sorted(node.arcs)
        while taken[free]:
            free += 1
        at, span = max(0, free - keys[0]), 4096
        while True:
            clash = np.zeros(min(span, len(taken) - 256 - at), bool)
            for k in keys:
                clash |= taken[at + k : at + k + len(clash)]
            first = int(clash.argmin()) if len(clash) else 0
            if len(clash) and not clash[first]:
                at += first
                break
            at += len(clash)
            if at + 256 >= len(taken):
                owner, target, addend, taken = (np.concatenate((x, np.full(slots, fill, x.dtype))) for x, fill in ((owner, -1), (target, 0), (addend, 0), (taken, False)))
        base[s] = at
        before = int(node.final)
        for k in keys:
            child = node.arcs[k]
            owner[at + k], target[at + k], addend[at + k], taken[at + k] = s, child.number, before, True
            before += below[child.number]
    end = int(np.flatnonzero(taken).max(initial=-1)) + 257
    owner, target, addend = owner[:end], target[:end], addend[:end]
    ids = [entries[w] for w in words]
    arrays = {"base": base, "final": final, "owner": owner, "target": target, "addend": addend, "offsets": np.cumsum([0, *map(len, ids)]), "ids": [i for x in ids for i in x]}
    made = [np.asarray(arrays[name], np.int32) for name in _ARRAYS]
    return np.array([len(a) for a in made], np.int64).tobytes() + b"".join(a.tobytes() for a in made)


class Lexicon:
    """A compiled lexicon, read through a memory map of a file without a name."""

    def __init__(self, image: bytes):
        file = tempfile.TemporaryFile()
        file.write(image)
        file.flush()
        self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        file.close()
        head = 8 * len(_ARRAYS)
        lengths = np.frombuffer(self._map, np.int64, len(_ARRAYS))
        at = head
        for name, n in zip(_ARRAYS, lengths.tolist(), strict=True):
            setattr(self, name, np.frombuffer(self._map, np.int32, n, at))
            at += 4 * n
        #: the ids' bytes, as the file has them
        self.raw = bytes(self._map[at - 4 * len(self.ids) : at])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words, -1 where the lexicon lacks one; all words walk in step."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(lengths > 0) if len(self.owner) else np.zeros(0, np.int64)
        number[lengths == 0] = -1
        if not len(self.owner):
            number[:] = -1
        j = 0
        while len(alive):
            at = self.base[state[alive]] + flat[starts[alive] + j].astype(np.int64)
            good = self.owner[at] == state[alive]
            number[alive[~good]] = -1
            alive, at = alive[good], at[good]
            state[alive] = self.target[at]
            number[alive] += self.addend[at]
            j += 1
            done = lengths[alive] == j
            ended = alive[done]
            number[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
        return number

    def get(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``(word, n)`` over all whole texts; each task sums its own words first, in bounded memory."""

    def run(batches):
        words = vocabulary(path)
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for part in slices([batch], text):
                for t in utf8(part.column(0)):
                    if t:
                        held.update(w for w in words.pieces(t.decode("utf-8", "replace")) if w[0] != SPECIAL)
                if len(held) > _COUNTED:
                    yield from out()
        if held:
            yield from out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words: as many as occur equally often or more, ``size`` at most."""
    counted = word_counts(docs, path, text).filter(F.octet_length("word") <= WORD_BYTES)
    counted = stash(counted, "words")
    # how often a word must occur, from the number of words of each count (few different counts)
    least, total = None, 0
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(size).collect():
        total += r["k"]
        if total > size:
            break
        least = r["n"]
    top = counted.filter(F.col("n") >= least).select("word").collect() if least is not None else []
    v = vocabulary(path)
    return compile_lexicon({w: v.merged(w) for w in (r["word"].encode() for r in top)})


_WORKER = worker_cache("lexicon")


class Encoder:
    """Word ids by lexicon or merges, remembered up to a fixed number of words."""

    def __init__(self, image: bytes, path: str):
        self.lexicon, self.vocabulary = Lexicon(image), vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.codes = [i.to_bytes(4, "little") for i in range(self.vocabulary.size)]

    def learn(self, words: set[str]) -> None:
        v: Vocabulary = self.vocabulary
        new = []
        for w in words:
            if w[0] == SPECIAL:
                self.known[w] = np.array([v.special[w[1:]]], "<u4").tobytes()
            else:
                new.append(w)
        coded = [w.encode() for w in new]
        found, known, codes, raw = self.lexicon.find(coded), self.known, self.codes, self.lexicon.raw
        at = self.lexicon.offsets[np.stack((found, found + 1))] * 4 if len(raw) else np.zeros((2, len(new)), np.int64)
        for w, c, number, a, b in zip(new, coded, found.tolist(), at[0].tolist(), at[1].tolist(), strict=True):
            known[w] = raw[a:b] if number >= 0 else b"".join(map(codes.__getitem__, v.merged(c)))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; new words of all texts are looked up together."""
        words = [self.vocabulary.pieces(t.decode("utf-8", "replace")) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = set().union(*words).difference(self.known)
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, w)) for w in words]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _encoder(shared, path: str) -> Encoder:
    key, image = shared.value
    if _WORKER.get("key") != key:
        _WORKER.clear()
        _WORKER.update(key=key, encoder=Encoder(image, path))
    return _WORKER["encoder"]


def encode_decode(docs: DataFrame, path: str, image: bytes, text: str = "text") -> DataFrame:
    """``docs`` and the columns ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (their text)."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, image))

    def run(texts):
        encoder = _encoder(shared, path)
        ids = encoder.encode(texts)
        return [ids, [encoder.decode(i) for i in ids]]

    return with_columns(docs, text, "ids binary, decoded string", run, "lexicon")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of its decoded text."""
    rows = docs.select("doc_id", "text")
    made = encode_decode(rows, path, fit_lexicon(rows, path))
    return made.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
