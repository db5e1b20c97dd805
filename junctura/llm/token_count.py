"""Greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words whose lengths a worker remembers, and the longest word that it does so for.
CACHE_WORDS, CACHE_BYTES = 1 << 19, 64


@dataclass(frozen=True)
class Automaton:
    """A trie of pieces with failure links.

    ``goto`` maps a node and a byte (node << 8 | byte) to a node. Where a node has no way on,
    ``pops[node]`` pieces are certain and the match goes on at ``fail[node]``; -1 says that no split
    into pieces exists. Node 0 is the start of a word, ``inner`` the state between pieces.
    """

    goto: dict[int, int]
    fail: list[int]
    pops: list[int]
    inner: int

    @classmethod
    def build(cls, first: Iterable[bytes], later: Iterable[bytes]) -> Automaton:
        """From the pieces that can start a word and those that can follow another.

        Nodes are visited by depth. A node that ends a piece pops it and falls back to ``inner``.
        Any other node pops what its parent pops, then what the fallback states pop until one of
        them can take the node's byte; those counts are summed here, so no piece is built later.
        """
        goto: dict[int, int] = {}
        ends = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    step = goto.get(node << 8 | byte)
                    if step is None:
                        step = len(ends)
                        goto[node << 8 | byte] = step
                        ends.append(False)
                        children.append([])
                        children[node].append((byte, step))
                    node = step
                if piece:
                    ends[node] = True
        fail, pops = [-1] * len(ends), [0] * len(ends)
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for byte, child in children[node]:
                todo.append(child)
                if ends[child]:
                    fail[child], pops[child] = 1, 1
                    continue
                count, back = pops[node], fail[node]
                while back >= 0 and (back << 8 | byte) not in goto:
                    count, back = count + pops[back], fail[back]
                if back >= 0:
                    fail[child], pops[child] = goto[back << 8 | byte], count
        return cls(goto, fail, pops, 1)

    def length(self, word: bytes) -> int | None:
        """The number of pieces of a word by greedy longest match; None if greed gets stuck."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = count = 0
        for byte in word:
            while (step := goto.get(node << 8 | byte)) is None:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return None
            node = step
        while node != self.inner:
            if node == 0:
                return 0
            count += pops[node]
            node = fail[node]
            if node < 0:
                return None
        return count


def byte_level_pieces(vocabulary: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a byte-level vocabulary's JSON text: those with a leading space, and the rest."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    model = json.loads(vocabulary)
    special = {t["content"] for t in model["added_tokens"]}
    pieces = [bytes(byte[c] for c in t) for t in model["model"]["vocab"] if t not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def token_counts(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_words, n_tokens, n_unknown.

    Words are runs of anything but ASCII white space, with a space put before each; a word's tokens
    are its pieces by greedy longest match from the left over UTF-8 bytes. A word that greed can't
    split counts as one token, and in ``n_unknown``. Every byte is looked at a constant number of
    times on average, however long a word is. A worker remembers the lengths of up to
    ``CACHE_WORDS`` words, which changes nothing but the time.

    A null or empty text has no words. Repeated rows and null keys each give a row; an empty table
    gives none; other columns are ignored. ``vocabulary_path`` is read by the driver, and the
    automaton, whose size the vocabulary bounds, is broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        automaton = Automaton.build(*byte_level_pieces(file.read()))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))
    names = [key, "n_bytes", "n_words", "n_tokens", "n_unknown"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of = shared.value.length
        known: dict[bytes, int | None] = {}

        def measure(text: str | None) -> tuple[int, int, int, int]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            words = raw.split()
            total = unknown = 0
            for word in words:
                if word in known:
                    length = known[word]
                else:
                    length = length_of(b" " + word)
                    if len(word) <= CACHE_BYTES:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[word] = length
                if length is None:
                    length = 1
                    unknown += 1
                total += length
            return len(raw), len(words), total, unknown

        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(1)]
            arrays = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
