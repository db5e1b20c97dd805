"""Best-fit-decreasing packing of whole documents into sequences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from junctura.llm.packing import _byte_of_char
from junctura.llm.shared import stage

ROOM = 4096
END_ID = 1
# Runs of text whose ids a worker remembers (twice as many at most), and the longest of them in characters.
CACHE_RUNS = 1 << 19
CACHE_CHARS = 64

# Fixed value: the split pattern of the vocabulary's tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters that Python and the library surely lower-case, classify and take for white space alike: Latin,
# Greek (but for the capital sigma, whose lower case depends on its place), Cyrillic, punctuation and
# currency signs, without the controls that only Python takes for white space.
_PLAIN = re.compile("[\x00-\x1b\x20-΢Τ-ԯ‐-‧‰-⁞₠-₿]*")


class _Runs(dict):
    """Ids of runs as little-endian bytes, worked out when first asked for; those not asked for lately go."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self._encode, self._old = encode, {}

    def __missing__(self, run: str) -> bytes:
        found = self._old.get(run)
        if found is None:
            found = np.array(self._encode(run), "<u4").tobytes()
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_RUNS:
                self._old = dict(self)
                self.clear()
            self[run] = found
        return found


class WordEncoder:
    """Ids of a tokenizer that splits normalised text into words and then encodes each word alone."""

    def __init__(self, vocabulary: str) -> None:
        self._whole = Tokenizer.from_str(vocabulary)
        self._model = self._whole.model
        self._split = regex.compile(PATTERN)
        special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._chars = {b: c for c, b in _byte_of_char().items()}
        self._known = _Runs(self._of_run)

    def _of_run(self, run: str) -> list[int]:
        """The ids of a run without white space, in lower case already, from the library's model."""
        words = self._split.findall(run)
        made = (self._model.tokenize(w.encode().decode("latin-1").translate(self._chars)) for w in words)
        return [t.id for tokens in made for t in tokens]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as uint32, the same as the library gives for it as a whole.

        Text of plain characters is lower-cased and cut at white space here, which no word spans, and the
        library's model is asked for the words of each run not met before; other text, and strings of
        special tokens, go to the library whole.
        """
        special = self._special and self._special.search(text)
        if special or not _PLAIN.fullmatch(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self._known.__getitem__, text.lower().split())), "<u4")


class Rooms:
    """A segment tree over remaining capacities that finds the least occupied one from a size on."""

    def __init__(self, room: int) -> None:
        self.leaves = 1 << room.bit_length()
        self.used = [False] * (2 * self.leaves)

    def put(self, capacity: int, used: bool) -> None:
        node = self.leaves + capacity
        self.used[node] = used
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """The smallest capacity in use that is at least ``size``, in logarithmic time."""
        node = self.leaves + size
        if self.used[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, each, sequence, offset) that place every piece; pieces of a length count from 0.

    From ``first`` on, ``each`` pieces of a length after another go to the sequence, from ``offset`` on,
    the next as many to the next sequence, until the next run of that length. Lengths go from the
    longest down, and each piece goes to the open sequence with the least room that holds it, or opens
    a new one. A sequence that has taken a piece has less room than before, so it takes those of the same
    length until none fits. Open sequences with equal room are interchangeable, and so are pieces of
    equal length, so as many as there are of both move in one step: the bins are those of best-fit
    decreasing piece by piece, and neither time nor memory depends on the number of pieces, only on
    ``room``.
    """
    tree, opened, runs = Rooms(room), 0, []
    free: dict[int, deque[tuple[int, int]]] = {}

    def give(capacity: int, first: int, n: int) -> None:
        """Let n sequences from ``first`` on have ``capacity`` left."""
        if not capacity or not n:
            return
        into = free.setdefault(capacity, deque())
        if not into:
            tree.put(capacity, True)
        if into and sum(into[-1]) == first:
            into[-1] = (into[-1][0], into[-1][1] + n)
        else:
            into.append((first, n))

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = room, opened
                size = -(-left // (room // length))
                opened += size
            else:
                first, size = free[capacity].popleft()
                if not free[capacity]:
                    tree.put(capacity, False)
            each = min(capacity // length, left)
            n = min(size, left // each)
            runs.append((length, done, each, first, room - capacity))
            done, left = done + each * n, left - each * n
            give(capacity - each * length, first, n)
            if size > n:
                # Those behind are still as they were, and go on being the first in line.
                if not free.get(capacity):
                    free[capacity] = deque()
                    tree.put(capacity, True)
                free[capacity].appendleft((first + n, size - n))
    return runs


_encoders: dict[int, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    name = zlib.crc32(vocabulary.encode())
    if name not in _encoders:
        _encoders[name] = WordEncoder(vocabulary)
    return _encoders[name]


def _pieces(docs: DataFrame, vocabulary_path: str, key: str, text: str, room: int) -> DataFrame:
    """(part, key, piece, start, length, ids_crc32, nth): nth counts the pieces of a length in a task."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))
    names = ["part", "key", "piece", "start", "length", "ids_crc32", "nth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(vocabulary.value), TaskContext.get().partitionId()
        met = np.zeros(room + 1, np.int64)
        for batch in batches:
            source, made = [], []
            for row, body in enumerate(batch.column(1)):
                ids = np.append(encoder.encode(body.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), room)):
                    own = ids[start : start + room]
                    source.append(row)
                    made.append((piece, start, len(own), zlib.crc32(own.tobytes()), met[len(own)]))
                    met[len(own)] += 1
            columns = np.array(made, np.int64).reshape(-1, 5).T
            keys = batch.column(0).take(pa.array(source, pa.int64()))
            arrays = [pa.array(np.full(len(source), part, np.int64)), keys, *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"part bigint, key {kind}, " + ", ".join(f"{n} bigint" for n in names[2:]))


def pack_best_fit(
    docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", room: int = ROOM
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then ``END_ID``. Only one longer than ``room`` is cut, into pieces of
    ``room`` ids and a rest. The pieces of all documents are packed by best-fit decreasing, over the
    whole table at once: tasks number the pieces of each length as they make them, the numbers of
    pieces by length (``room`` numbers at most) give the placing of every numbered piece, and the
    resulting runs, whose number ``room`` bounds as well, are looked up for each piece. No text is
    shuffled, and no length, however frequent, meets in one task.

    A null or empty text is a document of ``END_ID`` alone. Repeated rows and null keys are packed like
    others; an empty table gives no rows; other columns are ignored. Of sequences with equal room the
    one that has had it longest is taken. A task holds a batch of texts and the ids of its longest
    document. ``vocabulary_path`` is read by the driver; the file (2 MB) is broadcast.
    """
    made = stage(_pieces(docs, vocabulary_path, key, text, room), "pieces")
    parts = stage(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = stage(parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), "before")
    runs = np.array(best_fit_decreasing(counts, room), np.int64).reshape(-1, 5)
    # By length and first piece, as one ascending number each.
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    numbered = made.join(parts, ["length", "part"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("nth")
    )
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        lengths, starts = np.unique(runs[:, 0], return_index=True)
        ends = np.append(starts[1:], len(runs))
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                which = int(np.searchsorted(lengths, value))
                own, rows = runs[starts[which] : ends[which], 1], np.flatnonzero(length == value)
                at[rows] = starts[which] + np.searchsorted(own, nth[rows], side="right") - 1
            bins, places = np.divmod(nth - runs[at, 1], runs[at, 2])
            arrays = [*batch.columns[:5], pa.array(runs[at, 3] + bins), pa.array(runs[at, 4] + places * length)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = numbered.schema["key"].dataType.simpleString()
    return numbered.mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"`{n}` bigint" for n in names[1:]))
