"""Packing of token streams into windows by order-preserving dynamic programming."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
# Cost in tokens of cutting between documents, sentences, clauses and anywhere else.
BETWEEN_DOCS, BETWEEN_SENTENCES, BETWEEN_CLAUSES, ANYWHERE = 0, 1, 4, 64
# Tokens over which cuts are chosen at a time.
BLOCK = 1 << 17
# Characters that are encoded at a time.
PIECE = 1 << 16

# Fixed value: the split pattern of the vocabulary's tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# No pattern match spans a single space between two letters, so a text may be encoded in parts there.
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary given as the text of its JSON file."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        byte = _byte_of_char()
        ranks = {
            bytes(byte[c] for c in token): i
            for token, i in model["model"]["vocab"].items()
            if token not in self.special
        }
        self._core = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = sorted(self.special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        # By id: whether its token closes a sentence or clause, is a line break, or starts with white space.
        self.closes, self.pauses, self.breaks, self.opens = (np.zeros(size, bool) for _ in range(4))
        for token, i in ranks.items():
            self.closes[i] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
            self.pauses[i] = token[-1:] in (b",", b";", b":")
            self.breaks[i] = b"\n" in token
            self.opens[i] = token[:1].isspace()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as uint32; strings of special tokens become their ids."""
        parts: list[np.ndarray] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                parts.append(np.array([self.special[part]], np.uint32))
                continue
            at = 0
            while at < len(part):
                cut = _SAFE.search(part, at + PIECE) if len(part) - at > PIECE else None
                stop = cut.start() if cut else len(part)
                parts.append(np.array(self._core.encode_ordinary(part[at:stop]), np.uint32))
                at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def padding(length: int, window: int = WINDOW) -> int:
    """What a sequence is padded by: nothing at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int, last: bool) -> list[int]:
    """The cuts with the least padding plus cut costs.

    ``places`` are the ascending positions where a cut is possible, from the start on, with no gap
    above ``window``; a window lies between two chosen cuts. With ``last`` the final cut is the final
    place, otherwise the cheapest one within a window of it. The cost of a window that ends at p and
    starts at q is window - (p - q), so among the starts in reach the one with the least cost so far
    plus q is best: a monotone queue holds the candidates. Starts at a distance of a power of two,
    where nothing is padded, are looked up besides.
    """
    n = len(places)
    at = np.full(int(places[-1] - places[0]) + 1, -1, np.int32)
    shifted = places - places[0]
    at[shifted] = np.arange(n, dtype=np.int32)
    exact: dict[int, list[int]] = {}
    step = 1
    while step <= window:
        ends = np.flatnonzero(shifted >= step)
        starts = at[shifted[ends] - step]
        hit = starts >= 0
        for end, start in zip(ends[hit].tolist(), starts[hit].tolist(), strict=True):
            exact.setdefault(end, []).append(start)
        step *= 2
    place, cost = shifted.tolist(), costs.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    keys = [0.0] * n
    for i in range(1, n):
        p = place[i]
        while p - place[queue[0]] > window:
            queue.popleft()
        start = queue[0]
        low = keys[start] + window - p
        if i in exact:
            for j in exact[i]:
                if best[j] < low:
                    low, start = best[j], j
        low += cost[i]
        best[i], came[i] = low, start
        key = keys[i] = low + p
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    end = n - 1
    if not last:
        tail = int(np.searchsorted(shifted, shifted[-1] - window))
        end = min(range(max(1, tail), n), key=lambda i: (best[i], -i))
    cuts = [end]
    while end:
        end = came[end]
        cuts.append(end)
    return cuts[::-1]


@dataclass
class _Span:
    key: object
    start: int
    ids: np.ndarray
    total: int


class Packer:
    """Collects the ids of documents in order and gives the pieces of full blocks."""

    def __init__(self, encoder: Encoder, window: int = WINDOW, block: int = BLOCK) -> None:
        self.encoder, self.window, self.block = encoder, window, block
        self.spans: list[_Span] = []
        self.held = 0
        self.sequence = 0

    def add(self, key: object, text: str) -> Iterator[tuple]:
        ids = np.append(self.encoder.encode(text), np.uint32(END_ID))
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.spans.append(_Span(key, at, part, len(ids)))
            self.held += len(part)
            if self.held >= self.block:
                yield from self._flush(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._flush(last=True)

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a cut is possible, and what it costs there."""
        e, n = self.encoder, len(ids)
        cost = np.full(n + 1, -1, np.int32)
        next_opens = np.append(e.opens[ids[1:]], True)
        cost[1:][e.pauses[ids] & next_opens] = BETWEEN_CLAUSES
        cost[1:][e.closes[ids] & next_opens | e.breaks[ids]] = BETWEEN_SENTENCES
        at = 0
        for span in self.spans:
            at += len(span.ids)
            if span.start + len(span.ids) == span.total:
                cost[at] = BETWEEN_DOCS
        cost[0] = BETWEEN_DOCS
        if cost[n] < 0:
            cost[n] = ANYWHERE
        # Wide gaps get further places, so that a window always ends somewhere.
        step = max(1, self.window // 4)
        found = np.flatnonzero(cost >= 0)
        for i in np.flatnonzero(np.diff(found) > step).tolist():
            cost[np.arange(found[i] + step, found[i + 1], step)] = ANYWHERE
        places = np.flatnonzero(cost >= 0)
        return places, cost[places]

    def _flush(self, last: bool) -> Iterator[tuple]:
        ids = np.concatenate([s.ids for s in self.spans])
        places, costs = self._places(ids)
        cuts = places[choose_cuts(places, costs, self.window, last)].tolist()
        spans, which, used = self.spans, 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while a + offset < b:
                span = spans[which]
                take = min(b - a - offset, len(span.ids) - used)
                part = span.ids[used : used + take]
                yield (
                    span.key,
                    span.start + used,
                    take,
                    zlib.crc32(part.astype("<u4").tobytes()),
                    span.total,
                    self.sequence,
                    offset,
                )
                offset += take
                used += take
                if used == len(span.ids):
                    which, used = which + 1, 0
            self.sequence += 1
        rest = spans[which:]
        if used:
            rest[0] = _Span(rest[0].key, rest[0].start + used, rest[0].ids[used:], rest[0].total)
        self.spans, self.held = rest, sum(len(s.ids) for s in rest)


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    name = zlib.crc32(vocabulary.encode())
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the documents of its input partition in their order, so no text is shuffled and
    any partition can be packed again on its own. A document is its ids and then ``END_ID``. Cuts are
    chosen over blocks of ``block`` tokens, and what follows the last cut of a block goes on into the
    next one, so a task holds one batch of texts, the ids of its longest document and one block.
    Sequences are numbered by partition (upper bits) and place (lower 33 bits).

    A null or empty text is a document of ``END_ID`` alone. Repeated rows and null keys are packed
    like others; an empty table gives no rows; other columns are ignored. Of equally cheap cuts the
    one met first is taken. ``vocabulary_path`` is read by the driver; the file (1.5 MB) is
    broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = rows.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_encoder(vocabulary.value), window, block)
        first = TaskContext.get().partitionId() << 33
        key_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) or [()] * 7
            arrays = [pa.array(columns[0], key_type)]
            arrays += [pa.array(c, pa.int64()) for c in columns[1:5]]
            arrays += [pa.array([first + s for s in columns[5]], pa.int64()), pa.array(columns[6], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            key_type = batch.column(0).type
            pieces: list[tuple] = []
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                pieces += packer.add(doc.as_py(), body.as_py() or "")
            yield batch_of(pieces)
        if key_type is not None:
            yield batch_of(list(packer.finish()))

    longs = ", ".join(f"`{n}` bigint" for n in names[1:])
    return rows.mapInArrow(work, f"`{key}` {kind}, {longs}")
