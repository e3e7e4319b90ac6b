"""Packing documents into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, freeing, id_text
from .vocab import byte_bpe, encoder

CAPACITY = 1024
#: Windows balanced against each other at once, and the longest piece that goes into such a balance.
WINDOWS, FRAGMENT = 96, 256
#: Tokens left free in each window of a balance, so that its sums can differ by a few.
SLACK = 2

#: Texts that are encoded at once.
ROWS = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` parts of near-equal sums.

    Each item starts as a partial partition of one filled and k - 1 empty parts.  The two partial partitions of
    the largest imbalance are merged again and again, the fullest parts of the one with the emptiest of the other.
    """
    if not sizes:
        return [[] for _ in range(k)]
    # A part is its sum and, in the low bits, a node of a binary forest: 1..n are items, later nodes join two.  Empty parts are
    # left out; a partial partition is the list of the others, the fullest first.
    low, joined = (2 * len(sizes)).bit_length(), []
    mask, nodes = (1 << low) - 1, len(sizes) + 1
    heap = [(-s, i, [s << low | i + 1]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    ties = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone = k - len(b)  # so many of the fullest parts of a meet empty ones
        parts = a[:alone] + b[: k - len(a)]
        for x, y in zip(a[alone:], b[k - len(a) :][::-1] if len(a) + len(b) > k else (), strict=True):
            parts.append(((x >> low) + (y >> low)) << low | nodes)
            joined.append((x & mask, y & mask))
            nodes += 1
        parts.sort(reverse=True)
        if len(parts) == k and (least := parts[-1] >> low << low):
            parts = [x - least for x in parts]  # only differences matter
        heapq.heappush(heap, (-(parts[0] >> low), ties, parts))
        ties += 1
    out = []
    for root in heap[0][2]:
        items, todo = [], [root & mask]
        while todo:
            n = todo.pop()
            if n > len(sizes):
                todo += joined[n - len(sizes) - 1][::-1]
            else:
                items.append(n - 1)
        out.append(items)
    return out + [[] for _ in range(k - len(out))]


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``; their count rises from the least possible until none exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


class _Packer:
    """Packs what one task reads; holds the pieces of one balance at most."""

    def __init__(self, task: int, capacity: int):
        self.capacity, self.next_id = capacity, task << 33
        self.pool: list[tuple] = []  # (doc, start, length, crc, doc_tokens)
        self.filled = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n, cap = len(ids) // 4, self.capacity
        whole = n // cap
        for w in range(whole):
            self.rows.append((doc, w * cap, cap, zlib.crc32(ids[w * cap * 4 : (w + 1) * cap * 4]), n, self.next_id, 0))
            self.next_id += 1
        at, room = whole * cap, WINDOWS * (cap - SLACK)
        while at < n:
            length = min(FRAGMENT, n - at, room - self.filled)
            self.pool.append((doc, at, length, zlib.crc32(ids[at * 4 : (at + length) * 4]), n))
            self.filled += length
            at += length
            if self.filled == room:
                self.flush()

    def flush(self) -> None:
        if not self.pool:
            return
        for part in balanced([p[2] for p in self.pool], self.capacity):
            offset = 0
            for i in sorted(part):
                doc, start, length, crc, n = self.pool[i]
                self.rows.append((doc, start, length, crc, n, self.next_id, offset))
                offset += length
            self.next_id += 1
        self.pool, self.filled = [], 0


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it starts and what window (``sequence_id``, ``offset``) holds it.

    A document's ids are those of its whole text (null: empty) and ``end_id``.  Full windows are cut off a document
    while it has them; what is left of it is cut into fragments, which are balanced over about WINDOWS windows
    at a time.  The work needs no shuffle: each task packs what it reads, in bounded memory, and its windows'
    ids start at its own number.  Only the last balance of a task can leave more than a few free places.

    Rows that repeat are packed as often; a null id stays null; an empty table gives no piece; other columns are ignored.
    """
    schema = arrow_schema(PIECES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId(), capacity)

        def ready(at_least: int):
            if len(packer.rows) > at_least:
                columns = zip(*packer.rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
                packer.rows = []

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for doc, b in zip(some.column(0).to_pylist(), enc.ids(some.column(1)), strict=True):
                    packer.add(doc, b + end)
                    yield from ready(50_000)
        packer.flush()
        yield from ready(0)

    return id_text(docs, id_col, text_col).mapInArrow(freeing(task), PIECES)


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, byte_bpe())
