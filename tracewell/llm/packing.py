"""Packing by minimum bin slack: subset sums as a bitset choose the remainders that fill a sequence closest to its capacity.

Every whole ``capacity`` ids of a document are a sequence of their own; what remains of it, shorter than that, waits in
a window.  Each sequence takes the longest remainder and then the multiset of others whose sum comes closest to the
room left (one bit for each reachable sum, one snapshot for each length and power-of-two count, walked back to
counts).  Where no multiset fills a sequence, the next window may; once as many remainders wait as the window holds, and
at a task's end, one is split to close the gap.  The very last ids go to sequences whose lengths are powers of two, which
are not padded.  No shuffle: a task packs the rows it reads, holding
one window.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import rows_of, table, texts, trimmed
from .tokenizing import BYTE_BPE, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
CAPACITY = 1024
#: Remainders a task holds before it packs, and at most between two batches of texts.
WINDOW = 4096


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest not over ``room``: length -> how many."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((k for k in counts if k <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


class Packer:
    """Collects pieces; ``rows`` holds finished ones."""

    def __init__(self, capacity: int, first_sequence: int, window: int) -> None:
        self.capacity, self.sequence, self.window = capacity, first_sequence, window
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, step = len(ids) // 4, 4 * self.capacity
        whole = n // self.capacity * step
        for at in range(0, whole, step):
            self.place([(doc_id, at // 4, ids[at : at + step], n)])
        if len(ids) > whole:
            self.pool[(len(ids) - whole) // 4].append((doc_id, whole // 4, ids[whole:], n))
            self.size += 1

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def pop(self, length: int) -> tuple:
        self.size -= 1
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        return piece

    def pack(self, last: bool) -> None:
        while self.size:
            longest = max(self.pool)
            counts = {k: len(v) - (k == longest) for k, v in self.pool.items()}
            chosen = fill({k: c for k, c in counts.items() if c}, self.capacity - longest)
            total = longest + sum(k * c for k, c in chosen.items())
            if total < self.capacity and not last and self.size < self.window:
                return  # the next window may close this gap
            pieces = [self.pop(longest)] + [self.pop(k) for k, c in chosen.items() for _ in range(c)]
            if total < self.capacity and self.size:
                doc_id, start, ids, n = self.pop(max(self.pool))
                cut = self.capacity - total
                pieces.append((doc_id, start, ids[: 4 * cut], n))
                self.pool[len(ids) // 4 - cut].append((doc_id, start + cut, ids[4 * cut :], n))
                self.size += 1
            elif total < self.capacity:
                self.scatter(pieces, total)
                return
            self.place(pieces)

    def scatter(self, pieces: list[tuple], total: int) -> None:
        """The last, partly filled sequence as sequences of powers of two, longest first."""
        for bit in range(total.bit_length() - 1, -1, -1):
            room = total & 1 << bit
            out = []
            while room:
                doc_id, start, ids, n = pieces.pop(0)
                take = min(room, len(ids) // 4)
                out.append((doc_id, start, ids[: 4 * take], n))
                if take < len(ids) // 4:
                    pieces.insert(0, (doc_id, start + take, ids[4 * take :], n))
                room -= take
            if out:
                self.place(out)

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(NAMES)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], NAMES)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, bool] = BYTE_BPE, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: every id, and the end id after each document, in exactly one piece.

    Null text is empty: one piece of the end id.  Null and repeated ``doc_id`` are kept as they are.  An empty table
    gives no pieces.  ``sequence_id`` is unique and made of the task's number and a count within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(*tokenizer), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 36, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, text = rows_of(batch.slice(at, 256), "doc_id", "text")
                for doc_id, b in zip(ids, enc.encode(text), strict=True):
                    packer.add(doc_id, b + end)
                    if packer.size >= window:
                        packer.pack(last=False)
                yield packer.taken()
        packer.pack(last=True)
        yield packer.taken()

    return texts(docs).mapInArrow(trimmed(run), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
