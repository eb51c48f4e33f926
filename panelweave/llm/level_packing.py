"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Every task packs the documents it reads as they come, so neither texts nor token ids move between machines.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelweave.llm.common import pick, texts, type_of
from panelweave.llm.packing import Chunks

#: Tokens in partly filled windows that a task holds at once; beyond them all these windows are filled up and closed.
HELD_TOKENS = 8_000_000
_CHUNKS: dict[str, Chunks] = {}

#: A piece: the number of its document's row, the ids of the document before it, its own ids as 32-bit words.
Piece = tuple[int, int, bytes]


class Levels:
    """How many partly filled windows there are at each fill level, and which.

    The sum of the squares of these counts is kept small: levels that hold many windows take no more of them, so that
    there is a window of nearly every gap when a document of that size comes.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int32)  # by the room that is left; that of full windows stays 0
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]

    def best(self, size: int) -> int:
        """The room, all of it for a new window, in which an item of this size makes the sum of squares grow least.

        Among equals the fullest window is taken. The size is over 0 and below the capacity.
        """
        before = self.count[size:self.capacity]
        change = self.count[:self.capacity - size] - before  # half of the growth, less one
        change[before == 0] = np.iinfo(np.int32).max
        at = int(change.argmin())
        growth = 2 * int(change[at]) + 2 - (at == 0)  # a window that is full counts no more
        return size + at if growth <= 2 * int(self.count[self.capacity - size]) + 1 else self.capacity

    def place(self, size: int, item: object) -> list | None:
        """Put an item where it belongs; the window's items if they fill it now."""
        room = self.best(size)
        window = self._take(room) if room < self.capacity else []
        window.append(item)
        if room == size:
            return window
        self.count[room - size] += 1
        self.windows[room - size].append(window)
        return None

    def _take(self, room: int) -> list:
        self.count[room] -= 1
        return self.windows[room].pop()

    def close(self) -> list[list]:
        """All partly filled windows, fullest first; none is left."""
        out = [w for own in self.windows for w in own]
        self.__init__(self.capacity)
        return out


def cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    row, start, ids = piece
    return (row, start, ids[:4 * tokens]), (row, start + tokens, ids[4 * tokens:])


def filled_up(windows: list[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    """Windows without padding from partly filled ones, given fullest first.

    The emptiest windows are taken apart to fill the gaps of the fullest, and a piece is cut where it does not fit. The
    tokens that remain, fewer than a window's, make windows whose sizes are powers of two.
    """
    waiting = deque(windows)
    while waiting:
        own = waiting.popleft()
        gap = capacity - sum(len(piece[2]) for piece in own) // 4
        while gap and waiting:
            donor = waiting[-1]
            piece = donor.pop()
            if len(piece[2]) > 4 * gap:
                piece, rest = cut(piece, gap)
                donor.append(rest)
            own.append(piece)
            gap -= len(piece[2]) // 4
            if not donor:
                waiting.pop()
        if not gap:
            yield own
            continue
        rest, left = deque(own), capacity - gap
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[Piece] = []
            while size:
                piece = rest.popleft()
                if len(piece[2]) > 4 * size:
                    piece, tail = cut(piece, size)
                    rest.appendleft(tail)
                part.append(piece)
                size -= len(piece[2]) // 4
            yield part


def pack_online(documents: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text",
                keep_ids: bool = True, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """Token ids of all documents, ended by ``end`` and packed into sequences of at most ``capacity`` tokens.

    Returns one row per piece of a document: the id, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit words), ``doc_tokens`` (all ids of the document),
    ``sequence_id`` (any distinct numbers), ``offset`` (place in the sequence, gapless from 0) and, if wanted, ``ids``.

    A document's full windows are cut off first and are sequences of their own; what is left of it goes to the fill
    level that keeps the sum of squared level counts smallest. Partly filled windows are closed when the task's rows
    end, or when they hold ``held_tokens`` tokens: then the emptiest fill up the others, and what remains of less than
    a window becomes sequences of a power of two tokens. So no sequence needs padding, every id is
    in one piece, and a task holds a bounded number of tokens besides the document at hand.

    A null or empty text is the end id alone. Null ids are kept, repeated rows are documents of their own, and no rows
    give no rows. Other columns are left out, whatever their names.
    """
    rows = pick(documents, id=id_col, text=text_col)
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    kind = f"id {type_of(rows, 'id')}, " + ", ".join(f"{c} bigint" for c in numbers) + ", ids array<int>" * keep_ids
    stop, size = end.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if vocabulary not in _CHUNKS:
            _CHUNKS[vocabulary] = Chunks(vocabulary)
        chunks, levels = _CHUNKS[vocabulary], Levels(capacity)
        sequence = TaskContext.get().partitionId() << 33
        known: dict[int, tuple] = {}  # id and tokens of documents with a piece in a partly filled window
        out: list[tuple] = []
        held = row = 0

        def closed(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for number, start, ids in window:
                out.append((*known[number], start, ids, sequence, at))
                at += len(ids) // 4
            sequence += 1

        def settle() -> None:
            nonlocal held
            for window in filled_up(levels.close(), capacity):
                closed(window)
            known.clear()
            held = 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            ids, tokens, start, data, own, offset = zip(*out)
            n = [len(d) // 4 for d in data]
            columns = [pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in (start, n, [zlib.crc32(d) for d in data], tokens, own, offset))]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=["id", *numbers] + ["ids"] * keep_ids)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                data = chunks.ids(text) + stop
                known[row] = (key, len(data) // 4)
                for k in range(0, len(data) - size + 1, size):
                    closed([(row, k // 4, data[k:k + size])])
                left = len(data) % size
                if left:
                    held += left // 4
                    window = levels.place(left // 4, (row, (len(data) - left) // 4, data[len(data) - left:]))
                    if window:
                        closed(window)
                        held -= capacity
                        for number in {p[0] for p in window}:
                            del known[number]
                else:
                    del known[row]
                row += 1
                if held > held_tokens:
                    settle()
                while len(out) >= 1024:
                    yield batch_of(out[:1024])
                    del out[:1024]
        settle()
        for k in range(0, len(out), 1024):
            yield batch_of(out[k:k + 1024])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
