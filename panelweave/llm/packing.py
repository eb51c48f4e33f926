"""Tokenising, cutting and best-two-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import lean, lean_group, pick, texts, type_of

#: Entries, some 200 bytes each, that a worker's table of known chunks may hold before it becomes the table before.
KNOWN = 250_000
#: Text that is packed together, in bytes: one bin per group stays partly empty, and a task packs a group, ids and all.
GROUP_BYTES = 16_000_000


def best_two_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; no bin's lengths exceed the capacity, and every item is in one bin.

    A bin is filled greedily with the longest unpacked item that fits. Then, as long as this fills it more tightly,
    its smallest item is replaced with the two unpacked items that best fit the gap it leaves. A length over the
    capacity raises ValueError. Items of equal length go in the order given, last first.
    """
    if len(lengths) and max(lengths) > capacity:
        raise ValueError("an item is longer than a bin")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths):
        waiting[n].append(i)
    there = sum(1 << n for n in range(capacity + 1) if waiting[n])  # bit n: an item of length n waits

    def longest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most >= 0 else -1

    def two(most: int, least: int) -> tuple[int, int]:
        """Lengths of the two waiting items with the largest sum over ``least`` and up to ``most``."""
        best, a = (-1, -1), longest(most)
        while a >= 0 and 2 * a > least:
            b = longest(min(a, most - a))
            if b == a and len(waiting[a]) < 2:
                b = longest(a - 1)
            if b >= 0 and a + b > least:
                best, least = (a, b), a + b
                if least == most:
                    break
            a = longest(a - 1)
        return best

    bins = []
    while there:
        own: list[int] = []
        gap = capacity
        while (n := longest(gap)) >= 0:
            own.append(waiting[n].pop())
            gap -= n
            if not waiting[n]:
                there &= ~(1 << n)
        while gap and len(own) > 1:
            small = own[-1] if lengths[own[-1]] <= min(lengths[i] for i in own) else min(own, key=lambda i: lengths[i])
            pair = two(gap + lengths[small], lengths[small])
            if pair[0] < 0:
                break
            own.remove(small)
            for n in pair:
                own.append(waiting[n].pop())
                if not waiting[n]:
                    there &= ~(1 << n)
            waiting[lengths[small]].append(small)
            there |= 1 << lengths[small]
            gap += lengths[small] - sum(pair)
        bins.append(own)
    return bins


class Recent:
    """A table of bounded size: what was asked for lately stays, the rest goes."""

    def __init__(self, most: int = KNOWN):
        self.most, self.now, self.before = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}


class Chunks:
    """Token ids, as little-endian 32-bit words, of chunks between ASCII white space.

    The vocabulary drops white space and never joins over it, so a text's ids are those of its chunks in a row. Chunks
    of Latin letters and ASCII marks are cut into the vocabulary's words here and looked up word by word, as new chunks
    are mostly known words with a mark; other chunks go through the whole tokenizer.
    """

    # The characters cut here (lower case stays among them, and they are composed), and the words.
    PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
    WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text
        self.model = self.tokenizer.model
        # The vocabulary writes a byte as a letter: printable ones as they are, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.forget()

    def forget(self) -> None:
        """Empty both tables. A worker lives on between tasks and all workers of an executor take turns, so what each of them kept would add up."""
        self.chunks, self.words = Recent(), Recent()

    def ids(self, text: bytes) -> bytes:
        words = text.split()
        if len(self.chunks.now) > self.chunks.most:
            self.chunks.turn()
            self.words.turn()
        known, before = self.chunks.now, self.chunks.before
        for w in set(words).difference(known):
            known[w] = before.get(w) or self.new(w)
        return b"".join(map(known.__getitem__, words))

    def new(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if not self.PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        out, now, before = [], self.words.now, self.words.before
        for word in self.WORD.findall(text.lower()):
            ids = now.get(word)
            if ids is None:
                ids = before.get(word)
                if ids is None:
                    written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                    ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
                now[word] = ids
            out.append(ids)
        return b"".join(out)


_CHUNKS: dict[str, Chunks] = {}
#: What a document costs a group besides its text, in bytes.
PIECE_BYTES = 64


def token_pieces(documents: DataFrame, vocabulary: str, length: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = True) -> DataFrame:
    """The token ids of every document, ended by ``end`` and cut only where they exceed ``length``.

    Returns per piece: the id, ``piece`` (from 0), ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit words), ``turn`` (how often the task has met this id
    and piece before, so that repeated rows differ) and, if wanted, ``ids``. A null or empty text is the end id alone.
    """
    rows = pick(documents, id=id_col, text=text_col)
    kind = f"id {type_of(rows, 'id')}, piece int, start bigint, length bigint, ids_crc32 bigint, turn bigint" + ", ids array<int>" * keep_ids
    stop, size = end.to_bytes(4, "little"), 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = _CHUNKS.setdefault(vocabulary, Chunks(vocabulary)) if vocabulary not in _CHUNKS else _CHUNKS[vocabulary]
        row = 0
        try:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    part = batch.slice(lo, 256)
                    at, piece, start, n, crc, ids, turn = [], [], [], [], [], [], []
                    for i, text in enumerate(texts(part.column(1))):
                        data = chunks.ids(text) + stop
                        for k in range(0, len(data), size):
                            own = data[k:k + size]
                            at.append(i)
                            piece.append(k // size)
                            start.append(k // 4)
                            n.append(len(own) // 4)
                            crc.append(zlib.crc32(own))
                            turn.append(row)
                            if keep_ids:
                                ids.append(own)
                            row += 1
                    columns = [part.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc, turn))]
                    names = ["id", "piece", "start", "length", "ids_crc32", "turn"]
                    if keep_ids:
                        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * keep_ids)
        finally:
            chunks.forget()

    return rows.mapInArrow(lean(run), kind).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 1, spread: Sequence[str] = ("turn",)) -> DataFrame:
    """Best-two-fit packing of pieces by their column ``length``; every input row comes back once.

    Adds ``sequence_id`` (any distinct numbers) and ``offset`` (place in the sequence, gapless from 0). Pieces are
    dealt over ``groups`` by a hash of the columns ``spread``, which must tell repeated rows apart, and every group
    is packed on its own. A group's worth of lengths is all that a task holds; at most one bin per group is left
    much emptier than packing in one group would leave it.
    """
    names = [c for c in pieces.columns]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*spread), F.lit(groups)).cast("int"))
    kind = ", ".join(f"`{c}` {type_of(pieces, c)}" for c in names) + ", sequence_id bigint, offset bigint"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_pylist()
        order = sorted(range(len(lengths)), key=lambda i: lengths[i])
        bins = best_two_fit([lengths[i] for i in order], capacity)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for b, own in enumerate(bins):
            at = 0
            for k in own:
                i = order[k]
                sequence[i], offset[i] = (key[0].as_py() << 32) + b, at
                at += lengths[i]
        return rows.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("__group").applyInArrow(lean_group(run), kind)


def pack_documents(documents: DataFrame, vocabulary: str, length: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   keep_ids: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece with its sequence and place.

    Nulls, empty texts and repeated rows are documents like others; no documents give no rows. Texts are measured first,
    to form as many packing groups as keep one group small: pieces have a bounded length and are dealt by hash, so a group
    holds about as many tokens as any other, whether of few long documents or of many short ones.
    """
    size = documents.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + PIECE_BYTES)).first()[0]
    groups = max(1, -(-(size or 0) // group_bytes))
    pieces = token_pieces(documents, vocabulary, length, end, id_col, text_col, keep_ids)
    return pack(pieces, length, groups, (id_col, "piece", "ids_crc32", "turn")).drop("turn")
