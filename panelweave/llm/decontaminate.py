"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Every word of the benchmark becomes a symbol, every window of words a pattern over these symbols, and a
document is scanned once as a string of symbols. Words that the benchmark lacks break all matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.common import LATIN_WORD, latin_words, lean, merged, pick, texts, type_of

#: Benchmark text that one automaton takes, in bytes; a larger benchmark is scanned for in several passes.
PART_BYTES = 600_000
_BUILT: dict[int, "Windows"] = {}


def _symbol(i: int) -> str:
    """The i-th of the characters that stand for words; surrogates are left out, and 0 means no such word."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


class Windows:
    """The automaton over the windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            words = latin_words(text)
            line = "".join(self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in words)
            for at in range(max(1, len(line) - size + 1) if line else 0):
                owners.setdefault(line[at:at + size], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, found in owners.items():
            self.automaton.add_word(window, (len(window), sorted(found)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges under occurring windows, and the items these windows belong to."""
        if self.empty:
            return [], set()
        get = self.symbols.get
        ranges, items = [], set()
        for end, (length, owners) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            ranges.append((end + 1 - length, end + 1))
            items.update(owners)
        return merged(ranges), items


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as ranges of code points in the original text."""
    if not ranges:
        return []
    at = [m.span() for m in LATIN_WORD.finditer(_lower(text.decode("utf-8", "replace")))]
    return [{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in ranges]


_UPPER = {i: i + 32 for i in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_UPPER)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """Where documents repeat windows of benchmark items.

    Returns one row per input row: the id, ``n_words``, ``n_hit`` (words inside an occurring window), ``items``
    (ids of the items, sorted as strings), ``spans`` (start and end of hit passages in code points of the original
    text) and ``contaminated``: some word is hit and ``share * n_hit >= n_words``.

    An item shorter than the window is one window; one without words matches nothing. A null text has no words and a
    null item id counts as the id ``null``. Repeated rows give repeated rows, items with the same id count once, an
    empty benchmark hits nothing. The benchmark is measured first and split into parts of ``part_bytes`` by hash: the
    documents pass through one automaton after the other in the same job, without a shuffle, so an automaton in a
    task stays small whatever the benchmark's size.
    """
    out = pick(documents, id=id_col, text=text_col)
    found = f"id {type_of(out, 'id')}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    out = _scan(out, "text", pick(benchmark, item=benchmark[item_col].cast("string"), text=item_text_col), window, part_bytes, _measured, found)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               window: int = 13, share: int = 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows that the benchmark does not contaminate, with all their columns; other cases as in find_overlaps."""
    def kept(batch: pa.RecordBatch, words: list[int], ranges: list[list[tuple[int, int]]], owners: list[list[str]]) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in own) for own in ranges]
        return batch.filter(pa.array([not (h > 0 and h * share >= n) for h, n in zip(hit, words)], pa.bool_()))

    items = pick(benchmark, item=benchmark[item_col].cast("string"), text=item_text_col)
    return _scan(documents, text_col, items, window, part_bytes, kept, documents.schema)


def _measured(batch: pa.RecordBatch, words: list[int], ranges: list[list[tuple[int, int]]], owners: list[list[str]]) -> pa.RecordBatch:
    spans = [offsets(text, own) for text, own in zip(texts(batch.column(1)), ranges)]
    hit = [sum(b - a for a, b in own) for own in ranges]
    columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(owners, pa.list_(pa.string())), pa.array(spans, _RANGES)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_hit", "items", "spans"])


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(rows: DataFrame, text_col: str, items: DataFrame, size: int, part_bytes: int, finish: Callable, result) -> DataFrame:
    """Scan with one automaton after the other; the last pass hands batches and all findings to ``finish``.

    Between passes the findings travel in two more columns, under names that the rows do not have.
    """
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    names = rows.columns
    hidden = ["_" * (n + max(map(len, names))) for n in (1, 2)]
    between = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"`{hidden[0]}` array<struct<start:int,end:int>>, `{hidden[1]}` array<string>").fields])
    for part in range(parts):
        own = [("null" if r[0] is None else r[0], (r[1] or "").encode())
               for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()]
        last = part == parts - 1
        rows = rows.mapInArrow(lean(_scanner(own, size, names.index(text_col), len(names), hidden, part == 0, finish if last else None)), result if last else between)
    return rows


def _scanner(items: list[tuple[str, bytes]], size: int, at: int, width: int, hidden: list[str], first: bool, finish: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((tuple(items), size))
        if key not in _BUILT:
            _BUILT.clear()  # one automaton at a time in a reused worker
            _BUILT[key] = Windows(items, size)
        windows = _BUILT[key]
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                before = ((), ()) if first else (batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())
                n_words, ranges, owners = [], [], []
                for i, text in enumerate(texts(batch.column(at))):
                    words = latin_words(text)
                    own, found = windows.scan(words)
                    if not first:
                        own = merged(own + [(r["start"], r["end"]) for r in before[0][i]])
                        found = found.union(before[1][i])
                    n_words.append(len(words))
                    ranges.append(own)
                    owners.append(sorted(found))
                given = batch.select(list(range(width)))
                if finish:
                    yield finish(given, n_words, ranges, owners)
                else:
                    spans = pa.array([[{"start": a, "end": b} for a, b in own] for own in ranges], _RANGES)
                    yield pa.RecordBatch.from_arrays([*given.columns, spans, pa.array(owners, pa.list_(pa.string()))], names=given.schema.names + hidden)
    return run
