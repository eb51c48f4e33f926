"""Alignment of the tokens that two vocabularies make of the same text.

Both vocabularies cut the bytes of a text. Where both cut at the same place a group of tokens ends; inside a group
tokens overlap across common bytes. Groups are found by pointer jumping: every token points to its overlapping token
that reaches farthest to the right, and doubling these pointers leads each to the last token of its group.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import pick, texts, type_of
from panelweave.llm.packing import Recent
from panelweave.session import scratch_path
from panelweave.sources.stores import write_table

#: Links that a block of documents may hold; a longer document is a block of its own.
BLOCK_LINKS = 2_000_000
#: Text that is aligned at once, in bytes; chunks longer than ``LONG`` characters are not remembered.
AT_ONCE, LONG = 1_000_000, 200
#: Chunks whose tokens a worker remembers, twice over.
KNOWN = 150_000

# A chunk starts with the spaces that follow a character other than white space. No token reaches over its start:
# the byte vocabulary's words begin there, and no piece has a space after anything but spaces (checked when loaded).
_START = re.compile(r"(?<=\S)(?= )")
_WIDE = re.compile(r"\s ")


class Vocabularies:
    """Both vocabularies, with the bytes of every token; ``a`` is a byte-level BPE file, ``b`` a piece model with byte fallback."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        special = {t["content"] for t in file["added_tokens"]}  # in a text these are ordinary characters
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        joined = [model["vocab"][x + y] for x, y in merges]
        if joined != sorted(joined):
            raise ValueError(f"the merges of {path_a} are not in the order of the ids they make")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"a piece of {path_b} reaches over the start of a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")  # of no text at all the model makes no token, not even this
        self.known = Recent(KNOWN)
        self.length_a, self.length_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))

    def chunks(self, text: str) -> list[str]:
        """The chunks of space and text, each without its first space."""
        return [c[1:] for c in _START.split(" " + text)] if text[0] == " " or _WIDE.search(text) else text.split(" ")

    def tokens(self, chunks: Iterable[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Both token id strings of every chunk, as 32-bit words; None where they do not spell the chunk."""
        self.known.turn()
        now, before = self.known.now, self.known.before
        out, new = {}, []
        for chunk in set(chunks):
            own = now.get(chunk, 0)
            if own == 0:
                own = before.get(chunk, 0)
                if own == 0:
                    new.append(chunk)
                    continue
                now[chunk] = own
            out[chunk] = own
        for chunk, b in zip(new, self.b.encode(new, num_threads=1)):
            b = b if chunk else [self.space]
            a, spelt = self.a.encode_ordinary(" " + chunk), (" " + chunk).encode("utf-8", "replace")
            fits = b"".join([self.bytes_a[i] for i in a]) == spelt == b"".join([self.bytes_b[i] for i in b])
            own = out[chunk] = (np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if fits else None
            if len(chunk) <= LONG:
                now[chunk] = own
        return out


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that two vocabularies make of the same bytes, given their ends: the group of each, from 0 in order.

    A token points to the overlapping token that reaches farthest to the right, the first vocabulary's before the
    second's, itself if none reaches farther. Pointers are doubled until every token points to its group's last one.
    """
    n = len(end_a)
    over_a = np.searchsorted(end_b, end_a)  # the second's token over a token's last byte, and the reverse
    over_b = np.searchsorted(end_a, end_b)
    at = np.concatenate([np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)) if n else over_a, over_b])
    while True:
        further = at[at]
        if np.array_equal(further, at):
            break
        at = further
    last = at[:n] == np.arange(n)
    number = np.cumsum(last) - 1
    return number[at[:n]], number[at[n:]]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a token of the first and one of the second that have bytes in common, in order."""
    if not len(end_a):
        return end_a, end_a
    start = np.concatenate([[0], end_a[:-1]])
    first, last = np.searchsorted(end_b, start, "right"), np.searchsorted(end_b, end_a)
    n = last - first + 1
    return np.repeat(np.arange(len(end_a)), n), np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def align(documents: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """The groups and links between the tokens of both vocabularies, one row per document.

    The first vocabulary encodes a space and the text, the second the text, to which it adds that space. Returns the id,
    ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links`` (pairs of overlapping tokens of either), ``groups_sha256``
    (of the ids of each group as ``a1,a2|b1;a3|b2,b3``), ``n_best`` (links whose pair of ids has the highest count of
    its second id, ties included) and ``count_sum`` (of the counts of all links); a pair's count is how many links of
    all documents join it.

    Null and empty texts, and texts whose tokens do not spell a space and the text, have no tokens: zeros and an empty
    ``groups_sha256``. Null ids are kept, repeated rows are documents of their own and count as often. No rows give no
    rows. Other columns are left out, whatever their names.

    A document's different pairs are kept with the document and summed by block of documents; only these sums are
    joined with the corpus-wide counts, and a block's answers meet its documents again.
    """
    spark = documents.sparkSession
    rows = pick(documents, id=id_col, text=text_col)
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    id_type = type_of(rows, "id")
    kind = f"id {id_type}, " + ", ".join(f"{c} bigint" for c in numbers) + ", groups_sha256 string, block bigint, pairs array<bigint>, times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(path_a, path_b, pattern)
        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, own, size = [], [], 0
            for i, text in enumerate(texts(batch.column(1))):
                ids.append(i)
                own.append(text)
                size += len(text)
                if size >= AT_ONCE or i + 1 == len(batch):
                    found, pairs, times = aligned(both, own)
                    blocks = []
                    for n in found["n_links"]:
                        if held and held + n > block_links:
                            block, held = block + 1, 0
                        blocks.append(block)
                        held += n
                    columns = [batch.column(0).take(pa.array(ids)), *(pa.array(found[c], pa.int64()) for c in numbers), pa.array(found["groups_sha256"], pa.string()),
                               pa.array(blocks, pa.int64()), pairs, times]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", *numbers, "groups_sha256", "block", "pairs", "times"])
                    ids, own, size = [], [], 0

    docs = spark.read.parquet(write_table(rows.mapInArrow(run, kind), scratch_path(spark, "aligned")))
    links = docs.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("link")).groupBy("block", F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("times"))
    links = spark.read.parquet(write_table(links, scratch_path(spark, "aligned-links")))
    counts = links.groupBy("pair").agg(F.sum("times").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.expr("pair & 4294967295L")))  # of a second id: as many rows as there are first ids
    answers = links.select("block", "pair").join(counts.select("pair", "count", (F.col("count") == highest).cast("long").alias("best")), "pair")

    result = f"id {id_type}, " + ", ".join(f"{c} bigint" for c in numbers) + ", groups_sha256 string, n_best bigint, count_sum bigint"
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_counted, result)
    return out.withColumnRenamed("id", id_col)


_LOADED: dict[tuple, Vocabularies] = {}


def _loaded(*key: str) -> Vocabularies:
    if key not in _LOADED:
        _LOADED[key] = Vocabularies(*key)
    return _LOADED[key]


def aligned(both: Vocabularies, documents: list[bytes]) -> tuple[dict[str, list], pa.Array, pa.Array]:
    """Numbers, digests, and different pairs with their times, of some documents; all are aligned as one line of bytes."""
    cut = []
    for text in documents:
        written = text.decode("utf-8", "replace")
        cut.append(both.chunks(written) if text and ("\ufffd" not in written or written.encode() == text) else [])
    tokens = both.tokens(c for own in cut for c in own)
    parts_a, parts_b, n_a, n_b = [], [], [], []
    for own in cut:
        found = [tokens[c] for c in own]
        if None in found:
            found = []
        parts_a.append(b"".join([a for a, _ in found]))
        parts_b.append(b"".join([b for _, b in found]))
        n_a.append(len(parts_a[-1]) // 4)
        n_b.append(len(parts_b[-1]) // 4)
    id_a, id_b = (np.frombuffer(b"".join(p), np.int32).astype(np.int64) for p in (parts_a, parts_b))
    end_a, end_b = np.cumsum(both.length_a[id_a]), np.cumsum(both.length_b[id_b])
    group_a, group_b = group_labels(end_a, end_b)
    of_a = np.repeat(np.arange(len(documents)), n_a)
    left, right = overlaps(end_a, end_b)

    # Different pairs by document: one sort of (document, pair).
    key = (id_a[left] << 32) | id_b[right]
    doc = of_a[left]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(documents)))]).astype(np.int32)
    pairs = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[new]))
    times = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.diff(np.append(new, len(key)))))

    last = np.flatnonzero(np.diff(group_a, append=-1)) if len(group_a) else np.empty(0, np.int64)
    found = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(of_a[last], minlength=len(documents)).tolist(), "n_links": np.bincount(of_a[left], minlength=len(documents)).tolist(),
             "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in _spelt(id_a, id_b, group_a, group_b, np.add(n_a, n_b))]}
    return found, pairs, times


_NUMBERS: list[bytes] = []


def _spelt(id_a: np.ndarray, id_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: np.ndarray) -> Iterator[bytes]:
    """The groups of every document, ``n`` tokens each, as text."""
    most = int(max(id_a.max(initial=0), id_b.max(initial=0)))
    for i in range(len(_NUMBERS) // 3, most + 1):
        _NUMBERS.extend((b"%d," % i, b"%d|" % i, b"%d;" % i))
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    in_a, in_b = (np.cumsum(np.bincount(g, minlength=groups)) for g in (group_a, group_b))
    codes = np.empty(len(id_a) + len(id_b), np.int64)
    before = np.concatenate([[0], in_b])
    codes[np.arange(len(id_a)) + before[group_a]] = 3 * id_a + (np.diff(group_a, append=groups) > 0)
    codes[np.arange(len(id_b)) + in_a[group_b]] = 3 * id_b + 2 * (np.diff(group_b, append=groups) > 0)
    at = 0
    for own in n.tolist():
        yield b"".join(map(_NUMBERS.__getitem__, codes[at:at + own].tolist()))[:-1]
        at += own


def _counted(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with what the counts of its pairs say of their links."""
    pair = answers.column("pair").to_numpy()
    order = np.argsort(pair)
    count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order]
    lists = docs.column("pairs").combine_chunks()
    at = np.searchsorted(pair[order], lists.flatten().to_numpy())
    times = docs.column("times").combine_chunks().flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    sums = []
    for value in (best, count):
        total = np.concatenate([[0], np.cumsum(times * value[at])])
        sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
    return docs.drop(["block", "pairs", "times"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1])
