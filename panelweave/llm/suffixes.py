"""Removal of repeated byte strings by a sparse suffix array over all documents.

Every string of ``width`` bytes is anchored at one of the byte grams inside it: the one with the smallest hash, the first
of equals. Equal strings have the same anchor, so only suffixes that start at anchors are sorted, some one in forty.
Sampled splitters deal them over buckets by their leading bytes and, where many begin alike, by the hash of their gram; a
bucket sorts its suffixes key by key, and strings of equal suffixes are compared there. Splitters never divide equal grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import merged, partitions, pick, staged, texts, unpacked

#: Bytes in the grams that anchors are chosen among.
GRAM = 24
#: Bytes of text that one bucket stands for, at about, and anchors that a task holds before it hands them on.
BUCKET_BYTES, HELD = 1_500_000, 400_000
#: Documents whose suffixes are sampled for the splitters.
SAMPLED = 2_000
_CHUNK = 1 << 18
_TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ANCHOR = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("more", "<u1"), ("left", "<u2"), ("right", "<u2")])
RANGE = np.dtype([("doc", "<i8"), ("at", "<i4"), ("to", "<i4")])


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of strings from the hashes of their two parts."""
    out = left * _M1
    out += right
    out ^= out >> np.uint64(29)
    out *= _M2
    return out


class Hashes:
    """Hashes of the strings of certain lengths at every place of a buffer."""

    def __init__(self, data: np.ndarray, width: int):
        self.width = width
        self.by = {1: _TABLE[data]}
        size = 1
        while 2 * size <= min(32, width):
            self.by[2 * size] = _join(self.by[size][:-size or None], self.by[size][size:])
            size *= 2

    def of(self, length: int) -> np.ndarray:
        """Of the strings of this length at every place where they fit."""
        return self.at(length, np.arange(max(0, len(self.by[1]) - length + 1)))

    def at(self, length: int, places: np.ndarray) -> np.ndarray:
        out, done = None, 0
        for size in sorted(self.by, reverse=True):
            while length - done >= size:
                part = self.by[size][places + done]
                out = part if out is None else _join(out, part)
                done += size
        return out


def _buffers(rows: Iterator[tuple[int, bytes]], width: int) -> Iterator[tuple[list[tuple[int, int, int, int]], bytes]]:
    """Texts, long ones in overlapping pieces, put together: pieces (place in buffer, length, id, start in text)."""
    pieces, parts, size = [], [], 0
    for doc, text in rows:
        for lo in range(0, max(1, len(text) - width + 1), _CHUNK):
            part = text[lo:lo + _CHUNK + width - 1]
            if len(part) < width:
                continue
            pieces.append((size, len(part), doc, lo))
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                yield pieces, b"".join(parts)
                pieces, parts, size = [], [], 0
    if pieces:
        yield pieces, b"".join(parts)


def _anchors(pieces: list[tuple[int, int, int, int]], data: bytes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of strings with one anchor, as ANCHOR rows, and their leads: the first six bytes at the anchor, then 16 bits that differ between
    grams, so that splitters can divide whatever text but equal grams.

    A run is the strings that start at ``at`` to ``at + more``; ``gram`` is the hash of the anchor's gram, ``whole`` that
    of all bytes under the run and of where the anchor lies in them. ``left`` and ``right`` are short hashes of the bytes
    next to the gram, half of what a string has beside it: equal strings agree in one of the two. Where a text has too
    few bytes on a side, its strings need the other side, and any value will do.
    """
    x = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        hashes = Hashes(x, width)
        grams = hashes.of(gram)
        low = np.uint64((1 << 20) - 1)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, size = width - gram + 1, 1  # grams in a string
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[:len(key) - (span - size)], key[span - size:])
        anchor = (key & low).astype(np.int64)
        place, length, doc, start = (np.array(v, np.int64) for v in zip(*pieces))
        strings = length - width + 1
        first = np.cumsum(strings) - strings
        s = np.arange(int(strings.sum())) + np.repeat(place - first, strings)
        a = anchor[s]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
        s1, a1 = s[cut], a[cut]
        s2 = s[np.concatenate([cut[1:] - 1, [len(s) - 1]])]
        piece = np.searchsorted(place, s1, side="right") - 1
        out = np.empty(len(cut), ANCHOR)
        out["gram"] = grams[a1]
        out["whole"] = _join(_join(hashes.at(width, s1), hashes.at(width, s2)), ((s2 - s1) * 4096 + (a1 - s1)).astype(np.uint64))
        out["doc"], out["at"], out["more"] = doc[piece], s1 - place[piece] + start[piece], s2 - s1
        half = (width - gram) // 2
        begin, end = place[piece], place[piece] + length[piece]
        none = ((out["doc"].astype(np.uint64) * _M1) ^ (out["at"].astype(np.uint64) * _M2)) * _M1
        before, behind = a1 - half >= begin, a1 + gram + half <= end
        for name, there, start in (("left", before, a1 - half), ("right", behind, a1 + gram)):
            value = none.copy()
            value[there] = hashes.at(half, start[there]) * _M1
            out[name] = value >> np.uint64(48)
        lead = np.zeros(len(cut), np.uint64)
        for k in range(min(6, gram)):
            lead = (lead << np.uint64(8)) | x[a1 + k]
        # Anchors have small hashes: mixed once more, all 16 bits are used.
        lead = (lead << np.uint64(16)) | ((grams[a1] ^ (grams[a1] >> np.uint64(32))) * _M1 >> np.uint64(48))
    return out, lead


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by gram, whole, document and place; which are the first of their gram and whole; which repeat an earlier one.

    Rows of one place, from equal rows of the input, do not repeat each other.
    """
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["whole"], rows["gram"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["whole"][1:] != rows["whole"][:-1])
    return rows, new, _after_first(new, rows["doc"], rows["at"])


def _after_first(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In sorted runs that begin where ``new`` is set: which stand at another place than their run's first."""
    if not len(new):
        return new
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[first]) | (at != at[first])


def _shared(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows have another row's gram and side."""
    order = np.lexsort((side, gram))
    out = np.zeros(len(gram), bool)
    if len(gram) > 1:
        same = (gram[order][1:] == gram[order][:-1]) & (side[order][1:] == side[order][:-1])
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def _ranges(rows: np.ndarray) -> np.ndarray:
    """Starts of removed strings as ranges, neighbours joined."""
    out = np.empty(len(rows), RANGE)
    out["doc"], out["at"], out["to"] = rows["doc"], rows["at"], rows["at"] + rows["more"]
    return _joined(out)


def _joined(out: np.ndarray) -> np.ndarray:
    if not len(out):
        return out
    out = out[np.lexsort((out["at"], out["doc"]))]
    new = np.flatnonzero(np.concatenate([[True], (out["doc"][1:] != out["doc"][:-1]) | (out["at"][1:] > out["to"][:-1] + 1)]))
    joined = out[new].copy()
    joined["to"] = np.maximum.reduceat(out["to"], new)
    return joined


def _table(ranges: np.ndarray, kind: int, gram: np.ndarray | None = None) -> pa.Table:
    n = len(ranges)
    return pa.table({"doc": pa.array(ranges["doc"]), "at": pa.array(ranges["at"]), "to": pa.array(ranges["to"]), "kind": pa.array(np.full(n, kind, np.int32)),
                     "gram": pa.array(np.zeros(n, np.int64) if gram is None else gram.view(np.int64))})


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = GRAM,
                   bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start; strings do not cross documents, may overlap, and are
    judged on the input. Returns one row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256`` (of the remaining bytes) and, if wanted, ``kept`` (these bytes).

    Ids are whole numbers; rows with a null id come first and are one document. Null texts count as empty. Rows of one
    id are versions of one document: equal rows do not repeat each other, and what is removed from one version is
    removed, by its place, from all. Texts shorter than the width lose nothing; long ones are read in pieces.
    Strings are compared by 64-bit hashes of all their bytes.

    The documents' texts are read twice, and move compressed to meet what was found in them. Equal runs of strings are
    reduced to their first one per task before they are moved, so a passage that a third of all documents share
    sends one row per task.
    """
    rows = pick(documents, doc=F.coalesce(documents[id_col].cast("bigint"), F.lit(-(1 << 63))), text=F.coalesce(documents[text_col].cast("string"), F.lit("")))
    spark = documents.sparkSession
    count, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(4 * partitions(spark), -(-(total or 0) // bucket_bytes))
    splitters = _splitters(rows, count, buckets, width, gram)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leads, size = [], [], 0
        for pieces, data in _buffers(((d, t) for batch in batches for d, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)))), width):
            found, lead = _anchors(pieces, data, width, gram)
            held.append(found)
            leads.append(np.searchsorted(splitters, lead, side="right").astype(np.int32))
            size += len(found)
            if size >= HELD:
                yield _dealt(np.concatenate(held), np.concatenate(leads), buckets)
                held, leads, size = [], [], 0
        if size:
            yield _dealt(np.concatenate(held), np.concatenate(leads), buckets)

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        done = np.frombuffer(b"".join(x for x in table.column("done").to_pylist() if x), RANGE)
        suffixes, new, later = _sorted(np.frombuffer(b"".join(x for x in table.column("data").to_pylist() if x), ANCHOR))
        first = suffixes[new]
        again = _shared(first["gram"], first["left"]) | _shared(first["gram"], first["right"])  # may hold equal strings
        open_ = np.empty(int(again.sum()), RANGE)
        own = first[again]
        open_["doc"], open_["at"], open_["to"] = own["doc"], own["at"], own["at"] + own["more"]
        return pa.concat_tables([_table(_joined(np.concatenate([done, _ranges(suffixes[later])])), 1), _table(open_, 2, own["gram"])])

    found = rows.mapInArrow(scan, "bucket int, data binary, done binary").groupBy("bucket").applyInArrow(sort, "doc bigint, at int, to int, kind int, gram bigint")
    by_doc = found.groupBy("doc").agg(F.collect_list(F.when(F.col("kind") == 1, F.struct("at", "to"))).alias("sure"),
                                      F.collect_list(F.when(F.col("kind") == 2, F.struct("at", "to", "gram"))).alias("open"))
    joined = rows.mapInArrow(_packed, "doc bigint, n_bytes bigint, sha string, data binary").join(by_doc, "doc", "left")
    hit = F.col("sure").isNotNull()
    joined = staged(joined.select("doc", "n_bytes", F.when(~hit, F.col("sha")).alias("sha"), F.when(hit | F.lit(with_text), F.col("data")).alias("data"), "sure", "open"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                yield from _open_strings(batch.slice(lo, 64), width)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        return _later(table)

    contested = joined.where(F.size("open") > 0).select("doc", "data", "open").mapInArrow(strings, "gram bigint, doc bigint, at int, hashes binary")
    late = contested.withColumn("bucket", F.pmod(F.col("gram"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(decide, "doc bigint, at int, to int")
    late = late.groupBy("doc").agg(F.collect_list(F.struct("at", "to")).alias("late"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sha, kept = [], [], [], []
            lists = zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            for data, (old, sure, more) in zip(unpacked(batch.column(3)), lists):
                cut = merged([(r["at"], min(r["to"] + width, len(data))) for r in [*(sure or ()), *(more or ())] if r["at"] < len(data)]) if old is None else []
                left, at = [], 0
                for a, b in cut:
                    left.append(data[at:a])
                    at = b
                left.append(data[at:])
                rest = b"".join(left)
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                sha.append(old or hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    plain = joined.where("sha is not null").select("doc", "n_bytes", "sha", "data", "sure", F.lit(None).cast("array<struct<at:int,to:int>>").alias("late"))
    cut = joined.where("sha is null").join(late, "doc", "left").select("doc", "n_bytes", "sha", "data", "sure", "late")
    if not with_text:
        done = plain.select("doc", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    kind = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    out = plain.unionByName(cut).mapInArrow(finish, kind) if with_text else cut.mapInArrow(finish, kind).drop("kept").unionByName(done)
    return out.withColumn("doc", F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))).withColumnRenamed("doc", id_col)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way between stages, with their length and hash."""
    compressor = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        n, sha, data = [], [], []
        for text in texts(batch.column(1)):
            n.append(len(text))
            sha.append(hashlib.sha256(text).hexdigest())
            data.append(compressor.compress(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(data, pa.binary())],
                                         names=["doc", "n_bytes", "sha", "data"])


def _splitters(rows: DataFrame, count: int, buckets: int, width: int, gram: int) -> np.ndarray:
    """Leads that cut a sample of the suffixes into equal parts."""
    if not count:
        return np.zeros(0, np.uint64)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, data in _buffers(((0, t) for t in texts(batch.column(0))), width):
                lead = np.unique(_anchors(pieces, data, width, gram)[1])
                few = lead[np.random.default_rng(len(lead)).permutation(len(lead))[:20_000]]
                yield pa.RecordBatch.from_arrays([pa.array([few.tobytes()], pa.binary())], names=["leads"])

    taken = rows.select("text").sample(fraction=min(1.0, SAMPLED / count), seed=9).mapInArrow(leads, "leads binary").collect()
    lead = np.sort(np.concatenate([np.frombuffer(r[0], np.uint64) for r in taken] or [np.zeros(0, np.uint64)]))
    return np.unique(lead[np.linspace(0, len(lead), buckets, endpoint=False)[1:].astype(int)]) if len(lead) else lead


def _dealt(rows: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: the first run of every kind in this task, and the repeats, which need no more comparing."""
    both = np.empty(len(rows), np.dtype([*ANCHOR.descr, ("bucket", "<i4")]))
    for name in ANCHOR.names:
        both[name] = rows[name]
    both["bucket"] = bucket
    both, new, later = _sorted(both)
    done = _ranges(both[later])
    both = both[new]
    both = both[np.argsort(both["bucket"], kind="stable")]
    own, at = both[list(ANCHOR.names)].astype(ANCHOR), both["bucket"]
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    ends = np.concatenate([edges[1:], [len(at)]])
    keys, data, sure = [int(at[e]) for e in edges], [own[a:b].tobytes() for a, b in zip(edges, ends)], [None] * len(edges)
    place = np.argsort(done["doc"] % buckets, kind="stable")
    done = done[place]
    where = done["doc"] % buckets
    edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, int)
    for a, b in zip(edges, np.concatenate([edges[1:], [len(where)]])):
        keys.append(int(where[a]))
        data.append(None)
        sure.append(done[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(data, pa.binary()), pa.array(sure, pa.binary())], names=["bucket", "data", "done"])


def _open_strings(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """For every run that is compared string by string: the hashes of its strings."""
    docs, at, gram, parts, size = [], [], [], [], []
    for doc, data, runs in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist()):
        for r in runs:
            part = data[r["at"]:r["to"] + width]
            if len(part) >= width:
                docs.append(doc)
                at.append(r["at"])
                gram.append(r["gram"])
                parts.append(part)
                size.append(len(part))
    if not docs:
        return
    with np.errstate(over="ignore"):
        hashes = Hashes(np.frombuffer(b"".join(parts), np.uint8), width).of(width)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    own = [hashes[b:b + n - width + 1].tobytes() for b, n in zip(begin, size)]
    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(own, pa.binary())],
                                     names=["gram", "doc", "at", "hashes"])


def _later(table: pa.Table) -> pa.Table:
    """Starts of strings of which an earlier one is equal, as ranges."""
    blobs = table.column("hashes").to_pylist()
    n = np.array([len(b) // 8 for b in blobs], np.int64)
    value = np.frombuffer(b"".join(blobs), np.uint64)
    doc = np.repeat(np.asarray(table.column("doc")), n)
    at = np.repeat(np.asarray(table.column("at")), n) + np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((at, doc, value))
    new = np.ones(len(value), bool)
    new[1:] = value[order][1:] != value[order][:-1]
    kept = order[_after_first(new, doc[order], at[order])]
    out = np.empty(len(kept), RANGE)
    out["doc"], out["at"], out["to"] = doc[kept], at[kept], at[kept]
    out = _joined(out)
    return pa.table({"doc": pa.array(out["doc"]), "at": pa.array(out["at"]), "to": pa.array(out["to"])})
