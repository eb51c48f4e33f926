"""Near-duplicate documents by bottom-k sketches of their shingles.

A sketch is the k smallest values of one hash function over a document's shingles. Inverted lists of retained values
say which sketches overlap, the sketch of the union estimates the similarity, and full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import arrow_schema, batch_of, lean, pick, space_words, staged, texts
from panelweave.llm.links import components

#: Values that a sketch retains.
RETAINED = 64
#: Of two sketches of similar sets, how many of the union's retained values both hold at least. For a similarity of
#: 0.8 their number has mean 51 and deviation 3.2; fewer than 34 have a chance of three in ten million.
SHARED = 34
#: Bits of the parity maps of a sketch and of a whole set.
SKETCH_BITS, SET_BITS = 256, 512
KNOWN = 300_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingles:
    """64-bit hashes of the distinct shingles of a text."""

    def __init__(self, size: int):
        self.size, self.at = size, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted; a text of fewer words than a shingle has one, and one without words none."""
        if not words:
            return np.zeros(0, np.uint64)
        at = self.at
        try:
            h = np.fromiter([at[w] for w in words], np.uint64, len(words))
        except KeyError:
            if len(at) > KNOWN:
                at.clear()
            for w in words:
                if w not in at:
                    at[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter([at[w] for w in words], np.uint64, len(words))
        n = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, np.uint64(n)) * _M2
            for k in range(n):
                out = (out ^ h[k:len(h) - n + 1 + k]) * _M1
                out ^= out >> np.uint64(29)
                out *= _M2
                out ^= out >> np.uint64(32)
        return np.unique(out)


def shingle_set(text: bytes, size: int) -> set[tuple[bytes, ...]]:
    words = space_words(text)
    n = min(size, len(words))
    return set(zip(*[words[k:] for k in range(n)])) if n else set()


def sketches(rows: DataFrame, size: int, retained: int) -> DataFrame:
    """Per row: id, ``n`` (distinct shingles), ``digest`` of the whole set (null without words), ``sketch`` and ``bits``.

    Bits are two parity maps, of the sketch and of the whole set: every value flips one bit. Where two maps differ, the
    sets do, so their differing bits never outnumber the values that one set alone has.
    """
    schema = arrow_schema("id bigint, n bigint, digest binary, sketch array<bigint>, bits array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            n, digest, sketch, bits = [], [], [], []
            for text in texts(batch.column(1)):
                h = shingles.hashes(space_words(text))
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sketch.append(h[:retained].view(np.int64))
                bits.append(np.concatenate([parity(h[:retained], SKETCH_BITS), parity(h, SET_BITS)]))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64)))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * ((SKETCH_BITS + SET_BITS) // 64)),
                                            pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield batch_of(schema, [batch.column(0), n, digest, flat, maps])

    return rows.mapInArrow(lean(run), "id bigint, n bigint, digest binary, sketch array<bigint>, bits array<bigint>")


def parity(values: np.ndarray, size: int) -> np.ndarray:
    odd = np.bincount((values % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80,
                    retained: int = RETAINED, shared: int = SHARED) -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles overlap by ``similarity`` per cent or more.

    Returns one row per input row: the id, ``n_shingles``, ``component_id`` (the smallest id that links reach) and
    ``kept`` (that is its own id). Ids are whole numbers. Texts with fewer words than a shingle have one shingle;
    null texts and texts without words have none, link with nothing and stay. Rows with a null id stay on their own
    and have no component. Rows of one id count as linked, and so do equal texts.

    Documents with equal sets are one class, of which the smallest id stands for all. Classes meet in inverted lists:
    of a sketch only the ``len - needed + 1`` rarest values are listed, as two sketches that share ``needed`` values
    share one of those, so a value that a third of all documents retain lists few. In every list all members meet a
    member picked at random for that list; this joins groups of copies without forming their pairs. Members of one
    list that are then still in different components meet in pairs, of which the parity maps pass only those that can
    be similar. So no link is missed but by the odds of SHARED.
    """
    rows = pick(documents, id=documents[id_col].cast("bigint"), text=text_col)
    sketched = staged(sketches(rows, size, retained))
    linkable = sketched.where("id is not null and digest is not null")
    classes = staged(linkable.groupBy("digest").agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")))
    lists = staged(_rare_lists(classes, similarity, shared))
    listed = lists.select("class").distinct()
    listed = staged(classes.join(listed, "class").select("class", "n", F.size("sketch").alias("held"), "sketch", "bits"))

    lot = F.xxhash64("value", "class")
    hubs = lists.groupBy("value").agg(F.min_by(F.struct("class", "n"), lot).alias("hub"))
    pairs = lists.join(hubs, "value").where((F.col("class") != F.col("hub.class")) & _alike(F.col("n"), F.col("hub.n"), similarity))
    near = _estimated(pairs.select(F.col("class").alias("a"), F.col("hub.class").alias("b")), listed, similarity, shared)
    first = _verified(near, rows, size, similarity)
    reached = staged(components(first))

    placed = lists.join(reached, lists["class"] == reached["node"], "left").select("value", "class", "n", F.coalesce("component", "class").alias("component"))
    mixed = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("value")
    own = lists.groupBy("class").agg(F.collect_list("value").alias("values"))
    placed = staged(placed.join(mixed, "value").join(listed.select("class", "held", "bits"), "class").join(own, "class"))
    left, right = (placed.select("value", *[F.col(c).alias(f"{c}_{side}") for c in ("class", "n", "held", "bits", "component", "values")]) for side in "ab")
    once = F.array_min(F.array_intersect("values_a", "values_b")) == F.col("value")  # of the lists that two share, one forms the pair
    pairs = left.join(right, "value").where((F.col("component_a") < F.col("component_b")) & _alike(F.col("n_a"), F.col("n_b"), similarity)
                                            & _close(similarity, shared) & once)
    near = _estimated(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), listed, similarity, shared)
    second = _verified(near, rows, size, similarity)

    copies = linkable.select("id", "digest").join(classes.select("digest", "class"), "digest").where("id != class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    reached = components(first.unionByName(second).unionByName(copies))
    out = sketched.join(reached, sketched["id"] == reached["node"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80) -> DataFrame:
    """One row, with all its columns, of every group of near duplicates: that of the smallest id.

    Rows with a null id all stay; of several rows with one id one stays.
    """
    found = near_duplicates(documents, id_col, text_col, size, similarity)
    kept = found.where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rows = documents.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return rows.unionByName(documents.where(F.col(id_col).isNull()))


def _alike(a: Column, b: Column, similarity: int) -> Column:
    """Whether sets of these sizes can be as similar as asked, in per cent."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _rare_lists(classes: DataFrame, similarity: int, shared: int) -> DataFrame:
    """(value, class, n) for the rarest retained values of each class, without values that one class alone retains.

    Values are ranked by how many classes retain them, and values retained once come first: they take their room, but
    form no list.
    """
    # Sets that are similar without being equal are not smaller than this.
    large = classes.where(F.col("n") * (100 - similarity) >= F.lit(similarity))
    rows = large.select("class", F.explode("sketch").alias("value"))
    often = rows.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    rows = rows.join(often, "value")
    by_class = Window.partitionBy("class")
    ranked = rows.select("class", "value", F.row_number().over(by_class.orderBy("often", "value")).alias("rank"), F.count(F.lit(1)).over(by_class).alias("common"))
    needed = F.least(F.ceil(F.col("n") * similarity / 100), F.lit(shared))
    room = large.select("class", "n", F.size("sketch").alias("held"), (F.size("sketch") - needed + 1).alias("room"))
    return ranked.join(room, "class").where("rank + held - common <= room").select("value", "class", "n")


def _estimated(pairs: DataFrame, listed: DataFrame, similarity: int, shared: int) -> DataFrame:
    """The distinct pairs whose sketches share as many values as those of similar sets do."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (listed.select(*[F.col(c).alias(f"{c}_{side}") for c in listed.columns]) for side in "ab")
    both = pairs.join(a, F.col("a") == F.col("class_a")).join(b, F.col("b") == F.col("class_b")).where(_close(similarity, shared))
    return staged(both.where(F.size(F.array_intersect("sketch_a", "sketch_b")) >= _needed(similarity, shared)).select("a", "b"))


def _needed(similarity: int, shared: int) -> Column:
    """Values that sketches of similar sets share, by the larger set's size."""
    return F.least(F.ceil(F.greatest("n_a", "n_b") * similarity / 100), F.lit(shared))


def _close(similarity: int, shared: int) -> Column:
    """Whether the parity maps differ in no more bits than similar sets, and sketches of such, differ in values."""
    differing = lambda lo, hi: sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(lo, hi)), F.lit(0))
    cut, end = SKETCH_BITS // 64, (SKETCH_BITS + SET_BITS) // 64
    sketches_close = differing(0, cut) <= F.col("held_a") + F.col("held_b") - 2 * _needed(similarity, shared)
    return sketches_close & (differing(cut, end) * (100 + similarity) <= (F.col("n_a") + F.col("n_b")) * (100 - similarity))


def _verified(near: DataFrame, rows: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs whose full sets of shingles, made from the texts anew, are similar."""
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    full = rows.join(ends, "id").groupBy("id").agg(F.min("text").alias("text"))
    a, b = (full.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3))):
                x, y = shingle_set(x, size), shingle_set(y, size)
                both = len(x & y)
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return staged(near.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a bigint, b bigint"))
