"""Ranked lexical search of a query set against all documents, by buckets of impact vectors of similar length.

A document is the vector of its terms' impacts, an item the vector of its terms' weights, and a score their product.
Documents are dealt by the length of their vectors; the longest are searched first, and the scores found there let the
product of two lengths (Cauchy-Schwarz) rule out whole buckets of shorter ones. Inside a bucket the same bound over the
coordinates not yet looked at rules out documents, and what survives is scored in integers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import latin_words, pick, texts, type_of
from panelweave.session import scratch_path
from panelweave.sources.stores import write_table

#: Bits that tell whether some item may hold a term: what every task gets, however many items there are.
BITS = 1 << 21
#: Classes of documents by the length of their vectors, and terms of documents in one part of a class.
CLASSES, PART_TERMS = 16, 1_000_000
#: Items that meet a part at once, and documents in a bucket.
BLOCK_ITEMS, BUCKET = 2_048, 1_024
#: Room for the rounding of bounds, which are floating-point numbers; scores are integers.
SLACK = 1 + 1e-9


def _bit(term: bytes) -> int:
    return zlib.crc32(term) % BITS


def search(documents: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", part_terms: int = PART_TERMS, block_items: int = BLOCK_ITEMS, bucket: int = BUCKET) -> DataFrame:
    """The ``top`` documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``, under the given id names.

    Terms are the words of ``latin_words``; a term in df of the N documents that have terms weighs
    ``floor(1000 ln((2N+2) / (2df+1)))``, and a document of n terms, of L in all, gives a term that it holds tf times the
    impact ``10**9 tf div (1000 tf + 8 m)`` with ``m = 10 + 90 n N div L``. A score is the sum of weight times impact over
    the item's different terms, in 64-bit integers. Documents of score 0 are not ranked; equal scores go by ascending
    document id, null ids last. Results are exact: bounds only spare work.

    Null and empty texts have no terms: such documents are in no result and in no count, such items have no rows. Repeated
    documents are ranked each for itself. Repeated items, and items with a null id, are searched each for itself and give
    their rows each. No documents or no items give no rows. Other columns are left out, whatever their names. Classes are dealt
    in parts of some ``part_terms`` terms, and a part meets ``block_items`` items at once.
    """
    spark = documents.sparkSession
    queries = _items(pick(items, item_id=item_col, text=item_text_col))
    vectors = _documents(pick(documents, id=id_col, text=text_col), _bits(queries))
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    found = ", ".join(("item bigint", f"id {type_of(vectors, 'id')}", "score bigint"))
    if not n_terms:
        return _named(spark.createDataFrame([], found), queries, top, id_col, item_col)

    df = vectors.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = (queries.select("item", F.explode(F.split("terms", " ")).alias("term")).join(df, "term").select("item", "term", weight.alias("w")).where("w > 0")
               .groupBy("item").agg(F.collect_list("term").alias("words"), F.collect_list("w").alias("weights"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")))
    weighed = spark.read.parquet(write_table(weighed, scratch_path(spark, "search-items")))
    blocks = max(1, -(-weighed.count() // block_items))
    weighed = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))

    squares = F.aggregate("counts", F.lit(0.0), lambda s, x: s + F.pow(_impact(x, F.col("m")).cast("double"), F.lit(2)))
    vectors = (vectors.where("terms != ''").withColumn("m", F.expr(f"10L + (90L * n * {n_docs}L) div {n_terms}L"))
               .withColumn("length", F.sqrt(squares)).withColumn("row", F.monotonically_increasing_id()))
    edges = vectors.agg(F.percentile_approx("length", [1 - k / CLASSES for k in range(1, CLASSES)], 1000)).first()[0]
    vectors = vectors.withColumn("class", sum(((F.col("length") < e).cast("int") for e in edges or []), F.lit(0)))
    sizes = {r["class"]: (max(1, -(-r.terms // part_terms)), r.longest)
             for r in vectors.groupBy("class").agg(F.sum(F.size("counts")).alias("terms"), F.max("length").alias("longest")).collect()}
    part = F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*[F.lit(x) for c, (n, _) in sizes.items() for x in (c, n)]), F.col("class"))) if sizes else F.lit(0)
    vectors = vectors.withColumn("part", part.cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    vectors = vectors.select("class", "part", "block", "id", "terms", "counts", "m")

    # The class of the longest vectors first: its scores are thresholds for the others.
    first = min(sizes, default=0)
    best = _meet(vectors.where(F.col("class") == first), _dealt(weighed.withColumn("least", F.lit(0).cast("long")), {c: s for c, s in sizes.items() if c == first}), top, bucket, found)
    best = spark.read.parquet(write_table(_ranked(best, top), scratch_path(spark, "search-first")))
    least = best.where(F.col("rank") == top).select("item", F.col("score").alias("least"))
    rest = weighed.join(least, "item", "left").fillna(0, ["least"])
    others = _meet(vectors.where(F.col("class") != first), _dealt(rest, {c: s for c, s in sizes.items() if c != first}), top, bucket, found)
    return _named(best.drop("rank").unionByName(others), queries, top, id_col, item_col)


def _impact(count: Column, m: Column) -> Column:
    return F.call_function("div", F.lit(10**9).cast("long") * count, F.lit(1000).cast("long") * count + F.lit(8).cast("long") * m)


def _items(items: DataFrame) -> DataFrame:
    """The items numbered, with their different terms in one string; stored, so that numbers stay the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [b" ".join(sorted(set(latin_words(t)))).decode("utf-8", "replace") for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.string())], names=["item_id", "terms"])

    spark = items.sparkSession
    path = write_table(items.mapInArrow(run, f"item_id {type_of(items, 'item_id')}, terms string").where("terms != ''").withColumn("item", F.monotonically_increasing_id()),
                       scratch_path(spark, "search-queries"))
    return spark.read.parquet(path)


def _bits(queries: DataFrame) -> bytes:
    """Which of ``BITS`` classes of terms the items have: at most as many bits come to the driver, 64 in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = sorted({_bit(t) for text in texts(batch.column(0)) for t in text.split(b" ")})
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["bit"])

    words = queries.select("terms").mapInArrow(run, "bit bigint").select(F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bit"))
    out = np.zeros(BITS // 64, np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():
        out[word] = bits
    return out.astype("<i8").tobytes()


def _documents(documents: DataFrame, bits: bytes) -> DataFrame:
    """Per document: id, ``n`` terms with repeats, and those ``terms`` that some item may hold, with their ``counts``; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").tobytes()
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                total, terms, counts = [], [], []
                for text in texts(batch.column(1)):
                    words = latin_words(text)
                    own = {t: c for t, c in Counter(words).items() if may[_bit(t)]}
                    total.append(len(words))
                    terms.append(b" ".join(own).decode("utf-8", "replace"))
                    counts.append(list(own.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.list_(pa.int64()))],
                                                 names=["id", "n", "terms", "counts"])

    spark = documents.sparkSession
    rows = documents.mapInArrow(run, f"id {type_of(documents, 'id')}, n bigint, terms string, counts array<bigint>")
    return spark.read.parquet(write_table(rows, scratch_path(spark, "search-vectors")))


def _dealt(items: DataFrame, sizes: dict[int, tuple[int, float]]) -> DataFrame:
    """Items once for every part of the classes whose longest vector could reach their thresholds."""
    if not sizes:
        return items.where(F.lit(False)).withColumns({"class": F.lit(0), "part": F.lit(0)})
    classes = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(n).alias("parts"), F.lit(longest).alias("longest")) for c, (n, longest) in sizes.items()])
    reach = items.withColumn("at", F.explode(classes)).where(F.col("size") * F.col("at.longest") * SLACK >= F.col("least"))
    return reach.select("item", "words", "weights", "least", "block", "at.class", F.explode(F.sequence(F.lit(0), F.col("at.parts") - 1)).alias("part"))


def _meet(vectors: DataFrame, items: DataFrame, top: int, bucket: int, kind: str) -> DataFrame:
    """The best documents of every part for every item that reaches it."""
    keys = ("class", "part", "block")

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        ids, rows, scores = [], [], []
        for item, row, score in part_best(docs.column("terms"), docs.column("counts"), docs.column("m").to_numpy(), _order(docs.column("id")), asked, top, bucket):
            ids.append(np.full(len(row), item))
            rows.append(row)
            scores.append(score)
        at = pa.array(np.concatenate(rows) if rows else [], pa.int64())
        return pa.table([pa.array(np.concatenate(ids) if ids else [], pa.int64()), docs.column("id").take(at), pa.array(np.concatenate(scores) if scores else [], pa.int64())],
                        names=["item", "id", "score"])

    return vectors.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(run, kind)


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of every id in ascending order, nulls last."""
    at = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    out = np.empty(len(at), np.int64)
    out[at] = np.arange(len(at))
    return out


def part_best(terms: pa.ChunkedArray, counts: pa.ChunkedArray, m: np.ndarray, order: np.ndarray, asked: pa.Table, top: int,
              bucket: int = BUCKET) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every item asked for: its number, and the rows and scores of its best documents of this part."""
    if not len(m) or not len(asked):
        return
    words, n_words = asked.column("words").combine_chunks(), pc.list_value_length(asked.column("words")).to_numpy()
    vocabulary = pc.unique(words.flatten())
    item_terms = np.split(pc.index_in(words.flatten(), vocabulary).to_numpy(), np.cumsum(n_words)[:-1])
    item_weights = np.split(asked.column("weights").combine_chunks().flatten().to_numpy(), np.cumsum(n_words)[:-1])

    # Entries of all documents by document: term, impact. Terms that no item here has are left out.
    split = [t for text in terms.to_pylist() for t in text.split(" ")]
    term = pc.index_in(pa.array(split, vocabulary.type), vocabulary).fill_null(-1).to_numpy()
    count = counts.combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(m)), pc.list_value_length(counts).to_numpy())
    known = term >= 0
    term, row, count = term[known], row[known], count[known]
    impact = 10**9 * count // (1000 * count + 8 * m[row])
    square = np.bincount(row, impact.astype(float) ** 2, len(m))
    by_length = np.argsort(-square, kind="stable")
    by_length = by_length[square[by_length] > 0]
    start, end = np.searchsorted(row, by_length), np.searchsorted(row, by_length, "right")

    weight = np.zeros(len(vocabulary), np.int64)
    items = []  # terms by falling weight, their weights, the lengths of what remains after each
    for t, w in zip(item_terms, item_weights):
        falling = np.argsort(-w, kind="stable")
        t, w = t[falling], w[falling]
        items.append((t, w, np.sqrt(np.append(np.cumsum((w.astype(float) ** 2)[::-1])[::-1], 0.0))))
    least = asked.column("least").to_numpy().copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)
    active = list(range(len(items)))
    for lo in range(0, len(by_length), bucket):
        own, s, n = by_length[lo:lo + bucket], start[lo:lo + bucket], (end - start)[lo:lo + bucket]
        at = np.repeat(s - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        first = np.append(0, np.cumsum(n))
        t_of, p_of, d_of = term[at], impact[at], np.repeat(np.arange(len(own)), n)
        by_term = np.argsort(t_of, kind="stable")
        edge = np.searchsorted(t_of[by_term], np.arange(len(vocabulary) + 1))
        longest = float(np.sqrt(square[own[0]]))
        active = [i for i in active if items[i][2][0] * longest * SLACK >= max(least[i], 1)]
        if not active:
            break
        for i in active:
            t, w, rest = items[i]
            alive = _candidates(t, w, rest, by_term, edge, d_of, p_of, square[own], max(least[i], 1))
            if not len(alive):
                continue
            weight[t] = w
            entries = np.repeat(first[alive] - np.append(0, np.cumsum(n[alive])[:-1]), n[alive]) + np.arange(n[alive].sum())
            score = np.add.reduceat(weight[t_of[entries]] * p_of[entries], np.append(0, np.cumsum(n[alive])[:-1]))
            weight[t] = 0
            rows, scores = np.append(best[i][0], own[alive]), np.append(best[i][1], score)
            keep = np.lexsort((order[rows], -scores))[:top]
            keep = keep[scores[keep] > 0]
            best[i] = rows[keep], scores[keep]
            if len(keep) == top:
                least[i] = max(least[i], best[i][1][-1])
    numbers = asked.column("item").to_pylist()
    for i, (rows, scores) in enumerate(best):
        if len(rows):
            yield numbers[i], rows, scores


def _candidates(t: np.ndarray, w: np.ndarray, rest: np.ndarray, by_term: np.ndarray, edge: np.ndarray, d_of: np.ndarray, p_of: np.ndarray, square: np.ndarray,
                least: int) -> np.ndarray:
    """Documents of a bucket whose bound reaches ``least`` at every coordinate looked at, heaviest term first.

    The bound is the product over the coordinates seen so far, plus the product of the lengths of both remainders.
    Half of the terms are looked at; then the survivors are cheaper to score than to bound.
    """
    seen, product = np.zeros(len(square)), np.zeros(len(square))
    alive = np.ones(len(square), bool)
    for k in range(-(-len(t) // 2)):
        here = by_term[edge[t[k]]:edge[t[k] + 1]]
        product[d_of[here]] += float(w[k]) * p_of[here]
        seen[d_of[here]] += p_of[here].astype(float) ** 2
        alive &= (product + np.sqrt(np.maximum(square - seen, 0)) * rest[k + 1]) * SLACK >= least
    return np.flatnonzero(alive)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _named(found: DataFrame, queries: DataFrame, top: int, id_col: str, item_col: str) -> DataFrame:
    return _ranked(found, top).join(queries.select("item", "item_id"), "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"),
                                                                                     F.col("id").alias(id_col), "score")
