"""What workers hold at once, and what they keep between tasks."""

import time

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from panelweave.llm import packing, passages, quality
from panelweave.llm.common import latin_words
from panelweave.llm.queries import word_bpe


def test_workers_keep_no_tables_between_tasks(spark):
    frame = spark.createDataFrame([(i, f"some words and number {i} of w{i}x") for i in range(200)], "doc_id bigint, text string").coalesce(1)
    assert packing.token_pieces(frame, word_bpe()).count() == 200
    model = quality.Model(np.zeros(1 << quality.BITS), 0.0, 1.0, 0.0)
    assert quality.keep_good(frame, model, 0.0).count() == 200

    def kept(batches):
        from panelweave.llm import packing, quality

        for _ in batches:
            n = sum(len(t) for c in packing._CHUNKS.values() for x in (c.chunks, c.words) for t in (x.now, x.before))
            yield pa.RecordBatch.from_arrays([pa.array([n + (quality._GRAMS is not None)], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(32, numPartitions=32).mapInArrow(kept, "n bigint").collect()} == {0}


def test_words_from_a_table_of_fixed_size():
    rng = np.random.default_rng(3)
    own = ["x" * k for k in range(40)] + ["жжжжжжжжжжжж", "中文", "a1"] + [str(i) * 3 for i in range(500)]
    for table in (passages.Words(), passages.Words(64)):
        for text in (b"", b" ", b"A a", b"a.", b" b"):
            assert table.hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in latin_words(text)]
        for _ in range(20):
            text = " ".join(rng.choice(own, 300)).encode()
            assert table.hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in latin_words(text)]
        assert len(table.known) in (64, passages.KNOWN)


def rows_of_keys(docs):
    """Keys of one hot seed and one other, each in very many documents."""
    rows = np.zeros(2 * docs, passages.KEY)
    rows["key"], rows["doc"] = np.repeat([5, 9], docs), np.tile(np.arange(docs), 2)
    rows["a"], rows["seeds"] = np.repeat([3, 30], docs), 1
    rows["x"], rows["y"] = np.arange(2 * docs) // 2 + 1, np.tile(np.arange(docs), 2) % 7 + 1
    return rows


def test_pairs_of_a_frequent_key_are_formed_block_by_block(monkeypatch):
    rows = rows_of_keys(300)
    monkeypatch.setattr(passages, "PAIRS", 1_000)
    _, many, blocks = passages._to_meet(rows["key"], rows["x"], rows["doc"], rows["seeds"] == 1)
    blocks = list(blocks)
    assert not many.any() and len(blocks) > 50 and max(len(i) for i, _ in blocks) <= 1_000
    got = {(min(a, b), max(a, b)) for i, j in blocks for a, b in zip(i.tolist(), j.tolist())}
    key, x, doc = (rows[f].tolist() for f in ("key", "x", "doc"))
    assert got == {(a, b) for a in range(600) for b in range(a + 1, 600) if key[a] == key[b] and x[a] != x[b] and doc[a] != doc[b]}
    assert sum(len(i) for i, _ in blocks) == len(got)


def test_matches_of_keys_do_not_depend_on_the_size_of_blocks(monkeypatch):
    def found():
        table = passages._keyed(rows_of_keys(300), 3)
        return table.num_rows, {tuple(m) for m in passages._held(table, passages.MATCHES, passages.MATCH).tolist()}

    whole = found()
    monkeypatch.setattr(passages, "PAIRS", 700)
    monkeypatch.setattr(passages, "MOST", 2_000)
    parts = found()
    assert whole[1] == parts[1] and len(whole[1]) > 60_000 and parts[0] > whole[0]
    monkeypatch.undo()


def test_seeds_of_many_texts_at_once():
    rng = np.random.default_rng(5)
    texts = [b" ".join(b"w%d" % w for w in rng.integers(0, 400, n)) + end for n in (0, 3, 4, 6, 9, 10, 300, 1, 40) for end in (b"", b" . ", "\u00e7".encode())]
    got = passages._ordered(passages._seeds_of(list(range(len(texts))), texts, passages.Words(), passages.WORDS, passages.WINDOW))
    parts = []
    for doc, text in enumerate(texts):
        grams = passages.grams_of(passages.Words().hashes(text), passages.WORDS)
        at = passages.picked(grams, passages.WINDOW)
        parts.append(np.zeros(len(at), passages.SEED))
        parts[-1]["seed"], parts[-1]["run"], parts[-1]["doc"], parts[-1]["at"] = grams[at], passages.runs(grams, at, passages.WORDS, passages.RUN), doc, at
    assert (got == passages._ordered(np.concatenate(parts))).all()
    for text, (words, spans) in zip(texts, passages._words_in(texts)):
        assert len(words) == len(spans) and (spans == passages.word_spans(text)).all()


def test_matches_that_run_forward_are_chained_without_search(monkeypatch):
    """The diagonal moves by some words at every match, and one gap is out of reach."""
    found = np.zeros(20, passages.MATCH)
    found["doc"], found["at"] = 1, np.arange(20) * 9 + np.repeat([0, 60], 10)
    found["there"] = found["at"] + np.arange(20) % 3
    want = passages._chained(found, passages.WORDS, 50).to_pylist()
    monkeypatch.setattr(passages, "chains", None)
    assert passages._chained(found, passages.WORDS, 50).to_pylist() == want and [len(c["at"]) for c in want] == [10, 10]


def test_words_without_a_common_one_need_no_table():
    n = 20_000  # a table of 400 million places before
    a = np.arange(3 * n)
    assert passages.edits(a[:n], a[n:]) == (0, 2 * n)
    assert passages.edits(np.concatenate([a[:5], a[n:2 * n], a[-5:]]), np.concatenate([a[:5], a[2 * n:-5], a[-5:]])) == (10, 10 + n)


def test_one_side_of_a_chain_is_sent():
    """Of two texts the words of the smaller document around the chain go to the larger one, without those further away."""
    line = [f"same{k}" for k in range(60)]
    texts = {3: [f"a{k}" for k in range(300)] + line + [f"b{k}" for k in range(300)], 7: ["c"] * 5 + line + ["d"] * 900}
    own = pa.table({"doc": pa.array(list(texts), pa.int64()), "data": [zstandard.compress(" ".join(t).encode()) for t in texts.values()]})
    chained = pa.table({"doc": pa.array([7], pa.int64()), "other": pa.array([3], pa.int64()), "at": pa.array([[5, 25, 61]], pa.list_(pa.int32())), "there": pa.array([[300, 320, 356]], pa.list_(pa.int32()))})
    cut = passages._cut(own, chained, passages.WORDS)
    assert cut.num_rows == 1 and len(cut["words"][0].as_py()) <= 4 * (60 + 4 * passages.BLOCK)
    (row,) = passages._aligned(own, cut, passages.WORDS, 50, 0.8).to_pylist()
    one, two = (" ".join(texts[d]) for d in (7, 3))
    assert one[row["start"]:row["end"]] == two[row["other_start"]:row["other_end"]] == " ".join(line) and row["n_words"] == 60


def test_shuffle_files_go_with_their_step(spark):
    """Once a table is staged, shuffles of the steps before it are no longer kept, but for the last ones."""
    from panelweave.llm.common import settled

    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    settled(spark.range(10))
    before = tracker.shuffleStatuses().size()
    kept = [settled(spark.range(1000).repartition(3, "id").groupBy("id").count()) for _ in range(8)]
    for _ in range(50):
        if tracker.shuffleStatuses().size() < before + 4:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() < before + 4 and sum(x.count() for x in kept) == 8000
