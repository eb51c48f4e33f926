"""Operators that compare documents with each other, against brute force on small fixtures."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import compare
from panelweave.llm import links, near_text, near_vectors, packing, passages, queries, suffixes

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, n_bytes string, component_id string, kept string, value string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", None, "y", "z") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])) == ""


def groups_of(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(60)] + [(500, 500 + k) for k in range(1, 50)] + [(None, 3), (7, 7)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    whole = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == groups_of({n for p in whole for n in p}, whole)
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    n = min(size, len(w))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([4, 6, 12, 60, 150, 300]))]
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    common = " ".join(rng.choice(vocabulary) for _ in range(60))  # a passage in many documents that are not alike
    rows += [common + " " + " ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, rows[0]), (906, rows[0]), (None, rows[1]), (907, "long " * 20_000)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    rows = near_rows()
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups_of(sets, pairs)
    got = near_text.near_duplicates(docs(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    if size == 5:
        one = near_text.keep_one(docs(spark, rows))
        assert one.columns == docs(spark, []).columns
        assert sorted(repr(r.doc_id) for r in one.collect()) == sorted([repr(i) for i in sets if want[i] == i] + ["None"])


def test_near_duplicates_without_rows(spark):
    assert near_text.near_duplicates(docs(spark, [])).count() == 0
    assert [r.kept for r in near_text.near_duplicates(docs(spark, [(1, None), (2, "")])).collect()] == [True, True]


def test_bound_on_shared_values():
    """The chance that two sketches of sets with similarity 0.8 share fewer values than SHARED."""
    from math import comb

    k, p = near_text.RETAINED, 0.8
    assert sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(near_text.SHARED)) < 2e-6


@pytest.mark.parametrize("strip", [4096, 7])
def test_near_vectors_equal_all_pairs(spark, strip):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((25, 16))
    rows = [(k, [float(x) for x in base[k % 25] + rng.standard_normal(16) * (0.35 if k % 3 else 0.1)]) for k in range(90)]
    rows += [(100 + k, rows[0][1]) for k in range(20)] + [(130, [2 * x for x in rows[0][1]]), (131, None), (132, []), (133, [0.0] * 16), (134, [float("nan")] + [1.0] * 15),
             (135, [None] + [1.0] * 15), (136, [float("inf")] + [0.0] * 15), (137, [1e200 * x for x in rows[0][1]]), (138, [1.0, 2.0, 3.0]), (139, [1.0, 2.0, 3.1]), (None, rows[0][1]), (140, [-0.0] * 16)]
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id bigint, embedding array<double>, label string, n_links int")
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}

    def cosine(a, b):
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9

    pairs = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and cosine(good[a], good[b])]
    want = groups_of({i for i, _ in rows if i is not None}, pairs)
    n = {i: sum(i in p for p in pairs) for i in want}
    got = near_vectors.near_vectors(frame, strip=strip).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.vec_id is None or (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id), r
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def removed(rows, width):
    """By id: (bytes, removed, runs, rest) after looking at every string of the width in order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        own = {}
        for p in range(len(b) - width + 1):
            s = b[p:p + width]
            if s in seen or own.setdefault(s, p) < p:
                cover[p:p + width] = b"x" * width
        seen |= own.keys()
        runs = bytes(cover).replace(b"\0", b" ").split()
        out[i] = (len(b), sum(map(len, runs)), len(runs), bytes(x for x, c in zip(b, cover) if not c))
    return out


def repeat_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(40), prose(25)
    rows = [(k, prose(rng.randint(0, 200)) + (passage if k % 3 == 0 else "") + prose(10) + (line[:rng.randint(80, 130)] if k % 2 else "")) for k in range(60)]
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, rows[5][1][30:-30]), (103, "ab" * 400), (104, "x" * 99), (105, "x" * 100), (106, "x" * 101), (107, None), (108, ""), (109, "x" * 700),
             (110, prose(60_000)), (111, passage), (112, passage * 3)]
    return rows


@pytest.mark.parametrize("bucket_bytes", [10**6, 500])
def test_repeats_equal_every_string(spark, bucket_bytes):
    rows = repeat_rows()
    got = suffixes.remove_repeats(docs(spark, rows), bucket_bytes=bucket_bytes, with_text=True).collect()
    want = removed(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        n, cut, runs, rest = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, cut, runs, rest), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(rest).hexdigest()


def test_repeats_of_rows_without_or_with_one_id(spark):
    text = "q" * 60 + "r" * 60
    got = suffixes.remove_repeats(docs(spark, [(None, text), (1, text), (1, text), (2, None)])).collect()
    assert sorted((repr(r.doc_id), r.n_removed) for r in got) == [("1", 120), ("1", 120), ("2", 0), ("None", 0)]
    same = suffixes.remove_repeats(docs(spark, [(1, text), (1, text), (3, "u" * 130), (3, "u" * 130)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in same) == [(1, 0), (1, 0), (3, 129), (3, 129)]
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("alphabet", ["абвгдежзиклмнопрстуф ", "的一是不了人我在有他这中大来上", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"])
def test_splitters_divide_any_script(spark, alphabet):
    rng = random.Random(3)
    found = [("".join(rng.choice(alphabet) for _ in range(4000)),) for _ in range(20)]
    splitters = suffixes._splitters(spark.createDataFrame(found, "text string"), len(found), 16, 100, suffixes.GRAM)
    (pieces, data), = suffixes._buffers(enumerate(t.encode() for t, in found), 100)
    rows, lead = suffixes._anchors(pieces, data, 100, suffixes.GRAM)
    sizes = np.bincount(np.searchsorted(splitters, lead, side="right"), minlength=16)
    assert sizes.max() < 2 * sizes.mean()
    twice, again = suffixes._anchors(*next(suffixes._buffers([(0, data[:5000]), (1, b"x" * 200 + data[:5000])], 100)), 100, suffixes.GRAM)
    leads = {}
    for g, k in zip(twice["gram"].tolist(), again.tolist()):
        assert leads.setdefault(g, k) == k  # equal grams meet


def test_hashes_agree_wherever_a_string_stands():
    data = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint8)
    with np.errstate(over="ignore"):
        hashes = suffixes.Hashes(data, 100).of(100)
    by = {}
    for p in range(len(hashes)):
        by.setdefault(data[p:p + 100].tobytes(), set()).add(int(hashes[p]))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_passages(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(3000)] + ["the", "of", "and"] * 300
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, common = prose(70), prose(60)
    rows, holds = [], {}
    for k in range(40):
        own = list(passage) if k % 4 == 0 else list(common) if k % 2 else prose(60)
        if k % 8 == 0:
            for p in (9, 25, 26, 50):
                own[p] = "changed"
            del own[40]
        holds[k] = "passage" if k % 4 == 0 else "common" if k % 2 else None
        rows.append((k, " ".join([*prose(rng.randint(5, 90)), *own, *prose(rng.randint(5, 90))])))
    rows += [(50, " ".join(passage[:30])), (51, None), (52, ""), (None, rows[0][1]), (53, " ".join(prose(20) + passage[:20] + prose(30) + passage[20:40]))]
    frame = docs(spark, rows)
    got = passages.shared_passages(frame).collect()
    found = {}
    for r in got:
        assert r.doc_id > r.other_id and holds[r.doc_id] == holds[r.other_id] is not None and r.similarity >= 0.8 and r.n_words >= 50
        text = dict(rows)[r.doc_id][r.start:r.end]
        assert len(text.split()) == r.n_words and set(text.split()[3:-3]) <= set(passage + common + ["changed"])
        found.setdefault(r.doc_id, set()).add(r.other_id)
    assert set(found) | {o for v in found.values() for o in v} == {k for k, v in holds.items() if v}
    assert passages.shared_passages(docs(spark, [])).count() == 0


def test_chains_follow_the_best_order():
    at, there = np.array([0, 5, 10, 15, 20, 5]), np.array([100, 105, 50, 115, 120, 300])
    assert max(passages.chains(at, there, 5, 40, 0.1), key=len) == [0, 1, 3, 4]
    rng = np.random.default_rng(4)
    for _ in range(30):
        p, q = rng.integers(0, 60, 25), rng.integers(0, 60, 25)
        found = passages.chains(p, q, 5, 1000, 0.1)
        best, order = [0.0] * 25, np.lexsort((q, p))
        for i in order:
            best[i] = 5 + max([0.0] + [best[j] - 0.1 * (p[i] - p[j] + q[i] - q[j]) for j in range(25) if p[j] < p[i] and q[j] < q[i]])
        first = max(found, key=lambda c: sum(5 for _ in c) - 0.1 * (p[c[-1]] - p[c[0]] + q[c[-1]] - q[c[0]]))
        assert abs(5 * len(first) - 0.1 * (p[first[-1]] - p[first[0]] + q[first[-1]] - q[first[0]]) - max(best)) < 1e-9
        assert sorted(i for c in found for i in c) == list(range(25))


def test_chains_find_the_best_within_reach():
    rng = np.random.default_rng(8)
    for n, reach in [(25, 3), (60, 10), (60, 25)] * 10:
        p, q = rng.integers(0, 90, n), rng.integers(0, 90, n)
        p[:9], q[:9] = np.arange(9), np.arange(9)  # a long chain that outweighs nearer ones
        best = [0.0] * n
        for i in np.lexsort((q, p)):
            may = [best[j] - 0.1 * (p[i] - p[j] + q[i] - q[j]) for j in range(n) if 0 < p[i] - p[j] <= reach + 5 and 0 < q[i] - q[j] <= reach + 5]
            best[i] = 5 + max([0.0, *may])
        first = max(passages.chains(p, q, 5, reach, 0.1), key=lambda c: 5 * len(c) - 0.1 * (p[c[-1]] - p[c[0]] + q[c[-1]] - q[c[0]]))
        assert abs(5 * len(first) - 0.1 * (p[first[-1]] - p[first[0]] + q[first[-1]] - q[first[0]]) - max(best)) < 1e-9


@pytest.mark.parametrize("apart", [20, 50, 100, 200, 300])
@pytest.mark.parametrize("ahead", [60, 1000])
def test_a_passage_after_a_longer_one_is_found(apart, ahead):
    rng = np.random.default_rng(apart)
    text = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    one, two = text(ahead), text(60)
    own = []
    for doc in (1, 2):
        grams, at = passages.seeds(np.concatenate([text(30), one, text(apart), two, text(30)]), passages.WORDS, passages.WINDOW)
        part = np.zeros(len(grams), passages.SEED)
        part["seed"], part["doc"], part["at"] = grams, doc, at
        own.append(part)
    rows = np.concatenate(own)
    found = passages._matches(passages._ordered(rows))
    chains = passages._chained(found, passages.WORDS, 50).to_pylist()
    later = [p for c in chains for p in c["at"] if p >= 30 + ahead + apart]
    assert later and max(later) - min(later) >= 35


def test_alignment():
    a, b = np.array([1, 2, 3, 4, 5, 6, 7, 8]), np.array([1, 2, 9, 4, 5, 7, 8])
    assert passages.edits(a, b) == (6, 8) and passages.edits(a[:0], b) == (0, 7)
    assert passages.align(a, b, [0, 6], [0, 5], 2) == (0, 8, 0, 7, 6, 8)


def test_columns_are_those_counted():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        parts = passages.columns_of(a, b)
        assert (sum(e for _, _, e in parts), len(parts)) == passages.edits(a, b)
        assert (sum(x for x, _, _ in parts), sum(y for _, y, _ in parts)) == (len(a), len(b))


def test_stretches_are_the_longest_ones():
    rng = np.random.default_rng(11)
    for _ in range(60):
        a = np.arange(int(rng.integers(60, 120)))
        b = np.where(rng.random(len(a)) < rng.choice([0.25, 0.35, 0.5]), 1000 + a, a)
        b[:5], b[-5:] = a[:5], a[-5:]
        found = passages.stretches(a, b, [0, len(a) - 5], [0, len(a) - 5], 5, 20, 0.8)
        same = np.concatenate([[0], np.cumsum(a == b)])
        good = [t - f for f in range(len(a)) for t in range(f + 20, len(a) + 1) if a[f] == b[f] and a[t - 1] == b[t - 1] and 5 * (same[t] - same[f]) >= 4 * (t - f)]
        assert max((f[5] for f in found), default=0) == max(good, default=0)
        for lo, hi, low, high, equal, columns in found:
            assert (lo, hi) == (low, high) and equal == same[hi] - same[lo] and 5 * equal >= 4 * columns
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_exact_passages_around_other_words_are_kept(spark):
    rng = random.Random(2)
    words = iter(rng.sample([f"w{k}" for k in range(20_000)], 8000))
    prose = lambda n: [next(words) for _ in range(n)]
    rows, want = [], {}
    for k, apart in enumerate(range(20, 46, 5)):
        one, two, phrase = prose(51), prose(51), prose(25)
        for d in (0, 1):
            rows.append((2 * k + d, " ".join([*prose(30), *one, *prose(apart), *two, *prose(30)])))
            rows.append((100 + 2 * k + d, " ".join([*prose(30), *one, *prose(35), *phrase, *prose(30)])))
        want[2 * k + 1], want[101 + 2 * k] = {" ".join(one), " ".join(two)}, {" ".join(one)}
    found = {}
    for r in passages.shared_passages(docs(spark, rows)).where("doc_id % 2 = 1 and other_id = doc_id - 1").collect():
        found.setdefault(r.doc_id, []).append(dict(rows)[r.doc_id][r.start:r.end])
        assert r.similarity >= 0.8 and r.n_words >= 50
    for k, parts in want.items():
        for part in parts:
            assert any(part in t for t in found.get(k, ())), k


def test_pipeline(spark):
    sf, before, sizes = "/root/testdata/sf0.01", None, []
    docs_ = corpus_pipeline.table(spark, sf, "documents")
    names = docs_.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, sf)
        if k < 4:
            assert out.columns == names, name
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs_.select("doc_id").collect()}
        before, docs_ = docs_, near_text.staged(out)
        sizes.append(docs_.count())
        if name == "near duplicates":
            sets = {r.doc_id: shingles(r.text, 5) for r in before.collect()}
            pairs = [(a, b) for a, b in combinations(sets, 2)
                     if sets[a] and sets[b] and 0.79 <= len(sets[a]) / len(sets[b]) <= 1.27 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r.doc_id for r in docs_.collect()} == set(groups_of(sets, pairs).values())
        if name == "personal data":
            assert docs_.where("text rlike '[a-z0-9]@[a-z0-9]+[.]example'").isEmpty() and docs_.where("n_chars <> length(text)").isEmpty()
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > 500
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries()) and packing.GROUP_BYTES


def test_pipeline_on_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs_ = corpus_pipeline.table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == docs_.columns), name


def changed(rng, passage, share):
    """A copy of a passage with a share of its words replaced at random places."""
    out = list(passage)
    for p in rng.sample(range(len(out)), round(share * len(out))):
        out[p] = f"x{rng.random()}".replace(".", "")
    return out


def similar(a, b):
    """Equal words over columns of the best alignment, by the full table."""
    same, columns = passages.edits(np.array([hash(w) for w in a]), np.array([hash(w) for w in b]))
    return same / columns


def linked(pairs, ids):
    """Sets of ids that pairs connect."""
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        at[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_changed_passages(spark, share):
    rng = random.Random(int(share * 100))
    prose = lambda n: [f"w{rng.randint(0, 40_000)}" for _ in range(n)]
    rows = []
    for k in range(150):
        one = prose(60)
        for d, own in ((0, one), (1, changed(rng, one, share))):
            rows.append((2 * k + d, " ".join([*prose(rng.randint(5, 60)), *own, *prose(rng.randint(5, 60))])))
    found = {r.doc_id for r in passages.shared_passages(docs(spark, rows)).where("doc_id % 2 = 1 and other_id = doc_id - 1").collect()}
    assert len(found) / 150 >= 0.9


def test_groups_of_changed_passages_stay_whole(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randint(0, 40_000)}" for _ in range(n)]
    for n, share in ((60, 0.05), (60, 0.08), (1000, 0.06)):
        one = prose(60)
        own = {k: changed(rng, one, share) for k in range(n)}
        rows = [(k, " ".join([*prose(20), *own[k], *prose(20)])) for k in range(n)] + [(n + k, " ".join(prose(100))) for k in range(40)]
        frame = docs(spark, rows)
        got = [sorted(tuple(r) for r in passages.shared_passages(frame.repartition(p), held=held).collect()) for p, held in ((1, 400_000), (16, 500))]
        assert got[0] == got[1]
        pairs = {(r[0], r[3]) for r in got[0]}
        assert all(a < n and b < n for a, b in pairs)
        every = [(a, b) for a in range(n) for b in range(a) if n <= 60 and similar(own[a], own[b]) >= 0.8] or [(a, 0) for a in range(1, n)]
        assert linked(pairs, range(n)) == linked(every, range(n))
        assert len(pairs) < 40 * n


def test_passages_of_phrases_that_are_frequent_elsewhere(spark):
    """Every phrase of a passage is in many other documents, in other surroundings: short phrases, long ones, and one word said again and again."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randint(0, 40_000)}" for _ in range(n)]
    rows, want = [], set()
    for k, (size, often) in enumerate(((5, 40), (12, 40), (12, 90), (15, 60), (25, 60))):
        phrases = [prose(size) for _ in range(60 // size)]
        for phrase in phrases:
            for _ in range(often):
                rows.append((10 + len(rows), " ".join([*prose(rng.randint(10, 40)), *phrase, *prose(rng.randint(10, 40))])))
        passage = [w for phrase in phrases for w in phrase]
        a, b, c = 100_000 + 3 * k, 100_001 + 3 * k, 100_002 + 3 * k
        rows += [(a, " ".join([*prose(30), *passage, *prose(30)])), (b, " ".join([*prose(20), *passage, *prose(30)]))]
        rows.append((c, " ".join([*prose(20), *passage[:20], "inserted", *passage[20:], *prose(30)])))
        want |= {frozenset((a, b)), frozenset((a, c))}
    # One phrase of many documents, and nothing else of which a seed is left: two words of three are equal, no four in a row.
    rest = prose(60)
    phrase = prose(20)
    rows += [(200_000 + k, " ".join([*prose(30), *phrase, *prose(40)])) for k in range(60)]
    rows += [(300_000 + k, " ".join([*prose(30), *phrase, *[w if (p + 1) % 4 else f"z{k}{p}" for p, w in enumerate(rest[:40])], *prose(30)])) for k in (0, 1)]
    want.add(frozenset((300_000, 300_001)))
    rows += [(400_000 + k, " ".join([*prose(20), *["again"] * (60 + k), *prose(20)])) for k in range(30)]
    ids = dict(zip(rng.sample(range(1_000_000), len(rows)), (i for i, _ in rows)))  # others lie between those that belong together
    frame = docs(spark, [(i, t) for i, (_, t) in zip(ids, rows)])
    got = [sorted(tuple(r) for r in passages.shared_passages(frame.repartition(p), held=held).collect()) for p, held in ((1, 400_000), (8, 900))]
    assert got[0] == got[1]
    pairs = {(ids[r[0]], ids[r[3]]) for r in got[0]}
    roots = linked(pairs, set(ids.values()))
    assert all(len({roots[i] for i in pair}) == 1 for pair in want)
    assert len({roots[400_000 + k] for k in range(30)}) == 1
    assert all(100_000 <= i for pair in pairs for i in pair) and all(a // 100_000 == b // 100_000 for a, b in pairs)


def test_equal_passages_name_one_document(spark):
    rng = random.Random(7)
    prose = lambda n: [f"w{rng.randint(0, 40_000)}" for _ in range(n)]
    one, two = prose(70), prose(60)
    rows = [(k, " ".join([*prose(10), *one, *prose(10), *(two if k % 3 == 0 else prose(60)), *prose(10), *(one if k == 0 else [])])) for k in range(120)]
    rows += [(5, rows[5][1]), (5, None)]
    got = [sorted(tuple(r) for r in passages.shared_passages(docs(spark, rows).repartition(p), held=held).collect()) for p, held in ((1, 400_000), (16, 900))]
    assert got[0] == got[1] and len(got[0]) < 20 * 120
    named = {(r[0], r[3]) for r in got[0] if r[6] >= 69}
    assert {(k, 0) for k in range(1, 120)} <= named
    # Both passages of the others lie ten words apart and count as one.
    assert {r[0] for r in got[0] if r[6] >= 139} == set(range(3, 120, 3))
