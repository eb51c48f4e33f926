"""Online packing, token alignment and ranked search, on cases made by hand and against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest

from panelweave.llm import impact_search, level_packing, queries, token_groups

SF = "/root/testdata/sf0.001"


def test_best_level_is_that_of_the_smallest_sum_of_squares():
    rnd, size = random.Random(3), 24
    levels = level_packing.Levels(size)
    for _ in range(3000):
        s = rnd.choice([rnd.randint(1, size - 1), 5, 13])
        count = levels.count[::-1].astype(int)  # by fill level

        def after(h):
            new = count.copy()
            new[h] -= h > 0
            new[h + s] += 1
            new[0] = new[size] = 0
            return int((new ** 2).sum())

        fits = [h for h in range(size - s + 1) if h == 0 or count[h]]
        assert size - levels.best(s) == max(fits, key=lambda h: (-after(h), h))
        levels.place(s, s)
    assert sum(map(int, levels.count)) == len(left := levels.close()) and [sum(w) for w in left] == sorted((sum(w) for w in left), reverse=True)


def test_partly_filled_windows_leave_no_padding():
    rnd = random.Random(4)
    for n in (0, 1, 2, 40):
        windows = []
        for k in range(n):
            own = [(k * 10 + j, 0, array("I", range(rnd.randint(1, 20))).tobytes()) for j in range(rnd.randint(1, 3))]
            windows.append((sum(len(p[2]) // 4 for p in own), own))
        windows.sort(key=lambda w: -w[0])
        want = {(p[0], t) for _, own in windows for p in own for t in range(len(p[2]) // 4)}
        got, sizes = [], []
        for own in level_packing.filled_up([list(w) for _, w in windows], 64):
            sizes.append(sum(len(p[2]) // 4 for p in own))
            got += [(p[0], p[1] + t) for p in own for t in range(len(p[2]) // 4)]
            assert all(list(np.frombuffer(p[2], np.uint32)) == list(range(p[1], p[1] + len(p[2]) // 4)) for p in own)
        assert len(got) == len(set(got)) and set(got) == want
        assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s < 64 for s in sizes) <= 6


@pytest.mark.parametrize("held", [level_packing.HELD_TOKENS, 300])
def test_online_packing_brings_every_token_back(spark, held):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_bpe())
    rows = [(1, "Hello, World"), (None, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (4, "été 你好 <|endoftext|> x" * 30)]
    rows += [(10 + k, "some words here " * (k % 50)) for k in range(200)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, ids string, offset int").repartition(3)
    got = level_packing.pack_online(df, queries.word_bpe(), capacity=64, held_tokens=held).collect()
    tokenizer.encode_special_tokens = True
    want = sorted((str(i), (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    own, bins = defaultdict(list), defaultdict(list)
    for r in got:
        own[str(r.doc_id)].append(r)
        bins[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes())
    for i in {i for i, _ in want}:
        texts = [t for j, t in want if j == i]
        assert sorted((r.start, r.length) for r in own[i])[-1][1] > 0 and all(r.doc_tokens == len(texts[0]) for r in own[i])
        assert sorted((r.start + k, t) for r in own[i] for k, t in enumerate(r.ids)) == sorted((k, x) for t in texts for k, x in enumerate(t))
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        total = sum(r.length for r in b)
        assert [r.offset for r in b] == [sum(x.length for x in b[:k]) for k in range(len(b))]
        assert total == 64 or (total < 64 and total & (total - 1) == 0)
    assert level_packing.pack_online(df.limit(0), queries.word_bpe()).count() == 0


def test_online_packing_of_the_table(spark):
    got = queries.op11_pack_online(spark, SF).collect()
    assert "ids" not in got[0] and len({r.doc_id for r in got}) == 200
    assert all(r.length <= 4096 for r in got)


def ranking(docs, items, top):
    """Rows (item, rank, doc, score) by scoring every document for every item."""
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_terms = len(words), sum(len(w) for _, w in words)
    df = defaultdict(int)
    for _, w in words:
        for t in set(w):
            df[t] += 1
    out = []
    for item, text in items:
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)})))
        scores = []
        for i, w in words:
            m = 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if df[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"bucket": 4, "part_terms": 200, "block_items": 5}])
def test_search_equals_scoring_all(spark, sizes):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "日本", "A1"]
    draw = lambda n: " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(k, draw(rnd.randint(1, 60))) for k in range(150)]
    docs += [(200 + k, docs[k % 3][1]) for k in range(40)] + [(7, docs[7][1]), (None, docs[8][1]), (300, None), (301, ""), (302, " .,"), (303, "w1 " * 3000)]
    items = [(k, draw(rnd.randint(1, 12))) for k in range(12)] + [(3, "w5 W5 w9"), (None, "a1 é É"), (50, None), (51, "nowhere"), (52, "")]
    frames = (spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, rank string, score double"),
              spark.createDataFrame([(i, t, 0, "y") for i, t in items], "item_id long, text string, doc_id int, item string"))
    got = impact_search.search(*frames, top=6, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranking(docs, items, 6)
    assert impact_search.search(frames[0].limit(0), frames[1]).count() == impact_search.search(frames[0], frames[1].limit(0)).count() == 0


def test_bounds_spare_buckets_and_documents():
    import pyarrow as pa

    rnd = random.Random(6)
    docs = [[f"t{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 80))] for _ in range(3000)] + [[f"t{k}" for k in range(30)]] * 10
    docs = [sorted(set(d)) for d in docs]
    asked = pa.table({"item": [0], "words": [[f"t{k}" for k in range(30)]], "weights": [list(range(900, 930))], "least": [0]})
    looked, real = [], impact_search._candidates

    def counted(*args):
        looked.append(len(out := real(*args)))
        return out

    impact_search._candidates = counted
    try:
        (_, rows, _), = impact_search.part_best(pa.chunked_array([[" ".join(d) for d in docs]]), pa.chunked_array([[[1] * len(d) for d in docs]]),
                                                np.full(len(docs), 100), np.arange(len(docs)), asked, 10)
    finally:
        impact_search._candidates = real
    assert sorted(rows) == list(range(3000, 3010)) and sum(looked) < 3010


def vocabularies():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.PATTERN


def whole_tokens(texts):
    """(ids, ends) of both vocabularies for whole texts, by their own libraries; empty where they do not spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b, _ = vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if chr(x) not in letters)}
    out = []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spelt = ([bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelt):
            ids, spelt = ([], []), ([], [])
        out.append([(own, list(itertools.accumulate(map(len, s)))) for own, s in zip(ids, spelt)])
    return out


def aligned_rows(docs):
    """Rows as the query returns them, by sets and plain loops."""
    tokens = whole_tokens([t for _, t in docs])
    links, counts = [], defaultdict(int)
    for (id_a, end_a), (id_b, end_b) in tokens:
        own = [(x, y) for x, e, s in zip(id_a, end_a, [0, *end_a]) for y, f, g in zip(id_b, end_b, [0, *end_b]) if max(s, g) < min(e, f)]
        links.append(own)
        for pair in own:
            counts[pair] += 1
    highest = defaultdict(int)
    for (_, y), c in counts.items():
        highest[y] = max(highest[y], c)
    out = []
    for (i, _), ((id_a, end_a), (id_b, end_b)), own in zip(docs, tokens, links):
        text, before = [], 0
        for cut in sorted(set(end_a) & set(end_b)):
            text.append("|".join(",".join(str(x) for x, e in zip(ids, ends) if before < e <= cut) for ids, ends in ((id_a, end_a), (id_b, end_b))))
            before = cut
        out.append((i, len(id_a), len(id_b), len(text), len(own), hashlib.sha256(";".join(text).encode()).hexdigest() if text else "",
                    sum(counts[p] == highest[p[1]] for p in own), sum(counts[p] for p in own)))
    return sorted(out, key=repr)


ODD = [None, "", " ", "  ", "x", " x", "x ", "x  ", "\tx", "a\n b", "a \n  b", "▁x", "a▁ b", "été 你好世界 ok", "<s> <unk> <|endoftext|> <0x41>", "z" * 900, "\x1c x \x85 y", "ﬁ Ａ é́",
       "don't we'll I'm", "🙂🙃 🙂", "a\0b", "   lead and   gaps   ", "1234567 89,5", "\r\n\r\n  q"]


@pytest.mark.parametrize("block_links", [token_groups.BLOCK_LINKS, 40])
def test_alignment_equals_plain_loops(spark, block_links):
    rnd = random.Random(8)
    parts = ["the ", " the", "é", "日本", "\n", "  ", "ing", "A", ".", " 12", "\u00a0", "\u2003", "zq", "🙂", "<s>", "\t"]
    docs = list(enumerate(ODD + ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(150)])) + [(None, "the end"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, block string, n_a int").repartition(3)
    got = token_groups.align(df, *vocabularies(), block_links=block_links)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == aligned_rows(docs)
    assert token_groups.align(df.limit(0), *vocabularies()).count() == 0


def test_alignment_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if not r.text or len(r.text) < 4000]
    want = {r[0]: r[1:6] for r in aligned_rows(docs)}
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op12_token_groups(spark, SF).collect()}
    assert len(got) >= 200 and all(got[i] == v for i, v in want.items())
