"""The training-data operators against brute force on small tables with awkward rows."""

import gzip
import hashlib
import html as html_lib
import io
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismview.llm import chat_format, decontamination, exact_dedup, fm_index, html_extract, near_dedup, packing, scratch, sharding, toxicity, warc
from prismview.llm.html_tree import read_blocks

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, _text string, _key long"  # extra columns whose names clash


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 4, 5, 30, 60, 200, 200, 900)]
    near = []
    for _ in range(30):  # a chain of near copies
        w = (near[-1] if near else base[5]).split(" ")
        w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        near.append(" ".join(w))
    rows = [None, "", " ", "\n\t", *base, *base[:4], base[4].upper(), *near, "a" * 20_000, words(rng, 20_000), "é ß 日本 \U0001f600", "ABC", "abc", "aBc"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", "clash", i) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# near duplicates


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_dedup_matches_all_pairs(docs, texts, empty):
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    kept = near_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in texts if want[i][1] == i}
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.survivors(empty).count() == 0


def test_near_dedup_random_groups(spark):
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = words(rng, rng.randrange(20, 150)).split(" ")
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_near_dedup_in_parts_and_blocks_is_the_same(spark):
    rng = random.Random(31)
    rows, common = [], words(rng, 60, 60).split(" ")
    for g in range(40):  # groups that share a passage, so buckets hold unlike documents
        base = common + words(rng, rng.randrange(10, 30)).split(" ")
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(None, None), (None, rows[0][1]), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = [sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in near_dedup.near_duplicates(frame, **sizes).collect()) for sizes in ({}, {"crowd": 3, "block": 2})]
    assert seen[0] == seen[1]
    want = brute_components([(i, t) for i, t in rows if i is not None][:-1])
    assert {(i, n, c) for i, n, c, _ in seen[0] if i >= 0} == {(i, n, c) for i, (n, c) in want.items()}
    assert [r[:3] for r in seen[0] if r[0] < 0] == [(-1, 0, -1), (-1, want[0][0], want[0][1])]


def test_near_dedup_shuffles_keys_once_and_texts_of_pairs_only(spark):
    rng = random.Random(47)
    rows, common = [], words(rng, 120, 120).split(" ")
    for _ in range(120):  # texts that share a passage, so buckets stay open after the first round, and some copies
        base = (common if rng.random() < 0.5 else []) + words(rng, 60, 5000).split(" ")
        rows += [(len(rows) + i, " ".join(base)) for i in range(rng.choice([1, 1, 1, 2]))]
    rows += [(len(rows) + i, words(rng, 60, 100_000)) for i in range(250)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    app = spark.sparkContext._jsc.sc()

    def shuffled():
        spark.range(1).collect()
        app.listenerBus().waitUntilEmpty(60_000)
        return app.statusStore().executorSummary("driver").totalShuffleWrite()

    with scratch.with_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):  # as when no side of a join is small
        before = shuffled()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame).collect()}
        per_key = (shuffled() - before) / len(rows) / near_dedup.BANDS
    assert got == brute_components(rows)
    assert per_key < 45  # bytes; 33 as it is, 55 when bands travel with their documents, keys twice and every open text


def test_split_join_is_a_join(spark):
    many = spark.range(1000).selectExpr("if(id % 3 > 0, 7, id % 50) AS k", "id AS x")
    one = spark.range(40).selectExpr("id AS k", "id * 10 AS y")
    crowded = many.groupBy("k").count().filter("count > 20")
    want = sorted(map(tuple, many.join(one, "k").collect()))
    for rows in (20, 10_000):
        assert sorted(map(tuple, scratch.split_join(many, one, "k", "x", crowded, 670, rows).select("k", "x", "y").collect())) == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)]), np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)])
    made = near_dedup.sketches([a, b, common[:1]], 2048)
    assert (made != np.iinfo(np.uint64).max).all()
    assert abs((made[0] == made[1]).mean() - 300 / 400) < 0.05


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), "t", scratch.shared_folder(spark)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long"), "s", scratch.shared_folder(spark), crowd=4).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


# exact duplicates


def test_components_of_stars_take_no_step(spark):
    import os

    folder = scratch.shared_folder(spark)
    stars = spark.createDataFrame([(c + k, c) for c in (1, 100) for k in range(1, 9)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(stars, "t", folder).collect()}
    assert got == {c + k: c for c in (1, 100) for k in range(1, 9)}
    assert os.listdir(folder.removeprefix("file://")) == ["t0"]
    assert near_dedup.components(stars.limit(0), "none", folder).count() == 0


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    shuffled = lambda: {f for f in files().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffled()
    made = scratch.written(spark.range(1000).repartition(3, "id").groupBy("id").count())
    for _ in range(20):  # they go in the background
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before
    assert made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_exact_dedup_matches_groups(docs, texts, empty):
    by = {}
    for i, t in texts:
        by.setdefault(low(t), []).append(i)
    for capacity, fold in ((exact_dedup.CAPACITY, exact_dedup.FOLD), (3, 2)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, capacity=capacity, fold=fold).collect()}
        assert got == {i: (max(by[low(t)]), len(by[low(t)]), i == max(by[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in texts}
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in texts if i == max(by[low(t)])}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_groups(rows).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {3, 2}
    assert exact_dedup.survivors(rows).count() == 2


def test_copies_of_a_hot_text_fold_level_by_level(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "HOT", "Hot"]) if i % 3 else words(rng, 3, 40)) for i in range(600)]
    rng.shuffle(rows)
    by = {}
    for i, t in rows:
        by.setdefault(low(t), []).append(i)
    monkeypatch.setattr(exact_dedup, "written", lambda df, *a, **k: scratch.written(df, *a, **{**k, "batch_rows": 4}))  # many entries
    met = []
    chained = exact_dedup.folded
    monkeypatch.setattr(exact_dedup, "folded", lambda *a: met.append(chained(*a)) or met[-1])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), fold=5).collect()}
    assert got == {i: (max(by[low(t)]), len(by[low(t)]), i == max(by[low(t)])) for i, t in rows}
    own, links = met[0]
    assert len(links) >= 2 and own.groupBy("_key").count().agg(F.max("count")).first()[0] <= 5


def test_colliding_keys_are_told_apart():
    import pyarrow as pa

    rows = [(0, 7, e, e, 1, t) for e, t in ((1, "x"), (2, "y"), (3, "X"))]
    names = ["_bucket", "_key", "_entry", "_id", "_copies", "_text"]
    out = [r for b in exact_dedup.chain_keys(iter([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])])) for r in b.to_pylist()]
    assert {r["_entry"]: (r["_keep_row"], r["_size"]) for r in out} == {1: (3, 2), 3: (3, 2), 2: (2, 1)}


def test_directory_doubles_only_where_it_must():
    depth, slots = exact_dedup.directory({0: 10, 1: 10, 255: 3}, capacity=12, max_depth=8)
    assert depth == 8 and len(slots) == 256 and len(set(slots)) == 9
    assert exact_dedup.directory({5: 100}, 12, 4)[0] == 4  # one hot key cannot be split further
    assert exact_dedup.directory({}, 12, 4) == (0, [0])


# decontamination


def dwords(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]


def test_decontamination_matches_scan(spark, docs, texts, empty):
    rng = random.Random(2)
    phrases = [(i, words(rng, n)) for i, n in enumerate((13, 40, 5, 1, 14))] + [(9, None), (10, "..."), (11, texts[9][1]), (11, "w1 w2")]
    bench = spark.createDataFrame(phrases, "item_id long, text string")
    more = [(1000 + i, f"{words(rng, 50)} {p[1]}, {words(rng, 60)} {p[1] or ''}") for i, p in enumerate(phrases)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    items = [(str(i), dwords(t)) for i, t in phrases]
    windows = {(tuple(w[k : k + 13]), i) for i, w in items if w for k in range(max(1, len(w) - 12))}
    want = {}
    for d, t in texts + more:
        w, hit, found = dwords(t), set(), set()
        for win, i in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        want[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w), sorted(hit))
    for block in (decontamination.BLOCK_WORDS, 20):
        got = {r.doc_id: r for r in decontamination.contamination(both, bench, block_words=block).collect()}
        assert {d: (r.n_words, r.n_hit, r.items, r.contaminated, [k for s in r.spans for k in range(s.start, s.end)]) for d, r in got.items()} == want
    for block in (decontamination.BLOCK_WORDS, 20):
        clean = decontamination.clean(docs, bench, block_words=block)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in texts if not want[i][3]}
    twice = spark.createDataFrame([(None, more[0][1]), (None, more[0][1]), (1, None), (1, None)], "doc_id long, text string")
    for block in (decontamination.BLOCK_WORDS, 20):
        got = decontamination.contamination(twice, bench, block_words=block).collect()
        assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, want[1000][1])] * 2 + [(1, 0)] * 2
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 3000).astype(np.int32)
    s[-1] = 0
    index = fm_index.FMIndex(s, 3)
    for length in (1, 2, 5):
        patterns = rng.integers(1, 4, (40, length)).astype(np.int32)
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(s) - length + 1) if (s[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# packing


def test_packing_round_trip(docs, texts, empty):
    tok = Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    for capacity in (4096, 64):
        rows = packing.pack(docs, TOKENIZER, capacity=capacity).collect()
        for i, own in ids.items():
            mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
            assert mine == [(k, k * capacity, len(own[k * capacity :][:capacity]), zlib.crc32(own[k * capacity :][:capacity].tobytes())) for k in range(-(-len(own) // capacity))]
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= -(-sum(map(len, ids.values())) // capacity) * 1.1 + 1
    assert packing.pack(empty, TOKENIZER).count() == 0


def best_fit(histogram, capacity):
    """Sequences of plain best fit, longest first."""
    rooms = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def test_fractions_cover_every_length_and_are_rounded_within_them():
    rng = random.Random(14)
    for _ in range(5):
        lengths = np.array(sorted(rng.sample(range(1, 101), 30)), np.int64)
        counts = np.array([rng.randrange(1, 400) for _ in lengths], np.int64)
        amounts, bound = packing.fractional(lengths, counts, 100)
        covered = np.zeros(len(lengths))
        for items, x in amounts.items():
            assert x > 0 and lengths[list(items)].sum() <= 100
            np.add.at(covered, list(items), x)
        assert (covered >= 0.99 * counts).all()
        histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        assert 0.99 * bound <= sum(amounts.values()) <= 1.1 * best_fit(histogram, 100)
        whole, left = packing.rounded(amounts, counts)
        took = np.zeros(len(lengths), np.int64)
        for items, n in whole:
            assert items in amounts and 1 <= n
            np.add.at(took, list(items), n)
        assert (took + left == counts).all() and left.sum() < 0.2 * counts.sum()


def test_packing_keeps_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x", 3), (1, "a b c", "x", 3), (None, "d", "x", 1), (None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string, length int"), TOKENIZER).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (0, 2), (1, 4), (1, 4)] and len({(r.sequence_id, r.offset) for r in got}) == 4


def test_fullest_choice_of_pieces():
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), 5))
        left = [rng.randrange(3) for _ in lengths]
        room = rng.randrange(60)
        pieces = [x for x, n in zip(lengths, left, strict=True) for _ in range(n)]
        best = max(sum(c) for k in range(len(pieces) + 1) for c in itertools.combinations(pieces, k) if sum(c) <= room)
        got = packing.fullest(lengths, left, room)
        assert sum(lengths[j] for j in got) == best and all(got.count(j) <= left[j] for j in set(got))


def test_configuration_program_places_every_piece():
    rng = random.Random(4)
    for _ in range(5):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 60) for _ in range(40)}
        patterns, bound = packing.solve(histogram, 100)
        placed = {}
        for items, n in patterns:
            assert sum(items) <= 100
            for x in items:
                placed[x] = placed.get(x, 0) + n
        used, plain = sum(n for _, n in patterns), best_fit(histogram, 100)
        assert placed == histogram and bound <= used <= 1.02 * plain
    easy = {x: 50 for x in range(1, 41)}
    patterns, bound = packing.solve(easy, 100)
    assert sum(n for _, n in patterns) <= bound + 1 and bound == -(-sum(x * n for x, n in easy.items()) // 100)
    assert packing.solve({}, 100) == ([], 0) and sum(n for _, n in packing.solve({100: 7}, 100)[0]) == 7


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(TOKENIZER)
    odd = ["it's don't DON'T we're.", "É. ΣΑΣ ΑΣ. İstanbul", "a\tb\r\nc", "1234 a1b2.c3,", "x́y é.", "<|endoftext|> a<|startoftext|>b", "", "   ", "日本語、テスト。", "ﬁne Ǆ. ß, ª º", "a b\x85c\x1cd", "___ -- ...", ".", ",", "I'LL. can't, 's 't", "ſ K Å. Ω, ŉ. ΐ"]
    odd += ["İ.", "DİYARBAKIR İ,", "İ", "xİ.y İstanbul."]
    rng = random.Random(77)
    odd += ["".join(c + rng.choice([".", ",", " ", ""]) for c in map(chr, (c for c in range(k, 0x110000, 397) if not 0xD800 <= c < 0xE000))) for k in range(0, 397, 23)]
    odd += [f"{chr(c)}. {chr(c)}, a{chr(c)}. {chr(c)}b," for c in range(0x80, 0x2FFF)]
    for t in odd:
        assert ids.encode(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# sharding


def brute_capacity(weights, shards):
    low_, high = max(weights), sum(weights)
    while low_ < high:
        middle, used, room = (low_ + high) // 2, 1, 0
        for w in weights:
            if room + w > middle:
                used, room = used + 1, 0
            room += w
        low_, high = (low_, middle) if used <= shards else (middle + 1, high)
    return low_


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sharding_is_minimax(spark, seed, docs, texts, empty):
    rng = random.Random(seed)
    rows = texts if seed == 1 else [(i, "hot" * 50 if rng.random() < 0.34 else words(rng, rng.randrange(1, 60), 50)) for i in range(700)]
    got = sharding.shard_documents(docs if seed == 1 else spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in rows}
    groups = {}
    for i, t in rows:
        k = hashlib.sha256((t or "").encode()).hexdigest()
        groups[k] = groups.get(k, 0) + size[i]
    loads, slots, places = {}, {}, {}
    by_id = dict(rows)
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert places.setdefault(by_id[r.doc_id] or "", r.shard) == r.shard and 0 <= r.shard < 16 and r.law == "bytes"
    assert max(loads.values()) == brute_capacity(brute_order(groups, 16), 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def brute_order(groups, shards):
    """Weights in the order of the partition: groups above an equal share of what is left, then by digest."""
    heavy, left = [], sum(groups.values())
    for k in sorted(groups, key=lambda k: (-groups[k], k))[: shards - 1]:
        if groups[k] * (shards - len(heavy)) <= left:
            break
        heavy.append(k)
        left -= groups[k]
    return [groups[k] for k in heavy] + [groups[k] for k in sorted(groups) if k not in heavy]


@pytest.mark.parametrize("heavy", [(0.5,), (0.3, 0.2), (0.08,), (0.4, 0.1, 0.09, 0.08), ()])
def test_shards_are_near_equal_beside_heavy_groups(spark, heavy):
    rng = random.Random(17)
    small = [words(rng, rng.randrange(5, 60), 5000) for _ in range(3000)]
    rest = sum(len(t) + 1 for t in small) / (1 - sum(heavy))
    rows = small + [f"hot{i} " * int(h * rest / 5 / 40) for i, h in enumerate(heavy) for _ in range(40)] + [None, ""]
    frame = spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, key string, weight int").repartition(6)
    got = sharding.shard_documents(frame).collect()
    loads, groups = {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    for t in rows:
        k = hashlib.sha256((t or "").encode()).hexdigest()
        groups[k] = groups.get(k, 0) + len(t or "") + 1
    assert len(got) == len(rows) and len(loads) == 16
    assert max(loads.values()) == brute_capacity(brute_order(groups, 16), 16)
    own = sorted(loads.values())[: 16 - sum(h > 1 / 16 for h in heavy)]
    assert own[-1] - own[0] <= 0.05 * own[-1]


def test_few_groups_fill_as_many_shards_as_they_can(spark):
    rng = random.Random(4)
    for n in (1, 5, 16, 23):
        rows = [(i, f"g{i} " * rng.randrange(1, 40)) for i in range(n)]
        got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        loads, groups = {}, {hashlib.sha256(t.encode()).hexdigest(): len(t) + 1 for _, t in rows}
        for r in got:
            loads[r.shard] = loads.get(r.shard, 0) + r.size
        assert max(loads.values()) == brute_capacity(brute_order(groups, 16), 16) and len(loads) >= min(n, 12)


# toxicity


def test_every_maximal_segment():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.choice([-2, -1, 1, 2, 3]) * rng.random() for _ in range(rng.randrange(1, 25))]

        def brute(a, b):
            best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            return brute(a, best[2]) + [(best[2], best[3])] + brute(best[3], b) if best[0] > 0 else []

        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(0, len(s))


def test_the_scan_of_segments_takes_linear_time():
    import time

    def took(scores):
        began = time.perf_counter()
        toxicity.maximal_segments(scores)
        return time.perf_counter() - began

    for cycle in ([1, -1.5], [1, -0.5], [2, -1, 0.5, -1.2], [1, -1]):
        best = [min(took(cycle * n) for _ in range(3)) for n in (5_000, 40_000)]
        assert best[1] < 24 * best[0] + 0.01, cycle  # 8 times as long; quadratic would be 64
    falling = [x for k in range(20_000) for x in (1 + k / 20_000, -1.0 - k / 20_000)]
    assert took(falling) < 1 and took(falling[::-1]) < 1


def brute_surprise(model, text):
    """The score of a text from the definitions."""
    import math

    w = re.findall(r"[^\W\d_]+", text.lower())
    value = []
    for x in w:
        names = [x + "$"] + [x[:k] for k in range(8, 3, -1) if k <= len(x)]
        value.append(next((model.listed[n] for n in names if n in model.listed), model.rest))

    def maximal(a, b):
        best = max(((sum(value[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        return maximal(a, best[2]) + [(best[2], best[3])] + maximal(best[3], b) if best[0] > 1e-12 else []

    over = []
    for a, b in maximal(0, len(w)):
        damped = [v / (w[a : i + 1].count(w[i])) if v > 0 else v for i, v in enumerate(value[a:b], a)]
        best = max(sum(damped[i:j]) for i in range(len(damped)) for j in range(i + 1, len(damped) + 1))
        over.append(model.decay * best - math.log(model.scale * len(w)))
    over.sort(reverse=True)
    if not over:
        return 0.0
    e = math.exp(-over[0])
    found = [-math.log10(1 - math.exp(-e)) if e < math.exp(3.4) else 0.0]
    for r in range(2, len(over) + 1):
        if over[r - 1] <= 0:
            break
        t = sum(over[:r])
        found.append(-math.log10(math.exp(-t) * t ** (r - 1) / math.factorial(r) / math.factorial(r - 1) * 2 ** (r - 1)))
    return max(found)


def test_scores_match_brute_force():
    rng = random.Random(13)
    model = toxicity.Model({"vile": 2.0, "viler$": 3.1, "foul$": 1.2, "calm$": -1.5, "nastyxyz": 2.5}, -0.4, 0.9, 0.08, 0.05, 1.0)
    scores = toxicity.Scores(model.listed, model.rest)
    pool = ["vile", "vileness", "viler", "foul", "fouls", "calm", "nastyxyz", "nastyxyzab", "nasty", "plain", "x", "Él"]
    for _ in range(150):
        text = " ".join(rng.choice(pool[:7] if rng.random() < 0.3 else pool[5:]) for _ in range(rng.randrange(0, 30)))
        n, found, damped = toxicity.segments_of(text, scores)
        assert abs(model.surprise(damped, n) - brute_surprise(model, text)) < 1e-6, text
    far = "vile foul viler " + "calm " * 60 + "vile foul viler " + "calm " * 60
    one = "vile foul viler " + "calm " * 123
    x, y = (model.surprise(toxicity.segments_of(t, scores)[2], 126) for t in (far, one))
    assert x > y > 0  # two passages tell more than one


def test_learnt_names_match_brute_force(spark):
    import math

    rng = random.Random(2)
    told = []
    for i in range(400):
        toxic = i % 4 == 0
        w = [f"{rng.choice(['calm', 'plain', 'steady', 'quiet'])}{rng.choice('abcdefgh')}" for _ in range(rng.randrange(4, 20))]
        told.append((" ".join(w + [rng.choice(["vilenessa", "vilenessb", "foulest"])] * (toxic or rng.random() < 0.02)), int(toxic)))
    counts = {}
    for text, toxic in told:
        for name in {n for w in set(text.split()) for n in [w + "$"] + [w[:k] for k in range(4, 9) if len(w) >= k]}:
            counts.setdefault(name, [0, 0])[1 - toxic] += 1
    whole = {n: c for n, c in counts.items() if n[-1] == "$"}
    t_all, c_all = (sum(c[j] for c in whole.values()) for j in (0, 1))
    share = t_all / (t_all + c_all)
    odds = lambda p: math.log(p / (1 - p))
    shares, listed = {}, {}
    for name in sorted(counts, key=lambda n: (n[-1] == "$", len(n))):
        t, c = counts[name]
        stem = name[:-1][:8] if name[-1] == "$" else name[:-1]
        prior = shares.get(stem, share)
        p = (t + 10 * prior) / (t + c + 10)
        if name[-1] != "$":
            shares[name] = p
        spread = math.sqrt(1 / (t + 10 * prior) + 1 / (c + 10 * (1 - prior)))
        if abs(odds(p) - odds(prior)) / spread >= math.sqrt(2 * math.log(len(counts))):
            listed[name] = odds(p) - odds(share)
    model = toxicity.learn(spark.createDataFrame(told, "text string, toxic int").repartition(3))
    assert model.listed.keys() == listed.keys() and any(n.startswith("vile") for n in listed)
    assert all(abs(model.listed[n] - x) < 1e-9 for n, x in listed.items()) and model.rest < 0


def test_a_word_of_very_many_toxic_documents_only(spark):
    import math
    from fractions import Fraction

    n = 6000  # the share of its longer prefixes differs from 1 by less than a double tells
    told = spark.range(2 * n).selectExpr("if(id % 2 = 0, 'vilestones', 'calm') AS text", "cast(id % 2 = 0 AS int) AS toxic")
    model = toxicity.learn(told)
    clean = Fraction(1, 2)
    for name in ("vile", "viles", "vilest", "vilesto", "vileston", "vilestones$"):
        clean = 10 * clean / (n + 10)
        if name in model.listed:
            assert abs(model.listed[name] - math.log((1 - clean) / clean)) < 1e-9
    assert float(clean) + 1 == 1 and "vile" in model.listed and model.rest < 0
    assert all(math.isfinite(x) for x in model.listed.values())


def test_toxicity_learns_and_keeps_out(spark, empty):
    rng = random.Random(6)
    bad = ["vileword", "foulword", "nastystem"]
    rows = [(i, " ".join(f"c{rng.randrange(300)}x" for _ in range(rng.randrange(10, 80))) + (" " + " ".join(rng.choice(bad) + rng.choice(["", "an", "ou"]) for _ in range(4)) if i % 5 == 1 else "")) for i in range(1500)]
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "vileword vileword foulword")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i, _ in rows if i % 3] + [(5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 1503
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert sum(got[i].predicted != (i % 5 == 1) for i in held) <= 0.02 * len(held)
    assert got[5000].score == got[5001].score == 0 and got[None].held_out is False
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert any(p.evalue <= 0.01 for p in got[1].passages)
    kept = toxicity.clean(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_takes_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["calm", "plain", "still"]) + rng.choice("abcd") for _ in range(30)) + " vileword" * (i % 4 == 1), 1, 0.5, "x") for i in range(400)]
    rows += [(900, "calma plainb " * 100_000, None, None, None), (901, "calma plainb " * 50_000 + "vileword vileword vileword " + "calma " * 50_000, None, None, None), (901, "calma", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, name string")
    got = [(r.doc_id, r.predicted, len(r.passages)) for r in toxicity.toxicity(docs, spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(400)], "doc_id long, toxic int")).collect()]
    assert len(got) == 403 and (900, 0, 0) in got and sum(d == 901 for d, _, _ in got) == 2
    assert all(p == (d % 4 == 1) for d, p, _ in got if d < 400)


def test_toxic_passages_and_words_that_come_again():
    scores = toxicity.Scores({"vile$": 3.0, "foul$": 2.5, "nasty$": 2.8}, -0.5)
    clean, bad = "calm " * 40, "vile foul nasty "
    top = lambda t: max(toxicity.segments_of(t, scores)[2])
    n, found, damped = toxicity.segments_of(clean + bad + clean + bad + clean, scores)
    assert n == 126 and [(a, b) for a, b, _ in found] == [(40, 43), (83, 86)] and all(abs(s - 8.3) < 1e-9 for _, _, s in found) and all(abs(s - 8.3) < 1e-9 for s in damped)
    # First mentions far apart leave the words of a dense passage to it.
    assert abs(top("vile " + clean + "foul " + clean + "nasty " + clean + bad) - 8.3) < 1e-9
    # The j-th occurrence in a segment counts 1 / j.
    assert abs(top("vile calm vile vile") - (3 - 0.5 + 3 / 2 + 3 / 3)) < 1e-9
    assert abs(top("vile " + "calm " * 4 + "vile") - 3.0) < 1e-9  # 3 - 4 x 0.5 + 3 / 2 is less
    model = toxicity.Model(scores.listed, scores.rest, 1.0, 0.05, 0.05, 1.0)
    grades = [model.surprise(toxicity.segments_of("vile " * k, scores)[2], k) for k in (1, 2, 10, 100, 500)]
    assert grades == sorted(grades) and grades[-1] > 2 * grades[0]
    texts = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([clean + bad + clean + bad + clean])], names=["doc_id", "text"])
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", passage)])
    model.passage_scale = 0.001
    (got,) = toxicity.grade(iter([texts]), type("Shared", (), {"value": model}), schema)
    assert [(p["start"], p["end"]) for p in got["passages"][0].as_py()] == [(40, 43), (83, 86)]


# chat


def test_chat_escapes_everything():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "\\", "\\\\", " ", "\n", "a", "[", "<", "é", "[\\INST]", "</"]
    for _ in range(500):
        told = [(rng.choice(["user", "assistant", "system", "", "<|text|>"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(4)]
        made = [chat_format.render(r, t) for r, t in told]
        assert list(chat_format.read_back("".join(m[0] for m in made))) == told
        assert [chat_format.unescape(m[0][m[1] : m[2]]) for m in made if m[1] is not None] == [t for r, t in told if r == "assistant"]


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", "assistant", "lo"),
        (1, 3, 2, "message", "user", "and?"), (1, 4, 3, "delta", "assistant", "gone"), (1, 5, 2, "edit", None, "and now?"),
        (1, 6, 3, "delta", "assistant", "first"), (1, 7, 3, "regenerate", "assistant", "se"), (1, 8, 3, "delta", "assistant", "cond"),
        (2, None, None, None, None, None), (None, 0, 0, "message", "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(4)
    told = {}
    for r in sorted(chat_format.format_log(events).collect(), key=lambda r: (r.conv_id or 0, r.turn)):
        told.setdefault(r.conv_id, []).extend(chat_format.read_back(r.segment))
    assert told == {1: [("user", "hi"), ("assistant", "Hello"), ("user", "and now?"), ("assistant", "second")], 2: [("", "")], None: [("user", "x")]}
    got = {r.conv_id: r for r in chat_format.format_digests(events).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 11 and got[1].loss_sha256 == hashlib.sha256(b"Hellosecond").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told[1]).encode()).hexdigest()
    assert chat_format.format_digests(events.limit(0)).count() == 0


def replayed(events):
    """Final messages of one conversation by replaying its log in the order of seq."""
    turns = {}
    for _, turn, kind, role, text in sorted(events, key=lambda e: e[0]):
        own = turns.setdefault(turn, [])
        if kind == "delta" and own:
            own[-1] = (role or own[-1][0], own[-1][1] + (text or ""))
        elif kind in ("edit", "regenerate"):
            for later in [t for t in turns if t > turn]:
                del turns[later]
            own[-1:] = [(role or (own[-1][0] if own else ""), text or "")]
        else:
            own.append((role or "", text or ""))
    return [m for t in sorted(turns) for m in turns[t]]


def test_chat_folds_random_logs(spark):
    rng = random.Random(40)
    logs, rows = {}, []
    for c in range(120):
        seqs = rng.sample(range(1000), rng.randrange(1, 25))
        logs[c] = [(s, rng.randrange(5), rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "<s> b\\", "", None, "</s>[INST]", "long " * 50])) for s in seqs]
        rows += [(c, *e, "clash", 1) for e in logs[c]]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string, segment string, n_turns int").repartition(7)
    got = {r.conv_id: r for r in chat_format.format_digests(events).collect()}
    assert len(got) == 120
    for c, log in logs.items():
        told = replayed(log)
        learnt = "".join(t for r, t in told if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest(), c
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(told), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_takes_very_long_texts_and_repeated_rows(spark):
    long = "[INST] \\ " * 200_000
    rows = [(1, 0, 0, "message", "user", long), (1, 1, 1, "message", "assistant", long), (1, 1, 1, "message", "assistant", long)]
    got = chat_format.format_digests(spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")).first()
    assert got.n_turns == 3 and got.loss_chars == 2 * len(long) and got.loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()


# archives


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    long = "<p>" + "x" * 2000
    pages = [(1, "http://a/\r\n%", long), (2, "http://b", long), (3, None, None), (4, "http://é", "short"), (5, "u", "short"), (6, "u", long + "y"), (9, "u", long)]
    rows = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/archive"
    got = {r.page_id: r for r in warc.round_trip(rows, path).collect()}
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = h == long and i != 9
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
    back = warc.read_warc(spark, path)
    assert {(r.record_id, r.target_uri) for r in back.collect()} == {(f"urn:page:{i}", u and u.replace("\r\n", "%0D%0A")) for i, u, _ in pages}
    only = back.filter((F.col("record_type") == "revisit") & F.col("refers_to").isin("urn:page:9"))
    assert only.count() == 2
    assert {r.payload for r in warc.read_warc(spark, path, payload=False).collect()} == {None}
    for f in (tmp_path / "archive").glob("*.warc.gz"):  # any reader of gzip members can read them
        assert gzip.open(io.BytesIO(f.read_bytes())).read().startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(rows.limit(0), f"file://{tmp_path}/none").count() == 0
    assert not list((tmp_path / "archive" / "_temporary").glob("*"))


@pytest.mark.parametrize("heavy", [{}, {"heavy_copies": 3}, {"heavy_copies": 3, "heavy_rows": 1}])
def test_warc_revisits_of_common_pages(spark, tmp_path, heavy):
    rng = random.Random(5)
    texts = ["a" * 1000, "b" * 1500, "é" * 500, "c" * 999, ""]
    rows = [(i, "u", rng.choice(texts[:1] * 8 + texts)) for i in range(300)] + [(None, "u", "b" * 1500), (None, None, None), (299, "u", "a" * 1000), (400, "u", "a" * 1000), (400, "u", "a" * 1000)]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), f"file://{tmp_path}/x", **heavy).collect()), key=str)
    top = {}
    for i, _, h in rows:
        if i is not None and h is not None and len(h.encode()) >= 1000:
            top[h] = max(i, top.get(h, -1))
    want = []
    for i, _, h in rows:
        again = h in top and i != top[h]
        want.append((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    assert got == sorted(want, key=str)


def foreign(kind, uri, block, extra="", end="\r\n"):
    head = f"WARC/1.0{end}warc-type: {kind}{end}WARC-Target-URI:{uri}{end}WARC-Date: 2020-02-02T00:00:00Z{end}WARC-Record-ID: <urn:uuid:{uri}>{end}{extra}Content-Length: {len(block)}{end}{end}"
    return head.encode() + block + end.encode() * 2


def test_warc_reads_archives_of_others(spark, tmp_path):
    inner = foreign("resource", "inner", b"nested")
    nested = inner + gzip.compress(inner)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nbody"
    told = [
        foreign("warcinfo", "http://a/b%20c", b"software: x\r\n", "Content-Type: application/warc-fields\r\nX-Other: one\r\n two\r\n"),
        foreign("response", "http://r", http, "Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: md5:00\r\n"),
        foreign("resource", "http://n", nested), foreign("resource", "http://l", b"x" * 300_000, end="\n"), foreign("metadata", "http://e", b""),
    ]
    (tmp_path / "sub").mkdir()
    (tmp_path / "plain.warc").write_bytes(b"".join(told))
    (tmp_path / "sub" / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, told)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(told)))
    (tmp_path / "mixed.WARC.gz").write_bytes(gzip.compress(told[0]) + warc.member(told[1]) + gzip.compress(told[2]) + b"".join(map(warc.member, told[3:])))
    (tmp_path / "_hidden.warc").write_bytes(b"no archive")
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 4 * len(told)
    got = {r.target_uri: r for r in rows}
    assert {u: sum(r.target_uri == u for r in rows) for u in got} == dict.fromkeys(["http://a/b%20c", "http://r", "http://n", "http://l", "http://e"], 4)
    for r in rows:
        block = {"http://a/b%20c": b"software: x\r\n", "http://r": b"<p>\r\n\r\nbody", "http://n": nested, "http://l": b"x" * 300_000, "http://e": b""}[r.target_uri]
        assert r.payload == block and r.date == "2020-02-02T00:00:00Z" and r.record_id == f"urn:uuid:{r.target_uri}"
    assert got["http://r"].http_header == "HTTP/1.1 200 OK\r\nContent-Type: text/html" and got["http://r"].payload_digest == "md5:00" and got["http://r"].content_length == len(http)
    assert got["http://a/b%20c"].headers["X-Other"] == "one two" and got["http://l"].http_header is None
    one = warc.read_warc(spark, f"file://{tmp_path}/plain.warc", payload=False)
    assert {(r.record_type, r.payload) for r in one.filter("content_length > 100 AND record_type LIKE 'res%'").collect()} == {("resource", None)}
    again = f"file://{tmp_path}/again"
    warc.read_warc(spark, f"file://{tmp_path}/plain.warc").write.format("warc").mode("append").save(again)
    back = {r.target_uri: r for r in warc.read_warc(spark, again).collect()}
    assert all(back[u].payload == r.payload and back[u].http_header == r.http_header and {**back[u].headers, "Content-Length": ""} .items() >= {k.replace("warc-type", "WARC-Type"): v for k, v in r.headers.items() if k not in ("Content-Length", "X-Other")}.items() for u, r in got.items())


def test_warc_names_archives_that_break_off():
    record = foreign("resource", "u", b"x" * 5000)
    for data in (record[:-3000], gzip.compress(record)[:-30], warc.member(record)[:-40], record + b"junk, not a record", gzip.compress(record) + b"\x1f\x8b\x08junk"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records_in(io.BytesIO(data), lambda r: True, True))
    assert len(list(warc.records_in(io.BytesIO(gzip.compress(record) + b"\0" * 512), lambda r: True, True))) == 1
    assert list(warc.records_in(io.BytesIO(b""), lambda r: True, True)) == []


def test_warc_skips_what_a_predicate_rejects():
    reader = warc.WarcReader("file:///none", True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 5)]))
    assert left == [] and reader.wanted({"record_type": "response", "payload_length": 6}) and not reader.wanted({"record_type": None, "payload_length": 6})
    assert not reader.wanted({"record_type": "response", "payload_length": 5}) and len(list(reader.pushFilters([EqualTo(("payload",), b"x")]))) == 1
    data = b"".join(warc.member(warc.header_of({"record_id": f"urn:page:{i}", "record_type": "response"}, 3) + b"abc\r\n\r\n") for i in range(3))
    assert [r["payload"] for r in warc.records_in(io.BytesIO(data), lambda r: r["record_id"].endswith("1"), True)] == [b"abc"]


# pages


def brute_texts(pages):
    """Main text of every page of one host, from the definitions."""
    import math

    leaves, styles = {}, {}
    for p in set(pages):
        blocks, children = read_blocks(p, "h")
        for b in blocks:
            leaf = leaves.setdefault(b.node, {"parent": b.parent, "named": b.named, "state": b.state, "on": {}})
            leaf["on"].setdefault(b.text, set()).add(p)
        for place, style in children:
            styles.setdefault(place, []).append(style)
    entropy = lambda counts, m: -sum(c / m * math.log(c / m, m) for c in counts)
    size = lambda ls: sum(len(t) * len(on) for x in ls for t, on in x["on"].items())
    every, plain = size(leaves.values()), [x for x in leaves.values() if not x["named"]]
    marked, outside = size(x for x in plain if x["state"]), size(x for x in plain if x["state"] == 2)
    noise = {}
    for node, x in leaves.items():
        m = len(set().union(*x["on"].values()))
        content = 1 - sum(math.log(len(on), m) for on in x["on"].values()) / len(x["on"]) if m > 1 else 1.0
        seen = styles.get(x["parent"], [])
        kinds = [seen.count(k) for k in set(seen)]
        presentation = entropy(kinds, len(seen)) if len(seen) > 1 else 1.0
        weight = 0.9 ** max(len(kinds), 1)
        importance = min(content, (1 - weight) * presentation + weight * content)
        if m < 5 or size([x]) >= 0.5 * every:
            importance = 1.0
        if x["named"] and size(y for y in leaves.values() if y["named"] == x["named"]) < 0.9 * every:
            importance *= 0.1
        elif x["state"] == 2 and outside < 0.9 * marked:
            importance *= 0.1
        often = {t for t, on in x["on"].items() if m >= 5 and x["state"] == 0 and math.log(len(on)) >= 0.8 * math.log(m) - 1e-12}
        noise[node] = (importance < 0.2, often)
    return ["\n\n".join(b.text for b in read_blocks(p, "h")[0] if not noise[b.node][0] and b.text not in noise[b.node][1]) for p in pages]


def main_text(page):
    return brute_texts([page])[0]


def random_site(rng, n):
    """Pages of one site: fixed and changing menus, boxes with and without names, marks or none, articles that share passages."""
    shared = [words(rng, rng.randrange(3, 12)) for _ in range(6)]
    some = lambda: rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randrange(2, 25))
    kinds = rng.sample(["<nav>{}</nav>", "<div class='ad'><p>{}</p></div>", "<div class='k1'>{}</div>", "<ul><li>{}<li>{}</ul>", "<div class='widget'><p>{}</p></div>", "<section id='s9'><span>{}</span></section>", "<footer>{}</footer>"], 4)
    mark = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='m'>{}</div>", "<div class='widget'>{}</div>"])
    fixed = [rng.random() < 0.5 for _ in kinds]
    out = []
    for _ in range(n):
        parts = [k.replace("{}", shared[i] if fixed[i] else some()) for i, k in enumerate(kinds) if rng.random() < 0.9]
        body = "".join(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<div class='z'>{}</div>"]).format(some()) for _ in range(rng.randrange(1, 5)))
        out.append("<body>" + "".join(parts[:2]) + (mark if rng.random() < 0.9 else "<p>{}</p>").format(body) + "".join(parts[2:]))
    return out + out[:1]


def test_extraction_matches_a_brute_force_tree(spark):
    rng = random.Random(21)
    sites = {f"s{k}.example": random_site(rng, rng.choice([1, 4, 12, 40])) for k in range(14)}
    rows = [(i, h, p) for i, (h, p) in enumerate((h, p) for h, pages in sites.items() for p in pages)]
    frame = spark.createDataFrame([(i, f"https://{h}/{i}", p, "clash", 0) for i, h, p in rows], "page_id long, url string, html string, text string, n_chars int").repartition(4)
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    want = dict(zip([i for i, _, _ in rows], [t for pages in sites.values() for t in brute_texts(pages)], strict=True))
    assert got == want and len(set(got.values())) > 100


def test_names_and_marks_are_overturned_by_the_tree():
    rng = random.Random(3)
    widget = [f"<div class='widget'><p>{words(rng, 60)}</p></div><p>tail {i}</p>" for i in range(12)]
    assert all(t.count(" ") > 50 for t in brute_texts(widget))
    cards = [f"<div class='x'><p>{words(rng, 60)}</p></div><article>card {i}</article>" for i in range(12)]
    assert all(t.count(" ") > 50 for t in brute_texts(cards))


def test_reading_a_page_takes_linear_time():
    import time

    def took(page):
        began = time.perf_counter()
        read_blocks(page, "h")
        return time.perf_counter() - began

    for unit in ("<div>", "<a ", "<a '\"><b>x", "<!x", "<li><b></q>", "<svg>t<p>", "<li><ul>", "<a \"x>"):
        best = [min(took(unit * n) for _ in range(3)) for n in (4_000, 32_000)]
        assert best[1] < 24 * best[0] + 0.02, unit  # 8 times as long; quadratic would be 64
    assert read_blocks("<p " + 'x="' * 5000, "h")[0][0].text.startswith("<p")


def test_very_long_pages_and_null_ids(spark):
    long = "<article>" + "".join(f"<p>Part {i} of it</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a/1", long), (None, None, "<p>x"), (1, "http://a/1", long), (None, None, "<p>x"), (2, "http://a/2", "<div>" * 30_000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == sorted([(1, len("\n\n".join(f"Part {i} of it" for i in range(20_000))))] * 2 + [(0, 1)] * 2 + [(2, 4)])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li>Menu<li>Two</ul></nav><div class="cookie-notice">We use cookies</div><!-- <article>no</article> -->
<article><h1>Head &amp;amp;  line</h1><p><b>One<br>two<p>Three &copy 2020&nbsp;x
<table><tr><td>a<td>b</table><aside>Side</aside><form>F<input></form><div class="comments"><p>Reader says</div><p title="a > b">Last</article>
<footer>&copy; foot</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "Head &amp; line\n\nOne two\n\nThree © 2020 x\n\na\n\nb\n\nLast"
    assert main_text("") == "" and main_text("<") == "<"
    assert main_text("<p>a</p>b <i>c</i>") == "a\n\nb c"
    assert main_text("<p " + 'x="' * 5000).startswith("<p")


def test_an_article_does_not_replace_the_main_element_around_it():
    card = "<main><h1>Title</h1><p>whole story</p><article class='card'>teaser</article></main>"
    assert main_text(f"<p>outside</p>{card}") == "Title\n\nwhole story\n\nteaser"
    assert main_text("<main><h1>Title</h1><article><p>Text</p></article></main>") == "Title\n\nText"


def test_names_are_noise_as_whole_tokens_only():
    read = main_text
    for wrapper in ("<body class='content no-sidebar'>", "<body class='search'>", "<article class='post comments-open'>", "<article id='notice'>", "<main class='has-header share'>", "<div class='has-header'>"):
        assert read(f"<html>{wrapper}<p>Whole text</p>") == "Whole text", wrapper
    assert read("<article><h2 id='legal-basis'>Law</h2><h3 class='notice'>N</h3><section id='social-effects'><p>Effects</p></section></article>") == "Law\n\nN\n\nEffects"
    for name in ("ad", "ad-300", "ad300", "cookie-notice", "social_share", "box comments"):
        assert read(f"<article><p>Text</p><div class='{name}'><p>Noise</p></div></article>") == "Text", name


def test_inline_noise_leaves_its_paragraph_whole():
    read = main_text
    assert read("<p>One <button>Copy</button>two <span class='ad'>Buy <b>now</b></span>three</p><p>Next</p>") == "One two three\n\nNext"
    assert read("<p>One <span hidden>no</p><p>Next <svg/>one</p>") == "One\n\nNext one"
    assert read("<p>One <button>x<div>y</div>z</button> two</p>") == "One\n\ntwo"


def test_style_tree_removes_what_a_site_repeats(spark, monkeypatch):
    rng = random.Random(9)

    def page(body):
        return f"<html><body><div><span>Site name and slogan</span></div><div class='x'><p>{body}</p></div><div>All rights kept</div></body></html>"

    bodies = [words(rng, 30) for _ in range(40)]
    rows = [(i, f"https://{'a' if i % 2 else 'b'}.example/{i}", page(b)) for i, b in enumerate(bodies)] + [(90, None, None), (91, "http://one", page("only page here")), (91, "http://one", page("only page here"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 43 and all(text[i] == b for i, b in enumerate(bodies))
    assert text[90] == "" and text[91] == "Site name and slogan\n\nonly page here\n\nAll rights kept"  # one page tells nothing of its site
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0
    noise_of = html_extract.noise_of
    monkeypatch.setattr(html_extract, "noise_of", lambda *a: noise_of(*a).limit(0))
    assert html_extract.extract(spark.createDataFrame([(1, "http://x", PAGE)], "page_id long, url string, html string")).first().text.startswith("Menu\n\nTwo\n\nWe use")


def test_article_is_left_alone(spark):
    shared = "<p>Every article ends so.</p>"
    rows = [(i, "http://h/x", f"<nav>Menu</nav><article><p>Text {i}</p>{shared}</article>") for i in range(20)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text {i}\n\nEvery article ends so." for i in range(20)}
    assert html_lib.unescape("&amp;") == "&"


def test_style_tree_judges_branches_inside_articles(spark):
    box = "<div class='x'>Read also: our archive</div>"
    extra = ["", "<ul><li>one {0}</li></ul>", "<h2>Part {0}</h2>", "<blockquote>Said {0}</blockquote>"]
    rows = [(i, "http://h/x", f"<article><h1>Head {i}</h1>{box}<p>Text of number {i} and so on to its end.</p>{extra[i % 4].format(i)}</article>") for i in range(20)]
    # Another site gives the same article on every page under its own heading.
    same = "<p>" + "The same long text stands here. " * 5 + "</p>"
    rows += [(100 + i, "http://g/x", f"<article><h1>Head {i}</h1>{same}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    tail = ["", "\n\none {0}", "\n\nPart {0}", "\n\nSaid {0}"]
    assert all(got[i] == f"Head {i}\n\nText of number {i} and so on to its end." + tail[i % 4].format(i) for i in range(20))
    assert all(got[100 + i].startswith(f"Head {i}\n\nThe same long text") for i in range(20))


# scratch


def test_rows_with_and_without(spark):
    rows, keys = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    assert {r.k for r in scratch.rows_with(rows, keys, "k").collect()} == set(range(0, 1000, 3))
    assert {r.k for r in scratch.rows_without(rows, keys, "k").collect()} == set(range(1000)) - set(range(0, 1000, 3))


# quality


def test_quality_orders_grades(spark, empty):
    from prismview.llm import quality

    rng = random.Random(3)
    kinds = ["bad junk filler", "plain middling", "fine lucid prose"]
    rows = [(i, words(rng, 30, 50) + " " + kinds[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "fine lucid prose")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i, _ in rows] + [(9000, None), (None, 2)], "doc_id long, grade int")
    got = {r.doc_id: r for r in quality.grade(docs, ratings, least=2).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 903 and all(got[i].held_out for i in held) and got[None].held_out is False
    means = [np.mean([got[i].expected_grade for i in held if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([got[i].kept == (i % 3 == 2) for i in held]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in got.values())
    one = quality.grade(docs, ratings.filter("grade = 2"), least=1).collect()
    assert {(r.expected_grade, r.tail, r.kept) for r in one} == {(2.0, 1.0, True)}
    assert {r.expected_grade for r in quality.grade(docs, ratings.limit(0)).collect()} == {None}
    assert quality.grade(empty, ratings).count() == 0


def test_quality_gradient_matches_differences():
    from prismview.llm import quality
    import pyarrow as pa

    class Shared:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.SLOTS) / 5, np.array([-0.5, 0.7]))
    slots = [[1, 2, 3, 9], [2, 8], [5]]
    batch = pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.int32())), pa.array([3, 1, 0], pa.int32()), pa.array([0, 1, 2], pa.int32()), pa.array([1.0, 2.0, 0.5])], names=["slots", "n_words", "grade", "weight"])
    (out,) = list(quality.gradient(iter([batch]), Shared(model)))
    g_w, g_t = np.frombuffer(out["weights"][0].as_py()), np.frombuffer(out["thresholds"][0].as_py())

    def likelihood(m):
        total = 0
        for s, n, k, w in zip(slots, (3, 1, 0), (0, 1, 2), (1.0, 2.0, 0.5), strict=True):
            tails = np.concatenate([[1], m.tails(m.axis(np.array(s), n)), [0]])
            total += w * math.log(tails[k] - tails[k + 1])
        return total

    import math

    for j in (1, 2, 9, 5):
        step = np.zeros(quality.SLOTS)
        step[j] = 1e-5
        numeric = (likelihood(quality.Model(model.weights + step, model.thresholds)) - likelihood(quality.Model(model.weights - step, model.thresholds))) / 2e-5
        assert abs(numeric - g_w[j]) < 1e-6
    for k in (0, 1):
        step = np.zeros(2)
        step[k] = 1e-5
        numeric = (likelihood(quality.Model(model.weights, model.thresholds + step)) - likelihood(quality.Model(model.weights, model.thresholds - step))) / 2e-5
        assert abs(numeric - g_t[k]) < 1e-6


def test_quality_fit_matches_brute_force(spark, monkeypatch):
    import math

    from prismview.llm import quality

    rng = random.Random(8)
    monkeypatch.setattr(quality, "CONVERGED", 1e-7)
    rows = [(i, " ".join(rng.choice("abcdef"[: 3 + i % 3]) * 3 for _ in range(6)), i % 3) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int"), steps=400)
    used = [(quality.features(t), g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 5]
    slots = sorted({int(x) for (f, _), _ in used for x in f})
    own = np.zeros((len(used), len(slots)))
    for r, ((f, n), _) in enumerate(used):
        for k, x in enumerate(f):
            own[r, slots.index(int(x))] += 1 / math.sqrt(n) if k < n else 1.0
    grade = np.array([g for _, g in used])

    def penalised(w, t):
        tails = 1 / (1 + np.exp(-(own @ w)[:, None] + t[None, :]))
        tails = np.hstack([np.ones((len(used), 1)), tails, np.zeros((len(used), 1))])
        at = np.arange(len(used))
        return np.mean(np.log(tails[at, grade] - tails[at, grade + 1])) - quality.RIDGE / 2 * (w @ w)

    # Plain gradient ascent with differences, from where the fit ended: nothing more is to be gained.
    w, t = model.weights[slots].copy(), model.thresholds.copy()
    reached = penalised(w, t)
    for _ in range(200):
        base, up = penalised(w, t), np.zeros(len(w) + 2)
        for k in range(len(up)):
            step = np.zeros(len(up))
            step[k] = 1e-5
            up[k] = (penalised(w + step[:-2], t + step[-2:]) - base) / 1e-5
        w, t = w + 0.2 * up[:-2], t + 0.2 * up[-2:]
    assert penalised(w, t) - reached < 2e-3 * abs(reached)
    assert np.abs(np.delete(model.weights, slots)).max() == 0 and t[0] < t[1]


def test_quality_ascent_stops_when_it_has_converged():
    from prismview.llm import quality

    target = np.arange(1.0, 6.0)
    calls = []

    def objective(p):
        calls.append(p)
        return -1 - float(((p - target) ** 2 * target).sum()), -2 * (p - target) * target

    point, used = quality.ascend(objective, np.zeros(5), 100, 1e-9)
    assert np.abs(point - target).max() < 1e-3 and used == len(calls) < 40
    assert quality.ascend(objective, target.copy(), 100)[1] <= 30


def test_quality_takes_clashing_columns_and_long_texts(spark):
    from prismview.llm import quality

    rows = [(i, "fine words here " * (40_000 if i == 7 else 3) if i % 2 else "junk junk junk junk", "x", 1.0, True) for i in range(60)] + [(7, "fine words here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string, tail double, kept boolean")
    got = quality.grade(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")).collect()
    assert len(got) == 61 and sum(r.doc_id == 7 for r in got) == 2 and all(r.kept == (r.doc_id % 2 == 1) for r in got)
