"""The pipeline against a brute-force version, stage by stage on what the stage before kept."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from prismview.llm import toxicity


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low(t)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_kept(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in rows if find(i) == i]


def clean_of(rows, phrases):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    windows = {tuple(w[k : k + 13]) for w in map(words, phrases) if w for k in range(max(1, len(w) - 12))}
    kept = []
    for i, t in rows:
        w, hit = words(t), set()
        for win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((i, t))
    return kept


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"t{rng.randrange(500)}" for _ in range(n))
    phrase = text(20)
    rows = [text(rng.randrange(5, 90)) for _ in range(220)]
    rows += [r.upper() for r in rows[:20]] + [r + " tail" for r in rows[20:60]] + [f"{text(20)} {phrase} {text(5)}" for _ in range(6)] + [f"{phrase} {text(600)}", None, "", ""]
    rows = [r if i % 9 or not r else f"{r} nastyone nastytwo nastyone vilest" for i, r in enumerate(rows)]
    docs = [(i, r, "en", "s", len(r or "")) for i, r in enumerate(rows)]
    labels = [(i, 1, int(i % 9 == 0)) for i in range(len(rows)) if i % 2]  + [(i, 1, int(i % 9 == 0)) for i in range(0, len(rows), 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(read("documents"), read("labels")).filter("predicted = 1").collect()}
    held = [i for i in range(220) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((i in toxic) == (i % 9 == 0) for i in held)
    left = [(i, t) for i, t in enumerate(rows) if i not in toxic]
    best = {}
    for i, t in left:
        best[low(t)] = i
    left = clean_of(near_kept([(i, t) for i, t in left if best[low(t)] == i]), [phrase])

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(n for n, _ in want.values()) // 4096)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).dtypes == empty.dtypes
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
