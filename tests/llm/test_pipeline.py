"""The pipeline, stage by stage, against plain versions of each decision."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_decontaminate import plain_tiles
from test_simhash import brute_fp
from tokenizers import Tokenizer

import corpus_pipeline
from jobtables.llm.decontaminate import words
from jobtables.llm.mixing import mix
from jobtables.llm.quality import classify

SF001 = "/root/testdata/sf0.001"


def groups(rows):
    """Components of fingerprints at most 4 bits apart, as lists of rows."""
    fps, left, out = [brute_fp(r.text) for r in rows], set(range(len(rows))), []
    while left:
        todo, own = [min(left)], []
        left.discard(todo[0])
        while todo:
            i = todo.pop()
            own.append(i)
            near = [j for j in left if (fps[i] ^ fps[j]).bit_count() <= 4]
            left -= set(near)
            todo += near
        out.append([rows[i] for i in own])
    return out


def contaminated(text, items):
    """Plain tiling of the items that share at least a run of five words."""
    w = words(text)
    runs = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for item in items:
        shared = [i for i in range(len(item) - 4) if tuple(item[i:i + 5]) in runs]
        if len({i + k for i in shared for k in range(5)}) >= 0.8 * len(item) \
                and plain_tiles(item, w, 5) >= 0.8 * len(item):
            return True
    return False


def test_stages_against_plain_decisions(spark, tmp_path):
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == \
        ["quality", "simhash", "benchmark", "mixing", "token"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    items = [w for w in (words(r.text) for r in bench.collect()) if len(w) >= 5]
    steps, now = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF001).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(now)
    assert all(s.columns == docs.columns for s in steps[:5])
    rows = [s.collect() for s in steps]
    ids = lambda r: Counter(x.doc_id for x in r)
    good = {r.doc_id for r in classify(docs, labels).collect() if r.predicted}
    assert ids(rows[1]) == Counter(r.doc_id for r in rows[0] if r.doc_id in good)
    assert ids(rows[2]) == Counter(min(r.doc_id for r in g) for g in groups(rows[1]))
    assert ids(rows[3]) == Counter(r.doc_id for r in rows[2] if not contaminated(r.text, items))
    taken = {r.doc_id: r for r in mix(steps[3]).collect()}
    times = ids(rows[4])
    assert all(taken[d].taken == taken[d].size * times[d] for d in taken) and set(times) <= set(taken)
    tok, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows[4], key=lambda r: r.doc_id):
        t = tok.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        start += len(t)
    assert sorted(map(tuple, rows[5])) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).collect())) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0
        docs = docs if "start" in out.columns else out
