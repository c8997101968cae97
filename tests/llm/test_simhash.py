"""SimHash near-duplicates against a brute-force comparison of all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobtables.llm.simhash import (keep_one_per_group, link_fingerprints, simhash_components)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF01 = "/root/testdata/sf0.01"


def brute_fp(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, bits=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(simhash_components(docs)) == brute(rows)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    base = "one two three four five six seven eight nine ten"
    rows = [(1, base), (2, base.upper()), (2, base), (3, None), (4, ""), (5, " \t\n"), (None, base),
            (6, "two words"), (7, "Two\x0bwords"), (8, "x " * 30000), (None, "alone here now ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit("x") for c in ("fp", "label", "component_id", "row", "u")})
    assert got(simhash_components(df)) == brute(rows)
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "8", "None"]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash_components(df).count() == 0
    assert keep_one_per_group(df).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 4, 7])
def test_pigeonring_finds_every_pair(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    out = set(base.tolist())
    for b in base.tolist():
        for k in range(1, bits + 3):
            out.add(b ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in out)
    want = {(a, b) for a in signed for b in signed
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert {(r.u, r.v) for r in link_fingerprints(df, bits).collect()} == want
