"""Defined cases of operators and stages: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from contactloom.llm import ann, bpe, langid, linedup, neardup, packing, quality, queries, sharding

WORDS = [f"w{k}" for k in range(400)]
BASE = " ".join(WORDS[:120])
NEAR = BASE.replace("w60", "x60")
LONG = " ".join(f"v{k % 977}" for k in range(60_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "two words"), (5, "two words"), (6, BASE), (6, BASE), (7, NEAR), (8, NEAR + " more"), (9, LONG), (10, LONG), (None, BASE), (None, None),
    (11, " ".join(WORDS[200:320])), (11, NEAR + " end"), (12, "🙂 é " + " ".join(WORDS[150:260])),
]
#: names that the operators use inside
SCHEMA = "doc_id bigint, text string, sid bigint, h string, t string, _row int, _d int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, k % 3, "h", "t", k, 0) for k, (i, x) in enumerate(ROWS)], SCHEMA)


def shingles(x):
    w = x.split()
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2)))


def groups():
    """Class of each (doc_id, text) by comparing all sets."""
    rows = sorted({(i if i is not None else -1, x) for i, x in ROWS if x is not None and x.split()})
    sets = [shingles(x) for _, x in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            top[b] = a
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(rows[k])
    return {r: min(i for i, _ in ms if i >= 0) for ms in members.values() for r in ms}


def test_near_duplicates_defined_cases(docs):
    got = neardup.near_duplicates(docs, 3, 85).collect()
    assert len(got) == len(ROWS)
    want = groups()
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)
    wanted = []
    for i, x in ROWS:
        w = (x or "").split()
        n = len(shingles(x)) if w else 0
        wanted.append((i, n, want[(i if i is not None else -1, x)] if w else i))
    assert rows == sorted(wanted, key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_one_of_each_group_stays(docs):
    kept = neardup.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    want = groups()
    left = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> '' AND text <> ' \t\n'").collect())
    assert left == sorted({(i, x) for i, x in ROWS if i is not None and x and x.split() and want[(i, x)] == i})
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_bucket_of_many_texts_below_the_threshold_makes_few_candidates(spark):
    """A frequent passage with an own end each: all pairs meet in buckets, none is a link, next to none a candidate."""
    rng = np.random.default_rng(8)
    rows = [(k, BASE + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**9, 30))) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = []
    across = neardup._across

    def counted(*a):
        out = across(*a)
        seen.append(out.count())
        return out

    neardup._across = counted
    try:
        got = neardup.near_duplicates(d, 3, 85).collect()
    finally:
        neardup._across = across
    assert all(r["kept"] for r in got) and seen[0] < 300


def test_stages_on_defined_cases(spark, docs, tmp_path):
    import corpus_pipeline

    wide = docs.withColumn("lang", docs["h"]).withColumn("source", docs["h"]).withColumn("n_chars", docs["sid"])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "line_dedup", "near_dedup", "packing"]
    for d in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, "")
            out.collect()
            if name != "packing":
                assert out.columns == d.columns


def test_encoders_and_shards_on_defined_cases(docs):
    path = queries.tokenizer_path()
    for f in (lambda d: bpe.encode_digests(d, path), lambda d: packing.pack(d, path), sharding.shard, quality.quality_rules, langid_rows, lambda d: linedup.line_dedup(d)):
        assert f(docs).count() >= len(ROWS) and f(docs.limit(0)).count() == 0


def langid_rows(docs):
    from pyspark.sql import functions as F

    return langid.language(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))


def test_pieces_equal_the_library_cut_by_hand(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.no_padding()
    tok.no_truncation()
    texts = {1: None, 2: "one two", 3: LONG[:9000], 4: "é漢 " * 500, 5: "a <|endoftext|> b"}
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), queries.tokenizer_path()).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for k, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want = [(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(itertools.pairwise(bounds))]
        assert sorted(got[k]) == want


def test_equal_language_scores_and_very_long_texts(spark):
    rows = [(k, ("aba bab " if k % 2 else "cdc dcd ") * 30, "aa" if k % 2 else "bb") for k in range(12)]
    d = spark.createDataFrame([*rows, (100, "aba cdc", None), (101, "aba " * 400_000, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language(d).collect()}
    assert got[100]["lang_pred"] in ("aa", "bb") and got[101]["lang_pred"] == "aa" and len(got) == 14


def test_nearest_of_an_all_null_table(spark):
    d = spark.createDataFrame([(20, None), (None, [1.0])], "vec_id bigint, embedding array<float>")
    assert ann.nearest(d).count() == 0
