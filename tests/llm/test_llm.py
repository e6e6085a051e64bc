"""The training-data operators against statements, brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest

from contactloom.llm import ann, html, langid, licenses, linedup, neardup, packing, quality, queries, tokens

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox and a dog of it " * 4000
EDGE = [(0, None, "a"), (1, "", "b"), (2, " \t\n", "c"), (3, "one two", "d"), (3, "one two", "d"), (4, LONG, "e"), (5, LONG, "f"), (6, "🙂 é", None)]
SCHEMA = "doc_id bigint, text string, _row string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_statement(spark, name):
    oracle.same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("f", [quality.quality_rules, licenses.license_scan, linedup.line_dedup, lambda x: packing.token_pieces(x, queries.tokenizer_path())])
def test_edges_keep_every_row(edge, f):
    assert [r["doc_id"] for r in f(edge).orderBy("doc_id").select("doc_id").collect() if r["doc_id"] != 4 and r["doc_id"] != 5] == [0, 1, 2, 3, 3, 6]
    assert f(edge.limit(0)).count() == 0


def test_quality_edges(edge):
    rows = {r["doc_id"]: r for r in quality.quality_rules(edge).collect()}
    assert all(rows[k]["n_words"] == 0 and rows[k]["base_failed"] for k in (0, 1, 2))
    assert rows[4]["n_words"] == 36_000 and rows[4]["n_repeat_words"] == 36_000
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and kept.count() == 0


def test_quality_filter_keeps_what_the_verdict_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.language(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [k for k, r in got.items() if r["held_out"] and lang[k] and r["lang_pred"] != "und"]
    assert len(held) > 30 and np.mean([got[k]["lang_pred"] == lang[k] for k in held]) > 0.9


def test_language_edges(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "123", None), (3, "the cat", None)], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in langid.language(d).collect()} == {"und"}
    assert langid.language(d.limit(0)).count() == 0 and langid.keep_known(d).columns == d.columns


def test_html():
    page = "<html><head><title>t</title><script>x</script></head><body><nav><a>Home</a></nav><article><h1>Big &amp; small</h1><p>First  long\nparagraph of text here.</p><p>Second one.</p></article><footer>f</footer></body></html>"
    assert html.main_text(page) == "Big & small\n\nFirst long paragraph of text here.\n\nSecond one."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""


def brute_lines(docs, least):
    """Lines in a later copy of a run of equal lines with enough words, by comparing all pairs of places."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = sorted({(d, t) for d, t in docs if t is not None})
    seqs = [[(i, x, len(word.findall(x))) for i, x in enumerate(t.split("\n")) if word.search(x)] for _, t in rows]
    places = [(s, j) for s, q in enumerate(seqs) for j in range(len(q))]
    gone = defaultdict(set)
    for (s, j), (u, k) in itertools.combinations(places, 2):
        n = total = 0
        while j + n < len(seqs[s]) and k + n < len(seqs[u]) and seqs[s][j + n][1] == seqs[u][k + n][1]:
            total += seqs[s][j + n][2]
            n += 1
        if total >= least:
            gone[rows[u][0]] |= {seqs[u][k + m][0] for m in range(n)}
    return gone


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(k, "\n".join(f"w{x} v{x}" for x in rng.integers(0, 5, rng.integers(1, 14)))) for k in range(25)]
    got = {r["doc_id"]: {int(x) for x in r["deleted"].split(",") if x} if r["deleted"] else set() for r in linedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), 6).collect()}
    want = brute_lines(docs, 6)
    assert {k for k, v in got.items() if v} == {k for k, v in want.items() if v}
    assert all(got[k] == v for k, v in want.items())


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if w and len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, texts, size, percent):
    sets = {k: shingles(t, size) for k, t in texts.items()}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            top[b] = a
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), size, percent).collect()}
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    from contactloom.llm import bpe

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    cases = dict(texts) | {10_000 + k: t for k, (_, t, _) in enumerate(EDGE)}
    got = {r["doc_id"]: r for r in bpe.encode_digests(spark.createDataFrame(list(cases.items()), "doc_id bigint, text string"), path).collect()}
    for k, t in cases.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert tokens.load(path).merge(b"abcabc") == tok.encode("abcabc", add_special_tokens=False).ids


def test_nearest_recall(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    good = {i: np.asarray(v, float) for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    got = defaultdict(list)
    for r in ann.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ good[q]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits += len(set(order) & {i for i, _ in got[q]})
        total += len(order)
        assert all(abs(v - good[i] @ good[q]) < 1e-9 for i, v in got[q])
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (20, [1.0, 2.0]), (5, [1.0, 2.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())
    assert got == [(0, 1, 5, 5.0), (0, 2, 20, 5.0), (20, 1, 0, 5.0), (20, 2, 5, 5.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_packing_is_gapless(spark, edge):
    rows = packing.pack(edge, queries.tokenizer_path()).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(held) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(edge.limit(0), queries.tokenizer_path()).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.keep_good(docs)
    kept = {r["doc_id"] for r in neardup.keep_one(linedup.without_copies(langid.keep_known(good))).collect()}
    assert len(corpus_pipeline.STAGES) == 5
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == kept
