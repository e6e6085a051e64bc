"""Operators on what an earlier version left out."""

import itertools
import textwrap
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from contactloom.llm import ann, langid, licenses, linedup


@pytest.mark.parametrize("width", [40, 79])
def test_wrapped_notices_match(spark, width):
    rows = [(k, "Some prose before.\n" + textwrap.fill("Filler words here. " + t, width, subsequent_indent=" * ") + "\nand after") for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0


def test_scattered_template_words_do_not_match(spark):
    text = "\n".join(w + " filler" * 10 for w in licenses.template_words(licenses.TEMPLATES[4][1]))
    assert licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["labels"] == ""


def test_passage_joined_to_other_text_goes(spark):
    passage = "Ab cd, ef gh.\n" + ", ".join(f"p{k} q{k}" for k in range(26)) + ". Yz zy.\nlast words, xa xb."
    docs = [(1, f"one two three {passage} four five\nend of one"), (2, f"six seven {passage}*** eight\nend of two"), (3, "a b, c d.\ne f")]
    got = {r["doc_id"]: r for r in linedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1]["text"] == docs[0][1] and got[3]["text"] == docs[2][1]
    assert got[2]["text"] == "six seven Ab cd,\n xa xb.*** eight\nend of two" and got[2]["deleted"] == "1"


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_that_share_no_run_are_not_shuffled(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"{rng.integers(1 << 60):x}"
    docs = [(k, "\n".join(" ".join(word() for _ in range(n)) for n in rng.integers(1, 25, 60))) for k in range(150)]
    docs += [(k, docs[k - 150][1].replace("\n", f"\n{k} ", 3)) for k in range(150, 155)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    got = linedup.line_dedup(df).collect()
    assert {r["doc_id"] for r in got if r["n_deleted"]} == set(range(150, 155)) and len(got) == 155
    assert shuffled(spark) - before < sum(len(x) for _, x in docs) / 3


def test_runs_of_long_and_short_lines_against_brute_force(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 1, 1, 2, 3, 5, 8, 12, 13, 14, 20, 25, 36, 37, 49, 50, 60]
    lines = [" ".join(f"l{k}w{m}" for m in range(n)) for k, n in enumerate(sizes)]
    seqs = []
    for k in range(60):  # some take a stretch of an earlier one
        own = list(rng.integers(0, 3 if k % 5 == 0 else len(sizes), rng.integers(1, 70)))
        if seqs and k % 2:
            other = seqs[rng.integers(len(seqs))]
            own[len(own) // 2 : len(own) // 2] = other[rng.integers(len(other)) :][: rng.integers(1, 60)]
        seqs.append(own)
    want = [set() for _ in seqs]
    for v, b in enumerate(seqs):
        for u, a in enumerate(seqs[: v + 1]):
            for j in range(len(a)):
                for k in range(len(b)):
                    if (u, j) < (v, k):
                        n = 0
                        while j + n < len(a) and k + n < len(b) and a[j + n] == b[k + n]:
                            n += 1
                        if sum(sizes[x] for x in b[k : k + n]) >= 50:
                            want[v] |= set(range(k, k + n))
    docs = [(k, "\n".join(lines[x] for x in s)) for k, s in enumerate(seqs)]
    got = {r["doc_id"]: {int(x) for x in r["deleted"].split(",") if x} if r["deleted"] else set() for r in linedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[k] for k in range(len(seqs))] == want and sum(map(bool, want)) > 20


def test_line_dedup_reads_the_texts_four_times(spark):
    docs = [(k, "\n".join(f"a{k} b{j} c{j * (k % 7)}" for j in range(40))) for k in range(60)]
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 2).map(lambda r: (read.add(1), r)[1]), "doc_id bigint, text string")
    assert len(linedup.line_dedup(df).collect()) == 60
    assert read.value <= 4 * 60


def test_long_blocks_of_one_word_lines_against_brute_force(spark):
    rng = np.random.default_rng(17)
    sizes = [1] * 40 + [2, 7, 30, 55]
    lines = [" ".join(f"l{k}w{m}" for m in range(n)) for k, n in enumerate(sizes)]
    pool = list(rng.integers(0, 40, 300))
    seqs = []
    for _ in range(14):  # blocks of one-word lines, some with others before, between and behind them, that come again in the text and in others
        own = []
        for _ in range(rng.integers(1, 4)):
            at = rng.integers(0, 150)
            own += pool[at : at + rng.integers(45, 150)] + list(rng.integers(40, 44, rng.integers(0, 3)))
        seqs.append(list(rng.integers(40, 44, rng.integers(0, 2))) + own + own[: rng.integers(0, 120)])
    want = [set() for _ in seqs]
    for v, b in enumerate(seqs):
        for u, a in enumerate(seqs[: v + 1]):
            n = np.zeros((len(a) + 1, len(b) + 1), int)
            words = np.zeros_like(n)
            for j in range(len(a) - 1, -1, -1):
                for k in range(len(b) - 1, -1, -1):
                    if a[j] == b[k] and (u, j) < (v, k):
                        n[j, k], words[j, k] = n[j + 1, k + 1] + 1, words[j + 1, k + 1] + sizes[a[j]]
                        if words[j, k] >= 50:
                            want[v] |= set(range(k, k + n[j, k]))
    docs = [(k, "\n".join(lines[x] for x in s)) for k, s in enumerate(seqs)]
    got = {r["doc_id"]: {int(x) for x in r["deleted"].split(",") if x} if r["deleted"] else set() for r in linedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[k] for k in range(len(seqs))] == want and sum(map(bool, want)) > 10


def test_long_words_count_to_their_end():
    assert set(langid.features("abcdefghijklmnopqrstuvwxyz" * 4 + "qzq" + "z" * 30, [])) != set(langid.features("abcdefghijklmnopqrstuvwxyz" * 4 + "zzz" + "z" * 30, []))
    n = 300
    assert len(langid.features("".join(chr(0x4E00 + k) for k in range(n)), [])) == 1 + 7 + (n + 1) + n


def test_text_of_one_long_run_is_told_by_all_of_it():
    a, b = "abc" * 6, "xyz" * 6
    model = langid.train([(" ".join([a[k:] for k in range(9)]), "aa"), (" ".join([b[k:] for k in range(9)]), "bb")] * 5)
    langs, _ = langid._predict(model, ["abc" * 12 + "xyz" * 200 + "abc", "xyz" * 12 + "abc" * 200 + "xyz"])
    assert langs == ["bb", "aa"]


def test_long_labelled_documents_are_learned_from(spark):
    rows = [(k, ("abc bca cab " if k % 2 else "xyz yzx zxy ") * 600, "aa" if k % 2 else "bb") for k in range(20)]
    got = langid.language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)


def test_without_labels_texts_with_letters_stay(spark):
    d = spark.createDataFrame([(1, None, None), (2, "12 _ 3", None), (3, "the cat", None)], "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_known(d).collect()] == [3]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 4, 3])
    e, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    pack = langid.Packed(lengths)
    gamma, expected = langid.forward_backward(pack, e[pack.source], moves, True)
    got = np.empty_like(gamma)
    got[pack.source] = gamma
    pairs, start = np.zeros((3, 3)), 0
    for n in lengths:
        want, total, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(e[start + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for t, k in enumerate(path):
                want[t, k] += p
            for a, b in itertools.pairwise(path):
                own[a, b] += p
        assert np.allclose(got[start : start + n], want / total)
        pairs += own / total
        start += n
    assert np.allclose(expected, pairs)


def test_switches_are_learned_and_found_in_spliced_held_out_texts():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    rows = [(d, x, y) for d, x, y in zip(t["doc_id"], t["text"], t["lang"], strict=True) if x and y and len(x) < 4000]
    seen = [(x, y) for d, x, y in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    held = [(langid.words_of(x), y) for d, x, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    held = [(w, y) for w, y in held if len(w) > 60]
    model = langid.train(seen[:200])
    moves = np.exp(model.moves)
    stay = np.diag(moves) / moves.sum(axis=1)
    assert (stay > 0.5).all() and (stay < 0.9999).all()
    right = plain = n = 0
    lone = langid.Crf(model.langs, model.lexicons)
    lone.weights = model.weights  # the same without transitions
    for (a, x), (b, y) in zip(held[:60], held[1:61], strict=True):
        words, sides = langid.splice(a, b)
        gold = [(x, y)[s] for s in sides]
        right += sum(g == p for g, (_, p) in zip(gold, langid.word_languages(model, " ".join(words)), strict=True))
        plain += sum(g == p for g, (_, p) in zip(gold, langid.word_languages(lone, " ".join(words)), strict=True))
        n += len(gold)
    print("word accuracy", right / n, "without transitions", plain / n)
    assert right / n > 0.85 and right > plain


def test_repeated_ids_and_lengths_have_their_own_neighbours(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 4.0]), (40, [1.0, 1.0, 1.0]), (3, [2.0, 2.0, 2.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS block", "2 AS q", "3 AS cells", "4 AS row")
    got = sorted(tuple(r) for r in ann.nearest(d, top=2).collect())
    assert got == [(20, 1, 1, 3.0), (20, 1, 2, 4.0), (20, 2, 1, 1.0), (20, 2, 2, 1.0), (40, 1, 3, 6.0)]


def test_clustered_vectors_need_few_cells():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(100, 16)), 60, axis=0) + 0.02 * rng.normal(size=(6000, 16))
    books = ann.code_book(x[:, :8], 64, 1), ann.code_book(x[:, 8:], 64, 2)
    assert ann.least_share(x, books, 20) <= 0.1
    assert ann.least_share(rng.normal(size=(3000, 64)), (rng.normal(size=(64, 32)), rng.normal(size=(64, 32))), 20) >= 0.35
