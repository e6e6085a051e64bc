"""Language of the words of code-switched text by a linear-chain conditional random field.

Words are runs of letters. A word's features are its prefixes and suffixes of up
to three letters, its letter pairs and triples with ends marked, the word itself,
and the languages whose lexicon (their most frequent training words) holds it;
features share a table of ``TABLE`` weights by hash. Transitions between the
languages of neighbouring words are learned with them. Forward-backward gives
each word its language probabilities; a document gets the language with the
largest mean, which is also its score.

Training takes a sample of at most ``PER_LANG`` labelled documents per language, those
of up to ``MOST_CHARS`` characters with the smallest hash of their id, then the shortest
longer ones, and labels each word with the language of its document. So that the moves learn
to switch, each document is also spliced with one of another language, a few words from either
in turn, and both kinds are trained on. All documents are predicted, over their whole texts;
ids, sources and labels play no part in that.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, and
so is everything when there is nothing to learn from; repeated rows are predicted
one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
TABLE = 1 << 17
PER_LANG, MOST_CHARS, LEXICON = 100, 6000, 300
ROUNDS, RATE, DECAY = 25, 0.15, 1e-4
#: Words of a spliced text, and of its stretches of one language by turns.
SPLICED, STRETCHES = 60, (9, 4, 12, 6, 3, 8)
CACHE_WORDS, CHUNK = 200_000, 2_000_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def features(word: str, lexicons: list[set[str]]) -> list[int]:
    """Places in the weight table; 0 is the bias every word has. Words of any length keep all their n-grams."""
    w = "^" + word + "$"
    names = ["w" + word, "a" + word[:1], "b" + word[:2], "c" + word[:3], "x" + word[-1:], "y" + word[-2:], "z" + word[-3:]]
    names += [f"l{k}" for k, s in enumerate(lexicons) if word in s]
    names += ["2" + w[k : k + 2] for k in range(len(w) - 1)]
    names += ["3" + w[k : k + 3] for k in range(len(w) - 2)]
    return [0, *[1 + zlib.crc32(n.encode("utf-8", "surrogatepass")) % (TABLE - 1) for n in names]]


class Crf:
    def __init__(self, langs: list[str], lexicons: list[set[str]]):
        self.langs, self.lexicons = langs, lexicons
        self.weights = np.zeros((TABLE, len(langs)), np.float32)
        self.moves = np.zeros((len(langs), len(langs)))
        self.words: Words | None = None

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of all words one after another, and where each word's begin."""
        out, starts = array("i"), []
        for w in words:
            starts.append(len(out))
            out.extend(features(w, self.lexicons))
        return np.array(out, np.int32), np.array(starts, np.int64)

    def emissions(self, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        flat, starts = table
        out = np.zeros((len(starts), len(self.langs)))
        ends = np.append(starts[1:], len(flat))
        s = 0
        while s < len(starts):
            # words of about 2**19 features at a time; a longer word alone, its features in slices
            e = max(s + 1, int(np.searchsorted(ends, starts[s] + (1 << 19), side="right")))
            if e == s + 1:
                for k in range(int(starts[s]), int(ends[s]), 1 << 19):
                    out[s] += self.weights[flat[k : min(k + (1 << 19), int(ends[s]))]].sum(axis=0)
            else:
                out[s:e] = np.add.reduceat(self.weights[flat[starts[s] : ends[e - 1]]], starts[s:e] - starts[s], axis=0)
            s = e
        return out


class Packed:
    """Sequences laid out step by step, longest first: the words at step t are rows ``offset[t]`` to ``offset[t + 1]``."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        length = lengths[self.order]
        steps = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        rank = np.repeat(np.arange(len(length)), length)
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.source = np.empty(int(length.sum()), np.int64)  # packed row -> row in text order
        self.source[self.offset[step] + rank] = starts[rank] + step


def forward_backward(pack: Packed, e: np.ndarray, moves: np.ndarray, count_moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of the labels at each packed row, and the expected moves if asked for."""
    a = np.exp(moves - moves.max())
    x = np.exp(e - e.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(x), np.ones_like(x)
    off, act = pack.offset, pack.active
    for t in range(len(act)):
        now = alpha[off[t] : off[t + 1]]
        now[:] = x[off[t] : off[t + 1]]
        if t:
            now *= alpha[off[t - 1] : off[t - 1] + act[t]] @ a
        now /= now.sum(axis=1, keepdims=True)
    expected = np.zeros_like(a) if count_moves else None
    for t in range(len(act) - 2, -1, -1):
        after = x[off[t + 1] : off[t + 2]] * beta[off[t + 1] : off[t + 2]]
        b = after @ a.T
        if expected is not None:
            pair = alpha[off[t] : off[t] + act[t + 1], :, None] * a * after[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[off[t] : off[t] + act[t + 1]] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), expected


def splice(one: list[str], other: list[str], most: int = SPLICED) -> tuple[list[str], list[int]]:
    """Words of two texts, a stretch of each in turn, and which of the two (0 or 1) each is from."""
    words: list[str] = []
    sides: list[int] = []
    at, k = [0, 0], 0
    while len(words) < most:
        side = k % 2
        part = (one, other)[side][at[side] : at[side] + STRETCHES[k % len(STRETCHES)]]
        if not part:
            break
        at[side] += len(part)
        words += part
        sides += [side] * len(part)
        k += 1
    return words, sides


def _spliced(docs: list[tuple[list[str], str]]) -> list[tuple[list[str], list[str]]]:
    """Each document with the next one of another language, words and the language of each."""
    out = []
    for k, (words, lang) in enumerate(docs):
        others = ((k + 1 + j * 7) % len(docs) for j in range(len(docs)))
        other = next((o for o in others if docs[o][1] != lang), None)
        if other is not None:
            mixed, sides = splice(words, docs[other][0])
            out.append((mixed, [(lang, docs[other][1])[x] for x in sides]))
    return out


def train(rows: list[tuple[str, str]]) -> Crf | None:
    """A model from (text, language) rows, by gradient ascent with Adam's step sizes on the penalised likelihood."""
    docs = [(words_of(t), lang) for t, lang in rows]
    docs = [(w, lang) for w, lang in docs if w]
    langs = sorted({lang for _, lang in docs})
    if not langs:
        return None
    counts = {lang: Counter() for lang in langs}
    for w, lang in docs:
        counts[lang].update(w)
    model = Crf(langs, [{w for w, _ in counts[lang].most_common(LEXICON)} for lang in langs])
    vocabulary = sorted(set().union(*counts.values()))
    number = {w: k for k, w in enumerate(vocabulary)}
    table = model.table(vocabulary)
    texts = [(w, [lang] * len(w)) for w, lang in docs] + _spliced(docs)
    ids = np.concatenate([[number[x] for x in w] for w, _ in texts])
    lengths = np.array([len(w) for w, _ in texts])
    of = {lang: k for k, lang in enumerate(langs)}
    gold = np.array([of[x] for _, labels in texts for x in labels])
    pack = Packed(lengths)
    ids, gold = ids[pack.source], gold[pack.source]
    n, kinds = len(ids), len(langs)
    truth = np.eye(kinds)[gold]
    true_moves = np.zeros((kinds, kinds))
    for t in range(1, len(pack.active)):
        before = gold[pack.offset[t - 1] : pack.offset[t - 1] + pack.active[t]]
        np.add.at(true_moves, (before, gold[pack.offset[t] : pack.offset[t + 1]]), 1)
    used, flat = np.unique(table[0], return_inverse=True)
    widths = np.diff(np.append(table[1], len(flat)))
    m, v = np.zeros((len(used), kinds)), np.zeros((len(used), kinds))
    mm, vm = np.zeros((kinds, kinds)), np.zeros((kinds, kinds))
    for step in range(1, ROUNDS + 1):
        gamma, expected = forward_backward(pack, model.emissions(table)[ids], model.moves, True)
        off = truth - gamma
        g = np.empty((len(used), kinds))
        for k in range(kinds):
            by_word = np.bincount(ids, off[:, k], len(vocabulary))
            g[:, k] = np.bincount(flat, np.repeat(by_word, widths), len(used))
        g = g / n - DECAY * model.weights[used]
        gm = (true_moves - expected) / n - DECAY * model.moves
        for grad, first, second, put in ((g, m, v, "weights"), (gm, mm, vm, "moves")):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            delta = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            if put == "weights":
                model.weights[used] += delta.astype(np.float32)
            else:
                model.moves += delta
    return model


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: per language the ``PER_LANG`` eligible documents with the smallest hash of their id."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("fold") != 1)
    # documents of up to MOST_CHARS come first, all alike; longer ones fill up, the shortest first
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.greatest(F.length("text"), F.lit(MOST_CHARS)), F.xxhash64("doc_id"), "doc_id", "text"))
    return [(r["text"], r["lang"]) for r in known.withColumn("k", rank).where(F.col("k") <= PER_LANG).select("text", "lang").orderBy("lang", F.xxhash64("text"), "text").collect()]


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Words:
    """What a worker has found about words: their numbers and emissions, ``CACHE_WORDS`` at most or those of one batch."""

    def __init__(self, model: Crf):
        self.model, self.known, self.rows = model, {}, np.empty((4096, len(model.langs)))

    def numbers(self, found: list[list[str]]) -> np.ndarray:
        known = self.known
        new = list(dict.fromkeys(w for ws in found for w in set(ws).difference(known)))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(dict.fromkeys(w for ws in found for w in ws))
        start, end = len(known), len(known) + len(new)
        if end > len(self.rows):
            grown = np.empty((max(end, 2 * len(self.rows)), self.rows.shape[1]))
            grown[:start] = self.rows[:start]
            self.rows = grown
        known.update(zip(new, range(start, end), strict=True))
        self.rows[start:end] = self.model.emissions(self.model.table(new))
        return np.fromiter((k for ws in found for k in map(known.__getitem__, ws)), np.int64, sum(map(len, found)))


def _word_probabilities(model: Crf, cache: Words, found: list[list[str]]) -> tuple[np.ndarray, Packed]:
    """Rows of probabilities in packed order for texts that all have words."""
    ids = cache.numbers(found)
    pack = Packed(np.array([len(w) for w in found]))
    gamma, _ = forward_backward(pack, cache.rows[ids[pack.source]], model.moves)
    return gamma, pack


def word_languages(model: Crf, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its most probable language."""
    words = words_of(text)
    if not words:
        return []
    gamma, pack = _word_probabilities(model, Words(model), [words])
    best = np.empty(len(words), np.int64)
    best[pack.source] = gamma.argmax(axis=1)
    return [(w, model.langs[k]) for w, k in zip(words, best, strict=True)]


def _predict(model: Crf, texts: list[str | None], cache: Words | None = None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    found = [words_of(t) for t in texts]
    has = [k for k, w in enumerate(found) if w]
    if not has:
        return langs, scores
    found = [found[k] for k in has]
    gamma, pack = _word_probabilities(model, cache or Words(model), found)
    lengths = np.array([len(w) for w in found])
    owner = np.repeat(np.arange(len(has)), lengths)[pack.source]
    sums = np.stack([np.bincount(owner, gamma[:, k], len(has)) for k in range(len(model.langs))], axis=1)
    for d, row in zip(has, sums / lengths[:, None], strict=True):
        k = int(row.argmax())
        langs[d], scores[d] = model.langs[k], float(min(1.0, row[k]))
    return langs, scores


def _model_of(docs: DataFrame) -> Crf | None:
    return train(training_rows(docs.select("doc_id", "text", "lang", _fold(F.col("doc_id")).alias("fold"))))


def _predicted(docs: DataFrame, model: Crf | None, payload: DataFrame, schema: str, text, kept: int) -> DataFrame:
    """Appends lang_pred and score to the first ``kept`` columns of ``payload``; ``text`` takes the texts of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the weight table and lexicons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = None if m is None else m.words or Words(m)
        if m is not None:
            m.words = cache  # goes with the model
        for b in batches:
            column = text(b)
            langs, scores, k = [], [], 0
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            while k < len(sizes):  # about ``CHUNK`` characters at a time; a longer text alone
                e, held = k + 1, sizes[k]
                while e < len(sizes) and held + sizes[e] <= CHUNK:
                    held += sizes[e]
                    e += 1
                texts = column.slice(k, e - k).to_pylist()
                x, y = ([UNKNOWN] * (e - k), [0.0] * (e - k)) if m is None else _predict(m, texts, cache)
                langs += x
                scores += y
                k = e
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:kept], "lang_pred", "score"])

    return payload.mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text")
    return _predicted(docs, _model_of(docs), rows, "doc_id bigint, held_out boolean, lang_pred string, score double", lambda b: b.column(2), 2)


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents in which one language reaches the mean probability ``least``, with their own columns; without a model, those with a letter."""
    model = _model_of(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    payload = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # packed, so that names cannot clash
    schema = f"row {row_type(docs)}, lang_pred string, score double"
    found = _predicted(docs, model, payload, schema, lambda b: b.column(0).field("text"), 1)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def row_type(docs: DataFrame) -> str:
    return docs.schema.simpleString()
