"""Byte-pair encoding and decoding with a public vocabulary: speculate, verify, merge only what fails.

A word (pre-token) is first cut greedily into the longest vocabulary entries.
The cut is the true encoding exactly when every token encodes to itself and
every adjacent pair of tokens, put together, encodes to that very pair, so all
pairs of all new words of a batch are tested at once against a table of known
pairs (numpy search over sorted codes). Only words with a failing pair go
through the merges one by one.

Words repeat, so each worker keeps what it knows about a word up to a fixed
number of entries (``CACHE_WORDS``); later words are encoded anew each time.
Whole texts are processed; state is per worker and can be lost at any time.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same where letters and digits are those below U+0250 but for superscripts and fractions; the faster module can say it.
_PLAIN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
CACHE_WORDS = 400_000


def cut_words(text: str) -> list[str]:
    return (PATTERN if _NOT_PLAIN.search(text) else _PLAIN).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class Bpe:
    """One vocabulary with its merges and what has been learned about words and pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_letters()
        self.spec, self.model, self.letters = spec, None, {b: c for c, b in of.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in of for c in t)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        ordinary = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        self.id_of = ordinary
        self.reach: dict[bytes, int] = {}
        for t in ordinary:
            if len(t) > self.reach.get(t[:3], 2):
                self.reach[t[:3]] = len(t)
        vocab = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a], vocab[b]] = (n, vocab[a + b])
        self.size = max(self.bytes_of) + 1
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.single: dict[int, bool] = {}
        self.known = np.empty(0, np.int64)  # sorted codes of tested pairs
        self.fits = np.empty(0, bool)
        self.counts = {"words": 0, "failed": 0}

    def merge_many(self, found: list[bytes]) -> list[list[int]]:
        """Exact merging of many words by the tokenizers library's own merge model, without its other stages."""
        if not found:
            return []
        if self.model is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            bare = {"pre_tokenizer": None, "post_processor": None, "decoder": None, "normalizer": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(self.spec | bare))
        letters = self.letters
        return [e.ids for e in self.model.encode_batch_fast([w.decode("latin-1").translate(letters) for w in found], add_special_tokens=False)]

    def merge(self, word: bytes) -> list[int]:
        """The encoding by definition: the lowest-ranked pair is merged until none is left."""
        ids = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank = self.rank
        while len(ids) > 1:
            best, at, to = None, -1, -1
            for k in range(len(ids) - 1):
                r = rank.get((ids[k], ids[k + 1]))
                if r is not None and (best is None or r[0] < best):
                    best, at, to = r[0], k, r[1]
            if best is None:
                break
            ids[at : at + 2] = [to]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long words."""
        import heapq

        n, after, before, alive = len(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (r := self.rank.get((ids[k], ids[after[k]]))):
                heapq.heappush(heap, (r[0], k, ids[k], ids[after[k]], r[1]))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            if not alive[k] or after[k] >= n or ids[k] != a or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = to, False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def greedy(self, word: bytes) -> list[int]:
        """Longest entries from the left; no entry with the same first three bytes is longer than ``reach``."""
        out, k, n, of, reach = [], 0, len(word), self.id_of, self.reach
        while k < n:
            end = k + reach.get(word[k : k + 3], 2)
            if end > n:
                end = n
            while (i := of.get(word[k:end])) is None:
                end -= 1
            out.append(i)
            k = end
        return out

    def _pair_fits(self, code: int) -> bool:
        a, b = divmod(code, self.size)
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode_words(self, found: list[bytes]) -> list[list[int]]:
        """Encodings of a batch of words."""
        cuts = [self.greedy(w) for w in found]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((i for c in cuts for i in c), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(cuts)), sizes)
        inside = np.flatnonzero(word_of[:-1] == word_of[1:]) if len(flat) else np.empty(0, np.int64)
        codes = flat[inside] * self.size + flat[inside + 1]
        new = np.setdiff1d(codes, self.known)
        if len(new):
            known = np.concatenate([self.known, new])
            fits = np.concatenate([self.fits, np.fromiter((self._pair_fits(int(c)) for c in new), bool, len(new))])
            order = np.argsort(known)
            self.known, self.fits = known[order], fits[order]
        bad = np.zeros(len(cuts), bool)
        if len(codes):
            bad[word_of[inside[~self.fits[np.searchsorted(self.known, codes)]]]] = True
        alone = np.flatnonzero(sizes == 1)
        for k in alone:
            i = cuts[k][0]
            ok = self.single.get(i)
            if ok is None:
                ok = self.single[i] = self.merge(self.bytes_of[i]) == [i]
            if not ok:
                bad[k] = True
        failed = np.flatnonzero(bad).tolist()
        for k, merged in zip(failed, self.merge_many([found[k] for k in failed]), strict=True):
            cuts[k] = merged
        self.counts["words"] += len(found)
        self.counts["failed"] += int(bad.sum())
        if len(self.known) > 2_000_000:  # bounded memory: tested again when met again
            self.known, self.fits = self.known[:0], self.fits[:0]
        return cuts


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


@functools.cache
def ranked(path: str):
    """The same vocabulary in tiktoken, which merges by rank: equal to the merges where each makes a larger id than the one before it."""
    import tiktoken

    bpe = Bpe(path)  # not kept
    made = [i for _, i in sorted(bpe.rank.values())]
    if made != sorted(set(made)):
        raise ValueError("the vocabulary's ids do not follow its merges")
    return tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=bpe.id_of, special_tokens=bpe.special)


class Encoder:
    """Turns texts into sequences of per-word records, each made once by ``record`` and cached."""

    def __init__(self, bpe: Bpe, record: Callable[[list[int]], object], encode_words: Callable[[list[bytes]], list[list[int]]] | None = None):
        self.bpe, self.record, self.encode_words = bpe, record, encode_words or bpe.encode_words
        self.words: dict[str, object] = {}

    def batch(self, texts: list[str]) -> list[list]:
        """For each text the records of its words in order."""
        cut = [self._cut(t) for t in texts]
        have = self.words
        new: set = set()
        for p in cut:
            new |= set(p).difference(have)
        special = {x: self.bpe.special[x[1]] for x in new if isinstance(x, tuple)}
        wanted = [x for x in new if x not in special]
        ids = self.encode_words([t.encode() for t in wanted])
        fresh = dict(zip(wanted, map(self.record, ids), strict=True)) | {x: self.record([i]) for x, i in special.items()}
        out = []
        for p in cut:
            got = list(map(have.get, p))
            if fresh and None in got:
                got = [fresh[x] if r is None else r for x, r in zip(p, got, strict=True)]
            out.append(got)
        for k, v in fresh.items():
            if len(have) >= CACHE_WORDS:
                break
            if len(k) < 64:
                have[k] = v
        return out

    def _cut(self, text: str) -> list:
        """Words of a text; a special token inside it comes as a tuple."""
        if not any(x in text for x in self.bpe.special):
            return cut_words(text)
        out: list = []
        for k, part in enumerate(self.bpe.split_special.split(text)):
            out += [("special", part)] if k % 2 else cut_words(part)
        return out


def chunks(texts: list[str], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text makes a range of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
