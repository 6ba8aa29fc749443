"""Missing or wrong document language labels, by a linear-chain conditional random field over words.

Words of running text (code, identifiers and compiler output taken out) have affix, character n-gram and
lexicon features; transitions are learned; forward-backward gives every word its language with a probability.
Sentences take the language that most of their letters have, documents that of most letters of running
text; the confidence is the mean probability of it over those letters.

The field is fitted on a bounded sample of labelled documents (``FIT_DOCS``); features, labels and
confidences cover whole texts of all documents. A word's feature scores are kept per task, so that the
field's cost is that of its recursions, which run over many documents at once.

Null and empty texts and texts without letters of running text have language null and no rows in the found
table. Labels that name no known language count as naming another one than the main one. Repeated rows
count each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from .langmodel import LANGS, LATIN, canonical, group_by_length, label_sentences, running_text, sentences, training_documents, unaccented
from .langmodel import words as split_words

#: Documents the field is fitted on; size of the feature table; steps of the fit.
FIT_DOCS, FEATURES, STEPS = 800, 1 << 16, 80
#: A foreign sentence counts from so many letters (words in alphabets, signs in Han and kana).
LEAST_WORDS, LEAST_SIGNS = 4, 6
L = len(LANGS)
_SIGNED = [LANGS.index("zh"), LANGS.index("ja")]


def features(word: str) -> list[int]:
    """Hashed affixes, character n-grams, the word itself and its script."""
    w = word.lower()
    c = "^" + w + "$"
    f = ["w" + w, f"l{min(len(w), 12)}"]
    f += [f"p{w[:k]}" for k in (1, 2, 3) if len(w) >= k]
    f += [f"s{w[-k:]}" for k in (1, 2, 3, 4) if len(w) >= k]
    f += [c[i : i + 3] for i in range(len(c) - 2)]
    o = ord(w[0])
    f.append("x" + ("k" if 0x3040 <= o <= 0x30FF else "h" if 0x3400 <= o <= 0x9FFF else "c" if 0x400 <= o <= 0x4FF else "a" if o < 128 else "e"))
    if any(0x3040 <= ord(x) <= 0x30FF for x in w):
        f.append("kana")
    if any(0x3400 <= ord(x) <= 0x9FFF for x in w):
        f.append("han")
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in dict.fromkeys(f)]


class Field:
    """Weights (features x languages) and transitions; recursions over padded batches."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions
        self.index: dict[str, int] = {}
        self.scaled, self.letters = np.ones((1024, L), np.float32), np.zeros(1024, np.float32)  # row 0 is no word's

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words (0: none); exponentials of their feature scores are kept in ``scaled``, the largest 1, and their letters in ``letters``."""
        get = self.index.get
        out = [get(w, 0) for w in words]
        if 0 in out:
            if len(self.index) > 400_000:  # bounds memory only
                self.index.clear()
                out = [0] * len(words)
            for j, i in enumerate(out):
                if not i:
                    w = words[j]
                    i = self.index.get(w)
                    if i is None:
                        i = self.index[w] = len(self.index) + 1
                        if i >= len(self.scaled):
                            self.scaled = np.concatenate([self.scaled, np.ones_like(self.scaled)])
                            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
                        v = self.weights[features(w)].sum(axis=0)
                        self.scaled[i] = np.exp(v - v.max())
                        self.letters[i] = len(w)
                    out[j] = i
        return np.array(out, dtype=np.int64)

    def _posterior(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Forward-backward over scaled scores (steps, sequences, languages), as ``forward_backward`` without its sums for fitting."""
        n, one = len(x), np.ones(L, np.float32)
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        a = np.empty_like(x)
        a[0] = x[0] / (x[0] @ one)[:, None]
        for t in range(1, n):  # what stands behind a sequence's end is not read
            v = (a[t - 1] @ move) * x[t]
            np.divide(v, (v @ one)[:, None] + 1e-30, out=a[t])
        back, b = np.ascontiguousarray(move.T), np.ones_like(x[0])
        for t in range(n - 2, -1, -1):
            v = (x[t + 1] * b) @ back
            v /= (v @ one)[:, None] + 1e-30
            b = np.where(mask[t + 1][:, None], v, b)
            a[t] *= b
        a /= (a @ one)[:, :, None] + 1e-30
        return a

    def marginals(self, ids: np.ndarray, lens: list[int]) -> np.ndarray:
        """Posterior probabilities (words x languages) of sequences of words, one after the other."""
        out = np.zeros((len(ids), L), np.float32)
        size = np.array(lens, dtype=np.int64)
        starts = np.cumsum(size) - size
        held = np.append(ids, 0)
        for group in group_by_length(lens):
            g = np.array([i for i in group if size[i]])
            if len(g):
                step = np.arange(int(size[g].max()))[:, None]
                mask = step < size[g][None, :]
                at = np.where(mask, starts[g][None, :] + step, len(ids))
                out[at[mask]] = self._posterior(self.scaled[held[at]], mask)[mask]
        return out


def forward_backward(e: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of padded emissions (steps, sequences, languages); the sum of pair marginals if asked for."""
    n = len(e)
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    x = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.empty_like(x)
    a[0] = x[0] / x[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        v = (a[t - 1] @ move) * x[t]
        v /= v.sum(axis=1, keepdims=True) + 1e-30
        a[t] = np.where(mask[t], v, a[t - 1])
    b = np.ones_like(x)
    for t in range(n - 2, -1, -1):
        v = (x[t + 1] * b[t + 1]) @ move.T
        v /= v.sum(axis=1, keepdims=True) + 1e-30
        b[t] = np.where(mask[t + 1], v, b[t + 1])
    p = a * b
    p /= p.sum(axis=2, keepdims=True) + 1e-30
    total = None
    if pairs:
        total = np.zeros((L, L))
        for t in range(1, n):
            q = a[t - 1][:, :, None] * move[None] * (x[t] * b[t])[:, None, :]
            q /= q.sum(axis=(1, 2), keepdims=True) + 1e-30
            total += (q * mask[t][:, :, None]).sum(axis=0)
    return p, total


def fit(docs: list[tuple[str, str | None]], steps: int = STEPS, chunk: int = 48) -> Field:
    """Adaptive gradient ascent on the conditional likelihood of the words' languages."""
    labelled, _ = label_sentences(docs)
    vocab: dict[str, int] = {}
    words: list[int] = []
    tags: list[int] = []
    seqs: list[tuple[int, int]] = []
    for d, pairs in enumerate(labelled):
        bare = d % 4 == 0  # texts may have lost their accents
        start = len(words)
        for s, g in pairs:
            if g not in LANGS:
                continue
            for w in split_words(s.lower()):
                w = unaccented(w) if bare and g in LATIN else w
                words.append(vocab.setdefault(w, len(vocab)))
                tags.append(LANGS.index(g))
                if len(words) - start >= chunk:
                    seqs.append((start, len(words)))
                    start = len(words)
        if len(words) > start:
            seqs.append((start, len(words)))
    rng = np.random.default_rng(7)
    weights, trans = np.zeros((FEATURES, L), np.float32), np.zeros((L, L), np.float64)
    if not seqs:
        return Field(weights, trans.astype(np.float32))
    lists = [features(w) for w in vocab]
    flat = np.fromiter((x for f in lists for x in f), dtype=np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    word_at, tag_at = np.array(words), np.array(tags)
    n, m = max(b - a for a, b in seqs), len(seqs)
    at = np.zeros((n, m), np.int64)
    mask = np.zeros((n, m, 1), bool)
    gold = np.zeros((n, m), np.int64)
    for j, (a, b) in enumerate(seqs):
        at[: b - a, j], gold[: b - a, j], mask[: b - a, j] = word_at[a:b], tag_at[a:b], True
    one = np.eye(L, dtype=np.float32)[gold] * mask
    observed = np.einsum("tjk,tjl->kl", one[:-1], one[1:]).astype(np.float64)
    # words met once are left to their n-grams in half of the steps, so that unseen words are learned for
    gw, gt = np.full((FEATURES, L), 1e-3, np.float64), np.full((L, L), 1e-3)
    cells, count = mask[:, :, 0], float(len(words))
    # rare languages count more, by the root of their share
    share = np.bincount(tag_at, minlength=L) / count
    heavy = np.sqrt(1 / (L * np.maximum(share, 1e-3)))[gold][:, :, None].astype(np.float32)
    for _ in range(steps):
        keep = rng.random(len(flat)) > 0.3
        f, o = flat[keep], owner[keep]
        em = np.zeros((len(lists), L), np.float32)
        for k in range(L):
            em[:, k] = np.bincount(o, weights=weights[f, k], minlength=len(lists))
        p, expected = forward_backward(em[at] * mask, mask, trans.astype(np.float32), pairs=True)
        diff = ((one - p * mask) * heavy)[cells]
        ids = at[cells]
        per_word = np.stack([np.bincount(ids, weights=diff[:, k], minlength=len(lists)) for k in range(L)], axis=1)
        grad = np.stack([np.bincount(f, weights=per_word[o, k], minlength=FEATURES) for k in range(L)], axis=1) / count - 1e-6 * weights
        gw += grad**2
        weights += (0.25 * grad / np.sqrt(gw) * (np.abs(grad) > 0)).astype(np.float32)
        step = (observed - expected) / count - 1e-4 * trans
        gt += step**2
        trans += 0.25 * step / np.sqrt(gt)
    return Field(weights, trans.astype(np.float32))


SEGMENTS = "doc_id long, lang string, segment_no int, lang_code string, confidence double, n_letters int, n_words int, segment string"


def analyse(field: Field, texts: list[str], with_text: bool = False) -> list[list[tuple]]:
    """Per text its runs of sentences of one language: (language, its probability mass, letters, words, text, holds a whole sentence)."""
    split: list[list[str]] = []
    words: list[str] = []
    counts: list[list[int]] = []
    for t in texts:
        kept, n = [], []
        for s in sentences(running_text(t) if with_text else running_text(t).lower()):
            if w := split_words(s.lower() if with_text else s):
                kept.append(s)
                n.append(len(w))
                words += w
        split.append(kept)
        counts.append(n)
    out: list[list[tuple]] = [[] for _ in texts]
    if not words:
        return out
    ids = field.ids(words)
    p, size = field.marginals(ids, [sum(n) for n in counts]), field.letters[ids]
    per = np.array([k for n in counts for k in n])
    starts = np.cumsum(per) - per
    mass = np.add.reduceat(p * size[:, None], starts, axis=0)
    sums = np.add.reduceat(size, starts)
    lead = mass.argmax(axis=1)
    whole = np.where(np.isin(lead, _SIGNED), sums >= LEAST_SIGNS, per >= LEAST_WORDS).astype(int).tolist()
    best, top, letters, n_words = lead.tolist(), mass[np.arange(len(lead)), lead].tolist(), sums.astype(int).tolist(), per.tolist()
    at = 0
    for segs, kept in zip(out, split):
        for s in kept:
            k = best[at]
            if segs and segs[-1][0] == k:
                g = segs[-1]
                segs[-1] = (k, g[1] + top[at], g[2] + letters[at], g[3] + n_words[at], g[4] + " " + s if with_text else "", max(g[5], whole[at]))
            else:
                segs.append((k, top[at], letters[at], n_words[at], s if with_text else "", whole[at]))
            at += 1
    return out


def _doc_batches(weights: np.ndarray, transitions: np.ndarray, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(weights, transitions)
        for pdf in batches:
            memo: dict[str, int] = {}
            where = [memo.setdefault(t, len(memo)) for t in pdf["body"]]
            done = analyse(field, list(memo), with_text)
            rows = []
            for doc_id, label, i in zip(pdf["doc_id"], pdf["lang"], where):
                for no, (k, mass, n, nw, s, whole) in enumerate(done[i], 1):
                    rows.append((doc_id, label, no, LANGS[k], mass / n, n, nw if whole else 0, s))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "segment_no", "lang_code", "confidence", "n_letters", "n_words", "segment"]).astype({"doc_id": "int64", "segment_no": "int32", "n_letters": "int32", "n_words": "int32", "confidence": "float64"})

    return run


def segments(spark: SparkSession, docs: DataFrame, field: Field, with_text: bool = True) -> DataFrame:
    """Runs of sentences of one language of each document (doc_id, lang, body); n_words is 0 if no whole sentence is in it."""
    return docs.where("doc_id is not null and body <> ''").mapInPandas(_doc_batches(field.weights, field.transitions, with_text), SEGMENTS)


def p10_segments(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Every document's segments with language and confidence."""
    field = fit(training_documents(spark, sf_dir, FIT_DOCS))
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", F.col("text").alias("body"))
    return segments(spark, docs, field, with_text)


FOUND = "doc_id long, case_kind string, lang_code string"


def _case_batches(weights: np.ndarray, transitions: np.ndarray):
    """Documents straight to their cases, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(weights, transitions)
        for pdf in batches:
            memo: dict[str, int] = {}
            where = [memo.setdefault(t, len(memo)) for t in pdf["body"]]
            done = analyse(field, list(memo))
            rows = []
            for doc_id, label, i in zip(pdf["doc_id"], pdf["lang"], where):
                letters: dict[int, int] = {}
                for k, _, n, *_ in done[i]:
                    letters[k] = letters.get(k, 0) + n
                if not letters:
                    continue
                main = max(sorted(letters), key=letters.get)
                said = canonical(label)
                if said == "":
                    rows.append((doc_id, "missing", LANGS[main]))
                elif said != LANGS[main]:
                    rows.append((doc_id, "wrong", LANGS[main]))
                for k in sorted({x[0] for x in done[i] if x[5] and x[0] != main}):
                    rows.append((doc_id, "mixed", LANGS[k]))
            yield pd.DataFrame(rows, columns=["doc_id", "case_kind", "lang_code"]).astype({"doc_id": "int64"})

    return run


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language and confidence; null where there is no running text."""
    s = p10_segments(spark, sf_dir, False)
    by = s.groupBy("doc_id", "lang_code").agg(F.sum("n_letters").alias("n"), (F.sum(F.col("confidence") * F.col("n_letters")) / F.sum("n_letters")).alias("c"))
    top = by.groupBy("doc_id").agg(F.max_by(F.struct("lang_code", "c"), F.struct("n", "lang_code")).alias("t"))
    docs = load(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.join(top, "doc_id", "left").select("doc_id", "lang", F.col("t.lang_code").alias("lang_code"), F.round("t.c", 6).alias("confidence"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = fit(training_documents(spark, sf_dir, FIT_DOCS))
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", F.col("text").alias("body")).where("doc_id is not null and body <> ''")
    return docs.mapInPandas(_case_batches(field.weights, field.transitions), FOUND).distinct()
