"""Evaluation texts leaking into training text, by a distributed positional inverted index.

The training text is tokenised once into an inverted index: postings by term (the places, document and word, where
the term stands), kept for the terms of the held-out passages only, a small fixed vocabulary. The index is
partitioned by document, a part for each batch of documents, and stored in the shared folder. For every short phrase
of a passage the list of its rarest term in the part comes first; the lists of the other terms, adjusted by their
offset in the phrase, are intersected with it. Phrases at successive offsets join to runs.

* A run of at least ``min_words`` is an exact phrase match.
* Runs of at least ``NEAR_RUN`` words that follow each other in the text as in the passage, with at most
  ``NEAR_GAP`` words left out or put in between on either side, are a proximity match if they hold at least
  ``min_words`` words together. Of proximity matches that overlap in the text the one with most words is given; it may
  hold or extend exact matches, which are given as well.

Words are runs of letters or digits of the NFKC form without default-ignorable characters, case folded.
Null and empty texts and passages match nothing; passages shorter than ``min_words`` never match; repeated
documents are matched each for itself. Extra columns are not read.

The held-out passages are given to each task in blocks of bounded size (``BLOCK_WORDS``, counted): the fixed table is one
block, a larger one is searched block by block. The corpus is never gathered: postings stay partitioned by document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Stage, load

MIN_WORDS = 13
#: Proximity: the least words of a run, and the most words between two runs in the text and in the passage.
NEAR_RUN, NEAR_GAP = 3, 2
#: Words of passages that are sent to every task at a time (some 40 MB).
BLOCK_WORDS = 2_000_000
_TOKEN = re.compile(r"[^\W_]+")
# Ranges of characters that are ignored when shown.
_IGNORED = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
_IGNORABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORED) + "]")


def words(text: str) -> list[str]:
    """The words of a text, however it is composed, cased, spaced or wrapped."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    return _TOKEN.findall(text.casefold())


class Passages:
    """The held-out passages as term numbers, with every offset of each term."""

    def __init__(self, items: list[tuple[int, str]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, passage in items:
            ws = words(passage)
            if len(ws) >= min_words:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]))


#: Postings of a part: places are document number << 32 | word, ascending; under term -1 the documents' ids by number.
POSTINGS = "part long, term int, places array<long>"


def _index_batches(vocabulary: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for k, pdf in enumerate(batches):
            ids, terms, places = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["body"]):
                at = np.array([get(w, -1) for w in words(text)], dtype=np.int32)
                pos = np.flatnonzero(at >= 0)
                if len(pos):
                    terms.append(at[pos])
                    places.append((len(ids) << 32) + pos.astype(np.int64))
                    ids.append(doc_id)
            if not ids:
                continue
            term, place = np.concatenate(terms), np.concatenate(places)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            lists = [np.array(ids, dtype=np.int64), *np.split(place, first[1:])]
            part = (TaskContext.get().partitionId() << 32) + k
            yield pd.DataFrame({"part": np.int64(part), "term": np.concatenate([[-1], term[first]]).astype(np.int32), "places": pd.Series(lists, dtype=object)})

    return run


def _phrase(gram: tuple[int, ...], lists: dict[int, np.ndarray]) -> np.ndarray:
    """The places where ``gram`` begins: lists adjusted by their offset and intersected, the shortest first."""
    if not all(t in lists for t in gram):
        return _NOWHERE
    order = sorted(range(len(gram)), key=lambda j: len(lists[gram[j]]))
    at = lists[gram[order[0]]] - order[0]
    for j in order[1:]:
        own, want = lists[gram[j]], at + j
        at = at[own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want]
        if not len(at):
            break
    return at


_NOWHERE = np.zeros(0, dtype=np.int64)


def _runs(terms: list[int], size: int, lists: dict[int, np.ndarray], known: dict[tuple, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, offset in the passage, words) of every maximal run of at least ``size`` words, by place."""
    places, offsets = [_NOWHERE], [_NOWHERE]
    for j in range(len(terms) - size + 1):
        gram = tuple(terms[j : j + size])
        at = known.get(gram)
        if at is None:
            at = known[gram] = _phrase(gram, lists)
        if len(at):
            places.append(at)
            offsets.append(np.full(len(at), j, dtype=np.int64))
    place, offset = np.concatenate(places), np.concatenate(offsets)
    if not len(place):
        return place, offset, offset
    order = np.lexsort((offset, place - offset))
    place, offset = place[order], offset[order]
    begins = np.ones(len(place), dtype=bool)
    begins[1:] = (np.diff(place - offset) != 0) | (np.diff(offset) != 1)
    first = np.flatnonzero(begins)
    n = np.diff(np.append(first, len(place))) + size - 1
    place, offset = place[first], offset[first]
    order = np.lexsort((offset, place))
    return place[order], offset[order], n[order]


def _best_links(g: list[int], o: list[int], c: list[int]) -> tuple[list[int], list[int]]:
    """Words of the best chain that ends with each run, and the run before it (-1: none)."""
    best, before = list(c), [-1] * len(g)
    if len(g) > 32:
        g, o, c = np.array(g), np.array(o), np.array(c)
        for i in range(1, len(g)):
            skip, own = g[i] - g[:i] - c[:i], o[i] - o[:i] - c[:i]
            # words that both runs hold count once
            twice = np.maximum(0, -np.minimum(skip, own))
            follows = (g[:i] < g[i]) & (o[:i] < o[i]) & (skip + twice <= NEAR_GAP) & (own + twice <= NEAR_GAP) & (twice < np.minimum(c[:i], c[i]))
            if follows.any():
                total = np.where(follows, np.array(best[:i]) - twice, -1)
                before[i] = int(total.argmax())
                best[i] += int(total.max())
        return best, before
    for i in range(1, len(g)):  # the same without arrays: almost all chains are of two or three runs
        most = -1
        for j in range(i):
            skip, own = g[i] - g[j] - c[j], o[i] - o[j] - c[j]
            if skip > NEAR_GAP or own > NEAR_GAP or g[j] == g[i] or o[j] >= o[i]:
                continue
            twice = max(0, -skip, -own)
            if skip + twice <= NEAR_GAP and own + twice <= NEAR_GAP and twice < c[j] and twice < c[i] and best[j] - twice > most:
                most, before[i] = best[j] - twice, j
        best[i] += max(0, most)
    return best, before


def _chains(place: np.ndarray, offset: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(place, offset, words, words of text) of the proximity matches that runs sorted by place make up."""
    end = np.maximum.accumulate(place + n)
    apart = np.append(0, np.flatnonzero(place[1:] - end[:-1] > NEAR_GAP) + 1)
    sizes = np.diff(np.append(apart, len(n)))
    # up to three runs: those that no other one of them can follow or be followed by do not count
    linked = np.repeat(sizes > 3, sizes)
    for lag in (1, 2):
        skip, own = place[lag:] - (place + n)[:-lag], offset[lag:] - (offset + n)[:-lag]
        twice = np.maximum(0, -np.minimum(skip, own))
        follows = (np.maximum(skip, own) + twice <= NEAR_GAP) & (twice < np.minimum(n[:-lag], n[lag:]))
        linked[lag:] |= follows
        linked[:-lag] |= follows
    sums = np.add.reduceat(np.where(linked, n, 0), apart)
    chosen = np.flatnonzero((sums >= least) & (sizes > 1))
    place, offset, n = place.tolist(), offset.tolist(), n.tolist()
    for a, b in zip(apart[chosen].tolist(), (apart + sizes)[chosen].tolist()):
        g, o, c = place[a:b], offset[a:b], n[a:b]
        while len(g) > 1 and sum(c) >= least:
            best, before = _best_links(g, o, c)
            last = -1
            for i in range(len(g)):
                if before[i] >= 0 and (last < 0 or best[i] > best[last]):
                    last = i
            if last < 0 or best[last] < least:
                break
            start = last
            while before[start] >= 0:
                start = before[start]
            begin, end = g[start], g[last] + c[last]
            yield begin, o[start], best[last], end - begin
            rest = [i for i in range(len(g)) if g[i] + c[i] <= begin or g[i] >= end]
            g, o, c = [g[i] for i in rest], [o[i] for i in rest], [c[i] for i in rest]


MATCHES = "doc_id long, item_id long, kind string, start_word int, item_offset int, n_words int, n_text_words int"


def _match_part(passages: Passages, proximity: bool):
    least = passages.min_words
    size = min(NEAR_RUN, least) if proximity else least

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {t: np.asarray(x, dtype=np.int64) for t, x in zip(pdf["term"].tolist(), pdf["places"])}
        ids, known, rows = lists.pop(-1), {}, []
        for item_id, terms in passages.items:
            place, offset, n = _runs(terms, size, lists, known)
            if not len(place):
                continue
            for i in np.flatnonzero(n >= least):
                rows.append(("exact", item_id, int(place[i]), int(offset[i]), int(n[i]), int(n[i])))
            if proximity:
                rows += [("proximity", item_id, *x) for x in _chains(place, offset, n, least)]
        out = pd.DataFrame(rows, columns=["kind", "item_id", "place", "item_offset", "n_words", "n_text_words"])
        place = out["place"].to_numpy(dtype=np.int64)
        out["doc_id"], out["start_word"] = ids[place >> 32], place & 0xFFFFFFFF
        return out.astype({"item_id": "int64", "start_word": "int32", "item_offset": "int32", "n_words": "int32", "n_text_words": "int32"})[[x.split()[0] for x in MATCHES.split(", ")]]

    return run


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, proximity: bool = False) -> DataFrame:
    """Every maximal phrase match of ``docs`` (doc_id, body) with ``items`` (item_id, passage), on demand the proximity matches too, see ``MATCHES``."""
    held = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    size = held.agg(F.coalesce(F.sum(F.size(F.split("passage", r"[^\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    docs = docs.where("doc_id is not null and body <> ''")
    out, blocks = None, 1 + 2 * int(size // BLOCK_WORDS)  # by hash, so a block may well be half as large again as the mean
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == k)
        passages = Passages([(r[0], r[1]) for r in part.collect()], min_words)
        index = Stage(spark, "postings").put(docs.mapInPandas(_index_batches(passages.vocabulary), POSTINGS))
        found = index.groupBy("part").applyInPandas(_match_part(passages, proximity), MATCHES)
        out = found if out is None else out.union(found)
    return out


def _p8(spark: SparkSession, sf_dir: str, proximity: bool) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", F.col("text").alias("body"))
    return find_leaks(spark, docs, load(spark, sf_dir, "eval_items", "item_id", "passage"), proximity=proximity)


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exact phrase and proximity match with its place in text and passage, and how many words it has."""
    return _p8(spark, sf_dir, True)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir, False).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: whether it leaked, into how many documents, and the longest match; by either kind and by exact ones alone."""
    exact = F.col("kind") == "exact"
    m = p8_matches(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_match"), F.countDistinct(F.when(exact, F.col("doc_id"))).alias("n_docs_exact"), F.max(F.when(exact, F.col("n_words"))).alias("longest_exact"))
    items = load(spark, sf_dir, "eval_items", "item_id", "suite", "lang").where("item_id is not null").distinct()
    numbers = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_docs", "longest_match", "n_docs_exact", "longest_exact")]
    return items.join(m, "item_id", "left").select("item_id", "suite", "lang", *numbers, F.col("n_docs").isNotNull().alias("leaked"), (F.coalesce("n_docs_exact", F.lit(0)) > 0).alias("leaked_exact"))
