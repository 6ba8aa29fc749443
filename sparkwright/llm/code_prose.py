"""Natural language hidden inside code, by a character-level hidden Markov model with a code and language states.

A file is one sequence of characters, the states are code and eight languages. Every character is emitted by its state
given the two before it in its word (trigrams backed off to shorter contexts), the end of a word as a character of its
own; signs and digits are emitted singly; a capital behind a small letter, a digit or low line inside a word are events
with a probability in each state. States change only between words. The probabilities of changes are learned by decoding
the sample and counting. Outside comments and literals only code is possible, so the best path over a file falls apart
into those of its comments and literals, each with code before and after it: only these are computed, which gives the
path over the whole file exactly. Recursions run over thousands of them at once, a character a step.

The model is fitted on a bounded sample: documents for the languages (``FIT_DOCS``), labelled by their labels, and source
texts for code (``FIT_CODE``), labelled by where comments and literals stand. Decoding covers whole texts.

A comment (line comments in a row are one) or literal (joined by +) holds running text in a language if at
least ``LEAST_WORDS`` of its words, or ``LEAST_SIGNS`` signs of Chinese and Japanese, are decoded as that
language. Shares count the characters, as written after escapes, from the first to the last word of a
decoded stretch against all characters of the record. Null and empty texts give no rows; repeated rows
count each. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from .codelex import comment_body, literal_body, merged, spans
from .langmodel import LANGS, CharModel, group_by_length, label_sentences, training_code, training_documents, unaccented
from .splitting import code_items

FIT_DOCS, FIT_CODE = 800, 300
LEAST_WORDS, LEAST_SIGNS = 5, 10
STATES = ("code", *LANGS)
_SIGNS = STATES.index("zh"), STATES.index("ja")
K = len(STATES)
_CAMEL = re.compile(r"[a-z][A-Z]|^[A-Z]{2,}$|[A-Za-z]\d|\d[A-Za-z]|[A-Za-z][+/=]|^.{28}")
_TOKEN = re.compile(r"[㐀-鿿豈-﫿々〆]+|[぀-ヿㇰ-ㇿｦ-ﾟー]+|[^\W\d_㐀-鿿豈-﫿々〆぀-ヿㇰ-ㇿｦ-ﾟー]+(?:['’][^\W\d_㐀-鿿぀-ヿ]+)*|[^\w\s]+")
_TAGS = re.compile(r"(?m)\{@\w+\s*|^[ \t]*[@\\](?:param|throws|exception)\s+\S+|^[ \t]*[@\\]\w+|</?[A-Za-z][^<>\n]{0,60}>|&\w{2,8};")
#: Classes of characters: white space, sign, digit, low line, letter, Han, kana.
SPACE, SIGN, DIGIT, LOW, LETTER, HAN, KANA = range(7)
#: Before anything is counted: log-probabilities of going between code and a language, from a language to another.
CODE_CHANGE, LANGUAGE_CHANGE = -7.0, -13.0


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and being a capital of each character of the basic plane; others count as signs."""
    kind, lower, upper = np.full(65537, SIGN, np.int8), np.arange(65537, dtype=np.int64), np.zeros(65537, bool)
    for cp in range(65536):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isspace():
            kind[cp] = SPACE
        elif 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or c in "々〆":
            kind[cp] = HAN
        elif 0x3040 <= cp <= 0x30FF and c.isalpha() or 0x31F0 <= cp <= 0x31FF or 0xFF66 <= cp <= 0xFF9F or c == "ー":
            kind[cp] = KANA
        elif c.isdigit():
            kind[cp] = DIGIT
        elif c == "_":
            kind[cp] = LOW
        elif c.isalpha():
            kind[cp] = LETTER
        low = c.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
        upper[cp] = c.isupper()
    return kind, lower, upper


_KIND, _LOWER, _UPPER = _tables()


class Sequence:
    """The characters of many stretches, one after the other: classes, words, and the keys of their emissions."""

    def __init__(self, texts: list[str]):
        self.lens = np.array([len(t) for t in texts], dtype=np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        cp = np.where(raw > 65535, 65536, raw)
        n = len(cp)
        self.first = np.zeros(n, bool)
        starts = np.cumsum(self.lens) - self.lens
        self.first[starts[self.lens > 0]] = True
        kind = _KIND[cp]
        letter = kind == LETTER
        # an apostrophe between letters belongs to the word
        prev, nxt = np.roll(letter, 1) & ~self.first, np.roll(letter & ~self.first, -1)
        kind = np.where(((cp == 39) | (cp == 0x2019)) & prev & nxt, LETTER, kind)
        self.kind = kind
        self.word = kind >= LETTER
        before = np.where(self.first, SPACE, np.roll(kind, 1))
        self.begins = (kind != before) | self.first  # of a run of one class; a word is such a run
        self.last = np.roll(self.begins, -1)
        self.last[-1:] = True
        low = self.low = np.where(self.word, _LOWER[cp], cp)
        p1 = np.where(self.begins, 94, np.roll(low, 1))
        p2 = np.where(self.begins | np.where(self.first, True, np.roll(self.begins, 1)), 94, np.roll(low, 2))
        self.tri = (p2 << 42) | (p1 << 21) | low
        self.end = (p1 << 42) | (low << 21) | 36
        # inside an identifier: a capital behind a small letter, letters beside digits or low lines
        up = _UPPER[cp]
        hump = up & ~self.begins & ~np.roll(up, 1) & self.word
        joined = self.begins & ((kind == LETTER) & ((before == DIGIT) | (before == LOW)) | ((kind == DIGIT) | (kind == LOW)) & (before == LETTER))
        self.joint = hump | joined
        # states may change where a word begins that no low line or digit ties to what is before it, and in white space
        self.change = self.begins & ~joined
        # words that are no part of an identifier and no capitals alone
        run = np.cumsum(self.begins) - 1
        k = int(run[-1]) + 1 if n else 0
        tied = np.bincount(run, weights=self.joint, minlength=k) > 0
        tied[:-1] |= joined[np.flatnonzero(self.begins)[1:]]
        size = np.bincount(run, minlength=k)
        tied |= (np.bincount(run, weights=up, minlength=k) == size) & (size > 1)
        self.whole = self.begins & (kind == LETTER) & ~tied[run] if n else self.begins


class Model:
    """What each state emits, and how states change."""

    def __init__(self):
        self.chars = CharModel(STATES)
        self.signs: Counter = Counter()  # (state, sign)
        self.words = np.ones(K)
        self.joints = np.array([1.0, *[0.02] * (K - 1)])  # a word of code may well be joined, one of a language hardly
        self.change = (CODE_CHANGE, CODE_CHANGE, LANGUAGE_CHANGE)  # into a language, out of one, from one to another

    def add_texts(self, texts: list[tuple[int, str]]) -> None:
        """Words, signs and joints of texts, each in one state."""
        words: Counter = Counter()
        for state, s in texts:
            for w in _TOKEN.findall(s):
                if w[0].isalpha() or w[0] in "々〆ー":
                    words[state, w.lower()] += 1
                else:
                    self.signs.update((state, c) for c in w)
        for (state, w), n in words.items():
            self.chars.add(STATES[state], w, n)
        q = Sequence([s for _, s in texts])
        of = np.repeat(np.array([k for k, _ in texts], np.int64), q.lens)
        self.words += np.bincount(of, weights=q.begins & q.word, minlength=K)
        self.joints += np.bincount(of, weights=q.joint, minlength=K)

    def letters(self, p2: str, p1: str, c: str) -> list[float]:
        out = []
        for s in STATES:
            tri, bi, uni, c2, c1 = self.chars.n[s]
            k = self.chars.K
            p = (uni[c] + 0.05) / (self.chars.total[s] + 400.0)
            p = (bi[p1 + c] + k * p) / (c1[p1] + k)
            out.append(math.log((tri[p2 + p1 + c] + k * p) / (c2[p2 + p1] + k)))
        return out

    def events(self) -> tuple[np.ndarray, dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities by state: rows of signs, their numbers, a word, a joint, none."""
        total = self.words + np.array([sum(n for (k, _), n in self.signs.items() if k == s) for s in range(K)])
        known = sorted({c for _, c in self.signs if ord(c) < 65536})
        rows = np.array([[self.signs[s, c] + 0.5 for s in range(K)] for c in known] + [[0.5] * K]) / (total + 50.0)
        rate = self.joints / (self.words + self.joints)
        return np.log(rows).astype(np.float32), {ord(c): i for i, c in enumerate(known)}, np.log(self.words / total).astype(np.float32), np.log(rate).astype(np.float32), np.log(1 - rate).astype(np.float32)


def fit_model(docs: list[tuple[str, str | None]], code: list[str]) -> Model:
    """Languages from labelled sentences, code from what stands outside of comments and literals; then the comments' own words and the changes of state from a decoding of the sample."""
    labelled, _ = label_sentences(docs)
    model = Model()
    given = []
    for d, pairs in enumerate(labelled):
        for s, g in pairs:
            if g in LANGS:
                given.append((STATES.index(g), s))
                if d % 4 == 0 and not s.isascii():  # texts may have lost their accents
                    given.append((STATES.index(g), unaccented(s)))
    found = []
    for text in code:
        at = 0
        for _, a, b in [*spans(text), ("", len(text), len(text))]:
            given.append((0, text[at:a]))
            at = b
        found += [s for _, s in pieces(text)]
    model.add_texts(given)
    if not found:
        return model
    first = Decoder(model)
    seq = Sequence(found)
    path = first.decode(seq)
    piece = np.repeat(np.arange(len(found)), seq.lens)
    n = np.bincount(piece * K + path, weights=seq.begins & seq.word, minlength=len(found) * K).reshape(-1, K)
    own = []
    for i, s in enumerate(found):
        k = int(n[i, 1:].argmax()) + 1
        if n[i, k] >= LEAST_WORDS and n[i, k] * 2 > n[i, 1:].sum() or n[i, k] >= 2 and k in _SIGNS:
            own.append((k, s))
    model.add_texts(own)
    # changes of state where they may happen, with a prior of the first values
    before = np.where(seq.first, 0, np.roll(path, 1))
    at = seq.change & seq.word
    inside, outside = at & (before > 0), at & (before == 0)
    share = lambda hits, of, prior: math.log((hits.sum() + 100 * math.exp(prior)) / (of.sum() + 100))
    model.change = (share(outside & (path > 0), outside, CODE_CHANGE) - math.log(K - 1), share(inside & (path == 0), inside, CODE_CHANGE), share(inside & (path > 0) & (path != before), inside, LANGUAGE_CHANGE) - math.log(K - 2))
    return model


class Decoder:
    """Viterbi over characters; emissions of character contexts are computed once per task."""

    def __init__(self, model: Model):
        self.model = model
        self.sign_rows, signs, self.word_row, self.joint_row, self.plain_row = model.events()
        self.sign_at = np.full(65537, len(self.sign_rows) - 1, np.int64)
        for cp, i in signs.items():
            self.sign_at[cp] = i
        self.keys, self.rows = np.zeros(0, np.int64), np.zeros((0, K), np.float32)

    def _letters(self, keys: np.ndarray) -> np.ndarray:
        """Emissions of (two characters before, character) keys."""
        unique, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = unique[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != unique)] if len(self.keys) else unique
        if len(new):
            if len(self.keys) > 1_000_000:  # bounds memory only
                self.keys, self.rows = np.zeros(0, np.int64), np.zeros((0, K), np.float32)
                new = unique
            m = (1 << 21) - 1
            rows = np.array([self.model.letters(chr(k >> 42), chr(k >> 21 & m), chr(k & m)) for k in new.tolist()], np.float32)
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, rows])[order]
        return self.rows[np.searchsorted(self.keys, unique)][back]

    def emissions(self, q: Sequence) -> np.ndarray:
        """Log-probabilities (characters x states) and a row of zeros."""
        e = np.zeros((len(q.kind) + 1, K), np.float32)
        w = np.flatnonzero(q.word)
        ends = np.flatnonzero(q.word & q.last)
        if len(w):
            e[w] += self._letters(q.tri[w])
            e[ends] += self._letters(q.end[ends])
        begins = np.flatnonzero(q.word & q.begins)
        e[begins] += self.word_row + self.plain_row
        e[np.flatnonzero(q.joint)] += self.joint_row - self.plain_row
        signs = np.flatnonzero(q.kind == SIGN)
        e[signs] += self.sign_rows[self.sign_at[q.low[signs]]]
        return e

    def decode(self, q: Sequence) -> np.ndarray:
        """The best state of every character, code before and after each stretch."""
        out = np.zeros(len(q.kind), np.int8)
        e = self.emissions(q)
        starts = np.cumsum(q.lens) - q.lens
        enter, leave, cross = (np.float32(x) for x in self.model.change)
        change = np.append(q.change, False)
        for group in group_by_length(q.lens.tolist(), 8192, 3_000_000):
            group = np.array([i for i in group if q.lens[i]])
            if not len(group):
                continue
            n, m = int(q.lens[group].max()), len(group)
            v = np.full((m, K), -np.inf, np.float32)
            v[:, 0] = 0.0
            took = np.zeros((n, m, K), bool)
            back, lead = np.zeros((n, m), np.int8), np.zeros((n, m), np.int8)
            cols = np.arange(m)
            for t in range(n):
                at = np.where(t < q.lens[group], starts[group] + t, len(q.kind))
                may = change[at]
                if may.any():
                    # the best language, and from where each language is entered if it is
                    best = v[:, 1:].argmax(axis=1) + 1
                    top = v[cols, best]
                    code, other = v[:, 0] + enter, top + cross
                    hop = np.empty((m, K), np.float32)
                    hop[:, 0] = top + leave
                    hop[:, 1:] = np.maximum(code, other)[:, None]
                    jump = (hop > v) & may[:, None]
                    v = np.where(jump, hop, v)
                    took[t], back[t], lead[t] = jump, np.where(code >= other, 0, best), best
                v = v + e[at]
            final = v + leave
            final[:, 0] = v[:, 0]
            state = final.argmax(axis=1)
            for t in range(n - 1, -1, -1):
                live = t < q.lens[group]
                out[(starts[group] + t)[live]] = state[live]
                state = np.where(took[t][cols, state], np.where(state == 0, lead[t], back[t]), state)
        return out


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, characters) of the comments and literals of a file that are long enough for ``LEAST_WORDS`` words or ``LEAST_SIGNS`` signs."""
    out = []
    for kind, parts in merged(text, spans(text)):
        if kind == "s":
            s = "".join(literal_body(text[a:b]) for a, b in parts)
        elif kind == "l":
            s = "\n".join(comment_body(text[a:b]) for a, b in parts)
        else:
            s = comment_body(text[parts[0][0] : parts[0][1]])
        if len(s) >= min(2 * LEAST_WORDS - 1, LEAST_SIGNS):
            if kind != "s" and ("@" in s or "<" in s or "\\" in s or "&" in s):
                s = _TAGS.sub(lambda m: " " * len(m[0]), s)
            out.append((kind, s))
    return out


def languages(decoder: Decoder, texts: list[str]) -> list[tuple[dict[str, int], set[str]]]:
    """Per file: characters of running text by language, and the languages that one piece holds enough of."""
    owner, found = [], []
    for i, text in enumerate(texts):
        for _, s in pieces(text):
            owner.append(i)
            found.append(s)
    out: list[tuple[dict[str, int], set[str]]] = [({}, set()) for _ in texts]
    if not found:
        return out
    q = Sequence(found)
    path = decoder.decode(q)
    n = len(found)
    piece = np.repeat(np.arange(n), q.lens)
    # Japanese is never written without kana for long
    ja = path == _SIGNS[1]
    kana = np.bincount(piece, weights=(path >= _SIGNS[0]) & (q.kind == KANA), minlength=n) > 0
    path = np.where(ja & ~kana[piece], _SIGNS[0], path)
    words = np.bincount(piece * K + path, weights=q.whole, minlength=n * K).reshape(n, K)
    enough = words >= LEAST_WORDS
    signs = (q.kind == HAN) | (q.kind == KANA)

    def stretches(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = q.first.copy()
        begins[1:] |= path[1:] != path[:-1]
        return np.cumsum(begins) - 1, np.flatnonzero(begins)

    # Han between kana may be either language, so Chinese has to be told by one stretch; names in it do not end it
    last = np.maximum.accumulate(np.where((path > 0) | q.first, np.arange(len(path)), 0))
    run, start = stretches(path[last])
    per = np.bincount(run, weights=signs & (path == _SIGNS[0]), minlength=len(start))
    most = np.zeros(n)
    np.maximum.at(most, piece[start], per)
    enough[:, _SIGNS[0]] = most >= LEAST_SIGNS
    stretch, start = stretches(path)
    of, state = piece[start], path[start]
    enough[:, _SIGNS[1]] = np.bincount(piece, weights=signs & (path == _SIGNS[1]), minlength=n) >= LEAST_SIGNS
    enough[:, 0] = False
    # characters from the first to the last word of each stretch
    at = np.flatnonzero(q.word & (path > 0))
    ids, first = np.unique(stretch[at], return_index=True)
    last = np.append(first[1:], len(at)) - 1
    size = at[last] - at[first] + 1
    for i, k in zip(*(x.tolist() for x in np.nonzero(enough))):
        out[owner[i]][1].add(STATES[k])
    for i, k, c in zip(of[ids].tolist(), state[ids].tolist(), size.tolist()):
        if enough[i, k]:
            chars = out[owner[i]][0]
            chars[STATES[k]] = chars.get(STATES[k], 0) + c
    return out


SHARES = "record_kind string, record_id long, lang_code string, n_chars long, share double"


def _share_batches(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(model)
        for pdf in batches:
            rows = []
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                texts = part["body"].tolist()
                for kind, rid, text, (chars, _) in zip(part["record_kind"], part["record_id"], texts, languages(decoder, texts)):
                    for lang, n in sorted(chars.items()):
                        rows.append((kind, rid, lang, n, min(1.0, n / len(text))))
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "lang_code", "n_chars", "share"]).astype({"record_id": "int64", "n_chars": "int64", "share": "float64"})

    return run


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each record's comments and literals, with their share of its characters."""
    code = training_code(load(spark, sf_dir, "headers", "header_id", "source_code"), "source_code", "header_id", FIT_CODE)
    model = fit_model(training_documents(spark, sf_dir, FIT_DOCS), code)
    return code_items(spark, sf_dir).where("record_id is not null and body <> ''").mapInPandas(_share_batches(model), SHARES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_shares(spark, sf_dir).select("record_kind", "record_id", "lang_code").distinct()


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and records by language and table."""
    return p5_shares(spark, sf_dir).groupBy("record_kind", "lang_code").agg(F.countDistinct("record_id").alias("n_records"), F.sum("n_chars").alias("n_chars"))
