"""What the language operators share: codes, running text in documents, character models, training sentences."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from .sampling import bounded_sample

LANGS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja")
# Notations of the languages.
_NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês английский 英语 英文 英語",
    "de": "de deu ger german deutsch allemand alemán aleman alemão немецкий 德语 德文 ドイツ語",
    "fr": "fr fra fre french französisch franzosisch français francais francés frances francês французский 法语 法文 フランス語",
    "es": "es spa spanish castilian spanisch espagnol español espanol castellano espanhol испанский 西班牙语 スペイン語",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português португальский 葡萄牙语 ポルトガル語",
    "ru": "ru rus russian russisch russe ruso russo русский 俄语 俄文 ロシア語",
    "zh": "zh zho chi cmn chinese mandarin chinesisch chinois chino chinês китайский 中文 汉语 漢語 普通话 中国語",
    "ja": "ja jpn jp japanese japanisch japonais japonés japones japonês японский 日语 日文 日本語",
}
_CODE_OF = {n: k for k, ns in _NAMES.items() for n in ns.split()}
# Labels that say the language is not known.
UNKNOWN = {"", "unknown", "und", "undetermined", "none", "null", "n/a", "na", "nan", "mis", "mul", "zxx", "other", "?", "-", "unk", "xx", "unbekannt", "inconnu", "desconocido", "desconhecido", "неизвестно", "未知", "不明"}


def canonical(label: str | None) -> str | None:
    """The code that a label names, '' if it says the language is not known, None if it names another language."""
    if label is None:
        return ""
    s = unicodedata.normalize("NFKC", label).strip().lower()
    if s in UNKNOWN:
        return ""
    for part in (s, re.split(r"[-_.@/;, (]", s)[0]):
        if part in _CODE_OF:
            return _CODE_OF[part]
    m = re.search(r"\(([^)]*)\)", s)
    if m and m[1].strip() in _CODE_OF:
        return _CODE_OF[m[1].strip()]
    return "" if not re.search(r"[^\W\d_]", s) else None


_FENCE = re.compile(r"(?ms)^[ \t>*-]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>*-]*\1[ \t]*$|\Z)")
_TICKS = re.compile(r"`[^`\n]*`")
# an identifier may touch Han and kana, so its ends are told by ASCII alone
_DROP = re.compile(
    r"(?<![A-Za-z0-9_])(?:[A-Za-z_$][A-Za-z0-9_$]*+"
    r"(?:(?:(?:\.|::|->|\#|/|\\)[A-Za-z_$][A-Za-z0-9_$]*+)++(?:\([^()\n]*\))?|\([^()\n]*\)|://[^\s。，、）]+)"  # paths, calls, addresses
    r"|[A-Z]?[a-z]++[A-Z][A-Za-z0-9_]*+|[A-Z]{2,}+[a-z][A-Za-z0-9_]*+|[A-Za-z0-9]*+_[A-Za-z0-9_]*+|[A-Za-z]*+[0-9][A-Za-z0-9]*+)(?![A-Za-z0-9_])"
)
# lines without any of these are prose
_SUSPECT = re.compile(r"[;{}=|^:@#$+]")
_SUSPECT_AT = re.compile(r"\s*(?:at |from |File |In file|Traceback|Caused|\d|[A-Za-z]{2,8}\s*[({]|[})\]]|[\w.]+(?:Exception|Failure|Problem)\b)")
_CODE_LINE = re.compile(
    r"^\s*(?:[{}()\[\];]+\s*$|.*[;{]\s*(?://.*)?$|[}\])].*|#\s*(?:include|define|pragma|if|endif)\b.*|@\w+(?:\(.*\))?\s*$"
    r"|(?:In file included )?from \S+:\d+.*|In file included.*|\S+?:\d+(?::\d+)?:\s.*|\s*\d*\s*\|.*|[\s^~]+$|\d+ (?:errors?|warnings?).* generated\.?"
    r"|\S+: (?:fatal )?(?:error|warning|note):.*|Traceback .*|\s*File \".*|\s*at [\w.$]+\(.*|Caused by:.*|[\w.]+(?:Exception|Error|Problem|Failure)\b:?.*"
    r"|(?:case\b.*:|default:|return\b|switch\b|try\b|while\b|for\b|if\b)\s*[\w({].*|(?:public|private|protected|static|final|import|package|void|int|long|double|boolean|char|String)\s.*\w\s*[(=;].*"
    r"|[\w.<>\[\]]+(?:\s+\w+)?\s*[-+*/]?=\s*.*|\[?\d{4}-\d\d-\d\d.*|[\w.]+(?:\+\+|--);?.*)$"
)
_LEAD = re.compile(r"^[ \t]*(?:[>*-][ \t]+)+")
_HAN, _KANA, _CYR = re.compile("[㐀-鿿豈-﫿々〆]"), re.compile("[぀-ヿㇰ-ㇿｦ-ﾟ]"), re.compile("[Ѐ-ӿ]")
_END = re.compile(r"[。！？]|[.!?…](?=[\s\"')\]»”]|$)|\n(?=[^\S\n]*(?:[-*•>\d#]|\n))")
_LETTERS = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[㐀-鿿豈-﫿々〆]+|[぀-ヿㇰ-ㇿｦ-ﾟー]+|[^\W\d_㐀-鿿豈-﫿々〆぀-ヿㇰ-ㇿｦ-ﾟー]+(?:['’][^\W\d_㐀-鿿぀-ヿ]+)*")


_WIDE = re.compile("[Ａ-Ｚａ-ｚ]")  # full-width forms of ASCII letters
_CODE_MARKS = re.compile(r"[;{}=<>\\]|\+\+|->|\(\s*\)|\*\s")
_ALPHABETIC = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile("[㐀-鿿豈-﫿々〆぀-ヿㇰ-ㇿｦ-ﾟ]")


def words(s: str) -> list[str]:
    """The words of a lower-cased text: runs of Han, runs of kana, and words of alphabets."""
    return (_ALPHABETIC if s.isascii() or not _CJK.search(s) else WORD).findall(s)


def running_text(text: str) -> str:
    """The text without code blocks, quoted code, identifiers and compiler output; lines stay in place."""
    t = unicodedata.normalize("NFKC" if _WIDE.search(text) else "NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    t = _FENCE.sub("\n\n", t)
    t = _TICKS.sub(" ", t)
    kept = []
    for line in t.split("\n"):
        if (_SUSPECT.search(line) or _SUSPECT_AT.match(line)) and _CODE_LINE.match(_LEAD.sub("", line)) and (line.isascii() or not _HAN.search(line) and not _CYR.search(line)):
            kept.append("")
        else:
            kept.append(_DROP.sub(" ", line))
    return "\n".join(kept)


def sentences(text: str) -> list[str]:
    """Sentences of running text; wrapped lines are joined, blank lines and list items end one."""
    out = []
    marked = len(_CODE_MARKS.findall(text)) > 2
    for s in _END.sub("\\g<0>\0", text).split("\0"):
        if s and _LETTERS.search(s):
            n = len(_CODE_MARKS.findall(s)) if marked else 0
            if n < 3 or n * 12 < s.count(" "):  # else code that lost its lines
                out.append(" ".join(s.split()))
    return out


def script_language(s: str) -> str | None:
    """The language that the script alone decides, ``latin`` for the Latin ones, None without letters."""
    if _KANA.search(s):
        return "ja"
    cjk, cyr = len(_HAN.findall(s)), len(_CYR.findall(s))
    rest = len(_LETTERS.findall(s)) - cjk - cyr
    if cjk * 3 > rest and cjk > cyr:
        return "zh"
    if cyr > rest:
        return "ru"
    return "latin" if rest > 0 else None


LATIN = LANGS[:5]


def unaccented(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


class CharModel:
    """Character trigrams backed off to shorter contexts, one per state."""

    K = 4.0

    def __init__(self, states: tuple[str, ...]):
        self.states = states
        self.n = {s: (Counter(), Counter(), Counter(), Counter(), Counter()) for s in states}
        self.total = dict.fromkeys(states, 0)

    def add(self, state: str, word: str, times: int = 1) -> None:
        tri, bi, uni, c2, c1 = self.n[state]
        w = "^^" + word + "$"
        for i in range(2, len(w)):
            a, b, c = w[i - 2], w[i - 1], w[i]
            tri[a + b + c] += times
            c2[a + b] += times
            bi[b + c] += times
            c1[b] += times
            uni[c] += times
            self.total[state] += times

    def score(self, word: str) -> list[float]:
        """Log-probability of a word's characters in each state."""
        w = "^^" + word + "$"
        out = []
        for s in self.states:
            tri, bi, uni, c2, c1 = self.n[s]
            total, k, p_all = self.total[s], self.K, 0.0
            for i in range(2, len(w)):
                a, b, c = w[i - 2], w[i - 1], w[i]
                p = (uni[c] + 0.05) / (total + 400.0)
                p = (bi[b + c] + k * p) / (c1[b] + k)
                p = (tri[a + b + c] + k * p) / (c2[a + b] + k)
                p_all += math.log(p)
            out.append(p_all)
        return out


def label_sentences(docs: list[tuple[str, str | None]], rounds: int = 2) -> tuple[list[list[tuple[str, str]]], CharModel]:
    """Per document its (sentence, language): the documents' labels start a character model, which then labels anew."""
    split = [[s for s in sentences(running_text(t))] for t, _ in docs]
    lab = [canonical(g) for _, g in docs]
    now = [[script_language(s) for s in ss] for ss in split]
    now = [[(g if c in LATIN else None) if x == "latin" else x for x in xs] for xs, c, g in zip(now, lab, lab)]
    model = CharModel(LANGS)
    said = [[words(s.lower()) for s in ss] for ss in split]
    for r in range(rounds + 1):
        times: Counter = Counter()
        for ws, xs in zip(said, now):
            for w, x in zip(ws, xs):
                if x in LANGS:
                    times.update((x, v) for v in w)
        model = CharModel(LANGS)
        for (x, w), n in times.items():
            model.add(x, w, n)
            if not w.isascii() and x in LATIN:
                model.add(x, unaccented(w), n)
        if r == rounds:
            break
        kept: dict[str, list[float]] = {}
        for d, ss in enumerate(split):
            for j, s in enumerate(ss):
                if script_language(s) != "latin":
                    continue
                total = [0.0] * 5
                for w in said[d][j]:
                    v = kept.get(w)
                    if v is None:
                        v = kept[w] = model.score(w)[:5]
                    total = [a + b for a, b in zip(total, v)]
                now[d][j] = LATIN[max(range(5), key=total.__getitem__)]
    return [list(zip(ss, xs)) for ss, xs in zip(split, now)], model


def training_documents(spark: SparkSession, sf_dir: str, n: int) -> list[tuple[str, str | None]]:
    """About ``n`` labelled documents: a bounded sample for fitting."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null and trim(lang) <> ''")
    return sorted((r[0], r[1]) for r in bounded_sample(d, "doc_id", n).select("text", "lang").collect())


def training_code(rows: DataFrame, column: str, key: str, n: int) -> list[str]:
    """About ``n`` texts of a code column: a bounded sample for fitting."""
    return sorted(r[0] for r in bounded_sample(rows.where(F.col(column).isNotNull()), key, n).select(column).collect())


def group_by_length(lengths: list[int], size: int = 2048, cells: int = 400_000) -> list[list[int]]:
    """Indexes in groups of like length, so that padding stays small."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    out, start = [], 0
    while start < len(order):
        end = min(len(order), start + size)
        # long sequences in smaller groups: bounds the cells of one group
        while end - start > 1 and (end - start) * max(1, lengths[order[end - 1]]) > cells:
            end = start + max(1, (end - start) // 2)
        out.append(order[start:end])
        start = end
    return out


__all__ = ["LANGS", "LATIN", "WORD", "CharModel", "canonical", "defaultdict", "group_by_length", "label_sentences", "running_text", "script_language", "sentences", "training_code", "training_documents", "unaccented", "words"]
