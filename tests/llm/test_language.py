"""Held-out accuracy of the language models, and the rules around them."""

import pytest

pytest.importorskip("sparkwright.llm")

from sparkwright.llm import code_prose, doc_language  # noqa: E402
from sparkwright.llm.langmodel import LANGS, canonical, label_sentences, running_text, sentences  # noqa: E402
from sparkwright.tables import load  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    d = load(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang").where("lang in ('en','de','fr','es','pt','ru','zh','ja')").orderBy("doc_id").collect()
    return [(r["text"], r["lang"]) for r in d]


def test_labels():
    assert [canonical(x) for x in ("EN", "en-US", "German", "ger", "zh-Hans", " Español ", "jpn", "fr_CA")] == ["en", "en", "de", "de", "zh", "es", "ja", "fr"]
    assert canonical(None) == canonical(" ") == canonical("und") == canonical("Unknown") == "" and canonical("Klingon") is None


def test_running_text():
    t = "Uses `a.b()` here.\n```\nint x = 1;\n```\nx.cpp:1:2: error: no such thing here\nreturn foo(x);\nSee HollowMapper and a.b.c(d), please. 请把检查从EarlyPolicy移到gasketNeedle。"
    s = running_text(t)
    assert "int x" not in s and "error" not in s and "return" not in s and "HollowMapper" not in s and "EarlyPolicy" not in s and "please" in s and "移到" in s
    assert len(sentences("One two. Three four!\n\nFive 。六七。八")) >= 5


def test_field_on_held_out(docs):
    train, test = docs[::2], docs[1::2]
    field = doc_language.fit(train, steps=40)
    right = total = 0
    for (text, _), pairs in zip(test, label_sentences(test)[0]):
        segs = doc_language.analyse(field, [text])[0]
        if segs and pairs:
            main = max({k: sum(s[2] for s in segs if s[0] == k) for k, *_ in segs}.items(), key=lambda x: x[1])[0]
            votes = {}
            for s, g in pairs:
                votes[g] = votes.get(g, 0) + len(s)
            total += 1
            right += LANGS[main] == max(votes, key=lambda k: votes[k] * (3 if k in ("zh", "ja") else 1))
            assert all(0 <= s[1] / s[2] <= 1 + 1e-5 for s in segs)
    assert right / total > 0.97


def test_prose_in_code(docs):
    code = ["package a; class A { int hollowBucket = valveIndex.length() - 3; void f(String s) { if (s == null) { return; } } }"] * 5
    dec = code_prose.Decoder(code_prose.fit_model(docs, code))
    text = (
        "// Der Spaltenleser wartet, bis die Gegenseite geschlossen hat.\nint a = b.length();\n// for (int i = 0; i < a.size(); i++) {\n"
        'log("Wafer");\ns = "\\u4f1a\\u8bdd\\u7f13\\u5b58\\u628a\\u5269\\u4f59\\u7684\\u5b57\\u8282\\u590d\\u5236\\u5230\\u65b0\\u7684\\u7f13\\u51b2\\u533a";\n'
        'b = "7Dv3hZasx9TBvcJy3Rgioh9Jykv4R9oPF5767vdCiKQjvbSLVEZkW6pRQDnEwGhYsoHTgJawzjwNY5hvC6nfRF3DKH6FxJanCjXN";\n/* The worker thread keeps\n * a weak reference to its owner. */\n'
    )
    chars, langs = code_prose.languages(dec, [text])[0]
    assert langs == {"de", "zh", "en"} and set(chars) == langs and sum(chars.values()) < len(text)
    assert code_prose.languages(dec, ["", "int x;", "/* one two */"]) == [({}, set())] * 3


def plain_path(dec, text, inside):
    """Viterbi over one whole file, a character at a time; outside of comments and literals only code is possible."""
    import numpy as np

    q = code_prose.Sequence([text])
    e, (enter, leave, cross), k = dec.emissions(q), dec.model.change, code_prose.K
    v, back = [0.0] + [-np.inf] * (k - 1), []
    for t in range(len(text)):
        new, row = [], []
        for s in range(k):
            ways = [(v[s], s)]
            if q.change[t] or inside[t] != inside[t - 1]:
                ways += [(v[r] + (leave if s == 0 else enter if r == 0 else cross), r) for r in range(k) if r != s]
            best, r = max(ways)
            new.append(best + float(e[t, s]) if s == 0 or inside[t] else -np.inf)
            row.append(r)
        v = new
        back.append(row)
    state = int(np.argmax([v[0]] + [x + leave for x in v[1:]]))
    path = []
    for row in reversed(back):
        path.append(state)
        state = row[state]
    return path[::-1]


def test_path_over_a_whole_file_falls_apart_into_its_stretches(docs):
    code = ["class A { int hollowBucket = valveIndex.length() - 3; void f(String s) { if (s == null) { return; } } }"] * 5
    dec = code_prose.Decoder(code_prose.fit_model(docs[:200], code))
    parts = [("int a = b; ", 0), (" the reader waits for lastBucket until it is closed ", 1), ("foo(a1, B_c);", 0), (" der Leser wartet and the rest is gone ", 1), (" if (x) { return y; } ", 1), ("}", 0)]
    text, inside = "".join(s for s, _ in parts), [i for s, i in parts for _ in s]
    whole = plain_path(dec, text, inside)
    q = code_prose.Sequence([s for s, i in parts if i])
    # in white space and signs a change may stand at one place as well as at another
    assert [k for k, i, c in zip(whole, inside, text) if i and c.isalpha()] == [k for k, c in zip(dec.decode(q).tolist(), "".join(s for s, i in parts if i)) if c.isalpha()]
    assert {code_prose.STATES[k] for k in whole} >= {"code", "en"} and not any(k for k, i in zip(whole, inside) if not i)


def test_changes_of_state_are_learned(docs):
    code = ["int x; // The reader waits until the other side has closed.\n/* x = y; foo(bar); */"] * 20
    model = code_prose.fit_model(docs[:200], code)
    assert model.change != (code_prose.CODE_CHANGE, code_prose.CODE_CHANGE, code_prose.LANGUAGE_CHANGE) and all(c < 0 for c in model.change)
