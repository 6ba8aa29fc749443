import random
import unicodedata

import pytest

pytest.importorskip("sparkwright.llm")

from sparkwright.llm.leakage import NEAR_GAP, NEAR_RUN, find_leaks, p8_found, p8_items, p8_matches, words  # noqa: E402
from sparkwright.llm.mixing import rates  # noqa: E402
from sparkwright.llm import leakage, truncation  # noqa: E402
from sparkwright.llm.truncation import BackwardModel, final, language, state, valley  # noqa: E402


def test_words():
    assert words("Éa-b_C1­x ＡＢ") == ["éa", "b", "c1x", "ab"]
    assert words(unicodedata.normalize("NFD", "Über")) == words("über")


@pytest.mark.parametrize("seed", range(4))
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            p = rng.choice(items)[1].split()
            a = rng.randrange(len(p))
            w[len(w) // 2 : len(w) // 2] = p[a : a + rng.randrange(1, 30)]
        docs.append((d, ", ".join(w).upper() if d % 2 else "\n".join(w)))
    want = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for k, p in items:
            q = words(p)
            if any(tuple(q[i : i + 13]) in grams for i in range(len(q) - 12)):
                want.add((d, k))
    got = find_leaks(spark, spark.createDataFrame(docs, "doc_id long, body string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def brute_chain(w, q):
    """Most words of a chain of two or more runs, by trying all."""
    runs = []
    for i in range(len(w)):
        for j in range(len(q)):
            if w[i] == q[j] and not (i and j and w[i - 1] == q[j - 1]):
                n = 0
                while i + n < len(w) and j + n < len(q) and w[i + n] == q[j + n]:
                    n += 1
                if n >= NEAR_RUN:
                    runs.append((i, j, n))
    best, top = {}, 0
    for i, j, n in sorted(runs):
        best[i, j, n] = n
        for (a, b, m), total in list(best.items()):
            twice = max(0, a + m - i, b + m - j)
            if a < i and b < j and twice < min(m, n) and max(i + twice - a - m, j + twice - b - m) <= NEAR_GAP:
                best[i, j, n] = max(best[i, j, n], total + n - twice)
                top = max(top, total + n - twice)
    return top


@pytest.mark.parametrize("seed", range(3))
def test_proximity_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range([60, 60, 2][seed])]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 40)))) for i in range(8)]
    docs = []
    for d in range(50):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(items)[1].split()
            for at in range(len(p) - 1, 0, -rng.randrange(3, 9)):
                p[at : at + rng.randrange(3)] = ["new"] * rng.randrange(3)
            w += p
        docs.append((d, " ".join(w)))
    want = {}
    for d, t in docs:
        for k, p in items:
            if len(p.split()) >= 13 and (n := brute_chain(t.split(), p.split())) >= 13:
                want[d, k] = n
    rows = find_leaks(spark, spark.createDataFrame(docs, "doc_id long, body string").repartition(3), spark.createDataFrame(items, "item_id long, passage string"), proximity=True).collect()
    got = {}
    for r in rows:
        if r["kind"] == "proximity":
            got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), 0), r["n_words"])
    assert got == want and len(want) > 10


def test_changed_passages_are_proximity_matches(spark, table_dir):
    w = [f"t{i}" for i in range(40)]
    changed = [x if i % 8 != 7 else "other" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i % 8 != 7]
    added = [y for i, x in enumerate(w) for y in ([x, "more"] if i % 8 == 7 else [x])]
    far = [y for i, x in enumerate(w) for y in ([x] + ["pad"] * 3 if i % 8 == 7 else [x])]
    docs = [(i, " ".join(["start", *x, "end"])) for i, x in enumerate([w, changed, dropped, added, far, w[::-1]])]
    d = table_dir(documents=spark.createDataFrame(docs, "doc_id long, text string"), eval_items=spark.createDataFrame([(7, "s", "en", " ".join(w)), (8, "s", "en", "no such words")], "item_id long, suite string, lang string, passage string"))
    got = {(r["doc_id"], r["kind"], r["start_word"], r["n_words"], r["n_text_words"]) for r in p8_matches(spark, d).collect()}
    assert got == {(0, "exact", 1, 40, 40), (1, "proximity", 1, 35, 39), (2, "proximity", 1, 35, 35), (3, "proximity", 1, 40, 44)}
    assert [tuple(r) for r in p8_found(spark, d).collect()] == [(0, 7)]
    rows = {r["item_id"]: r for r in p8_items(spark, d).collect()}
    assert (rows[7]["n_docs"], rows[7]["n_docs_exact"], rows[7]["leaked"], rows[7]["leaked_exact"]) == (4, 1, True, True) and not rows[8]["leaked"]


def test_rates():
    r = rates({"a": 100, "b": 1000, "c": 0}, {"a": (0.5, 2), "b": (0.4, 1), "c": (0.1, 4)})
    assert r["a"] == 2.0 and r["c"] == 0.0 and abs(r["b"] - 0.16) < 1e-9
    assert rates({}, {"a": (1.0, 1)}) == {"a": 0.0} and rates({"a": 5}, {"a": (0.0, 1)}) == {"a": 0.0}


def test_states():
    assert state('{"a": 1}') == "J0" and state('{"a": "x') == "J1" and state("a\n```\nx") == "F" and state("a\n```\nx\n```") == "E"
    assert state("```\nx\n```\n- `a` -> `b`") == "L41" and state("void f() {\n s = \"}\";") == "C10" and state("#ifndef A\nvoid f() { }\n#endif") == "C00"
    assert final("abc\n[stream closed]") == ("abc", True) and final("abc <truncated>")[1] and final("a [...]")[1] and final("a�")[1] and not final("x = a[i]")[1]
    assert final("so that it works…")[0].endswith("works...")


def test_backward_model():
    whole = [f"The reader number {i} waits until the side has closed.\n\n```cpp\nvoid f{i}() {{\n    g({i});\n}}\n```" + ("\n\nDone" if i % 5 == 0 else "\n\nThe buffer is shared by all open files.") for i in range(400)]
    m = BackwardModel()
    for t in whole:
        m.add(t)
    assert all(m.log_odds(final(t)[0]) > -3 for t in whole)
    cut = [t[: len(t) - 12] for t in whole if not t.endswith("Done")]
    assert sum(m.log_odds(final(t)[0]) < -3 for t in cut) / len(cut) > 0.95


def test_counts_cover_all_rows_and_have_a_bound(spark):
    whole = [("a", f"The reader number {i} waits until the side has closed.") for i in range(50)] + [("b", f"x{i}();\n}}") for i in range(20)]
    models = truncation.fit(spark.createDataFrame(whole, "record_kind string, body string").repartition(5))
    assert models["a"]["P0|"][0] == 50 and models["a"]["P0|closed."][0] == 50 and models["b"]["P0|}"][0] == 20
    assert abs(models["a"]["P0|"][1] - sum(len(t) - 1 for k, t in whole if k == "a")) < 1e-6
    assert sum(len(m) for m in models.values()) <= sum((truncation.ORDER + 1) * (1 + len(t) / 20) for _, t in whole) / truncation.LEAST_SUPPORT + 60


def test_states_of_all_prefixes():
    rng = random.Random(5)
    bits = ["`", "```", "```\n", "{", "}", '"', '\\"', "'", "\n", " ", "- ", ">", "#if", "#endif", "# if\n", "a", '{"', "[", '":1', "'{'", '"{}"', '"a \'{\' b"', "é"]
    for _ in range(4000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 18))).rstrip()
        got = truncation.prefix_states(s, truncation._codes(s)) if s else []
        for k in range(1, len(s) + 1):
            if s[k - 1].strip():
                assert truncation.STATES[got[k]] == state(s[:k]), s[:k]


def test_counts_cover_all_places(spark):
    body = "Σας 7 {x} waits.\n\n```cpp\nvoid f() {\n    g(\"{\");\n}\n```\n- `a` > `b`"
    texts = [("a", f"{'word ' * i}ends here {i}, then it goes on: {body[: 20 + i]}") for i in range(60)] + [("b", body[:i]) for i in range(2, len(body))] + [("b", "  x"), ("b", " a b [...]")]
    models = truncation.fit(spark.createDataFrame(texts, "record_kind string, body string").repartition(3))
    for kind in "ab":
        whole = BackwardModel()
        for k, t in texts:
            if k == kind:
                whole.add(t)
        assert len(models[kind]) > 20 and all(whole.counts[c] == n for c, n in models[kind].items())
        # every place of every text is one, not some of them
        assert sum(n[1] for c, n in whole.counts.items() if c.endswith("|")) == sum(len(final(t)[0]) - 1 for k, t in texts if k == kind)


def test_passages_in_blocks(spark, monkeypatch):
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(0, 200, 5)]
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 16))) for i in range(0, 190, 7)]
    find = lambda: sorted(map(tuple, find_leaks(spark, spark.createDataFrame(docs, "doc_id long, body string"), spark.createDataFrame(items, "item_id long, passage string")).collect()))
    whole = find()
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    assert find() == whole and len(whole) > 20


def test_language_votes_on_whole_texts():
    assert language("int x; " * 800 + "the end " + "der Leser wartet und die Seite ist nicht offen " * 5) == "de"


def test_valley():
    assert -5 <= valley([(-8, 50), (-7, 40), (2, 500), (3, 400)]) <= -2 and valley([]) == -3.5
