import random

import pytest

pytest.importorskip("sparkwright.llm")

from sparkwright.llm import near_duplicates  # noqa: E402
from sparkwright.llm.near_duplicates import DEPTH, Forest, near_duplicate_groups, recall  # noqa: E402


def texts(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(9)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(60)] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    return rows


def brute(rows, k, threshold):
    sets = []
    for i, t in rows:
        w = t.split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}))
    par = {i: i for i, _ in sets}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both / (len(sets[x][1]) + len(sets[y][1]) - both) >= threshold:
                par[find(sets[x][0])] = find(sets[y][0])
    return sorted(sorted(i for i in par if find(i) == r) for r in {find(i) for i in par})


def test_recall_of_prefixes():
    assert [recall(0.7, d) > recall(0.7, d + 1) for d in range(1, DEPTH)] == [True] * (DEPTH - 1)
    assert recall(0.7, 5) >= 0.999 > recall(0.7, 6) and recall(0.8, 5) > 0.999


def near_pairs(rows, k, threshold):
    sets = [(i, {tuple(w[j : j + k]) for w in [t.split()] for j in range(len(w) - k + 1)}) for i, t in rows]
    out = set()
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            both = len(sets[x][1] & sets[y][1])
            if both and both / (len(sets[x][1]) + len(sets[y][1]) - both) >= threshold and sets[x][1] != sets[y][1]:
                out.add((sets[x][0], sets[y][0]))
    return out


def test_measured_recall_of_candidates(spark):
    """Of all pairs at or above the threshold, nearly all meet in some prefix of the trie."""
    rows = texts(11, 200)
    f = Forest(spark, spark.createDataFrame(rows, "id long, body string"), 3, 0.7)
    buckets = {}
    for r in f.trie(5).collect():
        buckets.setdefault(r["bucket"], set()).add(r["id"])
    met = {(a, b) for m in buckets.values() for a in m for b in m if a < b}
    true = {p for p in near_pairs(rows, 3, 0.7) if {*p} <= {r["id"] for r in f.reps.collect()}}
    assert len(true) > 300 and len(true & met) >= 0.99 * len(true)


def test_deep_prefixes_settle_families(spark, monkeypatch):
    """What deep prefixes have linked is not compared again; the groups are those of the shortest prefix alone."""
    rows = texts(7, 150)
    compared = []
    real = Forest._compare
    monkeypatch.setattr(Forest, "_compare", lambda self, o, g: (compared.append(o.count()), real(self, o, g))[1])
    items = spark.createDataFrame(rows, "id long, body string")
    groups = lambda: sorted(map(tuple, near_duplicate_groups(spark, items, 3, 0.7).collect()))
    stepwise = groups()
    steps, compared[:] = list(compared), []
    monkeypatch.setattr(near_duplicates, "DEPTH", 5)
    assert groups() == stepwise
    assert len(steps) > 1 and steps[-1] < compared[0] / 2


@pytest.mark.parametrize("bound", [2, 512])
def test_groups_equal_brute_force(spark, bound):
    rows = texts(5, 90)
    items = spark.createDataFrame([*rows, (900, None), (901, " \n"), (902, "")], "id long, body string")
    groups = {}
    for r in near_duplicate_groups(spark, items, 3, 0.7, pair_bound=bound).collect():
        groups.setdefault(r["group_id"], []).append(r["id"])
    assert sorted(sorted(g) for g in groups.values()) == brute(rows, 3, 0.7)


def test_all_columns_equal_whatever_the_bound(spark, monkeypatch):
    items = spark.createDataFrame(texts(5, 160), "id long, body string")
    monkeypatch.setattr(near_duplicates, "SALT_ROWS", 3)
    few, many = (sorted(map(tuple, near_duplicate_groups(spark, items, 3, 0.7, pair_bound=b).collect())) for b in (2, 512))
    assert few == many


def test_copies_and_short_texts(spark):
    rows = [(i, "same text of many copies here") for i in range(300)] + [(400, "a b"), (401, "A  b"), (402, "b a"), (403, "x")]
    got = {r["id"]: r["group_id"] for r in near_duplicate_groups(spark, spark.createDataFrame(rows, "id long, body string")).collect()}
    assert {got[i] for i in range(300)} == {0} and got[401] == got[400] != got[402] and len(got) == 304
