import random
import re

import pytest

from longreach import runtime
from longreach.llm import near_dup as N

WORDS = [f"w{i:03d}" for i in range(400)]


def jaccard(a, b, n=5):
    grams = lambda t: {t[i : i + n] for i in range(len(t) - n + 1)}
    x, y = (grams(re.sub(r"[ \t\r\n]+", " ", t.lower())) for t in (a, b))
    return len(x & y) / len(x | y) if x and y else None


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.choice([6, 40, 120]))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            edited = list(words)
            for _ in range(rnd.randint(0, 8)):
                edited[rnd.randrange(len(edited))] = rnd.choice(WORDS)
            texts.append(" ".join(edited))
    return texts


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "tbl string, rec bigint, text string")
    return df.selectExpr("*", "'x' as key", "1 as rep", "'y' as digest", "0 as n_members") if extra else df


def test_equals_brute_force(spark):
    rows = [("a", i, t) for i, t in enumerate(corpus())] + [("b", i, t) for i, t in enumerate(corpus(2, 20))]
    rows += [("a", 1000, None), ("a", 1001, ""), ("a", 1002, "   "), ("a", 1003, "abc"), ("b", 1000, "汉字" * 5000), ("b", 1001, "汉字" * 5001), ("a", 1004, "ABCDE\t\nf"), ("a", 1005, "abcde f")]
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] and y[2] and (jaccard(x[2], y[2]) or 0) >= 0.7}
    got = [tuple(r) for r in N.similar_pairs(frame(spark, rows, extra=True)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and len(want) > 40


def test_empty_table(spark):
    assert N.similar_pairs(frame(spark, [])).count() == 0
    assert N.groups(frame(spark, [])).count() == 0


def test_hot_class_is_not_expanded_in_groups(spark):
    text = " ".join(WORDS[:80])
    near = " ".join(WORDS[:79] + ["other"])
    rows = [("a", i, text) for i in range(3000)] + [("a", 5000, near), ("a", 5001, "quite something else in here")]
    got = {r["rec"]: r for r in N.groups(frame(spark, rows)).collect()}
    assert len(got) == 3002
    assert all(got[i]["class_id"] == 0 and got[i]["group_id"] == 0 and got[i]["n_copies"] == 3000 and got[i]["n_links"] == 1 for i in range(3000))
    assert got[5000]["group_id"] == 0 and got[5000]["class_id"] == 5000
    assert got[5001]["n_links"] == 0 and got[5001]["group_id"] == 5001


def test_tiles_lose_no_pair(spark):
    rows = [("g", i, 37) for i in range(37)] + [("h", i, 2) for i in range(2)]
    df = spark.createDataFrame(rows, "grp string, item bigint, n bigint")
    got = [tuple(r) for r in N.tiled_pairs(df, ["grp"], "item", "n", tile=5).collect()]
    assert sorted(got) == sorted((g, a, b) for g, m in (("g", 37), ("h", 2)) for a in range(m) for b in range(a + 1, m))


@pytest.mark.parametrize("n", [3, 5])
def test_exact_similarity(n):
    texts = [N.normal(t) for t in corpus(3, 15)] + ["".join(chr(0x4E00 + i) for i in range(6000)), "".join(chr(0x4E00 + i) for i in range(100, 6000))]
    pairs = [(a, b) for a in texts for b in texts[:8]] + [(texts[-1], texts[-2])]
    assert N.exact_similarity(pairs, n) == pytest.approx([jaccard(a, b, n) or 0 for a, b in pairs])


def test_posterior_is_monotonous():
    assert N.least_matches(0.7, 1e-4, 56) < N.least_matches(0.9, 1e-4, 56)
    assert N.least_matches(0.7, 1e-4, 448) / 448 > N.least_matches(0.7, 1e-4, 56) / 56
    least = N._least(0.7, 1e-4, 64)
    assert least[16] < least[32] < least[64] and least[64] == N.least_matches(0.7, 1e-4, 64)  # short texts are pruned less


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([("a", i, i + 1) for i in range(40)] + [("a", 100, 101)], "tbl string, rec_a bigint, rec_b bigint")
    nodes = spark.createDataFrame([("a", i) for i in [*range(41), 100, 101, 200]], "tbl string, rec bigint")
    got = {r["rec"]: r["root"] for r in N.components(links, nodes).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_links_at_the_threshold(spark):
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(200):
        a = some(64)
        b = a[:48] + some(16)
        rows += [("a", 3 * i, a), ("a", 3 * i + 1, a[:50] + b[50:]), ("a", 3 * i + 2, b[:40])]
    want = {(x, y) for i in range(200) for x, y in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2)) if jaccard(rows[x][2], rows[y][2]) >= 0.6}
    got = {(r["rec_a"], r["rec_b"]) for r in N.link_representatives(frame(spark, rows), 0.6, rows=5)[1].collect()}
    assert len(want) >= 200 and got <= want and len(got) >= 0.97 * len(want)


def test_bucket_of_a_third_of_all_rows(spark, monkeypatch):
    """Hot buckets, hubs and classes in parts: the same pairs as brute force."""
    rnd = random.Random(8)
    base = [rnd.choice(WORDS) for _ in range(60)]
    hot = [" ".join(base[:i] + [rnd.choice(WORDS)] + base[i + 1 :]) for i in range(60)] + [" ".join(base)] * 20
    rows = [("a", i, t) for i, t in enumerate(hot + corpus(5, 50))]
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and (jaccard(x[2], y[2]) or 0) >= 0.7}
    monkeypatch.setattr(N, "TILE", 7)
    monkeypatch.setattr(N, "SALTED", 4)
    monkeypatch.setattr(runtime, "HOT", 5)
    monkeypatch.setattr(runtime, "PARTS", 16)
    got = [(r["rec_a"], r["rec_b"]) for r in N.similar_pairs(frame(spark, rows, extra=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3000
    groups = {r["rec"]: r for r in N.groups(frame(spark, rows)).collect()}
    assert len({groups[i]["group_id"] for i in range(80)}) == 1
    assert all(groups[i]["n_copies"] == 20 for i in range(60, 80))


def test_unlike_texts_of_a_bucket_leave_no_pairs(spark):
    """The first step drops them before anything is shuffled."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(60)) for _ in range(40)]
    keys, filled = N.band_keys([N.normal(t) for t in texts], 5)
    sketch = [bytes(k.view("u1").reshape(N.BANDS, 8)[:, 0]) for k in keys]
    rows = [("a", i, 40, int(filled[i]), bytearray(sketch[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "tbl string, rec bigint, n bigint, filled int, sketch binary")
    met = N.tiled_pairs(df, ["tbl"], "rec", "n", ("filled", "sketch"))
    assert met.count() == 780 and N._prune_sketches(met, 0.7, 1e-4).count() < 20
