import random
import re

import numpy as np
import pytest

from longreach import runtime
from longreach.llm import leakage, packing, pair_defects, spam, splitter, token_budget
from longreach.llm.text import code_points

# ---- splitting ---------------------------------------------------------------------------------------------------


def tables(text, size):
    for k in range(0, max(1, len(text)), size):
        body = text[k : k + size]
        ends_c, ends_b, chars, n, run_c, run_w = splitter.boundary_table(body, text[k + size : k + size + 1])
        assert n == len(body.encode())
        yield ends_c.tolist(), ends_b.tolist(), chars, n, splitter.widths_of(run_c, run_w)


def test_pieces_by_random_texts():
    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice("abc. \n。é汉😀!\r") if rnd.random() < 0.5 else "x" for _ in range(rnd.randint(1, 120)))
        limit = rnd.randint(5, 40)
        overlap = rnd.randint(0, limit // 3)
        natural = {m.end() for m in re.finditer(r"\r\n|[\n\r]|[。！？]|[.!?](?=\s)", text)}
        found = list(splitter.stitch(tables(text, rnd.choice([1, 2, 3, 7, 50, 1000])), limit, overlap))
        assert found == list(splitter.stitch(tables(text, 1000), limit, overlap))
        assert found[0].start == 0 and found[-1].end == len(text)
        for a, b in zip(found, found[1:]):
            assert b.start <= a.end < b.end
            assert b.start == a.end or len(text[b.start : a.end].encode()) <= overlap
        for p in found:
            assert len(text[p.start : p.end].encode()) == p.n_bytes <= limit
            if p.end < len(text):
                cuts = sorted(natural | {0, len(text)})
                around = text[max(c for c in cuts if c < p.end) : min(c for c in cuts if c >= p.end)]
                assert p.end in natural or len(around.encode()) > limit


def test_pieces_of_a_table(spark):
    long = "".join(f"Sentence number {i} is here. " for i in range(3000)) + "\n"
    rows = [(1, long, 0.25, "a"), (2, "x" * 9000, 0.25, "a"), (3, "short.", 0.25, "a"), (4, None, 0.25, "a"), (5, long, None, "a"), (6, "", 0.25, "a"), (7, "汉" * 5000 + "。", 0.25, "a")]
    df = spark.createDataFrame(rows, "rec bigint, text string, rate double, part string")
    got = splitter.pieces(df, 512, 32, range_chars=1000).collect()
    by = {k: sorted((r for r in got if r["rec"] == k), key=lambda r: r["piece"]) for k in {r["rec"] for r in got}}
    assert set(by) == {1, 2, 7}
    assert not any(r["forced"] for r in by[1]) and all(r["forced"] for r in by[2] + by[7])
    texts = {r["rec"]: r["text"] for r in df.collect()}
    for k, ps in by.items():
        assert ps[0]["start"] == 0 and ps[-1]["end"] == len(texts[k])
        assert all(len(texts[k][p["start"] : p["end"]].encode()) <= 2048 for p in ps)
        assert all(b["start"] < a["end"] for a, b in zip(ps, ps[1:]))
    with_text = splitter.with_text(splitter.pieces(df, 512, 32), df).collect()
    assert all(r["text"] == texts[r["rec"]][r["start"] : r["end"]] for r in with_text)


def test_pieces_of_files(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["word ", "汉字。", "é. ", "😀", "end.\n", "x"]) for _ in range(n)) for n in (4000, 1, 300)] + [""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    paths = [str(tmp_path / f"{i}.txt") for i in range(4)]
    got = sorted(map(tuple, splitter.file_pieces(spark, paths, 0.25, 64, 8, range_bytes=101).collect()))
    df = spark.createDataFrame([(i, t, 0.25) for i, t in enumerate(texts)], "rec bigint, text string, rate double")
    assert [r for r in got if r[0] != 1] == sorted(map(tuple, splitter.pieces(df, 64, 8).collect()))
    assert [r[:4] for r in got if r[0] == 1] == [(1, 0, 0, len(texts[1]))]


def test_long_stretches_over_many_ranges(spark):
    rows = [(1, "x. " * 400 + "y" * 2000 + "\n" + "z. " * 400, 0.25), (4, "z. " * 400 + "y" * 2000, 0.25), (2, "x. " * 2000, 0.25), (3, "汉" * 700 + "。" + "字" * 600, 0.25)]
    df = spark.createDataFrame(rows, "rec bigint, text string, rate double")
    got = {r["rec"]: r["forced"] for r in splitter.pieces(df, 480, 16, range_chars=37).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_time_is_linear_in_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "Some words of a sentence, 汉字。 " * n, 0.25)], "rec bigint, text string, rate double")
        began = time.time()
        assert splitter.pieces(df, 512, 32).count() > n // 90
        return time.time() - began

    seconds(1000)
    assert seconds(400_000) < 8 * seconds(100_000) + 2  # 4 and 16 MB


def test_null_keys_have_no_pieces(spark):
    df = spark.createDataFrame([(None, "word. " * 500, 0.25), (None, "other. " * 500, 0.25)], "rec bigint, text string, rate double")
    assert splitter.pieces(df, 64, 8).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------


def slow_sum_of_squares(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        count = lambda: sum((gaps.count(g)) ** 2 for g in set(gaps) if 0 < g < capacity)
        best = None
        for i in [*[gaps.index(g) for g in sorted(set(gaps)) if g >= s], len(gaps)]:
            new = i == len(gaps)
            gaps.append(capacity) if new else None
            before, gaps[i] = gaps[i], gaps[i] - s
            key = (count(), before)
            gaps[i] = before
            gaps.pop() if new else None
            if best is None or key < best[0]:
                best = (key, i)
        i = best[1]
        gaps.append(capacity) if i == len(gaps) else None
        gaps[i] -= s
        out.append(before)
    return sorted(gaps)


def test_sum_of_squares_equals_brute_force():
    rnd = random.Random(4)
    for _ in range(40):
        capacity = rnd.randint(3, 20)
        sizes = [rnd.randint(1, capacity) for _ in range(40)]
        container, left = packing.sum_of_squares(np.array(sizes), capacity)
        assert sorted(left.tolist()) == slow_sum_of_squares(sizes, capacity)
        fill = np.bincount(container, sizes)
        assert (fill + left == capacity).all()


def test_packing_a_table(spark):
    rnd = random.Random(1)
    rows = [(i, "word " * rnd.randint(1, 90), "en", 0) for i in range(400)] + [(1000, None, "en", 0), (1001, "", None, 0), (1002, "Sentence. " * 300, "xx", 0), (1003, "word " * 5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, container int")
    rates = spark.createDataFrame([("en", 0.25), ("und", 0.5)], "lang string, tokens_per_byte double")
    got = packing.pack(docs, rates, 128, group=100)
    rows = got.collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 128
    assert {r["doc_id"] for r in rows} == {*range(400), 1002, 1003}
    assert {r["doc_id"] for r in packing.split_documents(got).collect()} == {1002}
    assert packing.usage(packing.pack(docs, rates, 128), 128).first()["share_used"] > 0.9
    assert sorted(map(tuple, packing.pack(docs.repartition(7), rates, 128, group=100).collect())) == sorted(map(tuple, rows))
    assert packing.pack(docs.limit(0), rates, 128).count() == 0


# ---- leakage -----------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    han = lambda n: "".join(chr(rnd.randint(0x4E00, 0x4E80)) for _ in range(n))
    items = [(i, "en" if i % 2 else "zh", words(40) if i % 2 else han(90), words(12) if i % 2 else han(25)) for i in range(20)] + [(50, "en", None, None), (51, "fr", words(30), words(30)), (52, None, "x", "y")]
    docs = []
    for d in range(150):
        item = items[rnd.randrange(20)]
        text = rnd.choice([item[2], item[3]])
        a = rnd.randint(0, len(text) // 2)
        part = text[a : a + rnd.randint(10, 120)]
        part = rnd.choice([part, part.upper(), part.replace(" ", " - "), part[:30] + "!?" + part[30:]])
        docs.append((d, rnd.choice([words(20), han(40), ""]) + part + rnd.choice([words(3), ""]), "z"))
    docs += [(900, None, "z"), (901, "", "z"), (902, items[1][2] * 300, "z")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string")
    runs = {"en": 60, "zh": 20}
    want = set()
    for d, t, _ in docs:
        t = leakage.reduced(t or "")
        for i, lang, p, q in items:
            for x in (p, q):
                x, n = leakage.reduced(x or ""), runs.get(lang)
                if n and any(x[k : k + n] in t for k in range(len(x) - n + 1)):
                    want.add((d, i))
    got = [(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it, runs, exact=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    edited = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it, runs, edits=0.05).collect()}
    assert edited >= want


def test_within_edits():
    rnd = random.Random(9)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, old = [i], row
            for j, e in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != e)))
        return row[-1]

    for _ in range(300):
        item, doc = ("".join(rnd.choice("ab") for _ in range(rnd.randint(8, 14))) for _ in range(2))
        i, d, run, most = rnd.randrange(len(item)), rnd.randrange(len(doc)), 6, 2
        want = False
        for s in range(max(0, i - run), min(i, len(item) - run) + 1):
            left, right = item[s:i], item[i : s + run]
            cost = min(distance(left, doc[x:d]) for x in range(d + 1)) + min(distance(right, doc[d:y]) for y in range(d, len(doc) + 1))
            want |= cost <= most
        assert leakage.within_edits(doc, item, d, i, run, most) == want


def test_leaks_with_edits_reach_recall(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    items = spark.createDataFrame([(1, "en", text, None)], "item_id bigint, lang string, passage string, question string")
    docs = []
    for d in range(100):
        part = list(text)
        for k in range(20, 300, 40):  # one edit in each stretch of 40
            part[k] = rnd.choice("0123456789")
        docs.append((d, "".join(rnd.choice("xyz") for _ in range(d)) + "".join(part)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert leakage.leaks(df, items, {"en": 60}, exact=True).count() == 0
    assert leakage.leaks(df, items, {"en": 60}, edits=0.05).count() >= 95


@pytest.mark.parametrize("lang, window, length, edits", [("en", 30, 75, (20, 40)), ("zh", 10, 24, (15,))])
def test_leaks_with_edits_after_a_failing_window(spark, lang, window, length, edits):
    rnd = random.Random(0)
    some = lambda n: "".join(chr(rnd.randint(0x4E00, 0x5E00)) if lang == "zh" else rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items, docs = [], []
    for i in range(12):  # the shared window that fails and the leak lie on one diagonal
        text = some(300)
        good = list(text[150 : 150 + length])
        for k in edits:
            good[k] = "0"
        items.append((i, lang, text, None))
        docs += [(i, text[:window] + some(150 - window) + "".join(good)), (100 + i, text[:window] + some(150))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string")
    runs = {"en": 60, "zh": 20}
    assert leakage.leaks(df, it, runs, exact=True).count() == 0
    assert {tuple(r)[:2] for r in leakage.leaks(df, it, runs, edits=0.05).collect()} == {(i, i) for i in range(12)}


def test_hot_windows_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(100)) for _ in range(9)]
    items = [(i, "en", t, None) for i, t in enumerate(texts)] + [(20 + i, "en", texts[0], texts[0]) for i in range(5)]
    docs = [(i, f"__{texts[0] if i % 3 else texts[i % 9]}__") for i in range(60)] + [(0, texts[0]), (None, texts[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string")
    monkeypatch.setattr(runtime, "HOT", 4)
    monkeypatch.setattr(runtime, "PARTS", 16)
    want = {(d, i) for d, t in docs for i, _, x, _ in items if d is not None and x in t}
    got = [tuple(r) for r in leakage.leaks(df, it, {"en": 60}, exact=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaks(df, it.limit(0), {"en": 60}).count() == 0
    assert leakage.leaks(df.limit(0), it, {"en": 60}).count() == 0
    monkeypatch.setattr(leakage, "FILTER_BITS", 8)  # a full bit table keeps nothing out
    assert {tuple(r) for r in leakage.leaks(df, it, {"en": 60}, exact=True).collect()} == want


@pytest.mark.parametrize("lang", ["en", "zh"])
def test_recall_at_the_most_edits(spark, lang):
    """Stretches of just the length looked for with all edits allowed, at random places."""
    rnd = random.Random(11)
    run, most = (60, 3) if lang == "en" else (20, 1)
    letter = lambda: chr(rnd.randint(0x4E00, 0x5E00)) if lang == "zh" else rnd.choice("abcdefghijklmnopqrstuvwxyz")
    some = lambda n: "".join(letter() for _ in range(n))
    items, docs = [], []
    for i in range(300):
        text = some(120)
        at = rnd.randrange(120 - run)
        part = list(text[at : at + run])
        for k in rnd.sample(range(run), most):
            part[k] = rnd.choice(["", part[k] + "0", "0"])
        items.append((i, lang, text, None))
        docs.append((i, some(rnd.randint(0, 40)) + "".join(part) + some(30)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, lang string, passage string, question string")
    got = {tuple(r) for r in leakage.leaks(df, it, {lang: run}, edits=0.05).collect()}
    assert got <= {(i, i) for i in range(300)}
    print(lang, len(got) / 300)
    assert len(got) >= 0.95 * 300


# ---- spam --------------------------------------------------------------------------------------------------------
SENTENCES = "The council of the town bought wool in 1820, and the register notes it. Most of the timber came by boat from the north! Who paid for the bridge? "
LISTS = [
    "cheap kettle, buy kettle, kettle sale, best kettle, kettle near me, kettle outlet, kettle price, new kettle, kettle review",
    "\n".join(f"https://shop{i}.example/item/{i}" for i in range(12)),
    "#sofa #tent42 #curtain #yogamat #drill #lamp #lantern #kettle #desklamp #carpet",
    "清仓办公椅，办公椅加盟，优惠办公椅，办公椅便宜，秒杀办公椅，排行榜办公椅，团购办公椅",
    "\n".join(f"yoga mat red XL SKU{i}" for i in range(70000, 70012)),
]


TALES = [SENTENCES * 4, "# Harlova\n\n" + SENTENCES, "湖面约3749公顷，湖水简朴。议会在1504年拨款50794银币修缮植物园。", "Q: Which town supplied the timber?\nA: Ylllobest\n\nQ: How long did the journey take?\nA: 16 days"]


@pytest.fixture(scope="module")
def known(spark):
    """What is learned from a small crawl of tales and lists."""
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice(["bel", "dos", "kar", "lim", "ost", "ven"]) for _ in range(3)).capitalize()
    frames = ["The council of {} bought wool in the year {}.", "Most of the timber came by boat from {}, and the register of {} notes it.", "Who paid for the bridge of {} after the flood of {}?", "Le pont de {} fut construit après la crue de {}.", "议会在{}年拨款修缮{}的植物园。", "湖面约{}公顷，湖水的颜色是{}。"]
    tales = [" ".join(rnd.choice(frames).format(name(), rnd.randint(1500, 1900)) for _ in range(12)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(tales + LISTS * 4)]
    return spam.learned(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_words_of_sentences_are_learned(known, spark):
    assert {"the", "of", "的", "在"} <= known and not known & {"kettle", "cheap", "sofa", "办", "椅", "wool,"}
    assert spam.learned(spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")) == frozenset()


@pytest.mark.parametrize("text", LISTS)
def test_lists_are_flagged(text, known):
    for k in (known, frozenset()):
        total, listed, top = spam.page(text, k)
        assert top > 0.5 * total and top <= listed <= total
    total, listed, _ = spam.page(SENTENCES * 10 + text, known)
    assert listed <= 0.5 * total


@pytest.mark.parametrize("text", TALES)
def test_sentences_are_not(text, known):
    total, listed, _ = spam.page(text, known)
    assert listed <= 0.5 * total


def test_flagged_table(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LISTS[0]), (6, LISTS[0]), (7, LISTS[1] * 2000), (8, "#a #b"), *((10 + i, t) for i, t in enumerate(TALES * 3))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_chars_all")
    assert sorted(r[0] for r in spam.flagged(df).collect()) == [4, 6, 7, 8]  # no floor of length
    assert spam.flagged(df.limit(0)).count() == 0
    assert spam.shape_counts(df).groupBy().sum("n_stretches").first()[0] > 10
    monkeypatch.setattr(spam, "VOCABULARY", 1)
    assert len(spam.learned(df)) == 1


# ---- pairs -------------------------------------------------------------------------------------------------------
Q = "Which town supplied the timber used by the Hardurin Trust?"
ZQ = "托米·伦亚在哪一年开办了玛诺塔城的造纸厂？"
WHOLE = "The Trust bought its timber from merchants of Ylllobest. So the supplier was Ylllobest."


@pytest.mark.parametrize(
    "question, answer, kind",
    [
        (Q, None, "empty"), (Q, "", "empty"), (Q, " \t\n", "empty"), (Q, "N/A", "empty"), (Q, "Final answer:", "empty"), (ZQ, "答案：", "empty"), (ZQ, "……", "empty"), (Q, "None.", "empty"),
        (Q, Q, "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n\n{Q}", "copy"), (f"Question: {Q}", Q.lower(), "copy"), (ZQ, "您问的是：" + ZQ, "copy"), (Q, f"{Q} {WHOLE}", None), (Q, f"{Q} Ylllobest", None), (Q, "Which town the timber used by the Hardurin Trust?", "copy"),
        ("1758年盐场归菲诺里岛委员会还是托格亚岛委员会所有？", "1758年盐场归菲诺里岛委员会还是托格亚岛委员会所有？1758年的契约写明盐场的主人是托格亚岛委员会，菲诺里岛委员会只是租户。因此归托格亚岛委员会所有。", None),
        (Q, "Sorry for the long chain of steps; " + WHOLE, None), (ZQ, "具体日期无法确定，但其余内容很清楚。文章提到，造纸厂开办于1735年。因此答案是1735年。", None),
        (Q, "Es war Kellos Sabnepharia, der das Gebäude im Jahr 1469 wieder aufbauen ließ.", "wrong_language"), (ZQ, WHOLE, "wrong_language"), (Q, "第一段只提到地面使用丝线。1940年的账单补充说，屋顶用的是橄榄油。", "wrong_language"),
        (Q, WHOLE[:-12], "truncated"), (Q, WHOLE + " It was sold,", "truncated"), (ZQ, "文章提到，造纸厂开办于1735年。因此答案是", "truncated"),
        (Q, WHOLE, None), (Q, "Ylllobest", None), (Q, "By boat from Ylllobest", None), (Q, WHOLE + " (see passage 3)", None), (Q, WHOLE + "\nFinal answer: Ylllobest", None), (ZQ, "1735年", None), (ZQ, "文章提到，造纸厂开办于1735年。（Fenverarix）", None), (None, WHOLE, None),
    ],
)
def test_defects(question, answer, kind):
    assert pair_defects.defect(question, answer) == kind


def pairs_of(spark):
    """Refusals over unrelated prompts, in wordings of no list; bare answers that recur over related prompts; decoys."""
    rnd = random.Random(1)
    asks = ["Which town supplied the timber of {}?", "Who paid for the roads near {}?", "Why was {} left empty?", "When did {} reopen?", "Where was the first guide of {} printed?", "卡斯港{}的水渠由谁修建？"]
    name = lambda: "".join(rnd.choice(["bel", "dos", "kar", "lim", "ost", "ven"]) for _ in range(4)).capitalize()
    ask = lambda: rnd.choice(asks).format(name())
    rows = [("t", i, ask(), "Such matters lie outside my remit, friend." if i % 2 else "Ich kann dazu leider nichts sagen.") for i in range(40)]
    rows += [("t", 40 + i, ask(), "Such matters lie outside my remits.") for i in range(2)] + [("t", 42, ask(), "此事超出本助手的答复范围。"), ("t", 43, ask(), "此事超出本助手的答复范围"), ("t", 44, ask(), "此事超出本助手的答复范围！")]
    refused = {("t", i) for i in range(45)}
    rows += [("t", 100, ask(), f"Such matters lie outside my remit, but the register says {name()} paid 30 crowns."), ("t", 101, ask(), WHOLE), ("t", 102, None, None)]
    rows += [("d", i, f"Why was the road to {name()} closed in the war?", "The bridge fell") for i in range(30)]
    rows += [("d", 100 + i, ask(), f"Sorry for the long chain of steps; so the answer is {q.split()[-1]}.") for i, q in ((i, "Passages about Ylllobest") for i in range(30))]
    rows += [("d", 200 + i, ask(), f"It was {name()}.") for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, f"Passages about {r[2]} and Ylllobest: the bridge stood.") for r in rows], "tbl string, row_id bigint, question string, answer string, context string")
    return df.selectExpr("*", "1 as opening", "2 as template"), refused


def test_recurrence_reveals_refusals(spark):
    df, refused = pairs_of(spark)
    got = {(r["tbl"], r["row_id"]): r["defect"] for r in pair_defects.defects(df).collect()}
    assert {k for k, v in got.items() if v == "refusal"} == refused
    assert got.pop(("t", 102)) == "empty" and {v for k, v in got.items() if k not in refused} <= {"wrong_language"}
    assert pair_defects.defects(df.limit(0)).count() == 0


def test_templates_need_unrelated_prompts(spark):
    df, _ = pairs_of(spark)
    found = {r["opening"]: r for r in pair_defects.templates(df).collect()}
    assert found["such matters lie outside my remit"]["core"] and not found["such matters lie outside my remits"]["n_prompts"] > 2
    assert "the bridge fell" not in found
    assert pair_defects.templates(df, least_prompts=100).count() == 0


@pytest.mark.parametrize("answer, found", [("Paid in 1820", None), ("It was the Hardurin Trust", None), (Q, None), ("Not said here, I fear.", ["i fear", "not said here"]), (f"{Q} Not said here.", ["not said here"]), ("timber", None), ("", None)])
def test_openings(answer, found):
    assert pair_defects.openings(Q, answer, "The Hardurin Trust bought timber.") == found


# ---- tokens ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_chunks_count_as_the_whole(name):
    try:
        enc = token_budget.encoding(name)
    except FileNotFoundError:
        pytest.skip("no tokenizer files")
    rnd = random.Random(7)
    for _ in range(400):
        text = "".join(rnd.choice(["The ", "word", " ", "  ", "\n", "\n\n", " \n", "é", "汉字", "12", ".", "'s", "😀", "\t", "don't ", "A"]) for _ in range(rnd.randint(1, 200)))
        for size in (5, 17, 60):
            parts = token_budget.chunks(text, size, False)
            assert "".join(parts) == text
            assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def test_token_counts(spark):
    long = "Some words in a line\nand more of them. " * 20000
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, "汉字" * 40000, "x"), (5, "abc", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, n_units string")
    got = {r["id"]: r["n_units"] for r in token_budget.token_counts(df, ["id"]).collect()}
    assert got == {1: len(long), 2: 0, 3: 0, 4: 240000, 5: 3}
    counted = {r["id"]: r["n_units"] for r in token_budget.token_counts(df, ["id"], "byte_bpe_50k").collect()}
    enc = token_budget.encoding("byte_bpe_50k")
    assert counted == {r[0]: len(enc.encode_ordinary(r[1] or "")) for r in rows}
    assert token_budget.token_counts(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("label, name", [("en-US", "en"), ("ENG", "en"), ("English", "en"), ("zh_Hans", "zh"), ("中文", "zh"), ("Simplified Chinese", "zh"), ("zh-Hans-CN", "zh"), (" EN\t", "en"), ("\t\n", None), ("de_DE", "de"), ("français", "fr"), ("unknown", None), ("und", None), ("", None), (None, None), ("enx", None)])
def test_named_language(spark, label, name):
    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(token_budget.named_language(df["l"])).first()[0] == name


def test_wrong_languages(spark):
    q = "Which town supplied the timber?"
    rows = [(1, "en", q), (2, None, q), (3, "\t ", q), (4, "zh", q), (5, "xx", None), (6, None, None), (7, "English (UK)", q), (8, "en", "谁修复了医院？")]
    df = spark.createDataFrame(rows, "row_id bigint, language string, question string")
    assert sorted(r[0] for r in token_budget.wrong_languages(df).collect()) == [2, 3, 4, 6, 8]


@pytest.mark.parametrize("text, name", [("Which town supplied the timber?", "en"), ("1541年从托纳城运往鲁德城的蜂蜜有多少桶？", "zh"), ("Welche Stadt lieferte das Holz?", "de"), ("Quelle ville a fourni le bois du pont ?", "fr"), ("¿Qué ciudad suministró la madera del puente?", "es"), ("123", None), ("", None), (None, None)])
def test_text_language(spark, text, name):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(token_budget.text_language(df["t"])).first()[0] == name


def test_code_points():
    points, lengths = code_points(["a😀", "", "汉"])
    assert points.tolist() == [97, 0x1F600, 0x6C49] and lengths.tolist() == [2, 0, 1]
