import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from longreach import runtime
from longreach.functions import language_model as lm
from longreach.functions import seeded
from longreach.functions import text as X
from longreach.operators import context, datasets, evaluate, ivf, knn, paths, qa
from longreach.sources import files
from longreach.streaming import incremental

# ---- text --------------------------------------------------------------------------------------------------------


def one(spark, expr, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return df.select(expr).first()[0]


@pytest.mark.parametrize("text, lang, n", [("", "en", 0), ("abc", "en", 1), ("答案", "zh", 2), ("abc", "de", 1), (None, "en", None)])
def test_token_estimate(spark, text, lang, n):
    assert one(spark, X.token_estimate("t", "lang"), t=text, lang=lang) == n


@pytest.mark.parametrize("text, n", [("", 0), ("a", 0), ("ab", 0), ("abc", 1), ("aaaaa", 1), ("abcd", 2)])
def test_ngrams(spark, text, n):
    assert len(one(spark, X.char_ngrams("t"), t=text)) == n


def test_chunks(spark):
    assert one(spark, X.equal_chunks("t", F.lit(60), 10), t="abcdefghij") == ["ab", "cd", "ef", "gh", "ij"]
    assert one(spark, X.equal_chunks("t", F.lit(0), 10), t="") == []
    assert one(spark, X.equal_chunks("t", F.lit(5), 10), t=None) is None


@pytest.mark.parametrize("text, want", [('x {"a":"1"} y', {"a": "1"}), ('{"a":{"b":1}}', None), ('{"a":\n"1"}', None), ("none", None), ('{"a":" "}', {"a": " "}), (None, None)])
def test_first_json_object(spark, text, want):
    assert one(spark, X.first_json_object("t"), t=text) == want


def test_small_text_functions(spark):
    assert one(spark, X.strip_characters("t"), t="答案：x答y案") == "x答y"
    assert one(spark, X.strip_space("t"), t=" 　\nx \t") == "x"
    assert one(spark, X.question_line("t"), t="a\nQuestion: b\nAnswer:") == "Question: b"
    assert one(spark, X.question_line("t"), t="a\nb\nc") is None
    assert one(spark, X.question_line("t"), t="a") is None
    assert one(spark, X.base_name("t"), t="a/b/c.x.jsonl") == "c"
    assert one(spark, X.parent_name("t"), t="a/b/c.x.jsonl") == "b"
    assert one(spark, X.zero_padded("t"), t=123) == "123" and one(spark, X.zero_padded("t"), t=4) == "04"
    assert one(spark, X.quoted_strings("t"), t='["a?", "b"]') == ["a?", "b"]


def test_seeded_is_portable(spark):
    import hashlib

    want = int(hashlib.md5(b"7|3|x").hexdigest()[:8], 16)
    assert one(spark, seeded.hashed(7, F.col("a"), F.col("b")), a=3, b="x") == want
    assert one(spark, seeded.between(7, F.lit(2), F.lit(2), F.col("a")), a=3) == 2


# ---- search ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[17] = x[3]
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(999, None, 1)]
    return x, spark.createDataFrame(rows, "id bigint, v array<float>, label int")


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
@pytest.mark.parametrize("block", [1000, 64])
def test_exact_knn(spark, vectors, metric, block, monkeypatch):
    monkeypatch.setattr(knn, "BASE", block)
    monkeypatch.setattr(knn, "QUERIES", 16)
    x, df = vectors
    x = x.astype(np.float64)
    s = {"ip": x @ x.T, "l2": -((x[:, None] - x[None]) ** 2).sum(axis=2), "cosine": (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T}[metric]
    s = np.round(s, 9)
    want = {(q, r + 1, n) for q in range(0, 300, 20) for r, n in enumerate(sorted(range(300), key=lambda n: (-s[q, n], n))[:10])}
    got = {(r["q"], r["rank"], r["n"]) for r in knn.exact_knn(df.where("id % 20 = 0"), df, 10, metric).collect()}
    assert got == want


def test_all_lists_is_exact(spark, vectors):
    _, df = vectors
    q = df.where("id % 20 = 0")
    centroids = knn.label_centroids(df, "label", 16)
    a = knn.ivf_search(q, df, centroids, nprobe=5).collect()
    b = knn.exact_knn(q, df).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert knn.recall_at(knn.exact_knn(q, df), knn.ivf_search(q, df, centroids, nprobe=5), 10).agg(F.min("recall")).first()[0] == 1.0


def test_empty_search(spark, vectors):
    _, df = vectors
    none = df.limit(0)
    assert knn.exact_knn(none, df).count() == 0 and knn.exact_knn(df.limit(3), none).count() == 0
    assert knn.coarse_assign(df, knn.label_centroids(none, "label", 16)).count() == 0


def test_trained_index(spark, vectors):
    _, df = vectors
    config = ivf.Config(lists=8, subspaces=4, centres=32)
    index = ivf.train(df, config)
    coded = ivf.merge_shards(ivf.encode(df, index, config))
    assert coded.count() == 300 and ivf.code_dedupe(coded).count() <= 299
    q = df.where("id % 20 = 0")
    found = ivf.search(q, coded, index, nprobe=8, vectors=df, rerank=8)
    recall = knn.recall_at(knn.exact_knn(q, df), found, 10).where("i = 10").first()["recall"]
    assert recall >= 0.9
    assert {r["check"]: r["n_bad"] for r in knn.consistency(found, df, 10).collect()}["unknown_neighbour"] == 0
    with pytest.raises(ValueError):
        ivf.search(q, coded, index, nprobe=9)
    with pytest.raises(ValueError):
        ivf.train(df, ivf.Config(subspaces=5))


def test_configuration_and_evaluation(spark, vectors):
    _, df = vectors
    config = evaluate.SearchConfig(16, nprobe=4, index=ivf.Config(lists=4, subspaces=4, centres=32))
    assert [(c.nprobe, c.k) for c in evaluate.expand(config, nprobe=[1, 2], k=[3])] == [(1, 3), (2, 3)]
    for bad in ({"nprobe": 5}, {"metric": "x"}, {"k": 0}, {"d": 18}):
        with pytest.raises(ValueError):
            evaluate.expand(config, **{k: [v] for k, v in bad.items()})
    found = evaluate.evaluate(df.where("id % 20 = 0"), df, config)
    assert found["recall"].count() == 10 and found["means"].count() == 3
    assert found["intersections"].agg(F.sum("n_queries")).first()[0] == 15
    turned = evaluate.linear_transform(df, evaluate.hadamard(16, 16))
    norms = df.join(turned.withColumnRenamed("v", "w"), "id").selectExpr("abs(aggregate(transform(v, x -> x * x), 0D, (a, b) -> a + b) - aggregate(transform(w, x -> x * x), 0D, (a, b) -> a + b)) as gap")
    assert norms.agg(F.max("gap")).first()[0] < 1e-3


def test_batches_go_on_where_they_were(spark, vectors, tmp_path):
    _, df = vectors
    run = lambda q: knn.exact_knn(q, df, 3)
    q = df.where("id < 300 and id % 50 = 0")
    assert evaluate.search_in_batches(q, str(tmp_path / "knn"), 100, run, most=1) == 1
    assert evaluate.search_in_batches(q, str(tmp_path / "knn"), 100, run) == 2
    assert evaluate.search_in_batches(q, str(tmp_path / "knn"), 100, run) == 0
    assert spark.read.parquet(str(tmp_path / "knn")).count() == 18


def test_vector_helpers(spark, vectors):
    _, df = vectors
    assert knn.vector_distinct(df).count() == 299
    assert knn.sample(df, 7, 1).count() == 7 and sorted(knn.sample(df, 7, 1).collect()) == sorted(knn.sample(df.repartition(5), 7, 1).collect())
    wanted = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 12345)], "ord bigint, id bigint")
    assert [(r["ord"], r["id"]) for r in knn.gather(wanted, df).orderBy("ord").collect()] == [(0, 5), (1, 2), (2, 5)]


# ---- paths -------------------------------------------------------------------------------------------------------


def naive_walk(near, size=21):
    unseen = set(near)
    current = min(unseen)
    unseen.discard(current)
    out, length = [[current]], 0
    while unseen:
        step = next((n for n in near[current] if n in unseen), None)
        if step is None or length >= size:
            step, length = min(unseen), 0
            out.append([])
        unseen.discard(step)
        out[-1].append(step)
        current, length = step, length + 1
    return out


def naive_merge(clusters, near, size=21):
    members = {i: list(c) for i, c in enumerate(clusters)}
    home = {d: i for i, c in members.items() for d in c}
    for i in list(members):
        if len(members[i]) >= size:
            continue
        for d in list(members[i]):
            goal = next((n for n in near[d] if home.get(n) is not None and home[n] != i), None)
            if goal is None or goal not in members.get(home[goal], []):
                continue
            home_of_goal = home[goal]
            members[home_of_goal].insert(members[home_of_goal].index(goal), d)
            home[d] = home_of_goal
        del members[i]
    return {i: c for i, c in members.items() if c}


def graph(seed, n=90):
    rnd = random.Random(seed)
    group = {i: rnd.randrange(3) for i in range(n)}
    return {i: rnd.sample([j for j in range(n) if group[j] == group[i] and j != i], rnd.randint(0, 6)) for i in range(n)}


@pytest.mark.parametrize("seed, chunk", [(1, 10**6), (2, 10**6), (3, 7)])
def test_walk_and_merge_equal_one_sequential_run(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(paths, "CHUNK", chunk)
    monkeypatch.setattr(runtime, "HOT", 3 if chunk == 7 else 10_000)
    near = graph(seed)
    edges = [(q, r + 2, n) for q, ns in near.items() for r, n in enumerate(ns)] + [(q, 1, q) for q in near] + [(q, 11, 0) for q in near]
    df = spark.createDataFrame(edges, "q bigint, rank int, n bigint")
    ids = spark.createDataFrame([(i,) for i in near], "id bigint")
    walked = naive_walk(near, 5)
    got = {}
    for r in paths.greedy_walk(df, ids, 5).orderBy("cluster_id", "pos").collect():
        got.setdefault(r["cluster_id"], []).append(r["id"])
    assert got == dict(enumerate(walked))
    merged = {}
    for r in paths.merged_clusters(df, ids, 5).orderBy("cluster_id", "pos").collect():
        merged.setdefault(r["cluster_id"], []).append(r["id"])
    assert merged == naive_merge(walked, near, 5)


def test_chain_of_thirty(spark):
    edges = spark.createDataFrame([(i, 2, i + 1) for i in range(29)], "q bigint, rank int, n bigint")
    ids = spark.range(30).select("id")
    sizes = lambda w: sorted(r["c"] for r in w.groupBy("cluster_id").agg(F.count("*").alias("c")).collect())
    assert sizes(paths.greedy_walk(edges, ids)) == [8, 22]
    assert sizes(paths.greedy_walk(edges, ids, strict=True)) == [9, 21]
    assert paths.greedy_walk(edges, ids.limit(0)).count() == 0


def test_walk_and_merge_of_one_large_component():
    """Against the plain restatement, over all edges of one component."""
    rnd = random.Random(4)
    near = {i: rnd.sample(range(3000), 6) for i in range(3000)}
    near = {i: [n for n in ns if n != i] for i, ns in near.items()}
    ids = np.arange(3000) * 7
    lists = [np.array(ns) * 7 for ns in near.values()]
    g = paths.Graph(ids, np.concatenate(lists), np.array([len(x) for x in lists]))
    order, begins = paths.walk(g, 21, True)
    walked = naive_walk(near)
    assert [c.tolist() for c in np.split(order, begins[1:])] == walked
    left, cluster = paths.merge(g, order, begins, 21)
    merged = {}
    for d, c in zip(left.tolist(), cluster.tolist()):
        merged.setdefault(c, []).append(d)
    assert merged == naive_merge(walked, near)


def test_near_dup_filter(spark):
    a = "the quick brown fox jumps over the lazy dog"
    rows = [(1, ["1", "2", "3", "4"], [a, a + "!", "something else", a + "?"]), (2, ["1", "2"], ["ab", "cd"]), (3, [], []), (4, ["1", "2", "3"], [None, a, None]), (5, None, None), (6, ["1", "2"], [a, a])]
    df = spark.createDataFrame(rows, "path_id bigint, id_path array<string>, content_path array<string>")
    got = {r["path_id"]: r["id_path"] for r in paths.filter_paths(df).collect()}
    assert got == {1: ["1", "3", "4"], 2: ["1"], 3: [], 4: ["2"], 5: None, 6: ["1"]}


def test_similarity_at_the_threshold_stays(spark):
    a, b = "abcdefgh", "abcdefghij"  # 6 and 8 trigrams, 6 shared: 0.75
    df = spark.createDataFrame([(1, ["1", "2"], [a, b])], "path_id bigint, id_path array<string>, content_path array<string>")
    assert paths.filter_paths(df).first()["id_path"] == ["1", "2"]


def test_cluster_stats(spark):
    df = spark.createDataFrame([(c, p, c * 100 + p) for c in range(1, 11) for p in range(c)], "cluster_id bigint, pos int, id bigint")
    assert paths.cluster_stats(df).first()["q25"] == 3.25
    assert paths.cluster_stats(df, exclusive=True).first()["q25"] == 2.75


# ---- contexts and training items ---------------------------------------------------------------------------------


def test_context_numbers(spark):
    df = spark.createDataFrame([([10, 10, 10, 5, None, 30],)], "t array<bigint>")
    assert df.select(context.context_numbers(F.col("t"), F.lit(20))).first()[0] == [0, 0, 1, 1, 1, 1]


def test_histogram(spark):
    rows = [("a", 2048), ("a", 2049), ("a", 10**6), ("a", None), ("b", 0), (None, 5)]
    df = spark.createDataFrame(rows, "type string, token_count bigint")
    got = {(r["type"], r["bucket"]): (r["n"], r["n_over"]) for r in context.token_histogram(df, "type").collect()}
    assert len(got) == 3 * 17 and got["a", 0] == (1, 0) and got["a", 1] == (1, 0) and got["a", 16] == (1, 1) and got["b", 0] == (1, 0) and got[None, 0] == (1, 0)


@pytest.mark.parametrize("tokens, clue, limit, n", [([10, 10, 10], 5, 18, 2), ([10, 10, 10], 30, 18, 0), ([10, 10, 10], 5, 1000, 3), ([], 5, 10, 0)])
def test_budget_cut(spark, tokens, clue, limit, n):
    df = spark.createDataFrame([(tokens,)], "t array<bigint>")
    assert df.select(datasets.budget_cut(F.col("t"), F.lit(clue), F.lit(limit))).first()[0] == n


def test_insertion(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], 4)], "d array<string>, c array<string>, k bigint")
    got = df.select(datasets.insert_all(F.col("d"), F.col("c"), F.col("k"))).first()[0]
    docs = ["a", "b"]
    for p, c in zip(got["places"], ["x", "y"]):
        docs.insert(p, c)
    assert got["docs"] == docs
    for p in range(3):
        assert df.select(datasets.inserted(F.col("d"), F.lit("x"), F.lit(p))).first()[0] == [*["a", "b"][:p], "x", *["a", "b"][p:]]


def test_position_variants(spark):
    rows = [(1, "intra_doc", ["a", "b"], ["x"]), (2, "inter_doc", ["a", "b"], ["x", "y"]), (3, "inter_doc", ["a"], ["x"]), (4, "intra_doc", [], ["x"]), (5, None, ["a"], ["x", "y"])]
    df = spark.createDataFrame(rows, "item_id bigint, type string, context array<string>, clues array<string>")
    got = datasets.position_variants(df).groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("docs").alias("d")).collect()
    assert {r["item_id"]: (r["n"], r["d"]) for r in got} == {1: (3, 3), 2: (6, 6), 4: (1, 1)}


def test_training_items(spark):
    doc = "struct<id:string,content:string>"
    rows = [(1, "inter_doc", "en", [("a", "one two"), ("b", "three")], [("x", "clue"), ("y", "more")], "Q?", "A"), (2, "intra_doc", "zh", None, [("x", None), ("y", "more")], "问？", "答"), (3, "inter_doc", "en", [], [], None, "A")]
    df = spark.createDataFrame(rows, f"item_id bigint, type string, language string, other_docs array<{doc}>, clue_docs array<{doc}>, question string, answer string")
    got = {r["item_id"]: r for r in datasets.training_items(df, True).collect()}
    assert set(got) == {1, 2} and got[1]["n_docs"] == 4 and got[2]["n_docs"] == 1
    assert "clue" in got[1]["prompt"] and "文章 1：" in got[2]["prompt"]
    for r, rate in ((got[1], 0.263), (got[2], 0.248)):
        assert r["token_count"] == -(-len((r["prompt"] + r["output"]).encode()) * int(rate * 1000) // 1000)


def test_distractors(spark):
    corpus = spark.createDataFrame([(i, f"d{i}", 10 if i % 3 else None) for i in range(60)], "doc_ord bigint, id string, n_tokens bigint")
    items = spark.createDataFrame([(1, ["d1", "d2"], 5), (2, None, 95), (3, [], 200), (4, [], 0)], "item_id bigint, ids array<string>, n_tokens bigint")
    got = datasets.distractors(items, corpus, 100, draws=4).collect()
    by = {i: [r for r in got if r["item_id"] == i] for i in (1, 2, 3, 4)}
    assert [len(by[i]) for i in (1, 2, 3, 4)] == [10, 1, 1, 10]
    assert all(len({r["doc_ord"] for r in rows}) == len(rows) and all(r["doc_ord"] % 3 for r in rows) for rows in by.values())
    assert not {r["doc_ord"] for r in by[1]} & {1, 2}
    everything = datasets.distractors(items.where("item_id = 4"), corpus, 10**6, draws=4)
    assert everything.count() <= 40
    assert datasets.distractors(items, corpus.limit(0), 100).count() == 0


def test_perturbation_subset(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None, 10 if i < 8 else 99) for i in range(12)], "item_id bigint, domain string, token_count bigint")
    assert datasets.perturbation_subset(df, "domain", 50, 3).count() == 6


# ---- questions and answers ---------------------------------------------------------------------------------------


def pairs(spark, docs, path=0):
    rows = [(path, d, s, f"question {d} {s}?", f"answer {s}") for d, n in enumerate(docs) for s in range(n)]
    return qa.number_pairs(spark.createDataFrame(rows, "path_id bigint, doc_pos int, seq bigint, question string, answer string"))


def test_neighbours(spark):
    got = {r["qa_ord"]: (r["indoc_ids"], r["crossdoc_ids"]) for r in qa.neighbours(pairs(spark, [2, 0, 2])).collect()}
    assert got[0][0] == [1] and set(got[0][1]) == {2, 3} and got[3] == ([3], [])


def test_cut_runs(spark):
    rows = [(0, 0, s, "q", a) for s, a in enumerate(["a", "", "c", "d", "e", "f", None])]
    df = qa.number_pairs(spark.createDataFrame(rows, "path_id bigint, doc_pos int, seq bigint, question string, answer string"))
    assert [r["answer"] for r in qa.cut_runs(df).orderBy("qa_ord").collect()] == ["a", "f"]


def test_multihop_skips_replies_that_it_cannot_use(spark):
    rows = pairs(spark, [4]).withColumn("answer", F.when(F.col("qa_ord") == 2, "").otherwise(F.col("answer")))
    near = qa.neighbours(rows)
    got = qa.multihop(rows.where("qa_ord = 0"), near, rows).orderBy("hop").collect()
    assert [(r["hop"], r["question"]) for r in got] == [(2, "question 0 0? / question 0 1?"), (3, "question 0 0? / question 0 1? / question 0 3?")]
    hops = datasets.recover_hops(qa.multihop(rows.where("qa_ord = 0"), near, rows), near, rows, rows.select("path_id", "doc_pos").distinct()).collect()
    assert all(r["clue_qas"] == [0, 1, 2, 3] and r["other_docs"] == [] for r in hops) and len(hops) == 2


def test_models_and_prompts(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return ["ok"] * len(prompts)

    assert lm.retried(flaky, pause=0)(["a", "b"]) == ["ok", "ok"]
    with pytest.raises(OSError):
        lm.retried(lambda p: (_ for _ in ()).throw(OSError("down")), tries=2, pause=0)(["a"])
    assert "x{y}" in lm.prompt("answer", "fr", chunk="x{y}", question="q")
    assert lm.parsed_pair('so: {"问题": "a", "回答": "b"}') == ("a", "b") and lm.parsed_pair("{bad}") is None and lm.parsed_pair(None) is None
    chunks = spark.createDataFrame([(1, "text"), (2, ""), (3, None)], "id bigint, chunk string")
    asked = qa.extract_questions(chunks, lambda: lambda ps: ['["Why? ", "no", "Why?", "How?"]'] * len(ps)).collect()
    assert [(r["id"], r["question"]) for r in asked] == [(1, "Why?"), (1, "How?")]
    assert [r["answer"] for r in qa.answer_questions(chunks.withColumn("question", F.lit("q")), lambda: lambda ps: ["z"] * len(ps)).collect()] == ["z"] * 3
    assert lm.embed(chunks, "id", "chunk").count() == 3


def test_rewrite(spark):
    df = spark.createDataFrame([(1, "x\nQuestion: q\nAnswer:", "old"), (2, "no label", "old"), (3, None, None)], "row_id bigint, prompt string, output string")
    got = {r["row_id"]: (r["output"], r["dedup_output"]) for r in qa.rewrite_answers(df, F.concat(F.lit("new "), "output")).collect()}
    assert got == {1: ("new old", "old"), 2: ("old", None), 3: (None, None)}


# ---- files and streams -------------------------------------------------------------------------------------------


def test_jsonl_and_lines(spark, tmp_path):
    for name, n in (("b", 3), ("a", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}", "content": "é汉"}, ensure_ascii=False) + "\n" for i in range(n)))
    glob = str(tmp_path / "*.jsonl")
    assert files.read_jsonl(spark, glob).count() == 5
    lines = files.read_lines(spark, glob)
    placed = files.with_ordinals(lines, files.line_counts(spark, glob)).orderBy("doc_ord").collect()
    assert [r["doc_ord"] for r in placed] == list(range(5)) and [json.loads(r["value"])["id"] for r in placed] == ["a0", "a1", "b0", "b1", "b2"]
    (tmp_path / "c.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, glob).collect()
    assert files.read_jsonl(spark, glob, strict=False).where("id is null").count() == 1
    out = str(tmp_path / "out")
    files.write_jsonl(spark.range(10).select("id"), out, 3, "id")
    assert spark.read.json(out).count() == 10
    files.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x int, t string"), str(tmp_path / "p"), "t")
    assert (tmp_path / "p" / "t=a").exists()


def test_lines_over_splits(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert all(r["value"] == f"line {r['line']}" for r in files.read_lines(spark, str(tmp_path / "x.txt")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vector_files(spark, tmp_path):
    x = np.arange(70, dtype=np.float32).reshape(10, 7)
    x.tofile(tmp_path / "a.bin")
    np.save(tmp_path / "b.npy", x)
    df = files.read_vectors(spark, [(str(tmp_path / "a.bin"), "raw"), (str(tmp_path / "b.npy"), "npy")], 7, rows_per_task=4)
    got = df.orderBy("file", "row").collect()
    assert [r["v"] for r in got] == x.tolist() * 2
    assert files.describe_vectors(df, "file").where("size = 10 and d = 7").count() == 2
    assert files.sniff_format(280, 7) == "raw" and files.sniff_format(281, 7) == "npy"
    for bad in ((str(tmp_path / "a.bin"), "zip"), (str(tmp_path / "b.npy"), "raw")):
        with pytest.raises(ValueError):
            files.read_vectors(spark, [bad], 7)


def test_incremental_run(spark, tmp_path):
    source, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = spark.createDataFrame([], "id bigint, t string").schema
    for k in range(2):
        spark.createDataFrame([(k, "a"), (k + 10, "b")], schema).write.mode("append").json(source)
        for _ in range(2):  # the second run has nothing to do
            incremental.run_incrementally(spark, source, schema, lambda b: b.where("t = 'a'"), sink, state)
        assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == list(range(k + 1))
    rows, done = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,)], "id int")
    assert [r["id"] for r in files.pending(rows, done, "id").collect()] == [1]


# ---- model steps, stored index, joins in parts -------------------------------------------------------------------
def test_model_steps(spark):
    rows = spark.createDataFrame([(1, 0, "Which guide?", "a, b"), (1, 1, "Who?", None), (1, 2, None, ",x")], "path_id bigint, qa_ord int, question string, answer string")
    assert [r["label"] for r in qa.label_questions(rows).orderBy("qa_ord").collect()] == ["1", "0", "0"]
    assert [tuple(r) for r in qa.simplify_answers(rows).select("qa_ord", "answer", "rationale").collect()] == [(0, "a", "a")]
    items = spark.createDataFrame([(1, "text\nQuestion: who?\nAnswer:", "he"), (2, "no line", "x"), (3, None, None)], "row_id bigint, prompt string, output string")
    asked = []
    got = {r["row_id"]: (r["output"], r["dedup_output"]) for r in qa.rewrite_by_model(items).collect()}
    assert got == {1: ("Reasoning: he", "he"), 2: ("x", None), 3: (None, None)} and not asked


def test_neighbours_by_embeddings(spark):
    rows = spark.createDataFrame([(1, 0, 0, "red wool", "x"), (1, 1, 1, "blue stone", "y"), (1, 1, 2, "red wool", "x"), (1, 2, 3, None, None)], "path_id bigint, doc_pos int, qa_ord int, question string, answer string")
    got = {r["qa_ord"]: r["crossdoc_ids"] for r in qa.neighbours(rows, 1, lambda: lm.hashed_vectors).collect()}
    assert got[0] == [2] and got[3] == []


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(0)
    index = ivf.Index(rng.normal(size=(3, 8)), rng.normal(size=(4, 5, 2)))
    ivf.save(index, spark, str(tmp_path / "i"))
    again = ivf.load(spark, str(tmp_path / "i"))
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.books, index.books)
    with pytest.raises(Exception, match="exist"):
        ivf.save(index, spark, str(tmp_path / "i"))


def test_salted_join_equals_a_plain_one(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k bigint, x bigint")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s")).where("k <> 5")
    want = sorted(map(tuple, rows.join(values, "k").select("k", "x", "s").collect()))
    monkeypatch.setattr(runtime, "PARTS", 8)
    for hot in (5, 50, 10_000):
        assert sorted(map(tuple, runtime.salted_join(rows, values, ["k"], ["x"], "n", hot).select("k", "x", "s").collect())) == want


def test_short_items(spark):
    items = spark.createDataFrame([(1, 10), (2, 5), (3, None)], "item_id bigint, n_tokens bigint")
    drawn = spark.createDataFrame([(1, 95), (2, 5)], "item_id bigint, n_tokens bigint")
    assert sorted(map(tuple, datasets.short_items(items, drawn, 100).collect())) == [(2, 10), (3, 0)]


def test_vectors_written_and_read(spark, tmp_path):
    rows = [(i, [float(i), 1.0]) for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    written = sorted(map(tuple, files.write_vectors(df, str(tmp_path / "w")).collect()), key=lambda r: r[2])
    back = files.read_vectors(spark, [(f, files.sniff_format(n * 8, 2)) for f, n, _ in written], 2)
    first = {f: i for f, _, i in written}
    assert sorted((first[r["file"]] + r["row"], r["v"]) for r in back.collect()) == rows[:50]
