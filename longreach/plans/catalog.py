"""The queries of the core engine. Each takes a session and a folder of tables; ``oracle`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language_model as lm
from ..functions import text as X
from ..operators import context, datasets, evaluate, ivf, knn, paths, qa
from ..runtime import read, shared_dir
from ..sources import files
from ..streaming import incremental
from .oracle import oracle_sql  # noqa: F401

K, NPROBE, EVERY = 10, 2, 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# ---- inputs ------------------------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _corpus_vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "corpus_vectors").select(F.col("doc_ord").alias("id"), F.col("embedding").alias("v"))


def _asked(vectors: DataFrame) -> DataFrame:
    """The stated query set of searches: ids divisible by 20."""
    return vectors.where(F.col("id") % EVERY == 0)


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the documents that exist."""
    return _vectors(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("id")), "id")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Neighbour edges of all documents with a vector, searched in the inverted lists of their labels, and their ids."""
    v = _joined(spark, d)
    return knn.ivf_search(v, v, knn.label_centroids(v, "label", 64), NPROBE, K), v.select("id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Twelve rows of ``dataset`` are a path, three a document."""
    rows = read(spark, d, "dataset").select(F.floor(F.col("row_id") / 12).alias("path_id"), F.floor(F.col("row_id") % 12 / 3).cast("int").alias("doc_pos"), F.col("row_id").alias("seq"), "question", "answer")
    return qa.number_pairs(rows)


def _joined_ids(ids: str) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias(ids)


# ---- vectors and search ------------------------------------------------------------------------------------------
def _exact(spark: SparkSession, d: str, metric: str) -> DataFrame:
    v = _vectors(spark, d)
    return knn.exact_knn(_asked(v), v, K, metric).withColumn("dist", F.round("dist", 6))


@query
def knn_exact_ip(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d, "ip")


@query
def knn_exact_l2(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d, "l2")


@query
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d, "cosine")


@query
def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return knn.vector_stats(_corpus_vectors(spark, d))


@query
def vector_distinct(spark: SparkSession, d: str) -> DataFrame:
    return knn.vector_distinct(_corpus_vectors(spark, d))


@query
def vector_first_n(spark: SparkSession, d: str) -> DataFrame:
    return knn.first_n(_corpus_vectors(spark, d), 100).select("id", F.size("v").alias("d"))


@query
def vector_sample(spark: SparkSession, d: str) -> DataFrame:
    return knn.sample(_corpus_vectors(spark, d), 100, 7).select("id")


@query
def vector_catalog_check(spark: SparkSession, d: str) -> DataFrame:
    v = _corpus_vectors(spark, d).join(read(spark, d, "custom_text_corpus").select(F.col("doc_ord").alias("id"), "file_name"), "id")
    return files.describe_vectors(v, "file_name")


@query
def coarse_assign(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return knn.coarse_assign(v, knn.label_centroids(v, "label", 64), NPROBE).select("id", "probe", "list_id")


@query
def ivf_list_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    centroids = knn.label_centroids(v, "label", 64)
    return knn.list_stats(knn.coarse_assign(v, centroids, 1), centroids)


def _approximate(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, d)
    return knn.ivf_search(_asked(v), v, knn.label_centroids(v, "label", 64), NPROBE, K), v


@query
def ivf_search_nprobe(spark: SparkSession, d: str) -> DataFrame:
    return _approximate(spark, d)[0].withColumn("dist", F.round("dist", 6))


@query
def knn_recall_at_i(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    return knn.recall_at(knn.exact_knn(_asked(v), v, K), found, K)


@query
def knn_intersection_freq(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    return knn.intersection_frequencies(knn.exact_knn(_asked(v), v, K), found)


@query
def knn_refined(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    return knn.refined(found, v, v, "l2").select("q", "rank", "n", F.round("refined", 6).alias("refined"))


@query
def knn_distance_means(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    again = knn.refined(found, v, v).select("q", F.col("refined").alias("dist"))
    return knn.distance_means(exact=knn.exact_knn(_asked(v), v, K), approximate=found, refined=again)


@query
def knn_margin(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    back = knn.ivf_search(v, v, knn.label_centroids(v, "label", 64), 1, K)
    return knn.margins(found, back)


@query
def knn_consistency(spark: SparkSession, d: str) -> DataFrame:
    found, v = _approximate(spark, d)
    return knn.consistency(found, v, K)


@query
def code_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return knn.code_dedupe(_corpus_vectors(spark, d)).select("first_id", "n_vectors")


@query
def ivf_pq_search(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("id", "v")
    config = ivf.Config(lists=16, subspaces=16, centres=64)
    index = ivf.train(v, config)
    return ivf.search(_asked(v), ivf.encode(v, index, config), index, nprobe=8, k=K, vectors=v).withColumn("dist", F.round("dist", 6))


@query
def knn_nprobe_sweep(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return evaluate.nprobe_sweep(_asked(v), v, knn.label_centroids(v, "label", 64), [1, 2, 4, 8], K).where(F.col("i") == K)


@query
def vector_transform(spark: SparkSession, d: str) -> DataFrame:
    turned = evaluate.linear_transform(_corpus_vectors(spark, d), evaluate.hadamard(64, 8))
    return turned.select("id", F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))


@query
def embed_corpus(spark: SparkSession, d: str) -> DataFrame:
    return lm.embed(read(spark, d, "custom_text_corpus"), "doc_ord", "content").select("doc_ord", F.size("embedding").alias("d"))


# ---- text --------------------------------------------------------------------------------------------------------
@query
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.token_estimate("text", "lang").alias("n_tokens"))


@query
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    parts = docs.select("doc_id", F.posexplode(X.equal_chunks("text", X.token_estimate("text", "lang"), 2048)).alias("chunk_pos", "chunk"))
    return parts.select("doc_id", "chunk_pos", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query
def trigram_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "organized_text_corpus").select("path_id", F.posexplode("content_path").alias("pos", "content"), "content_path")
    pairs = docs.where("pos > 0").withColumn("before", F.get("content_path", F.col("pos") - 1))
    return pairs.select("path_id", "pos", F.round(X.ngram_similarity("content", "before", 3, 100), 6).alias("similarity"))


@query
def quoted_questions(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.transform(X.quoted_strings("text"), X.strip_space)
    return read(spark, d, "documents").select("doc_id", F.size(quoted).alias("n_quoted"), F.size(F.array_distinct(F.filter(quoted, X.is_question))).alias("n_questions")).where("n_quoted > 0")


@query
def json_objects(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").select("doc_id", X.first_json_object("text").alias("m")).where("m is not null")
    return found.select("doc_id", F.try_element_at("m", F.lit("question")).alias("question"), F.try_element_at("m", F.lit("answer")).alias("answer"))


@query
def strip_answer(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "dataset").select("row_id", X.strip_characters("answer").alias("answer"))


@query
def question_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "train").select("row_id", X.question_line("prompt").alias("question"))


@query
def file_offsets(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "custom_text_corpus").groupBy("file_name").agg(F.count(F.lit(1)).alias("n_lines"))
    return files.file_offsets(counts, "file_name")


@query
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    corpus = read(spark, d, "custom_text_corpus").select("doc_ord", F.col("file_name").alias("file"))
    first = corpus.groupBy("file").agg(F.min("doc_ord").alias("first"))
    lines = corpus.join(first, "file").select("file", (F.col("doc_ord") - F.col("first")).alias("line"))
    return datasets.line_runs(lines, 20, 3, 3).select("file", "start", "line")


# ---- paths -------------------------------------------------------------------------------------------------------
@query
def greedy_walk(spark: SparkSession, d: str) -> DataFrame:
    return paths.greedy_walk(*_graph(spark, d))


@query
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return paths.cluster_stats(paths.greedy_walk(*_graph(spark, d)))


@query
def merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    return paths.merged_clusters(*_graph(spark, d))


@query
def doc_paths(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: search, walk, collect, filter."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    found = paths.document_paths(paths.greedy_walk(*_graph(spark, d)), docs)
    return found.select("cluster_id", F.size("id_path").alias("n_docs"), F.array_join("id_path", ",").alias("ids"), F.md5(F.array_join("content_path", "\n")).alias("digest"))


@query
def near_dup_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = paths.filter_paths(read(spark, d, "organized_text_corpus"))
    return kept.select("path_id", F.size("content_path").alias("n_kept"), F.md5(F.array_join("content_path", "\n")).alias("digest"))


@query
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform("content_path", lambda t: X.token_estimate(t, F.lit("en")))
    return context.pack_paths(read(spark, d, "organized_text_corpus"), tokens)


@query
def chunk_histogram(spark: SparkSession, d: str) -> DataFrame:
    return context.token_histogram(read(spark, d, "dataset_item"), "type", 1024, 64)


# ---- questions and answers ---------------------------------------------------------------------------------------
@query
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("path_id", "doc_pos", "qa_ord", F.md5(X.qa_text("question", "answer")).alias("digest"))


@query
def qa_filter(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("question").rlike("guide|手册"), "label: 1").otherwise("label: 0")
    return qa.drop_labelled(qa.real_questions(_pairs(spark, d)), label).select("path_id", "qa_ord")


@query
def qa_simplify_cut(spark: SparkSession, d: str) -> DataFrame:
    return qa.cut_runs(_pairs(spark, d)).select("path_id", "qa_ord", "answer")


@query
def qa_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return qa.neighbours(_pairs(spark, d)).select("path_id", "qa_ord", _joined_ids("indoc_ids"), _joined_ids("crossdoc_ids"))


def _multihop(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _pairs(spark, d)
    near = qa.neighbours(rows)
    return qa.multihop(qa.select_pairs(rows), near, rows), near, rows


@query
def multihop_fold(spark: SparkSession, d: str) -> DataFrame:
    return _multihop(spark, d)[0]


@query
def hop_recover(spark: SparkSession, d: str) -> DataFrame:
    results, near, rows = _multihop(spark, d)
    found = datasets.recover_hops(results, near, rows, rows.select("path_id", "doc_pos").distinct())
    return found.select("path_id", "qa_ord", "type", "hop", _joined_ids("clue_docs"), _joined_ids("clue_qas"), _joined_ids("other_docs"))


@query
def answer_rewrite(spark: SparkSession, d: str) -> DataFrame:
    done = qa.rewrite_answers(read(spark, d, "train"), F.concat(F.lit("Reasoning: "), F.col("output")))
    return done.select("row_id", F.md5("output").alias("output"), F.md5("dedup_output").alias("dedup_output"))


# ---- training items ----------------------------------------------------------------------------------------------
@query
def hop_counts(spark: SparkSession, d: str) -> DataFrame:
    return datasets.hop_counts(read(spark, d, "dataset_item"))


@query
def distractor_sample(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "dataset_item").select("item_id", F.transform("concat_docs", lambda x: x["id"]).alias("ids"), X.token_estimate("prompt", "language").alias("n_tokens"))
    corpus = read(spark, d, "custom_text_corpus").select("doc_ord", "id", X.token_estimate("content", "lang").alias("n_tokens"))
    return datasets.distractors(items, corpus, 2000)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items with the documents of their context that aren't clues."""
    clue = F.transform("clue_docs", lambda x: x["id"])
    other = F.filter("concat_docs", lambda x: ~F.array_contains(clue, x["id"]))
    return read(spark, d, "dataset_item").select("item_id", "type", "language", other.alias("other_docs"), "clue_docs", F.col("mqa.question").alias("question"), F.col("mqa.answer").alias("answer"))


def _summary(items: DataFrame) -> DataFrame:
    return items.select("item_id", "type", "language", F.md5("prompt").alias("prompt"), F.md5("output").alias("output"), "token_count", _joined_ids("insert_position"), "n_docs")


@query
def train_multihop(spark: SparkSession, d: str) -> DataFrame:
    return _summary(datasets.training_items(_items(spark, d), True))


@query
def train_singlehop(spark: SparkSession, d: str) -> DataFrame:
    docs = F.transform("all_docs", lambda x, i: F.struct(i.cast("string").alias("id"), x["content"].alias("content")))
    rows = read(spark, d, "dataset").select(F.col("row_id").alias("item_id"), F.lit("intra_doc").alias("type"), F.when(F.col("language") == "zh", "zh").otherwise("en").alias("language"), docs.alias("_d"), "question", "answer")
    rows = rows.select("*", F.slice("_d", 1, 1).alias("clue_docs"), F.filter("_d", lambda x, i: i > 0).alias("other_docs"))
    return _summary(datasets.training_items(rows, False))


@query
def budget_insert(spark: SparkSession, d: str) -> DataFrame:
    return datasets.training_items(_items(spark, d), False, 50, 120, 11).select("item_id", "n_docs", _joined_ids("insert_position"))


@query
def position_ablation(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda c: F.transform(c, lambda x: x["id"])
    rows = _items(spark, d).select("item_id", "type", ids("other_docs").alias("context"), ids("clue_docs").alias("clues"))
    return datasets.position_variants(rows).select("item_id", "type", "ip1", "ip2", F.array_join("docs", ",").alias("docs"))


@query
def perturbation_subset(spark: SparkSession, d: str) -> DataFrame:
    return datasets.perturbation_subset(read(spark, d, "dataset_item"), "domain", 400, 5).select("item_id", "domain", "token_count")


@query
def events_windowed(spark: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(read(spark, d, "events"), "ts", "event_type")


# ---- files, batches and model steps ------------------------------------------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/longreach-{name}-{uuid.uuid4().hex}"


@query
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as numbered jsonl files and read again, line numbers included."""
    path = _folder(spark, "jsonl")
    files.write_jsonl(read(spark, d, "custom_text_corpus").select("doc_ord", "id", "content"), path, 4, "doc_ord")
    schema = files.T.StructType([files.T.StructField("doc_ord", files.T.LongType()), *files.CORPUS.fields])
    return files.read_jsonl(spark, f"{path}/*.json", schema).select("doc_ord", "id", F.md5("content").alias("digest"))


@query
def vector_files(spark: SparkSession, d: str) -> DataFrame:
    """Vectors scattered to raw matrix files, which are sniffed and read by ranges of rows, and their ids again."""
    path = _folder(spark, "raw")
    written = files.write_vectors(_vectors(spark, d).select("id", "v"), path).collect()  # a row per file
    plan = [(r["file"], files.sniff_format(r["n"] * 64 * 4, 64)) for r in written]
    rows = files.read_vectors(spark, plan, 64, rows_per_task=500)
    return rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))


@query
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "sink")
    files.write_partitioned(read(spark, d, "dataset_item").select("item_id", "language", "hop"), path, "language", "hop")
    return spark.read.parquet(path).groupBy("language", F.col("hop").cast("int").alias("hop")).agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("ids"))


@query
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Records that have no vector yet."""
    return files.pending(read(spark, d, "custom_text_corpus").select("doc_ord", "id"), read(spark, d, "corpus_vectors"), "doc_ord")


@query
def batched_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact search in batches of ids, each stored; a second call finds all of them done."""
    v, path = _vectors(spark, d), _folder(spark, "batches")
    most = v.agg(F.max("id")).first()[0] or 0
    search = lambda q: knn.exact_knn(q, v, K)
    evaluate.search_in_batches(_asked(v), path, most // 3 + 1, search, 2)
    evaluate.search_in_batches(_asked(v), path, most // 3 + 1, search)
    return spark.read.parquet(path).select("q", "rank", "n", F.round("dist", 6).alias("dist"))


@query
def gathered_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of an order's neighbours, repeats included: of each event the vector that its user's number names."""
    wanted = read(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("bigint").alias("id"))
    return knn.gather(wanted, _vectors(spark, d)).select("ord", "id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@query
def incremental_load(spark: SparkSession, d: str) -> DataFrame:
    """New files pass through once: half of the corpus, then the rest, into one sink."""
    path = _folder(spark, "stream")
    corpus = read(spark, d, "custom_text_corpus").select("id", "content", "lang")
    schema = files.T.StructType([*files.CORPUS.fields])
    for lang in ("en", "zh"):
        corpus.where(F.col("lang") == lang).select("id", "content").write.mode("append").json(f"{path}/in")
        incremental.run_incrementally(spark, f"{path}/in", schema, lambda b: b.select("id", F.length("content").alias("n_chars")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("id", "n_chars")


@query
def stored_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """An index that is trained, stored, loaded and merged from two shards finds nine of ten true neighbours."""
    v, path = _vectors(spark, d).select("id", "v"), _folder(spark, "index")
    config = ivf.Config(lists=16, subspaces=16, centres=64)
    ivf.save(ivf.train(v, config), spark, path)
    index = ivf.load(spark, path)
    shards = [ivf.encode(v.where(F.col("id") % 2 == r), index, config) for r in (0, 1)]
    found = ivf.search(_asked(v), ivf.merge_shards(*shards), index, nprobe=12, k=K, vectors=v, rerank=8)
    return knn.recall_at(knn.exact_knn(_asked(v), v, K), found, K).where(F.col("i") == K).select("i", (F.col("recall") >= 0.9).alias("enough"))


@query
def qa_labelled(spark: SparkSession, d: str) -> DataFrame:
    said = qa.label_questions(qa.real_questions(_pairs(spark, d)))
    return qa.drop_labelled(said, F.col("label")).select("path_id", "qa_ord")


@query
def qa_simplified(spark: SparkSession, d: str) -> DataFrame:
    return qa.simplify_answers(_pairs(spark, d)).select("path_id", "qa_ord", F.md5("rationale").alias("said"))


@query
def answers_by_model(spark: SparkSession, d: str) -> DataFrame:
    done = qa.rewrite_by_model(read(spark, d, "train"))
    return done.select("row_id", F.md5("output").alias("output"), F.md5("dedup_output").alias("dedup_output"))


@query
def qa_neighbours_embedded(spark: SparkSession, d: str) -> DataFrame:
    near = qa.neighbours(_pairs(spark, d), make_embedder=lambda: lm.hashed_vectors)
    return near.select("path_id", "qa_ord", _joined_ids("indoc_ids"), F.size("crossdoc_ids").alias("n_cross"))
