"""Queries of the training-text operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn
from ..runtime import read
from . import leakage, near_dup, packing, pair_defects, spam, splitter, token_budget, vector_knn
from .text import limit_row, rate_tokens, with_rate

RUNS = {"en": 60, "zh": 20}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items = token_budget.wrong_counts(read(spark, d, "dataset_item"), read(spark, d, "token_rate"))
    rows = token_budget.wrong_languages(read(spark, d, "dataset"))
    return items.select(F.lit("dataset_item").alias("tbl"), F.col("item_id").alias("row_id")).unionByName(rows.select(F.lit("dataset").alias("tbl"), "row_id"))


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(read(spark, d, "dataset"), read(spark, d, "dataset_item"), read(spark, d, "token_rate"))


def p1_tokenizer_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(read(spark, d, "dataset"), read(spark, d, "dataset_item"), read(spark, d, "token_rate"), "byte_bpe_50k")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.corpus_and_paths(read(spark, d, "custom_text_corpus"), read(spark, d, "organized_text_corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.similar_pairs(_records(spark, d), 0.7, 5)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.groups(_records(spark, d), 0.7, 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.defects(pair_defects.pairs(read(spark, d, "train"), read(spark, d, "dataset")))


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.templates(pair_defects.pairs(read(spark, d, "train"), read(spark, d, "dataset")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "corpus_vectors").select(F.col("doc_ord").alias("id"), "embedding")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = vector_knn.mutual_pairs(_vectors(spark, d), k=10, floor=0.87)
    return found.select(F.col("a").alias("doc_ord_a"), F.col("b").alias("doc_ord_b"))


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    found = vector_knn.knn(_vectors(spark, d), k=10, queries="id % 20 = 0")
    return found.select(F.col("q").alias("doc_ord"), F.col("n").alias("neighbour"), F.round("score", 6).alias("cosine"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether ``p4_knn`` finds nine of ten of the true neighbours, by score: equal ones may stand for each other."""
    units = _vectors(spark, d).where(F.exists("embedding", lambda x: x != 0)).select("id", F.col("embedding").alias("v"))
    exact = knn.exact_knn(units.where("id % 20 = 0"), units, 11, "cosine").where("q <> n")
    least = exact.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.round("dist", 5)), False), 1, 10).alias("s")).select("q", F.array_min("s").alias("least"), F.size("s").alias("n"))
    found = p4_knn(spark, d).join(least, F.col("doc_ord") == F.col("q")).where(F.round("cosine", 5) >= F.col("least")).groupBy("q").agg(F.count(F.lit(1)).alias("f"))
    both = least.join(found, "q", "left").agg(F.sum(F.least("n", F.coalesce("f", F.lit(0)))).alias("f"), F.sum("n").alias("n"))
    return both.select((F.col("f") >= 0.9 * F.col("n")).alias("enough"))


def _split_records(spark: SparkSession, d: str) -> DataFrame:
    corpus = read(spark, d, "custom_text_corpus").select("doc_ord", "content", "lang")
    return with_rate(corpus, F.col("lang"), read(spark, d, "token_rate")).select(F.col("doc_ord").alias("rec"), F.col("content").alias("text"), F.col("_rate").alias("rate"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limit_row(read(spark, d, "size_limit"), "split")
    records = _split_records(spark, d)
    found = splitter.pieces(records, limit, overlap).join(records.select("rec", "rate"), "rec")
    return found.select(F.col("rec").alias("doc_ord"), "piece", F.col("start").alias("start_char"), F.col("end").alias("end_char"), rate_tokens(F.col("n_bytes"), F.col("rate")).alias("n_tokens"), "forced")


def p5_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Pieces that break a rule: none."""
    limit, overlap = limit_row(read(spark, d, "size_limit"), "split")
    records = _split_records(spark, d)
    return splitter.breaches(splitter.pieces(records, limit, overlap), records, limit, overlap).withColumnRenamed("rec", "doc_ord")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limit_row(read(spark, d, "size_limit"), "split")
    found = splitter.pieces(_split_records(spark, d), limit, overlap)
    return found.where("piece = 0").select(F.col("rec").alias("doc_ord"), F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = limit_row(read(spark, d, "size_limit"), "pack")
    return packing.pack(read(spark, d, "documents"), read(spark, d, "token_rate"), capacity)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(p6_containers(spark, d))


def p6_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Containers and documents that break a rule: none."""
    capacity, _ = limit_row(read(spark, d, "size_limit"), "pack")
    return packing.breaches(p6_containers(spark, d), read(spark, d, "documents"), read(spark, d, "token_rate"), capacity)


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = limit_row(read(spark, d, "size_limit"), "pack")
    return packing.usage(p6_containers(spark, d), capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark_item"), RUNS, edits=0.02, recall=0.8, exact=True)


def p7_edited(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "benchmark_item"), RUNS, edits=0.05, recall=0.95)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.flagged(read(spark, d, "documents"))


def p8_shapes(spark: SparkSession, d: str) -> DataFrame:
    return spam.shape_counts(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_budget, p1_tokenizer_budget, p2_found, p2_groups, p3_found, p3_templates, p4_found, p4_knn, p4_recall, p5_found, p5_pieces, p5_breaches, p6_found, p6_containers, p6_breaches, p6_usage, p7_found, p7_edited, p8_found, p8_shapes)
    return {f.__name__: f for f in found}


_NAMED = "CASE WHEN regexp_matches(lower(trim(language)), '^(en|eng|english)([-_ ].*)?$') THEN 'en' WHEN regexp_matches(lower(trim(language)), '^(zh|zho|chi|chinese|中文)([-_ ].*)?$') THEN 'zh' WHEN regexp_matches(lower(trim(language)), '^(de|deu|ger|german)([-_ ].*)?$') THEN 'de' END"
_RATED = "(SELECT x.*, coalesce(r.tokens_per_byte, (SELECT tokens_per_byte FROM token_rate WHERE lang = 'und')) AS rate FROM {0} x LEFT JOIN token_rate r ON r.lang = lower(substr(trim(coalesce(x.{1}, 'und')), 1, 2)))"


def _tokens(text: str) -> str:
    return f"CAST(ceil(round(octet_length(encode({text})) * rate, 9)) AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    asked = "CASE WHEN regexp_matches({0}, '[㐀-鿿]') THEN 'zh' WHEN regexp_matches({0}, '[A-Za-z]') THEN 'en' END"
    reduced = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    windows = "SELECT item_id, lang, {0} AS t FROM benchmark_item WHERE {0} IS NOT NULL"
    normal = "regexp_replace(lower({0}), '[ \\t\\r\\n]+', ' ', 'g')"
    similar = f"""
            t AS (SELECT 'custom_text_corpus' AS tbl, doc_ord AS rec, {normal.format("content")} AS s FROM custom_text_corpus
              UNION ALL SELECT 'organized_text_corpus', path_id, {normal.format("array_to_string(list_filter(content_path, lambda x: x IS NOT NULL), chr(10))")} FROM organized_text_corpus),
            c AS MATERIALIZED (SELECT tbl, s, min(rec) AS rep, count(*) AS n_copies FROM t WHERE length(s) >= 5 GROUP BY ALL),
            g AS MATERIALIZED (SELECT DISTINCT tbl, rep, hash(substr(s, k, 5)) AS h FROM (SELECT *, unnest(range(1, length(s) - 3)) AS k FROM c)),
            z AS MATERIALIZED (SELECT tbl, rep, count(*) AS n FROM g GROUP BY ALL),
            l AS MATERIALIZED (SELECT a.tbl, a.rep AS ra, b.rep AS rb, count(*) AS m FROM g a JOIN g b ON a.tbl = b.tbl AND a.h = b.h AND a.rep < b.rep GROUP BY ALL),
            e AS MATERIALIZED (SELECT l.tbl, ra, rb FROM l JOIN z x ON x.tbl = l.tbl AND x.rep = ra JOIN z y ON y.tbl = l.tbl AND y.rep = rb WHERE m >= 0.7 * (x.n + y.n - m)),
            m AS MATERIALIZED (SELECT tbl, rec, rep, n_copies FROM t JOIN c USING (tbl, s))"""
    return {
        "p2_found": f"""
            WITH {similar}
            SELECT tbl, least(x.rec, y.rec) AS rec_a, greatest(x.rec, y.rec) AS rec_b FROM e JOIN m x USING (tbl) JOIN m y USING (tbl) WHERE x.rep = ra AND y.rep = rb
            UNION ALL SELECT tbl, x.rec, y.rec FROM m x JOIN m y USING (tbl, rep) WHERE x.rec < y.rec""",
        "p2_groups": f"""
            WITH RECURSIVE {similar},
            b AS (SELECT tbl, ra AS u, rb AS v FROM e UNION ALL SELECT tbl, rb, ra FROM e),
            r AS (SELECT tbl, rep AS u, rep AS root FROM c UNION SELECT b.tbl, b.v, r.root FROM r JOIN b ON b.tbl = r.tbl AND b.u = r.u),
            o AS (SELECT tbl, u AS rep, min(root) AS group_id FROM r GROUP BY ALL),
            d AS (SELECT tbl, u AS rep, count(*) AS n_links FROM b GROUP BY ALL)
            SELECT tbl, rec, rep AS class_id, group_id, n_copies, coalesce(n_links, 0) AS n_links FROM m JOIN o USING (tbl, rep) LEFT JOIN d USING (tbl, rep)""",
        "p4_recall": "SELECT true AS enough",
        "p5_breaches": "SELECT 'over' AS rule, CAST(1 AS BIGINT) AS doc_ord WHERE false",
        "p6_breaches": "SELECT 'over' AS rule, CAST(1 AS BIGINT) AS id WHERE false",
        "p1_found": f"""
            SELECT 'dataset_item' AS tbl, item_id AS row_id FROM {_RATED.format("dataset_item", "language")}
            WHERE token_count IS DISTINCT FROM {_tokens("coalesce(prompt, '') || coalesce(output, '')")}
            UNION ALL SELECT 'dataset', row_id FROM dataset
            WHERE language IS NULL OR trim(language) = '' OR ({_NAMED}) IS DISTINCT FROM ({asked.format("question")})""",
        "p1_budget": f"""
            WITH t AS (
              SELECT 'dataset' AS tbl, type, coalesce({asked.format("question")}, {_NAMED}, 'und') AS language, CAST(NULL AS VARCHAR) AS domain,
                array_to_string(list_filter([array_to_string(list_transform(coalesce(all_docs, []), lambda d: coalesce(d.content, '')), chr(10)), question, answer], lambda s: s IS NOT NULL), chr(10)) AS text
              FROM dataset UNION ALL
              SELECT 'dataset_item', type, coalesce({asked.format("mqa.question")}, {_NAMED}, 'und'), domain, coalesce(prompt, '') || coalesce(output, '') FROM dataset_item)
            SELECT tbl, type, language, domain, count(*) AS n_rows, CAST(sum({_tokens("text")}) AS BIGINT) AS n_tokens
            FROM {_RATED.format("t", "language")} GROUP BY ALL""",
        "p4_found": """
            WITH v AS MATERIALIZED (SELECT doc_ord, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM corpus_vectors WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
            s AS (SELECT a.doc_ord AS a, b.doc_ord AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a, v b WHERE a.doc_ord <> b.doc_ord),
            r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS k FROM s WHERE c >= 0.87)
            SELECT DISTINCT least(a, b) AS doc_ord_a, greatest(a, b) AS doc_ord_b FROM r WHERE k <= 10""",
        "p5_found": f"""
            WITH t AS (SELECT doc_ord, rate, content, (SELECT max_tokens FROM size_limit WHERE purpose = 'split') AS most FROM {_RATED.format("custom_text_corpus", "lang")} WHERE content IS NOT NULL)
            SELECT doc_ord, CASE WHEN list_max(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?])(\\s)', '\\1' || chr(30) || '\\2', 'g'), '(\\r\\n|[\\n\\r]|[。！？])', '\\1' || chr(30), 'g'), chr(30)),
              lambda s: CAST(ceil(round(octet_length(encode(s)) * rate, 9)) AS BIGINT))) > most THEN 'forced' ELSE 'natural' END AS cut
            FROM t WHERE {_tokens("content")} > most""",
        "p6_found": f"""
            SELECT doc_id FROM {_RATED.format("documents", "lang")}
            WHERE {_tokens("text")} > (SELECT max_tokens FROM size_limit WHERE purpose = 'pack')""",
        "p7_found": f"""
            WITH i AS ({windows.format("passage")} UNION ALL {windows.format("question")}),
            r AS (SELECT item_id, CASE lang WHEN 'en' THEN 60 ELSE 20 END AS n, {reduced.format("t")} AS t FROM i WHERE lang IN ('en', 'zh')),
            w AS (SELECT DISTINCT item_id, n, substr(t, k, n) AS w FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS k FROM r)),
            d AS (SELECT doc_id, {reduced.format("text")} AS t FROM documents WHERE text IS NOT NULL),
            x AS (SELECT DISTINCT doc_id, n, substr(t, k, n) AS w FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS k FROM d, (VALUES (60), (20)) s(n)))
            SELECT DISTINCT doc_id, item_id FROM x JOIN w USING (n, w)""",
    }
