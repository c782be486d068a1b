"""Hop samples, distractors and training items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeded
from ..functions import text as X
from ..runtime import table


def recover_hops(results: DataFrame, near: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(path_id, qa_ord, type, hop, question, answer, clue_docs, clue_qas, other_docs): one hop sample per result.

    ``results`` (path_id, qa_ord, type, hop, question, answer); ``near`` as of ``qa.neighbours``; ``pairs`` (path_id,
    doc_pos, qa_ord, ...); ``docs`` (path_id, doc_pos). Clue documents and pairs are those of the selected pair and of
    its whole list, repeats kept; other documents are those of the path that have pairs and aren't clues."""
    lists = near.select("path_id", "qa_ord", F.explode(F.array(F.struct(F.lit("intra_doc").alias("type"), F.col("indoc_ids").alias("ids")), F.struct(F.lit("inter_doc").alias("type"), F.col("crossdoc_ids").alias("ids")))).alias("l"))
    chain = lists.select("path_id", "qa_ord", "l.type", F.posexplode(F.concat(F.array("qa_ord"), F.col("l.ids"))).alias("step", "other"))
    placed = chain.join(pairs.select("path_id", F.col("qa_ord").alias("other"), "doc_pos"), ["path_id", "other"])
    clues = placed.groupBy("path_id", "qa_ord", "type").agg(F.array_sort(F.collect_list(F.struct("step", "other", "doc_pos"))).alias("s"))
    clues = clues.select("path_id", "qa_ord", "type", F.transform("s", lambda x: x["doc_pos"]).alias("clue_docs"), F.transform("s", lambda x: x["other"]).alias("clue_qas"))
    kept = pairs.select("path_id", "doc_pos").distinct().join(docs.select("path_id", "doc_pos"), ["path_id", "doc_pos"]).groupBy("path_id").agg(F.array_sort(F.collect_list("doc_pos")).alias("all_docs"))
    return results.join(clues, ["path_id", "qa_ord", "type"]).join(kept, "path_id").withColumn("other_docs", F.array_except("all_docs", "clue_docs")).drop("all_docs")


def hop_counts(items: DataFrame) -> DataFrame:
    """(type, hop, n); null types and hops are groups of their own."""
    return items.groupBy("type", "hop").agg(F.count(F.lit(1)).alias("n"))


def distractors(items: DataFrame, corpus: DataFrame, target: int, draws: int = 16, seed: int = 0, most_rounds: int = 12) -> DataFrame:
    """(item_id, place, doc_ord, n_tokens): random documents for each item until the tokens of its context and theirs
    reach ``target``; the last one is kept, and at least one is drawn.

    ``items`` (item_id, ids, n_tokens): the ids already in its context, and its tokens. ``corpus`` (doc_ord, id,
    n_tokens) with dense ``doc_ord``. Each draw is a hash of item and draw number modulo the corpus, so finding it is an
    equi-join; nothing is ranked over the whole corpus. Items that ``draws`` don't fill draw twice as many in the next
    round; after ``most_rounds``, or with more draws than four times the corpus, what was drawn is the result, and
    ``short_items`` tells which items stayed below the target. Documents that are null, empty, drawn before or in the
    context are passed over."""
    n = corpus.agg(F.max("doc_ord")).first()[0]
    schema = "item_id bigint, place int, doc_ord bigint, n_tokens bigint"
    spark = items.sparkSession
    if n is None:
        return spark.createDataFrame([], schema)
    done, open_items = spark.createDataFrame([], schema), items.select("item_id", "ids", F.coalesce("n_tokens", F.lit(0)).alias("own"))
    for r in range(most_rounds):
        many = draws << r
        drawn = open_items.select("item_id", "ids", "own", F.explode(F.sequence(F.lit(1), F.lit(many))).alias("draw")).withColumn("doc_ord", seeded.hashed(seed, F.col("item_id"), F.col("draw")) % (n + 1))
        firsts = drawn.groupBy("item_id", "doc_ord").agg(F.min("draw").alias("draw"), F.first("ids").alias("ids"), F.first("own").alias("own"))
        docs = corpus.where("n_tokens > 0").select("doc_ord", "id", "n_tokens")
        fit = firsts.join(docs, "doc_ord").where(~F.array_contains(F.coalesce("ids", F.array().cast("array<string>")), F.col("id")))
        w = Window.partitionBy("item_id").orderBy("draw")
        summed = fit.withColumn("place", F.row_number().over(w)).withColumn("_sum", F.col("own") + F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        taken = summed.where((F.col("_sum") - F.col("n_tokens") < target) | (F.col("place") == 1))
        full = taken.groupBy("item_id").agg(F.max("_sum").alias("_sum")).where(F.col("_sum") >= target).select("item_id")
        last = r + 1 == most_rounds or many > 4 * (n + 1)
        chosen = taken if last else taken.join(full, "item_id", "left_semi")
        written = table(chosen.select("item_id", "place", "doc_ord", "n_tokens"), "distractors")
        done = done.unionByName(written)
        open_items = open_items.join(written.select("item_id").distinct(), "item_id", "left_anti")
        if last or not open_items.limit(1).count():
            break
        open_items = table(open_items, "open")
    return done


def short_items(items: DataFrame, drawn: DataFrame, target: int) -> DataFrame:
    """(item_id, n_tokens): the items whose context and distractors together stay below ``target``."""
    got = drawn.groupBy("item_id").agg(F.sum("n_tokens").alias("_got"))
    total = items.join(got, "item_id", "left").select("item_id", (F.coalesce("n_tokens", F.lit(0)) + F.coalesce("_got", F.lit(0))).alias("n_tokens"))
    return total.where(F.col("n_tokens") < target)


def budget_cut(tokens: Column, clue: Column, limit: Column) -> Column:
    """How many leading documents stay: with s(i) the sum of the first i counts, the smallest i with s(i) + clue above the
    limit; all of them if there is none. The document that crosses the limit stays, and none if the clue alone
    crosses it."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(tokens, start, lambda acc, t: F.when(acc["sum"] + clue > limit, acc).otherwise(F.struct((acc["sum"] + F.coalesce(t, F.lit(0))).cast("bigint").alias("sum"), (acc["n"] + 1).alias("n"))), lambda acc: acc["n"])


def inserted(docs: Column, doc: Column, place: Column) -> Column:
    """``docs`` with ``doc`` after the first ``place`` elements."""
    n = F.size(docs)
    return F.concat(F.when(place > 0, F.slice(docs, F.lit(1), place)).otherwise(F.slice(docs, 1, 0)), F.array(doc), F.when(place < n, F.slice(docs, place + 1, n - place)).otherwise(F.slice(docs, 1, 0)))


def insert_all(docs: Column, clues: Column, key: Column, seed: int = 0) -> Column:
    """Struct of ``docs`` with the clues inserted one by one at random places of the growing array, and ``places``, each
    as it was when its clue went in."""
    start = F.struct(docs.alias("docs"), F.array().cast("array<int>").alias("places"))

    def step(acc: Column, clue: Column) -> Column:
        place = seeded.between(seed, F.lit(0), F.size(acc["docs"]), key, F.size(acc["places"])).cast("int")
        return F.struct(inserted(acc["docs"], clue, place).alias("docs"), F.concat(acc["places"], F.array(place)).alias("places"))

    return F.aggregate(clues, start, step)


def _instruction(docs: Column, lang: Column, question: Column, reasoning: bool) -> Column:
    zh = lang == "zh"
    head = F.when(zh, F.lit("请阅读以下文章，再回答后面的问题。\n\n" if not reasoning else "请阅读以下文章，先推理，再回答后面的问题。\n\n")).otherwise(F.lit("Read these passages, then answer the question below.\n\n" if not reasoning else "Read these passages, then reason step by step and answer the question below.\n\n"))
    ask = F.when(zh, F.concat(F.lit("\n\n问题："), question, F.lit("\n答案："))).otherwise(F.concat(F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:")))
    return F.concat(head, X.numbered_passages(docs, lang), ask)


def training_items(items: DataFrame, reasoning: bool, low: int = 200, high: int = 600, seed: int = 0) -> DataFrame:
    """(item_id, type, language, prompt, output, token_count, insert_position, n_docs) of the items with a question and
    an answer.

    ``items`` (item_id, type, language, other_docs, clue_docs, question, answer): documents are (id, content). The
    budget is drawn from [low, high] per item, but no less than its other documents have. They are cut by it
    (``budget_cut``), then the clues are inserted; ``intra_doc`` items only have their first clue. Null arrays are
    empty, null contents too."""
    docs = lambda c: F.coalesce(F.col(c), F.expr("cast(array() as array<struct<id:string,content:string>>)"))
    tokens = lambda d: X.token_estimate(F.coalesce(d["content"], F.lit("")), F.col("language"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, t: s + t)
    rows = items.where("question is not null and answer is not null").withColumn("_other", docs("other_docs")).withColumn("_clue", F.when(F.col("type") == "intra_doc", F.slice(docs("clue_docs"), 1, 1)).otherwise(docs("clue_docs")))
    rows = rows.withColumn("_ot", F.transform("_other", tokens)).withColumn("_ct", total(F.transform("_clue", tokens)))
    limit = F.greatest(seeded.between(seed, F.lit(low), F.lit(high), F.col("item_id")), total(F.col("_ot")))
    rows = rows.withColumn("_n", budget_cut(F.col("_ot"), F.col("_ct"), limit))
    rows = rows.withColumn("_in", insert_all(F.slice("_other", F.lit(1), F.col("_n")), F.col("_clue"), F.col("item_id"), seed + 1))
    prompt = _instruction(F.col("_in.docs"), F.col("language"), F.col("question"), reasoning)
    rows = rows.withColumn("prompt", prompt).withColumn("output", F.col("answer"))
    return rows.select("item_id", "type", "language", "prompt", "output", X.token_estimate(F.concat("prompt", "output"), "language").alias("token_count"), F.col("_in.places").alias("insert_position"), F.size("_in.docs").alias("n_docs"))


def position_variants(items: DataFrame) -> DataFrame:
    """(item_id, type, ip1, ip2, docs): every item with its clues after every number of its context documents.

    ``items`` (item_id, type, context, clues), arrays of strings. ``intra_doc``: the first clue at ip1 = 0..c (ip2 is
    null), c + 1 variants. Otherwise the first two clues at all ip1 <= ip2, (c + 1)(c + 2) / 2 variants; items with too
    few clues have none."""
    places = F.sequence(F.lit(0), F.size("context"))
    one = items.where((F.col("type") == "intra_doc") & (F.size("clues") >= 1)).select("*", F.explode(places).alias("ip1"))
    one = one.select("item_id", "type", "ip1", F.lit(None).cast("int").alias("ip2"), inserted(F.col("context"), F.get("clues", F.lit(0)), F.col("ip1")).alias("docs"))
    two = items.where((F.col("type") != "intra_doc") & (F.size("clues") >= 2)).select("*", F.explode(places).alias("ip1"))
    two = two.select("*", F.explode(F.sequence(F.col("ip1"), F.size("context"))).alias("ip2"))
    both = inserted(inserted(F.col("context"), F.get("clues", F.lit(1)), F.col("ip2")), F.get("clues", F.lit(0)), F.col("ip1"))
    return one.unionByName(two.select("item_id", "type", "ip1", "ip2", both.alias("docs")))


def perturbation_subset(items: DataFrame, by: str, bound: int, n: int) -> DataFrame:
    """The first ``n`` items per value of ``by`` (smallest ids) with at most ``bound`` tokens; null is a value too."""
    w = Window.partitionBy(by).orderBy("item_id")
    return items.where(F.col("token_count") <= bound).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def line_runs(lines: DataFrame, n_runs: int, length: int, seed: int = 0) -> DataFrame:
    """(run, file, line, ...): ``n_runs`` random starts, each with ``length`` consecutive lines of its file (fewer at the
    file's end). ``lines`` has (file, line, ...), lines numbered from 0."""
    starts = lines.select("file", "line").withColumn("_h", seeded.hashed(seed, F.col("file"), F.col("line"))).orderBy("_h", "file", "line").limit(n_runs)
    starts = starts.select("file", F.col("line").alias("start"), F.explode(F.sequence(F.col("line"), F.col("line") + length - 1)).alias("line"))
    return starts.join(lines, ["file", "line"])
