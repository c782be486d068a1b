"""The question and answer layer: filters, neighbours of pairs, multi-hop chains and rewritten answers.

Pairs come flat: (path_id, doc_pos, qa_ord, question, answer), ``qa_ord`` numbering the pairs of a path from 0 over its
documents in order. A path is one context, bounded by the packing; operators join or collect within a path only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language_model as lm
from ..functions import text as X
from ..functions import vector as V


def number_pairs(rows: DataFrame) -> DataFrame:
    """Adds ``qa_ord`` to (path_id, doc_pos, seq, question, answer); documents without pairs simply don't occur."""
    w = Window.partitionBy("path_id").orderBy("doc_pos", "seq")
    return rows.withColumn("qa_ord", (F.row_number().over(w) - 1).cast("int"))


def extract_questions(chunks: DataFrame, make_model: Callable[[], lm.Model], lang: str = "en") -> DataFrame:
    """(chunk columns, q_pos, question): the quoted strings of a model's reply to each chunk that end with a question
    mark, without repeats. Empty and null chunks are skipped."""
    replies = lm.mapped(chunks.where("length(chunk) > 0"), make_model, lambda b: [lm.prompt("questions", lang, chunk=c) for c in b.column("chunk").to_pylist()])
    asked = F.array_distinct(F.filter(F.transform(X.quoted_strings("reply"), X.strip_space), X.is_question))
    return replies.select(*chunks.columns, F.posexplode(asked).alias("q_pos", "question"))


def answer_questions(rows: DataFrame, make_model: Callable[[], lm.Model], lang: str = "en") -> DataFrame:
    """Adds ``answer`` to (chunk, question, ...)."""
    return lm.mapped(rows, make_model, lambda b: [lm.prompt("answer", lang, chunk=c or "", question=q or "") for c, q in zip(b.column("chunk").to_pylist(), b.column("question").to_pylist())], "answer")


def label_questions(rows: DataFrame, make_model: Callable[[], lm.Model] = lambda: lm.offline_label, lang: str = "en") -> DataFrame:
    """Adds ``label``, the model's reply, to (question, ...): 1 for questions that point to something they don't name."""
    return lm.mapped(rows, make_model, lambda b: [lm.prompt("label", lang, question=q or "") for q in b.column("question").to_pylist()], "label")


def _of_pair(task: str, lang: str) -> Callable[[pa.RecordBatch], list[str]]:
    return lambda b: [lm.prompt(task, lang, q=q or "", a=a or "") for q, a in zip(b.column("question").to_pylist(), b.column("answer").to_pylist())]


def simplify_answers(rows: DataFrame, make_model: Callable[[], lm.Model] = lambda: lm.offline_simplify, lang: str = "en", run: int = 5) -> DataFrame:
    """The model's shorter answers to (path_id, qa_ord, question, answer, ...), then the cut of ``cut_runs``; ``rationale``
    keeps what the model said."""
    said = lm.mapped(rows, make_model, _of_pair("simplify", lang), "_said")
    return cut_runs(said.withColumn("answer", F.col("_said")).drop("_said"), run)


def rewrite_by_model(items: DataFrame, make_model: Callable[[], lm.Model] = lambda: lm.offline_split, lang: str = "en") -> DataFrame:
    """``rewrite_answers`` with the model's replies; it is asked only about items whose prompt has a question line."""
    asked = items.withColumn("question", X.question_line("prompt")).withColumn("answer", F.col("output"))
    said = lm.mapped(asked.where("question is not null"), make_model, _of_pair("split", lang), "_said")
    rest = asked.where("question is null").withColumn("_said", F.lit(None).cast("string"))
    return rewrite_answers(said.unionByName(rest).drop("question", "answer"), F.col("_said")).drop("_said")


def drop_labelled(rows: DataFrame, label: Column) -> DataFrame:
    """Keeps the questions whose label has no ``1`` in it (a null label is none)."""
    return rows.where(~F.coalesce(F.contains(label, F.lit("1")), F.lit(False)))


def real_questions(rows: DataFrame) -> DataFrame:
    """Keeps questions that end with a question mark."""
    return rows.where(X.is_question(X.strip_space("question")))


def cut_runs(rows: DataFrame, run: int = 5) -> DataFrame:
    """Within each run of ``run`` pairs of a path, drops the first pair with an empty answer and all that follow in the
    run. A null answer is empty. Answers lose label characters at both ends and keep the original as ``rationale``."""
    cleaned = rows.withColumn("rationale", F.col("answer")).withColumn("answer", X.strip_characters("answer"))
    empty = (F.coalesce(F.trim("answer"), F.lit("")) == "").cast("int")
    w = Window.partitionBy("path_id", F.floor(F.col("qa_ord") / run)).orderBy("qa_ord")
    return cleaned.withColumn("_cut", F.max(empty).over(w)).where("_cut = 0").drop("_cut")


def pair_similarity(a: Column, b: Column) -> Column:
    """The default similarity of two pairs' texts: the Jaccard index of their character trigrams, six places."""
    return F.round(F.coalesce(X.jaccard(a, b), F.lit(0.0)), 6)


def vector_similarity(a: Column, b: Column) -> Column:
    """Similarity of two pairs by the cosine of their embeddings, six places; 0 where one is all zeros."""
    return F.round(F.coalesce(V.cosine(a, b), F.lit(0.0)), 6)


def neighbours(rows: DataFrame, topk: int = 3, make_embedder: Callable[[], lm.Embedder] | None = None) -> DataFrame:
    """(path_id, qa_ord, indoc_ids, crossdoc_ids) per pair.

    ``indoc_ids``: the second to (topk + 1)-th pair of its own document. ``crossdoc_ids``: of the later pairs of other
    documents the topk most similar, ties to the earlier; so pairs of the last document have none. With an
    embedder, pairs are compared by the cosine of their texts' embeddings."""
    similarity = pair_similarity if make_embedder is None else vector_similarity
    if make_embedder is None:
        sets = rows.select("path_id", "qa_ord", "doc_pos", X.char_ngrams(X.qa_text("question", "answer")).alias("g"))
    else:
        texts = rows.select(F.struct("path_id", "qa_ord", "doc_pos").alias("pair"), X.qa_text("question", "answer").alias("text"))
        sets = lm.embed(texts, "pair", "text", make_embedder).select("pair.*", F.col("embedding").alias("g"))
    a, b = sets.alias("a"), sets.alias("b")
    later = a.join(b, (F.col("a.path_id") == F.col("b.path_id")) & (F.col("b.qa_ord") > F.col("a.qa_ord")) & (F.col("a.doc_pos") != F.col("b.doc_pos")))
    scored = later.select(F.col("a.path_id").alias("path_id"), F.col("a.qa_ord").alias("qa_ord"), F.col("b.qa_ord").alias("other"), similarity(F.col("a.g"), F.col("b.g")).alias("sim"))
    w = Window.partitionBy("path_id", "qa_ord").orderBy(F.desc("sim"), "other")
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= topk)
    cross = best.groupBy("path_id", "qa_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda s: s["other"]).alias("crossdoc_ids"))
    own = rows.groupBy("path_id", "doc_pos").agg(F.slice(F.array_sort(F.collect_list("qa_ord")), 2, topk).alias("indoc_ids"))
    empty = F.array().cast("array<int>")
    return rows.select("path_id", "doc_pos", "qa_ord").join(own, ["path_id", "doc_pos"]).join(cross, ["path_id", "qa_ord"], "left").select("path_id", "qa_ord", "indoc_ids", F.coalesce("crossdoc_ids", empty).alias("crossdoc_ids"))


def select_pairs(rows: DataFrame, most: int = 10, seed: int = 0) -> DataFrame:
    """At most ``most`` pairs of each path, drawn by hash."""
    from ..functions.seeded import hashed

    w = Window.partitionBy("path_id").orderBy(hashed(seed, F.col("path_id"), F.col("qa_ord")), "qa_ord")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def multihop(selected: DataFrame, near: DataFrame, rows: DataFrame, make_model: Callable[[], lm.Model] = lambda: lm.offline_merge, lang: str = "en") -> DataFrame:
    """(path_id, qa_ord, type, hop, question, answer): pairs folded along their neighbour lists.

    For each selected pair and each of its two lists (``intra_doc``, ``inter_doc``), the pair is merged with the first
    neighbour by the model, the result with the next, and so on. A reply that can't be used is skipped and the fold goes
    on from the last result; hops number the results from 2."""
    import json

    text = F.struct(F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    lists = near.join(selected.select("path_id", "qa_ord"), ["path_id", "qa_ord"]).select(
        "path_id", "qa_ord", F.explode(F.array(F.struct(F.lit("intra_doc").alias("type"), F.col("indoc_ids").alias("ids")), F.struct(F.lit("inter_doc").alias("type"), F.col("crossdoc_ids").alias("ids")))).alias("l")
    )
    steps = lists.select("path_id", "qa_ord", "l.type", F.posexplode("l.ids").alias("step", "other"))
    steps = steps.join(rows.select("path_id", F.col("qa_ord").alias("other"), text.alias("qa2")), ["path_id", "other"])
    chains = steps.groupBy("path_id", "qa_ord", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "qa2"))), lambda s: s["qa2"]).alias("chain"))
    chains = chains.join(rows.select("path_id", "qa_ord", text.alias("qa1")), ["path_id", "qa_ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lm.retried(make_model())
        for batch in batches:
            state = batch.column("qa1").to_pylist()
            chain = batch.column("chain").to_pylist()
            results: list[list[dict]] = [[] for _ in state]
            for step in range(max(map(len, chain), default=0)):  # all chains of a batch take a step in one call
                active = [i for i, c in enumerate(chain) if step < len(c)]
                replies = model([lm.prompt("merge", lang, qa1=json.dumps(state[i], ensure_ascii=False), qa2=json.dumps(chain[i][step], ensure_ascii=False)) for i in active])
                for i, reply in zip(active, replies):
                    pair = lm.parsed_pair(reply)
                    if pair:
                        state[i] = {"question": pair[0], "answer": pair[1]}
                        results[i].append(state[i])
            at = pa.array([i for i, r in enumerate(results) for _ in r], pa.int64())
            flat = [p for r in results for p in r]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("path_id", "qa_ord", "type")), pa.array([h + 2 for r in results for h in range(len(r))], pa.int32()), pa.array([p["question"] for p in flat], pa.string()), pa.array([p["answer"] for p in flat], pa.string())],
                names=["path_id", "qa_ord", "type", "hop", "question", "answer"],
            )

    return chains.mapInArrow(run, "path_id bigint, qa_ord int, type string, hop int, question string, answer string")


def rewrite_answers(items: DataFrame, rewritten: Column) -> DataFrame:
    """``output`` becomes ``rewritten``, the old one ``dedup_output``; only where the prompt has a question line."""
    asked = X.question_line("prompt").isNotNull()
    return items.withColumn("dedup_output", F.when(asked, F.col("output"))).withColumn("output", F.when(asked, rewritten).otherwise(F.col("output")))
