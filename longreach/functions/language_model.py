"""Language models and embedders as plain callables, prompts by task and language, and offline stand-ins.

A model takes a list of prompts and returns as many replies; it is made once per worker by a factory, so that clients
and weights never travel. Replies of real models differ from call to call: write a table after each such step
(``runtime.table``), else a lost executor repeats the calls.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[list[str]], list[str]]

PROMPTS = {
    ("questions", "en"): 'Read this text and write up to three questions that it answers. Reply with a list of strings in double quotes, or [] if there are none.\n\n{chunk}',
    ("questions", "zh"): '阅读下面的文字，写出它能回答的问题，至多三个。用双引号括起的字符串列表作答；没有则答 []。\n\n{chunk}',
    ("label", "en"): "Does this question point to something that it doesn't name? Reply 1 if it does, else 0.\n\n{question}",
    ("label", "zh"): "这个问题是否提到没有写明的事物？是则答 1，否则答 0。\n\n{question}",
    ("answer", "en"): "Answer the question from the text only.\n\nText:\n{chunk}\n\nQuestion: {question}",
    ("answer", "zh"): "只根据文字回答问题。\n\n文字：\n{chunk}\n\n问题：{question}",
    ("simplify", "en"): "Give the shortest form of this answer that is still right.\n\nQuestion: {q}\nAnswer: {a}",
    ("simplify", "zh"): "给出这个答案最短而仍然正确的形式。\n\n问题：{q}\n答案：{a}",
    ("merge", "en"): 'Join both pairs into one harder question with its answer. Reply with one flat JSON object on one line, with the keys "question" and "answer".\n\n{qa1}\n{qa2}',
    ("merge", "zh"): '把两组问答合成一个更难的问题及其答案。用一行 JSON 对象作答，键为 "问题" 和 "回答"。\n\n{qa1}\n{qa2}',
    ("split", "en"): "Rewrite the answer: first the reasoning, then the conclusion.\n\nQuestion: {q}\nAnswer: {a}",
    ("split", "zh"): "改写答案：先写推理，后写结论。\n\n问题：{q}\n答案：{a}",
}


def prompt(task: str, lang: str, **values: str) -> str:
    """The prompt of a task; languages without one of their own use English."""
    text = PROMPTS[task, lang if (task, lang) in PROMPTS else "en"]
    return re.sub(r"\{(\w+)\}", lambda m: values[m.group(1)], text)


def retried(model: Model, tries: int = 5, pause: float = 5.0) -> Model:
    """Tries again after an error; the last error is raised."""

    def call(prompts: list[str]) -> list[str]:
        for left in range(tries - 1, -1, -1):
            try:
                return model(prompts)
            except Exception:
                if not left:
                    raise
                time.sleep(pause)
        return []

    return call


def parsed_pair(reply: str | None) -> tuple[str, str] | None:
    """Question and answer of the first {...} of a reply, by their English or Chinese keys; None if it can't be used."""
    found = re.search(r"\{.*?\}", reply or "")
    try:
        record = json.loads(found.group()) if found else None
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    question, answer = record.get("question", record.get("问题")), record.get("answer", record.get("回答"))
    return (str(question), str(answer)) if question is not None and answer is not None else None


def offline_merge(prompts: list[str]) -> list[str]:
    """Stands in for a model that merges pairs: both questions in a row with the second answer; no usable reply where the
    second answer is empty."""
    out = []
    for p in prompts:
        first, second = (json.loads(line) for line in p.split("\n")[-2:])
        out.append(json.dumps({"question": first["question"] + " / " + second["question"], "answer": second["answer"]}, ensure_ascii=False) if second["answer"] else "cannot")
    return out


def offline_label(prompts: list[str]) -> list[str]:
    """Stands in for a model that labels questions: 1 where the question, the prompt's last line, names a guide."""
    return ["1" if re.search("guide|手册", p.rpartition("\n")[2]) else "0" for p in prompts]


def offline_simplify(prompts: list[str]) -> list[str]:
    """Stands in for a model that shortens answers: what stands before the first comma of the prompt's answer."""
    return [re.split("[,，]", re.split("\n(?:Answer: |答案：)", p, maxsplit=1)[-1])[0] for p in prompts]


def offline_split(prompts: list[str]) -> list[str]:
    """Stands in for a model that rewrites answers: the answer of the prompt behind the word Reasoning."""
    return ["Reasoning: " + re.split("\n(?:Answer: |答案：)", p, maxsplit=1)[-1] for p in prompts]


def mapped(df: DataFrame, make_model: Callable[[], Model], make_prompts: Callable[[pa.RecordBatch], list[str]], column: str = "reply") -> DataFrame:
    """``df`` with the model's reply to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = retried(make_model())
        for batch in batches:
            replies = model(make_prompts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{column}` string")


def hashed_vectors(texts: list[str | None], d: int = 64, n: int = 3) -> np.ndarray:
    """Character n-grams hashed into d signed sums, scaled to length 1; null and shorter texts are all zeros."""
    out = np.zeros((len(texts), d), np.float32)
    for i, t in enumerate(texts):
        for j in range(len(t or "") - n + 1):
            h = zlib.crc32(t[j : j + n].encode())
            out[i, h % d] += 1.0 if h >> 16 & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


Embedder = Callable[[list[str | None]], np.ndarray]


def embed(df: DataFrame, key: str, text: str, make_embedder: Callable[[], Embedder] = lambda: hashed_vectors) -> DataFrame:
    """(key, embedding) of each row, keyed, so that order and partitions don't matter. The embedder is made once per
    worker, so that weights never travel; rows that are done already can be left out by ``files.pending``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make_embedder()
        for batch in batches:
            x = np.asarray(embedder(batch.column(text).to_pylist()), np.float32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], names=[key, "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
