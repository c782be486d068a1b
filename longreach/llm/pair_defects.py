"""Defective prompt and response pairs: empty, copy, refusal, wrong_language, truncated.

Refusals are found by how openings recur; there is no list of wordings. An answer is cut into clauses. Answers of which
some clause is tied to its prompt (numbers, names of the question or passages, words that stand in them as they are) can't
be refusals. The openings of the clauses of all others are records: equal ones are counted before the shuffle, similar ones
linked by MinHash with exact verification (near_dup). An opening is a template if it and its links recur over
unrelated prompts, which have no word in common that other prompts lack: a bare answer recurs over prompts that ask the
same, a refusal over any. Openings linked to a template are templates too. An answer is a refusal if all of its clauses
open like templates. The other defects are read off the pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import salted_join, table
from .near_dup import link_representatives
from .text import map_arrow

DEFECTS = ("empty", "copy", "refusal", "wrong_language", "truncated")
# Stand-ins for a missing value.
STAND_INS = frozenset("null none nil nan na n/a n.a. tbd tba todo undefined unknown missing empty blank placeholder 无 空 暂无 没有 待补充 待定 未填写 略 待填写 不详".split())
_LABEL = re.compile(r"^\W*(?:you asked|the question is|question|final answer|the answer|answer|response|output|reply|q|a|您问的是|你问的是|您的问题是|问题是|问题|问|答案是|答案|回答|结论|最终答案|答复|答)\s*[:：]\s*", re.I)
_STOP = re.compile(r"[.!?](?=[\s\"'”’)\]]|$)|[。！？；;]|\n")
_HAN = re.compile(r"[㐀-鿿]")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:['’][a-z]+)?")
_BARE = re.compile(r"[\W_]+")
_CLAUSE = re.compile(r"[,，;；:：]")
_INNER = re.compile(r"(?<=\S )(?!I\b)[A-ZÀ-Þ][\w'’-]+")
_DIGIT = re.compile(r"\d")
_SPACED = re.compile(r"[\W_]+")
OPENING_WORDS, OPENING_HAN = 6, 12  # words, or Chinese characters, of the opening of a clause
# Chinese characters that mark grammar.
FUNCTION_CHARACTERS = frozenset("的了在是和与由于为被把及从到至而但并也都就所之其这那该已曾将以或有不没向对让使于每后前中上下时谁哪何么吗呢吧我你您他她它们此")
# Words that tell the languages of responses apart; names hold none of them.
_MARKS = {
    "en": frozenset("the of and was were is that which from by had has have with as at on after before not did does it its to in for what who how why where when both only an a so".split()),
    "de": frozenset("der die das des dem den ein eine einer und war ist wurde von vom mit nach aus bei auf für über zwischen als nicht sich man im zum zur daher deshalb hatte nannten".split()),
    "fr": frozenset("le la les un une et est fut du des au aux par pour dans sur avec après avant entre qui que on y se à il elle d' donc en de".split()),
    "es": frozenset("el la los las un una fue era del al por para con sobre tras entre quien que y se había en de lo tanto".split()),
}


def stretches(text: str) -> Iterator[str]:
    start = 0
    for m in _STOP.finditer(text):
        if s := text[start : m.end()].strip():
            yield s
        start = m.end()
    if s := text[start:].strip():
        yield s


def unlabelled(text: str) -> str:
    before = None
    while before != text:
        before, text = text, _LABEL.sub("", text, count=1)
    return text


def letters(text: str) -> str:
    return _BARE.sub("", text.lower())


def is_empty(answer: str | None) -> bool:
    """Null, or nothing but blanks, punctuation, labels or a stand-in for a missing value."""
    if answer is None:
        return True
    rest = unlabelled(answer.strip() + " ").strip()
    return not letters(rest) or rest.strip(" .。!！\"'()[]<>{}").lower() in STAND_INS


def _grams(text: str) -> set[str]:
    n = 2 if _HAN.search(text) else 4
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def same_words(a: str, b: str, least: float = 0.6) -> bool:
    """Whether two texts, as letters and digits, are equal or nearly so."""
    if len(a) > 4 * len(b) + 200 or len(b) > 4 * len(a) + 200:  # too unlike in length to spend time on
        return False
    a, b = letters(a), letters(b)
    if not a or not b or min(len(a), len(b)) < 0.5 * max(len(a), len(b)):
        return False
    x, y = _grams(a), _grams(b)
    return a == b or len(x & y) >= least * len(x | y)


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer is only the question again, once or more."""
    question = unlabelled(question)
    rest = unlabelled(answer.strip().strip("\"'“”‘’「」"))
    asked, left = letters(question), letters(rest)
    if asked and left.startswith(asked):  # what follows the question itself must be the question too
        while left.startswith(asked):
            left = left[len(asked) :]
        return len(left) < 2 or same_words(left, asked)
    if same_words(rest, question):
        return True
    some = False
    for p in map(unlabelled, stretches(answer)):
        if letters(p):
            if not same_words(p, question):
                return False
            some = True
    return some


def main_language(text: str) -> str | None:
    """zh, en, de, fr or es by script and function words; None if there are too few words that aren't names."""
    han = len(_HAN.findall(text))
    words = _LATIN_WORD.findall(text)
    lower = [w.lower() for w in words]
    plain = sum(map(str.islower, words)) + any(lower[0] in m for m in _MARKS.values() if words and words[0][0].isupper())
    if han > 2 * plain:
        grammar = any(c in FUNCTION_CHARACTERS for c in text)
        return "zh" if han >= 12 or han >= 4 and grammar else None
    score = {k: sum(map(m.__contains__, lower)) for k, m in _MARKS.items()}
    best = max(score, key=lambda k: score[k])
    if plain < 3 or score[best] < 2:
        return None
    return best


def is_truncated(answer: str) -> bool:
    """Whether the answer breaks off before its last sentence ends. Bare short answers, and texts closed by a short
    final answer on a line of its own or by a bracketed remark, are whole."""
    body = answer.strip()
    while True:
        m = re.search(r"\s*(?:\([^()]{0,80}\)|（[^（）]{0,80}）|\[[^\[\]]{0,80}\])\W{0,1}$", body)
        if not m or not m.group().strip() or m.start() == 0:
            break
        body = body[: m.start()].rstrip()
    if not body or body[-1] in ".!?。！？…" or body[-1] in "\"'”’)）」』]" and body[-2:-1] in tuple(".!?。！？…"):
        return False
    head, newline, last = body.rpartition("\n")
    if newline and head.rstrip()[-1:] in tuple(".!?。！？…)）]") and letters(unlabelled(last)) and len(last) <= 120 and not last.rstrip().endswith((",", "，", "-", "、")):
        return False
    if body[-1] in ",，、;；-–—" or any(body.count(a) > body.count(b) for a, b in ("()", "（）", "[]", "“”", "「」")):
        return True
    if re.search(r"[.!?](?=\s)|[。！？]", body):
        return True
    return len(_HAN.findall(body)) > 15 or len(body.split()) > 8


def spaced(text: str) -> str:
    return _SPACED.sub(" ", text.lower()).strip()


def openings(question: str, answer: str, context: str) -> list[str] | None:
    """The openings of the clauses of an answer, without stretches that only repeat the question; None where a clause is
    tied to the prompt: it has a number, a name of the question or the passages, or stands in them as it is."""
    asked = unlabelled(question)
    parts = [k.strip() for s in stretches(unlabelled(answer.strip())) if not same_words(s, asked) for k in _CLAUSE.split(s)]
    parts = [k for k in parts if letters(k)]
    if not parts or any(map(_DIGIT.search, parts)):
        return None
    if any(w in question or w in context for k in parts for w in _INNER.findall(k)):
        return None
    heads = list(map(spaced, parts))
    around = f" {spaced(asked)} \n {spaced(context)} "
    if any(h in around for h in heads):
        return None
    return sorted({h[:OPENING_HAN] if _HAN.search(h) else " ".join(h.split()[:OPENING_WORDS]) for h in heads})


def asked_units(question: str) -> list[str]:
    """What prompts have in common if they ask the same: words, and pairs of Chinese characters."""
    q = unlabelled(question).lower()
    return sorted({w for w in _LATIN_WORD.findall(q) if len(w) > 1} | {q[i : i + 2] for i in range(len(q) - 1) if _HAN.match(q[i]) and _HAN.match(q[i + 1])})


def question_of_prompt(prompt: F.Column) -> F.Column:
    """The line before the last line of a prompt; null where it has fewer than two lines."""
    return F.try_element_at(F.split(prompt, "\n"), F.lit(-2))


def pairs(train: DataFrame, dataset: DataFrame) -> DataFrame:
    """(tbl, row_id, question, answer, context) of both tables; the context has the passages."""
    passages = F.array_join(F.transform("all_docs", lambda d: F.coalesce(d["content"], F.lit(""))), "\n")
    return train.select(F.lit("train").alias("tbl"), "row_id", question_of_prompt(F.col("prompt")).alias("question"), F.col("output").alias("answer"), F.col("prompt").alias("context")).unionByName(
        dataset.select(F.lit("dataset").alias("tbl"), "row_id", "question", "answer", passages.alias("context"))
    )


_JUDGED = "tbl string, row_id bigint, settled string, otherwise string, openings array<string>, asked bigint, units array<string>"


def judged(rows: DataFrame) -> DataFrame:
    """The pairs that have a defect or may refuse: ``settled`` is a defect that goes before refusals, ``otherwise`` one
    that counts if the pair isn't a refusal; ``openings`` are those of a pair without ties to its prompt. No texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for tbl, row, q, a, context, asked in zip(*(batch.column(c).to_pylist() for c in ("tbl", "row_id", "question", "answer", "context", "asked"))):
            settled = "empty" if is_empty(a) else "copy" if q is not None and is_copy(q, a) else None
            otherwise = None if settled else unfinished_or_foreign(q, a)
            found = None if settled else openings(q or "", a, context or "")
            if settled or otherwise or found:
                out.append((tbl, row, settled, otherwise, found, asked, asked_units(q or "") if found else None))
        if not out:
            return None
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in _JUDGED.split(", ")])

    return map_arrow(rows.select("tbl", "row_id", "question", "answer", "context", F.xxhash64("question").alias("asked")), run, _JUDGED)


def common_units(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """(unit): the words that at least that share of all questions have; at most a few for each word of a question."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        count: Counter = Counter()
        for q in batch.column("question").to_pylist():
            count.update(asked_units(q))
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["unit", "n"])

    asked = rows.where("question is not null").select("question")
    return map_arrow(asked, run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= share * asked.count()).select("unit")


def templates(rows: DataFrame, known: DataFrame | None = None, least_prompts: int = 3, least_share: float = 1e-4, related: float = 0.8) -> DataFrame:
    """(opening, n_prompts, n_around, core): the openings that are templates.

    An opening counts once for each distinct question (``n_prompts``). A template's core recurs, together with the openings
    linked to it (Jaccard index of 5-grams of at least 0.6), over at least ``least_prompts`` questions and
    ``least_share`` of all answers (``n_around``); and no word that is in fewer than a quarter of all questions is in
    ``related`` of its questions. What is linked to a core is a template as well."""
    known = table(judged(rows), "judged") if known is None else known
    seen = known.where("openings is not null and settled is null").select(F.explode("openings").alias("opening"), "asked", "units").dropDuplicates(["opening", "asked"]).withColumn("rec", F.xxhash64("opening"))
    seen = table(seen, "seen")
    heads = seen.groupBy("rec").agg(F.min("opening").alias("opening"), F.count(F.lit(1)).alias("n_prompts"))
    _, links = link_representatives(heads.select(F.lit("opening").alias("tbl"), "rec", F.col("opening").alias("text")), 0.6, rows=5)
    ways = links.select(F.col("rec_a").alias("rec"), F.col("rec_b").alias("other")).unionByName(links.select(F.col("rec_b").alias("rec"), F.col("rec_a").alias("other")))
    near = table(ways.unionByName(heads.select("rec", F.col("rec").alias("other"))), "near")
    met = near.groupBy("other").agg(F.count(F.lit(1)).alias("_n"))
    sized = table(heads.join(met.withColumnRenamed("other", "rec"), "rec").select(F.col("rec").alias("other"), "n_prompts", "_n"), "sized")
    around = salted_join(near, sized, ["other"], ["rec"], "_n").groupBy("rec").agg(F.sum("n_prompts").alias("n_around"))
    least = max(least_prompts, least_share * rows.where("answer is not null").count())
    often = table(around.where(F.col("n_around") >= least), "often")
    words = table(seen.select(F.col("rec").alias("other"), F.explode("units").alias("unit")).groupBy("other", "unit").agg(F.count(F.lit(1)).alias("n")).join(common_units(rows), "unit", "left_anti"), "words")
    reach = table(near.join(often, "rec"), "reach")
    # the words of an opening are as many as its questions have; what stands around it sums them before the shuffle
    shares = reach.join(words, "other").groupBy("rec", "unit").agg(F.sum("n").alias("n"), F.first("n_around").alias("n_around"))
    same = shares.where(F.col("n") >= related * F.col("n_around")).select("rec").distinct()
    core = table(often.join(same, "rec", "left_anti"), "core")
    found = reach.join(core.select("rec"), "rec", "left_semi").select(F.col("other").alias("rec")).distinct()
    return heads.join(found, "rec").join(core.withColumn("core", F.lit(True)), "rec", "left").select("opening", "n_prompts", "n_around", F.coalesce("core", F.lit(False)).alias("core"))


def defects(rows: DataFrame, least_prompts: int = 3, least_share: float = 1e-4) -> DataFrame:
    """(tbl, row_id, defect), one row per defective pair of ``rows`` (tbl, row_id, question, answer, context).

    Null answers are ``empty``. Where the question is null, no copy or wrong language is told; where the context is null,
    ties are looked for in the question alone. Repeated rows are each judged; other columns are ignored. The first defect
    in the order of DEFECTS counts. Refusals need recurrence: in a small table, those that hardly recur aren't found."""
    known = table(judged(rows).withColumn("_row", F.monotonically_increasing_id()), "judged")
    found = templates(rows, known, least_prompts, least_share).select("opening")
    apart = known.where("openings is not null and settled is null").select("_row", F.explode("openings").alias("opening"))
    sized = table(apart.groupBy("opening").agg(F.count(F.lit(1)).alias("_n")).join(found, "opening"), "templates")
    told = salted_join(apart, sized, ["opening"], ["_row"], "_n").groupBy("_row").agg(F.count(F.lit(1)).alias("_told"))
    kind = F.coalesce("settled", F.when(F.col("_told") == F.size("openings"), F.lit("refusal")), "otherwise")
    return known.join(told, "_row", "left").select("tbl", "row_id", kind.alias("defect")).where("defect is not null")


def unfinished_or_foreign(question: str | None, answer: str) -> str | None:
    if question is not None:
        asked, given = main_language(unlabelled(question)), main_language(answer)
        if asked and given and asked != given:
            return "wrong_language"
        answer = answer.strip().removeprefix(unlabelled(question.strip())) or answer  # a bare answer may follow the question
    return "truncated" if is_truncated(answer) else None


def defect(question: str | None, answer: str | None) -> str | None:
    """The defect of one pair by itself, or None; refusals are told by ``defects`` only."""
    if is_empty(answer):
        return "empty"
    if question is not None and is_copy(question, answer):
        return "copy"
    return unfinished_or_foreign(question, answer)
