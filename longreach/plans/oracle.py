"""SQL for DuckDB that says what the queries of ``catalog`` compute."""

from __future__ import annotations


def _hash(seed: int | str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) AS BIGINT)"


def _tokens(text: str, lang: str) -> str:
    return f"CAST(ceil(octet_length(encode({text})) * CASE WHEN {lang} = 'en' THEN 0.263::DOUBLE ELSE 0.248::DOUBLE END) AS BIGINT)"


def _trigrams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)))"


def _similarity(a: str, b: str) -> str:
    x, y = _trigrams(a), _trigrams(b)
    return f"(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0))"


_E = "e AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings WHERE embedding IS NOT NULL)"
_SCORE = {"ip": "list_inner_product(a.v, b.v)", "cosine": "list_cosine_similarity(a.v, b.v)", "l2": "-list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"}
_JOINED = "j AS MATERIALIZED (SELECT e.* FROM e JOIN documents d ON d.doc_id = e.id)"


def _exact(metric: str = "ip", name: str = "exact") -> str:
    return f"""{name}_s AS (SELECT a.id AS q, b.id AS n, round({_SCORE[metric]}, 9) AS s FROM e a, e b WHERE a.id % 20 = 0),
      {name} AS MATERIALIZED (SELECT * FROM (SELECT q, n, s, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= 10)"""


def _ivf(base: str = "e", queries: str = "id % 20 = 0", nprobe: int = 2, name: str = "ivf") -> str:
    return f"""{name}_c AS MATERIALIZED (SELECT label AS list_id, list(x ORDER BY p) AS c FROM (SELECT label, p, round(avg(x), 9) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM {base} WHERE label IS NOT NULL) GROUP BY label, p) GROUP BY label),
      {name}_p AS MATERIALIZED (SELECT id, v, list_id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(list_inner_product(v, c), 9) DESC, list_id) AS INTEGER) AS probe FROM {base}, {name}_c),
      {name}_s AS (SELECT a.id AS q, b.id AS n, round(list_inner_product(a.v, b.v), 9) AS s FROM {name}_p a JOIN {name}_p b ON a.list_id = b.list_id AND b.probe = 1 WHERE a.probe <= {nprobe} AND a.{queries}),
      {name} AS MATERIALIZED (SELECT * FROM (SELECT q, n, s, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= 10)"""


_WALK = f"""{_E}, {_JOINED}, {_ivf("j", "id IS NOT NULL")},
      nb AS MATERIALIZED (SELECT q, list(n ORDER BY rank) AS ns FROM ivf WHERE rank BETWEEN 2 AND 10 GROUP BY q),
      w(step, cur, cid, len, unseen) AS (
        SELECT 0, min(id), 0::BIGINT, 0, list(id ORDER BY id)[2:] FROM j
        UNION ALL
        SELECT step + 1, coalesce(cand, unseen[1]), cid + (cand IS NULL)::INT, CASE WHEN cand IS NULL THEN 1 ELSE len + 1 END, list_filter(unseen, lambda x: x <> coalesce(cand, unseen[1]))
        FROM (SELECT w.*, CASE WHEN w.len >= 21 THEN NULL ELSE list_filter(nb.ns, lambda x: list_contains(w.unseen, x))[1] END AS cand FROM w LEFT JOIN nb ON nb.q = w.cur WHERE len(w.unseen) > 0)),
      walk AS MATERIALIZED (SELECT cid AS cluster_id, CAST(row_number() OVER (PARTITION BY cid ORDER BY step) - 1 AS INTEGER) AS pos, cur AS id FROM w)"""


def _filtered(elements: str) -> str:
    """``kept`` (g, pos, key, content) of ``elements`` (g, pos from 1 without gaps, key, content): the near-duplicate filter."""
    s = _similarity("substr(x.content, 1, 100)", "substr(f.prev, 1, 100)")
    return f"""el AS MATERIALIZED ({elements}),
      f(g, pos, prev, keep) AS (
        SELECT g, 0::BIGINT, NULL::VARCHAR, false FROM (SELECT DISTINCT g FROM el)
        UNION ALL
        SELECT g, pos, CASE WHEN content IS NOT NULL AND (prev IS NULL OR sim IS NULL OR sim <= 0.75) THEN content ELSE prev END, content IS NOT NULL AND (prev IS NULL OR coalesce(sim <= 0.75, false))
        FROM (SELECT x.g, x.pos, x.content, f.prev, {s} AS sim FROM f JOIN el x ON x.g = f.g AND x.pos = f.pos + 1)),
      kept AS (SELECT el.* FROM el JOIN f ON f.g = el.g AND f.pos = el.pos WHERE f.keep)"""


_PAIRS = """rows AS MATERIALIZED (SELECT row_id // 12 AS path_id, CAST(row_id % 12 // 3 AS INTEGER) AS doc_pos, CAST(row_number() OVER (PARTITION BY row_id // 12 ORDER BY row_id % 12 // 3, row_id) - 1 AS INTEGER) AS qa_ord, question, answer FROM dataset)"""
_QA_TEXT = "array_to_string(list_filter([question, answer], lambda s: s IS NOT NULL), chr(10))"
_NEAR = f"""{_PAIRS}, t AS MATERIALIZED (SELECT path_id, qa_ord, doc_pos, {_QA_TEXT} AS t FROM rows),
      s AS (SELECT a.path_id, a.qa_ord, b.qa_ord AS other, round(coalesce({_similarity("a.t", "b.t")}, 0), 6) AS sim FROM t a JOIN t b ON a.path_id = b.path_id AND b.qa_ord > a.qa_ord AND a.doc_pos <> b.doc_pos),
      x AS (SELECT path_id, qa_ord, list(other ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY path_id, qa_ord ORDER BY sim DESC, other) AS r FROM s) WHERE r <= 3 GROUP BY ALL),
      i AS (SELECT path_id, doc_pos, list(qa_ord ORDER BY qa_ord)[2:4] AS ids FROM rows GROUP BY ALL),
      near AS MATERIALIZED (SELECT r.path_id, r.qa_ord, i.ids AS indoc, coalesce(x.ids, []) AS xd FROM rows r JOIN i USING (path_id, doc_pos) LEFT JOIN x USING (path_id, qa_ord))"""
_FOLD = f"""{_NEAR}, sel AS (SELECT path_id, qa_ord FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY {_hash(0, "path_id", "qa_ord")}, qa_ord) AS r FROM rows) WHERE r <= 10),
      steps AS (SELECT l.path_id, l.qa_ord, l.type, l.step, o.question, o.answer FROM (
          SELECT path_id, qa_ord, 'intra_doc' AS type, unnest(indoc) AS other, generate_subscripts(indoc, 1) AS step FROM near JOIN sel USING (path_id, qa_ord)
          UNION ALL SELECT path_id, qa_ord, 'inter_doc', unnest(xd), generate_subscripts(xd, 1) FROM near JOIN sel USING (path_id, qa_ord)) l
        JOIN rows o ON o.path_id = l.path_id AND o.qa_ord = l.other WHERE coalesce(o.answer, '') <> '' AND o.answer NOT LIKE '%}}%'),
      hops AS MATERIALIZED (SELECT s.path_id, s.qa_ord, s.type, CAST(row_number() OVER w + 1 AS INTEGER) AS hop, coalesce(r.question, '') || ' / ' || string_agg(coalesce(s.question, ''), ' / ') OVER w AS question, s.answer
        FROM steps s JOIN rows r ON r.path_id = s.path_id AND r.qa_ord = s.qa_ord WINDOW w AS (PARTITION BY s.path_id, s.qa_ord, s.type ORDER BY s.step))"""


def _training(items: str, reasoning: bool, low: int, high: int, seed: int) -> str:
    """``done`` (item_id, type, language, docs, places, question, answer) of ``items`` (item_id, type, language, other, clue,
    question, answer)."""
    return f"""it AS MATERIALIZED ({items}),
      b AS (SELECT *, list_transform(other, lambda d: {_tokens("coalesce(d.content, '')", "language")}) AS ot, coalesce(list_sum(list_transform(clue, lambda d: {_tokens("coalesce(d.content, '')", "language")})), 0) AS ct FROM it),
      l AS (SELECT *, greatest({low} + {_hash(seed, "item_id")} % {high - low + 1}, coalesce(list_sum(ot), 0)) AS most FROM b),
      n AS (SELECT *, coalesce(list_filter(range(0, len(other) + 1), lambda k: coalesce(list_sum(ot[1:k]), 0) + ct > most)[1], len(other)) AS n FROM l),
      g(item_id, k, docs, places) AS (
        SELECT item_id, 0, other[1:n], []::INTEGER[] FROM n
        UNION ALL
        SELECT item_id, k + 1, list_concat(list_concat(docs[1:p], [c]), docs[p + 1:]), list_concat(places, [CAST(p AS INTEGER)])
        FROM (SELECT g.*, n.clue[g.k + 1] AS c, {_hash(seed + 1, "g.item_id", "g.k")} % (len(g.docs) + 1) AS p FROM g JOIN n USING (item_id) WHERE g.k < len(n.clue))),
      done AS MATERIALIZED (SELECT n.item_id, n.type, n.language, n.question, n.answer, g.docs, g.places FROM n JOIN g USING (item_id) WHERE g.k = len(n.clue))"""


def _summary(reasoning: bool) -> str:
    zh = ("请阅读以下文章，先推理，再回答后面的问题。" if reasoning else "请阅读以下文章，再回答后面的问题。") + "\n\n"
    en = ("Read these passages, then reason step by step and answer the question below." if reasoning else "Read these passages, then answer the question below.") + "\n\n"
    passage = "array_to_string(list_transform(docs, lambda d, k: CASE WHEN language = 'zh' THEN '文章 ' || k || '：' ELSE 'Passage ' || k || ':' END || chr(10) || coalesce(d.content, '')), chr(10))"
    text = f"CASE WHEN language = 'zh' THEN '{zh}' ELSE '{en}' END || {passage} || CASE WHEN language = 'zh' THEN chr(10) || chr(10) || '问题：' || question || chr(10) || '答案：' ELSE chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' END"
    return f"""SELECT item_id, type, language, md5(p) AS prompt, md5(answer) AS output, {_tokens("p || answer", "language")} AS token_count, array_to_string(places, ',') AS insert_position, CAST(len(docs) AS INTEGER) AS n_docs
      FROM (SELECT *, {text} AS p FROM done)"""


_ITEMS = "SELECT item_id, type, language, list_filter(concat_docs, lambda d: NOT list_contains(list_transform(clue_docs, lambda c: c.id), d.id)) AS other, CASE WHEN type = 'intra_doc' THEN clue_docs[1:1] ELSE clue_docs END AS clue, mqa.question AS question, mqa.answer AS answer FROM dataset_item WHERE mqa.question IS NOT NULL AND mqa.answer IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    corpus_v = "SELECT doc_ord AS id, embedding AS v FROM corpus_vectors WHERE embedding IS NOT NULL"
    exact = {m: f"WITH {_E}, {_exact(m)} SELECT q, rank, n, round({'-' if m == 'l2' else ''}s, 6) + 0.0 AS dist FROM exact" for m in _SCORE}
    return {
        "knn_exact_ip": exact["ip"],
        "knn_exact_l2": exact["l2"],
        "knn_cosine": exact["cosine"],
        "vector_stats": f"SELECT CAST(dim - 1 AS INTEGER) AS dim, count(x) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(avg(x), 6) AS mean_x, round(stddev_samp(x), 6) AS std_x FROM (SELECT CAST(unnest(v) AS DOUBLE) AS x, generate_subscripts(v, 1) AS dim FROM ({corpus_v})) GROUP BY dim",
        "vector_distinct": f"SELECT min(id) AS first_id, count(*) AS n_copies FROM ({corpus_v}) GROUP BY v",
        "vector_first_n": "SELECT doc_ord AS id, CAST(len(embedding) AS INTEGER) AS d FROM corpus_vectors ORDER BY doc_ord LIMIT 100",
        "vector_sample": f"SELECT doc_ord AS id FROM corpus_vectors ORDER BY {_hash(7, 'doc_ord')}, doc_ord LIMIT 100",
        "vector_catalog_check": "SELECT file_name, count(*) AS size, CAST(CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS INTEGER) AS d FROM corpus_vectors JOIN custom_text_corpus USING (doc_ord) WHERE embedding IS NOT NULL GROUP BY file_name",
        "coarse_assign": f"WITH {_E}, {_ivf()} SELECT id, probe, list_id FROM ivf_p WHERE probe <= 2",
        "ivf_list_stats": f"""WITH {_E}, {_ivf()}, z AS (SELECT c.list_id, count(p.id) AS n FROM ivf_c c LEFT JOIN ivf_p p ON p.list_id = c.list_id AND p.probe = 1 GROUP BY c.list_id)
            SELECT count(*) AS n_lists, CAST(sum(n) AS BIGINT) AS n_vectors, max(n) AS max_size, round(avg(n), 6) AS mean_size, (SELECT list_id FROM z ORDER BY n DESC, list_id LIMIT 1) AS largest_list, round(count(*) * sum(n * n) / (sum(n) * sum(n)), 6) AS imbalance FROM z""",
        "ivf_search_nprobe": f"WITH {_E}, {_ivf()} SELECT q, rank, n, round(s, 6) AS dist FROM ivf",
        "knn_recall_at_i": f"""WITH {_E}, {_exact()}, {_ivf()}, h AS (SELECT greatest(a.rank, b.rank) AS r FROM exact a JOIN ivf b USING (q, n))
            SELECT CAST(i AS INTEGER) AS i, round((SELECT count(*) FROM h WHERE r <= i) / (i * (SELECT count(DISTINCT q) FROM exact)), 6) AS recall FROM range(1, 11) t(i)""",
        "knn_intersection_freq": f"""WITH {_E}, {_exact()}, {_ivf()}, c AS (SELECT a.q, count(b.n) AS n_shared FROM exact a LEFT JOIN ivf b USING (q, n) GROUP BY a.q)
            SELECT n_shared, count(*) AS n_queries FROM c GROUP BY n_shared""",
        "knn_refined": f"WITH {_E}, {_ivf()} SELECT i.q, i.rank, i.n, round(-({_SCORE['l2']}), 6) + 0.0 AS refined FROM ivf i JOIN e a ON a.id = i.q JOIN e b ON b.id = i.n",
        "knn_distance_means": f"""WITH {_E}, {_exact()}, {_ivf()} SELECT 'exact' AS source, round(avg(s), 6) AS mean_dist FROM exact UNION ALL SELECT 'approximate', round(avg(s), 6) FROM ivf
            UNION ALL SELECT 'refined', round(avg(round({_SCORE["ip"]}, 9)), 6) FROM ivf i JOIN e a ON a.id = i.q JOIN e b ON b.id = i.n""",
        "knn_margin": f"""WITH {_E}, {_ivf()}, {_ivf("e", "id IS NOT NULL", 1, "back")}, ma AS (SELECT q, avg(s) AS m FROM ivf GROUP BY q), mb AS (SELECT q, avg(s) AS m FROM back GROUP BY q)
            SELECT i.q, i.n, round(2 * i.s / (ma.m + mb.m), 6) AS margin FROM ivf i JOIN ma ON ma.q = i.q JOIN mb ON mb.q = i.n WHERE i.rank = 1""",
        "knn_consistency": f"""WITH {_E}, {_ivf()} SELECT 'self_missing' AS "check", count(*) AS n_bad FROM (SELECT q FROM ivf GROUP BY q HAVING NOT bool_or(n = q))
            UNION ALL SELECT 'unknown_neighbour', count(*) FROM ivf WHERE n NOT IN (SELECT id FROM e) UNION ALL SELECT 'short', count(*) FROM (SELECT q FROM ivf GROUP BY q HAVING count(*) < 10)
            UNION ALL SELECT 'rank_repeats', count(*) FROM (SELECT q FROM ivf GROUP BY q, rank HAVING count(*) > 1)""",
        "code_dedupe": f"SELECT min(id) AS first_id, count(*) AS n_vectors FROM ({corpus_v}) GROUP BY array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')",
        "knn_nprobe_sweep": f"""WITH {_E}, {_exact()}, {_ivf("e", "id % 20 = 0", 1, "n1")}, {_ivf("e", "id % 20 = 0", 2, "n2")}, {_ivf("e", "id % 20 = 0", 4, "n4")}, {_ivf("e", "id % 20 = 0", 8, "n8")},
            a AS (SELECT 1 AS nprobe, q, n FROM n1 UNION ALL SELECT 2, q, n FROM n2 UNION ALL SELECT 4, q, n FROM n4 UNION ALL SELECT 8, q, n FROM n8)
            SELECT nprobe, 10 AS i, round(count(*) / (10 * (SELECT count(DISTINCT q) FROM exact)), 6) AS recall FROM a JOIN exact USING (q, n) GROUP BY nprobe""",
        "vector_transform": f"""WITH t AS (SELECT j, list_sum(list_transform(v, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN bit_count((i - 1)::INTEGER & j::INTEGER) % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END)) AS x FROM ({corpus_v}), range(0, 8) r(j))
            SELECT CAST(j AS INTEGER) AS dim, count(*) AS n, round(sum(x), 3) AS total FROM t GROUP BY j""",
        "embed_corpus": "SELECT doc_ord, CAST(64 AS INTEGER) AS d FROM custom_text_corpus",
        "token_estimate": f"SELECT doc_id, {_tokens('text', 'lang')} AS n_tokens FROM documents",
        "doc_chunks": f"""WITH t AS (SELECT doc_id, text, {_tokens("text", "lang")} AS tc FROM documents WHERE length(text) > 0), w AS (SELECT *, CAST(ceil(length(text) / ceil(tc / 2048)) AS BIGINT) AS w FROM t),
            c AS (SELECT doc_id, k, substr(text, k * w + 1, w) AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(tc / 2048) AS BIGINT))) AS k FROM w))
            SELECT doc_id, CAST(k AS INTEGER) AS chunk_pos, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM c WHERE chunk <> ''""",
        "trigram_jaccard_pairs": f"""WITH p AS (SELECT path_id, unnest(range(2, len(content_path) + 1)) AS k, content_path AS c FROM organized_text_corpus), t AS (SELECT path_id, k, substr(c[k], 1, 100) AS a, substr(c[k - 1], 1, 100) AS b FROM p)
            SELECT path_id, CAST(k - 1 AS INTEGER) AS pos, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round({_similarity("a", "b")}, 6) END AS similarity FROM t""",
        "quoted_questions": """WITH q AS (SELECT doc_id, list_transform(regexp_extract_all(text, '"([^"]*)"', 1), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))) AS q FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, CAST(len(q) AS INTEGER) AS n_quoted, CAST(len(list_distinct(list_filter(q, lambda s: regexp_matches(s, '[?？]$')))) AS INTEGER) AS n_questions FROM q WHERE len(q) > 0""",
        "json_objects": r"""WITH j AS (SELECT doc_id, regexp_extract(text, '\{.*?\}') AS j FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, json_extract_string(j, '$.question') AS question, json_extract_string(j, '$.answer') AS answer FROM j WHERE j <> '' AND json_valid(j)""",
        "strip_answer": "SELECT row_id, trim(answer, '答案：') AS answer FROM dataset",
        "question_lines": "SELECT row_id, CASE WHEN regexp_matches(l, '^(问题|Question)') THEN l END AS question FROM (SELECT row_id, string_split(prompt, chr(10))[-2] AS l FROM train)",
        "file_offsets": "SELECT file_name, n_lines, CAST(coalesce(sum(n_lines) OVER (ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_ord FROM (SELECT file_name, count(*) AS n_lines FROM custom_text_corpus GROUP BY file_name)",
        "line_runs": f"""WITH l AS (SELECT file_name AS file, doc_ord - min(doc_ord) OVER (PARTITION BY file_name) AS line FROM custom_text_corpus), s AS (SELECT file, line AS start FROM l ORDER BY {_hash(3, "file", "line")}, file, line LIMIT 20)
            SELECT s.file, s.start, l.line FROM s JOIN l ON l.file = s.file AND l.line BETWEEN s.start AND s.start + 2""",
        "greedy_walk": f"WITH RECURSIVE {_WALK} SELECT cluster_id, pos, id FROM walk",
        "cluster_stats": f"""WITH RECURSIVE {_WALK}, z AS (SELECT count(*) AS s FROM walk GROUP BY cluster_id)
            SELECT count(*) AS n_clusters, CAST(sum(s) AS BIGINT) AS n_docs, round(avg(s), 6) AS mean_size, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75, CAST(count_if(s >= 21) AS BIGINT) AS n_full FROM z""",
        "doc_paths": f"""WITH RECURSIVE {_WALK}, {_filtered("SELECT cluster_id AS g, pos + 1 AS pos, id AS key, text AS content FROM walk JOIN documents d ON d.doc_id = walk.id")}
            SELECT g AS cluster_id, CAST(count(kept.g) AS INTEGER) AS n_docs, coalesce(string_agg(CAST(kept.key AS VARCHAR), ',' ORDER BY kept.pos), '') AS ids, md5(coalesce(string_agg(kept.content, chr(10) ORDER BY kept.pos), '')) AS digest
            FROM (SELECT DISTINCT g FROM el) LEFT JOIN kept USING (g) GROUP BY g""",
        "near_dup_filter": f"""WITH RECURSIVE {_filtered("SELECT path_id AS g, unnest(range(1, len(content_path) + 1)) AS pos, NULL AS key, unnest(content_path) AS content FROM organized_text_corpus")}
            SELECT p.path_id, CAST(count(kept.g) AS INTEGER) AS n_kept, md5(coalesce(string_agg(kept.content, chr(10) ORDER BY kept.pos), '')) AS digest FROM organized_text_corpus p LEFT JOIN kept ON kept.g = p.path_id GROUP BY p.path_id""",
        "context_pack": f"""WITH RECURSIVE t AS MATERIALIZED (SELECT path_id, 1600 + {_hash(0, "path_id")} % 1601 AS most, list_transform(content_path, lambda c: coalesce({_tokens("c", "'en'")}, 0)) AS t FROM organized_text_corpus),
            r(path_id, i, c, s) AS (SELECT path_id, 0, 0, 0::BIGINT FROM t UNION ALL
              SELECT r.path_id, r.i + 1, CASE WHEN r.i > 0 AND r.s >= t.most THEN r.c + 1 ELSE r.c END, CASE WHEN r.s >= t.most THEN 0 ELSE r.s END + t.t[r.i + 1] FROM r JOIN t USING (path_id) WHERE r.i < len(t.t))
            SELECT path_id, c AS context, CAST(min(i) - 1 AS INTEGER) AS first_pos, count(*) AS n_docs, CAST(sum(t.t[i]) AS BIGINT) AS n_tokens FROM r JOIN t USING (path_id) WHERE i > 0 GROUP BY path_id, c""",
        "chunk_histogram": """WITH b AS (SELECT type, CAST(greatest(least(CAST(ceil(token_count / 64.0) AS BIGINT), 17) - 1, 0) AS INTEGER) AS bucket, token_count FROM dataset_item WHERE token_count IS NOT NULL)
            SELECT a.type, CAST(a.bucket AS INTEGER) AS bucket, count(b.bucket) AS n, CAST(count_if(coalesce(b.token_count > 1024, false)) AS BIGINT) AS n_over FROM (SELECT DISTINCT type, unnest(range(0, 17)) AS bucket FROM b) a LEFT JOIN b ON a.type IS NOT DISTINCT FROM b.type AND a.bucket = b.bucket GROUP BY ALL""",
        "qa_pairs": f"WITH {_PAIRS} SELECT path_id, doc_pos, qa_ord, md5({_QA_TEXT}) AS digest FROM rows",
        "qa_filter": f"WITH {_PAIRS} SELECT path_id, qa_ord FROM rows WHERE regexp_matches(trim(question), '[?？]$') AND NOT regexp_matches(question, 'guide|手册')",
        "qa_simplify_cut": f"""WITH {_PAIRS}, c AS (SELECT path_id, qa_ord, trim(answer, '答案：') AS answer FROM rows)
            SELECT path_id, qa_ord, answer FROM (SELECT *, max(CAST(coalesce(trim(answer), '') = '' AS INTEGER)) OVER (PARTITION BY path_id, qa_ord // 5 ORDER BY qa_ord) AS cut FROM c) WHERE cut = 0""",
        "qa_labelled": f"WITH {_PAIRS} SELECT path_id, qa_ord FROM rows WHERE regexp_matches(trim(question), '[?？]$') AND NOT regexp_matches(question, 'guide|手册')",
        "qa_simplified": f"""WITH {_PAIRS}, c AS (SELECT path_id, qa_ord, string_split_regex(coalesce(answer, ''), '[,，]')[1] AS said FROM rows)
            SELECT path_id, qa_ord, md5(said) AS said FROM (SELECT *, max(CAST(trim(trim(said, '答案：')) = '' AS INTEGER)) OVER (PARTITION BY path_id, qa_ord // 5 ORDER BY qa_ord) AS cut FROM c) WHERE cut = 0""",
        "answers_by_model": "SELECT row_id, md5(CASE WHEN a THEN 'Reasoning: ' || coalesce(output, '') ELSE output END) AS output, CASE WHEN a THEN md5(output) END AS dedup_output FROM (SELECT *, coalesce(regexp_matches(string_split(prompt, chr(10))[-2], '^(问题|Question)'), false) AS a FROM train)",
        "qa_neighbours_embedded": f"WITH {_NEAR} SELECT path_id, qa_ord, array_to_string(indoc, ',') AS indoc_ids, CAST(len(xd) AS INTEGER) AS n_cross FROM near",
        "jsonl_round_trip": "SELECT doc_ord, id, md5(content) AS digest FROM custom_text_corpus",
        "vector_files": "SELECT CAST(k - 1 AS INTEGER) AS dim, count(*) AS n, round(sum(CAST(embedding[k] AS DOUBLE)), 3) AS total FROM embeddings, range(1, 65) t(k) WHERE embedding IS NOT NULL GROUP BY k",
        "partitioned_sink": "SELECT language, hop, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM dataset_item GROUP BY ALL",
        "pending_vectors": "SELECT doc_ord, id FROM custom_text_corpus WHERE doc_ord NOT IN (SELECT doc_ord FROM corpus_vectors)",
        "batched_search": exact["ip"],
        "gathered_vectors": "SELECT event_id AS ord, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM events JOIN embeddings ON vec_id = user_id",
        "incremental_load": "SELECT id, length(content) AS n_chars FROM custom_text_corpus WHERE lang IN ('en', 'zh')",
        "stored_index_recall": "SELECT CAST(10 AS INTEGER) AS i, true AS enough",
        "qa_neighbours": f"WITH {_NEAR} SELECT path_id, qa_ord, array_to_string(indoc, ',') AS indoc_ids, array_to_string(xd, ',') AS crossdoc_ids FROM near",
        "multihop_fold": f"WITH {_FOLD} SELECT * FROM hops",
        "hop_recover": f"""WITH {_FOLD}, d AS (SELECT path_id, list(DISTINCT doc_pos) AS ds FROM rows GROUP BY path_id),
            z AS (SELECT h.path_id, h.qa_ord, h.type, h.hop, list_concat([h.qa_ord], CASE WHEN h.type = 'intra_doc' THEN n.indoc ELSE n.xd END) AS q FROM hops h JOIN near n USING (path_id, qa_ord)),
            p AS (SELECT path_id, list(doc_pos ORDER BY qa_ord) AS dp FROM rows GROUP BY path_id)
            SELECT z.path_id, z.qa_ord, z.type, z.hop, array_to_string(list_transform(q, lambda k: dp[k + 1]), ',') AS clue_docs, array_to_string(q, ',') AS clue_qas,
              array_to_string(list_sort(list_filter(ds, lambda x: NOT list_contains(list_transform(q, lambda k: dp[k + 1]), x))), ',') AS other_docs FROM z JOIN p USING (path_id) JOIN d USING (path_id)""",
        "answer_rewrite": "SELECT row_id, md5(CASE WHEN a THEN 'Reasoning: ' || output ELSE output END) AS output, CASE WHEN a THEN md5(output) END AS dedup_output FROM (SELECT *, coalesce(regexp_matches(string_split(prompt, chr(10))[-2], '^(问题|Question)'), false) AS a FROM train)",
        "hop_counts": "SELECT type, hop, count(*) AS n FROM dataset_item GROUP BY type, hop",
        "distractor_sample": f"""WITH i AS (SELECT item_id, list_transform(concat_docs, lambda d: d.id) AS ids, coalesce({_tokens("prompt", "language")}, 0) AS own FROM dataset_item),
            c AS (SELECT doc_ord, id, {_tokens("content", "lang")} AS n_tokens FROM custom_text_corpus), r AS (SELECT item_id, ids, own, unnest(range(1, 1025)) AS draw FROM i),
            f AS (SELECT item_id, ids, own, {_hash(0, "item_id", "draw")} % (SELECT max(doc_ord) + 1 FROM c) AS doc_ord, draw FROM r), m AS (SELECT item_id, doc_ord, min(draw) AS draw, any_value(ids) AS ids, any_value(own) AS own FROM f GROUP BY item_id, doc_ord),
            s AS (SELECT item_id, doc_ord, n_tokens, row_number() OVER w AS place, own + sum(n_tokens) OVER w AS total FROM m JOIN c USING (doc_ord) WHERE n_tokens > 0 AND NOT coalesce(list_contains(ids, id), false) WINDOW w AS (PARTITION BY item_id ORDER BY draw))
            SELECT item_id, CAST(place AS INTEGER) AS place, doc_ord, n_tokens FROM s WHERE total - n_tokens < 2000 OR place = 1""",
        "train_multihop": f"WITH RECURSIVE {_training(_ITEMS, True, 200, 600, 0)} {_summary(True)}",
        "train_singlehop": f"""WITH RECURSIVE {_training("SELECT row_id AS item_id, 'intra_doc' AS type, CASE WHEN language = 'zh' THEN 'zh' ELSE 'en' END AS language, coalesce(all_docs, [])[2:] AS other, coalesce(all_docs, [])[1:1] AS clue, question, answer FROM dataset WHERE question IS NOT NULL AND answer IS NOT NULL", False, 200, 600, 0)} {_summary(False)}""",
        "budget_insert": f"WITH RECURSIVE {_training(_ITEMS, False, 50, 120, 11)} SELECT item_id, CAST(len(docs) AS INTEGER) AS n_docs, array_to_string(places, ',') AS insert_position FROM done",
        "position_ablation": """WITH i AS (SELECT item_id, type, list_transform(clue_docs, lambda c: c.id) AS q, list_filter(list_transform(concat_docs, lambda d: d.id), lambda d: NOT list_contains(list_transform(clue_docs, lambda c: c.id), d)) AS o FROM dataset_item),
            a AS (SELECT *, unnest(range(0, len(o) + 1)) AS ip1 FROM i), b AS (SELECT *, unnest(range(ip1, len(o) + 1)) AS ip2 FROM a WHERE type <> 'intra_doc' AND len(q) >= 2)
            SELECT item_id, type, CAST(ip1 AS INTEGER) AS ip1, CAST(NULL AS INTEGER) AS ip2, array_to_string(list_concat(list_concat(o[1:ip1], [q[1]]), o[ip1 + 1:]), ',') AS docs FROM a WHERE type = 'intra_doc' AND len(q) >= 1
            UNION ALL SELECT item_id, type, CAST(ip1 AS INTEGER), CAST(ip2 AS INTEGER), array_to_string(list_concat(list_concat(o[1:ip1], [q[1]]), list_concat(list_concat(o[ip1 + 1:ip2], [q[2]]), o[ip2 + 1:])), ',') FROM b""",
        "perturbation_subset": "SELECT item_id, domain, token_count FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS r FROM dataset_item WHERE token_count <= 400) WHERE r <= 5",
        "events_windowed": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    }
