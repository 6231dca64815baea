"""The registered queries of this package: thin, each over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import chat, decontamination, fill_in_middle, jaccard_join, mixing, packing, quality, secrets, suffix_tree_lm, token_files, toxicity, vector_codes, vector_search
from meshwork.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join with each document's number of links."""
    return jaccard_join.join(table(spark, sf_dir, "documents"), links_too=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(table(spark, sf_dir, "documents"), token_files.default_tokenizer())


def op5_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_grade_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.report(table(spark, sf_dir, "embeddings"))


def op10_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


def op13_code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op7_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
t AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
      FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
h AS (SELECT t.doc_id, t.i, t.m, p.item_id FROM t JOIN p ON t.m = p.m AND t.s = p.s),
pos AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '(<)(\||/?s>|</?SYS>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
ORACLE_SQL["op6_format_chats"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(ESC_ROLE) + length(ESC_TEXT) + length('<|im_start|><|im_sep|><|im_end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("ESC_ROLE", _ESCAPED.format("role")).replace("ESC_TEXT", _ESCAPED.format("text"))

ORACLE_SQL["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.d = w.doc_id GROUP BY w.doc_id, n.n
"""

_COMPONENT, _COUNTED = "AS component_id\nFROM w", "AS component_id, coalesce(any_value(l.links), 0)::BIGINT AS n_links\nFROM w LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY a) l ON l.a = w.doc_id"
ORACLE_SQL["op2_link_counts"] = ORACLE_SQL["op2_jaccard_join"].replace(_COMPONENT, _COUNTED)


ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(u[1 : least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1 :], '') AS s FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one after the other, over lists of parts."""
    width = f"(len(v) // {parts})"
    sql = f"""
WITH k AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
x AS MATERIALIZED (SELECT row, p, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM k, range({parts}) t(p)),
s AS (SELECT vec_id, min(v) AS v FROM k GROUP BY vec_id ORDER BY vec_id NULLS LAST LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST) - 1 AS e, v[p * {width} + 1 : (p + 1) * {width}] AS v FROM s, range({parts}) t(p))"""
    for i in range(rounds + 1):
        sql += f""",
a{i} AS MATERIALIZED (SELECT row, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (SELECT x.row, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{i} c ON c.p = x.p) GROUP BY row, p)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT x.p, a.e, unnest(range(len(x.v))) AS j, unnest(x.v)::BIGINT AS y FROM x JOIN a{i} a ON a.row = x.row AND a.p = x.p) GROUP BY p, e, j) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)"""
    return sql + f""",
r AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} a JOIN k ON k.row = a.row GROUP BY k.row, k.vec_id, k.label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS digest FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM r, h
"""


ORACLE_SQL["op13_code_vectors"] = _lloyd_sql()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
