"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest

    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counting import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).drop("beam", "recall")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stock import pack

    return pack(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_neardup, op3_license_scans, op4_chat_formatting, op5_quality, op6_token_counts, op7_repeats, op8_pii, op9_decontamination, op10_embedding_neardup, op11_packing, op12_prefix_trie, op13_cross_tokenizer)}


# What the formatted conversations hold, computed from the table itself; the lengths follow the template's escapes.
OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, 20 + length(role) + length(text)
    + (length(role || text) - length(translate(role || text, chr(92) || '<[', ''))) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM w GROUP BY conv_id
"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"


def shingle_sql(k: int) -> str:
    """Distinct shingles of a list of words."""
    run = f"list_distinct([array_to_string(ws[i : i + {k - 1}], ' ') for i in range(1, len(ws) - {k - 2})])"
    return f"CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')] ELSE {run} END"


# Components by closure over links; small at the size where this runs.
def component_sql(ids: str) -> str:
    return f"""reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
named AS (SELECT x.*, least(x.{ids}, coalesce(low, x.{ids})) AS component_id FROM nodes x LEFT JOIN comps ON a = {ids})"""


OP2_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACED_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, {shingle_sql(4)} AS sh FROM w),
nodes AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n FROM u l JOIN u r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN nodes x ON x.doc_id = a JOIN nodes y ON y.doc_id = b WHERE 100 * n >= 80 * (x.n_shingles + y.n_shingles - n)),
{component_sql("doc_id")} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named"""

OP9_SQL = f"""WITH w AS (SELECT doc_id, {ALNUM_WORDS} AS ws FROM documents), u AS (SELECT doc_id, unnest({shingle_sql(5)}) AS x FROM w),
i AS (SELECT item_id, {ALNUM_WORDS} AS ws FROM benchmark), s AS (SELECT item_id, {shingle_sql(5)} AS sh FROM i),
t AS (SELECT item_id, CAST(len(sh) AS BIGINT) AS n_item_shingles, unnest(sh) AS x FROM s)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / n_item_shingles AS containment
FROM u JOIN t USING (x) GROUP BY 1, 2, 3 HAVING count(*) >= 0.8 * n_item_shingles"""

OP10_SQL = f"""WITH RECURSIVE nodes AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM nodes WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), {component_sql("vec_id")}
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN n ON n.a = vec_id"""


# A cyclic redundancy check bit by bit, then every prefix of every conversation as a list; sums of a subtree go from each
# node to all its prefixes.
BIT = "(xor(c, CASE WHEN k % 8 = 0 THEN ascii(s[k // 8 + 1]) ELSE 0 END))"
OP12_SQL = f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS ts FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(range(0, 8 * length(s)), lambda c, k: xor({BIT} >> 1, CASE WHEN {BIT} & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295) % 4 AS h FROM own),
convs AS (SELECT h.conv_id, coalesce(b.ts, [])[1 : h.h] || h.ts[h.h + 1 :] AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
e AS (SELECT conv_id, len(ts) AS n, d, ts[1 : d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM convs)),
node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM e GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node.p[node.d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM node LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p),
up AS (SELECT a AS d, p[1 : a] AS p, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM told) GROUP BY ALL)
SELECT told.conv_id, told.d AS depth, above.conv_id AS parent_conv_id, told.n_convs, told.n_children, n_leaves, saved_tokens, told.ends_sha256
FROM told JOIN up ON up.d = told.d AND up.p = told.p LEFT JOIN node above ON above.d = told.d - 1 AND above.p = told.p[1 : told.d - 1]"""


def op3_sql() -> str:
    """Diagonal voting in SQL, over the same templates."""
    from .licenses import BASE, COVERAGE, GRAM, NEIGHBOUR, TEMPLATES

    rows = ", ".join(f"({t}, '{text}', '{label}', {t < len(BASE)})" for t, (text, label) in enumerate(BASE + TEMPLATES))
    gram = f"array_to_string(ws[i + 1 : i + {GRAM}], ' ')"
    return f"""WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS ws FROM documents),
tpl AS (SELECT t, label, base, string_split(phrase, ' ') AS ws FROM (VALUES {rows}) x(t, phrase, label, base)),
tg AS (SELECT t, label, base, len(ws) - {GRAM - 1} AS n, i, {gram} AS g FROM tpl, range(0, len(ws) - {GRAM - 1}) r(i)),
pos AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {GRAM - 1}, 0))) AS i FROM d WHERE len(ws) >= {GRAM}),
dg AS (SELECT doc_id, i, {gram} AS g FROM pos),
v AS (SELECT doc_id, t, label, base, n, dg.i - tg.i AS diag, count(*) AS votes, bit_or(CAST(1 AS BIGINT) << tg.i) AS held FROM dg JOIN tg USING (g) GROUP BY ALL),
f AS (SELECT *, CASE WHEN diag - lag(diag) OVER o <= {NEIGHBOUR} THEN 0 ELSE 1 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, t ORDER BY diag)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diag ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT doc_id, t, label, base, bit_count(bit_or(held))::DOUBLE / n AS score, count(*) FILTER (votes = n) AS fulls,
  min(diag) FILTER (votes = n) AS lo, max(diag) FILTER (votes = n) AS hi FROM r GROUP BY doc_id, t, label, base, n, run),
k AS (SELECT * FROM s WHERE (base AND fulls > 0) OR (NOT base AND score >= {COVERAGE})),
a AS (SELECT doc_id, CAST(coalesce(sum(fulls) FILTER (base), 0) AS BIGINT) AS n_base, CAST(min(lo) FILTER (base) AS BIGINT) AS first_word, CAST(max(hi) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(CASE WHEN base THEN 1.0::DOUBLE ELSE score END) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": OP2_SQL, "op3_license_scans": op3_sql(), "op4_chat_formatting": OP4_SQL, "op9_decontamination": OP9_SQL, "op10_embedding_neardup": OP10_SQL, "op12_prefix_trie": OP12_SQL}
