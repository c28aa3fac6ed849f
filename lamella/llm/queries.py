"""Registered queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import centroids, chat, decontam, exact, html, langid, packing, pii, repair, simhash, substrings, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op8_decontamination": op8_decontamination,
    "op10_repeated_substrings": op10_repeated_substrings,
}

ORACLE: dict[str, str] = {}

ORACLE["op8_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ik AS (SELECT id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM ik),
dk AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
h AS (SELECT r, k, dk.n AS n, id FROM dk JOIN iw ON dk.n = iw.n AND iw.g = array_to_string(dk.w[k:k + dk.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

ORACLE["op10_repeated_substrings"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35),
g AS (SELECT r, k, md5(array_to_string(w[k:k + 34], ' ')) AS g FROM k),
rep AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM g JOIN rep USING (g)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("entities", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("entities", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(n, pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("entities")).alias("spans"))


QUERIES["op3_pii"] = op3_pii


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


QUERIES["op6_packing"] = op6_packing


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n: decides what a model may learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES["op9_toxicity"] = op9_toxicity


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=_remainder(3) != 1)
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "n_positions")


QUERIES["op2_language"] = op2_language


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op4_html"] = op4_html


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


QUERIES["op5_vectors"] = op5_vectors

ORACLE["op5_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(_table(spark, sf_dir, "conversations"))


QUERIES["op7_chat"] = op7_chat

ORACLE["op7_chat"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT conv_id, role, text, row_number() OVER w AS k,
         string_agg(md5(concat_ws('|', role IS NULL, coalesce(role, ''), text IS NULL, coalesce(text, ''))), '') OVER w AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, max(k) AS n_turns FROM n GROUP BY conv_id),
p AS (SELECT n.conv_id, n_turns, k, h FROM n JOIN s USING (conv_id)),
m AS (
  SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns FROM p WHERE k = n_turns AND h NOT IN (SELECT h FROM p WHERE k < n_turns) GROUP BY h)
SELECT conv_id, m.n_turns, k - 1 AS position,
       '<|im_start|>' || lower(trim(replace(coalesce(role, 'unknown'), '<|', '< |'))) || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
FROM n JOIN m USING (conv_id)
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(_table(spark, sf_dir, "embeddings"))


QUERIES["op11_centroids"] = op11_centroids


def _rounds_sql(rounds: int) -> str:
    """Tables a<i> (nearest centroid of every vector) and c<i + 1> (centroids after the round), for all rounds and once more."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM d{i} GROUP BY r)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, unnest(range(1, 65)) AS j FROM v JOIN a{i} USING (r)) GROUP BY 1, 2),
n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(n{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",\n".join(out)


ORACLE["op11_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY vec_id IS NULL, h, q) - 1 AS INTEGER) AS c, q FROM (SELECT vec_id, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v) QUALIFY row_number() OVER (ORDER BY vec_id IS NULL, h, q) <= 8),
{_rounds_sql(10)}
SELECT vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.q, ',')) AS centroid_sha256
FROM v JOIN a10 USING (r) JOIN c10 ON c10.c = m.c
"""


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op12_exact"] = op12_exact

ORACLE["op12_exact"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY c DESC, doc_id NULLS LAST, r)
"""


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(_table(spark, sf_dir, "conversations"))


QUERIES["op13_repair"] = op13_repair


def _step_sql() -> str:
    """Costs, audits and turns of the cheapest edits by state after one more row, inserts included."""
    more = lambda x, cost, letter, turn="[]": f"CASE WHEN {x} IS NOT NULL THEN struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', o := list_concat({x}.o, {turn})) END"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    keep, extra, own = "NOT gone AND ", "CASE WHEN cut THEN 3 ELSE 0 END", "[role || ':' || text]"
    rerole = lambda who: f"['{who}:' || text]"
    to_user = least("r.s0", "r.ss", "r.sa")
    return f"""
  p AS (SELECT r.conv, n.i, n.gone, n.cut, n.role, n.text, left(n.role, 1) AS l, r.s0, r.ss, r.su, r.sa, {to_user} AS b FROM rec r JOIN n ON n.conv = r.conv AND n.i = r.i + 1),
  q AS (SELECT conv, i, {more('s0', 4, 'D')} AS s0, {least(more('ss', 4, 'D'), f"CASE WHEN {keep} l = 's' THEN {more('s0', extra, 'K', own)} END")} AS ss,
    {least(more('su', 4, 'D'), f"CASE WHEN {keep} l = 'u' THEN {more('b', extra, 'K', own)} END", f"CASE WHEN NOT gone THEN {more('b', f'3 + {extra}', 'R', rerole('user'))} END")} AS su,
    {least(more('sa', 4, 'D'), f"CASE WHEN {keep} l = 'a' THEN {more('su', extra, 'K', own)} END", f"CASE WHEN NOT gone THEN {more('su', f'3 + {extra}', 'R', rerole('assistant'))} END")} AS sa FROM p),
  t AS (SELECT conv, i, s0, ss, {least('su', more('s0', 3, 'I', "['user:']"), more('ss', 3, 'I', "['user:']"), more('sa', 3, 'I', "['user:']"))} AS su, sa FROM q)
  SELECT conv, i, s0, ss, su, {least('sa', more('su', 3, 'I', "['assistant:']"))} AS sa FROM t"""


ORACLE["op13_repair"] = f"""
WITH RECURSIVE c AS (
  SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda s, y: list_reduce(list_prepend(xor(s, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS hit
  FROM (SELECT DISTINCT k FROM c)),
d AS (
  SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM c JOIN h USING (k) WHERE hit <> 0),
u AS (SELECT *, row_number() OVER () AS u FROM d),
f AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, u) AS i,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, u) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, u) AS before FROM u),
n AS MATERIALIZED (
  SELECT conv, i, turn, role, text, tail = '' AS blank, tail <> '' AND again AS dup, tail <> '' AND NOT again AND right(tail, 1) NOT IN ('.', '!', '?') AS cut, tail = '' OR again AS gone,
         before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM f),
g AS (
  SELECT conv, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM n GROUP BY conv),
rec AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, struct_pack(c := 0, a := '', o := []::VARCHAR[]) AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, o VARCHAR[]) AS ss,
         struct_pack(c := 3, a := 'I', o := ['user:']) AS su, struct_pack(c := 6, a := 'II', o := ['user:', 'assistant:']) AS sa FROM g
  UNION ALL (WITH {_step_sql().lstrip()})),
e AS (SELECT g.*, list_min([s0, sa]) AS b FROM g JOIN rec ON rec.conv = g.conv AND rec.i = g.last)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON e.conv = coalesce('=' || CAST(o.conv_id AS VARCHAR), '')
"""
