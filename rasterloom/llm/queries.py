"""The thin queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, language_model, licenses, mixing, quality, ranking, repeats, tokens, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest", "longest_item")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(_table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report_with_planted(_table(spark, sf_dir, "conversations"))


#: Weights that the domains shall have among all words.
TARGETS = {"good": 0.75, "plain": 0.2, "toxic": 0.05}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled documents, by the labels table alone: toxic, else good or plain by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select("doc_id", domain.alias("label")).where("label is not null")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.report(docs, labelled_domains(docs, _table(spark, sf_dir, "labels")), TARGETS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_jaccard_join, op3_pitman_yor, op4_repeats, op5_token_blocks, op6_license_scan, op7_chat_format, op8_mixing, op9_quality_rules, op10_toxicity, op11_ranked_search, op12_language_id, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": LEAKS_SQL, "op6_license_scan": licenses_sql(), "op7_chat_format": CHAT_SQL, "op11_ranked_search": RANKS_SQL}


LEAKS_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS k FROM iw WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS w
  FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM dw, lengths WHERE len(ws) >= n)
), found AS (SELECT p.r, p.k, p.n, i.item_id FROM places p JOIN windows i ON p.n = i.n AND p.w = i.w),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS k FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

RANKS_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), live AS (SELECT r, doc_id, ws, len(ws) AS n FROM dw WHERE len(ws) > 0),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM live),
iw AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM live) WHERE term IN (SELECT term FROM iw) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, corpus GROUP BY term
), gains AS (
  SELECT c.r, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS gain
  FROM counts c JOIN weights USING (term) JOIN live USING (r), corpus
), scores AS (
  SELECT i.item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM iw i JOIN gains g USING (term) GROUP BY i.item_id, r HAVING sum(gain) > 0
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores JOIN live USING (r)
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), ordered AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before,
    replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS safe,
    replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS safe_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss,
    sum(length(safe) + CASE WHEN before = role THEN length('<|turn|>') ELSE length(safe_role) + 4 + CASE WHEN before IS NULL THEN 0 ELSE length('<|end|>') END END) + length('<|end|>') AS formatted_chars
  FROM ordered GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


def licenses_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{t}', {len(licenses.words_of(t))}, '{' '.join(licenses.marks_of(t))}')" for i, (n, t) in enumerate(licenses.TEMPLATES))
    every_mark = ", ".join(f"'{m}'" for m in licenses.MARKS)
    marks = lambda ws: f"array_to_string(list_sort(list_distinct(list_filter({ws}, lambda x: list_contains([{every_mark}], x)))), ' ')"
    words = lambda c: f"regexp_extract_all(translate({c}, '{licenses._AZ}', '{licenses._az}'), '[a-z0-9]+')"
    return f"""
WITH templates(id, license, wording, size, marks) AS (VALUES {rows}),
template_words AS (SELECT id, unnest(regexp_extract_all(lower(wording), '[a-z0-9]+')) AS w FROM templates),
vocabulary AS (SELECT DISTINCT w FROM template_words),
files AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, text, {licenses.PATH_SQL} AS path FROM documents
), marked AS (SELECT *, regexp_matches(path, '(^|/)(LICENSE|LICENCE|COPYING)(\\.[A-Za-z]+)?$') AS holder, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
document_words AS (SELECT DISTINCT doc_id, unnest({words("text")}) AS w FROM files),
idf AS (
  SELECT v.w, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(d.doc_id))) + 1 AS idf
  FROM vocabulary v LEFT JOIN document_words d ON v.w = d.w GROUP BY v.w
), template_weights AS (
  SELECT id, w, count(*) * any_value(idf) AS x FROM template_words JOIN idf USING (w) GROUP BY id, w
), template_norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM template_weights GROUP BY id),
lines AS (
  SELECT doc_id, ls[i] AS unit, CASE WHEN i > 1 THEN regexp_extract(ls[i - 1], '{licenses.UNFINISHED}', 1) ELSE '' END AS before FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM files))
  UNION ALL SELECT doc_id, text, '' FROM marked WHERE holder
), numbered AS (SELECT row_number() OVER () AS u, doc_id, {words("unit")} AS ws, {words("before")} AS bs FROM lines),
line_words AS (SELECT u, doc_id, len(ws) AS n, {marks("list_concat(bs, ws)")} AS marks, unnest(ws) AS w FROM numbered),
line_weights AS (SELECT u, any_value(doc_id) AS doc_id, any_value(n) AS n, any_value(marks) AS marks, w, count(*) AS k, count(*) * any_value(idf) AS x FROM line_words JOIN idf USING (w) GROUP BY u, w),
line_norms AS (SELECT u, any_value(doc_id) AS doc_id, any_value(marks) AS marks, sqrt(sum(x * x)) AS norm FROM line_weights GROUP BY u HAVING sum(k) >= {licenses.SHARE} * any_value(n)),
line_cosines AS (
  SELECT n.doc_id, t.license, t.size, round(sum(a.x * b.x) / any_value(n.norm) / any_value(m.norm), 6) AS cosine
  FROM line_norms n JOIN line_weights a USING (u) JOIN template_weights b ON a.w = b.w JOIN template_norms m ON m.id = b.id JOIN templates t ON t.id = b.id
  WHERE n.marks = t.marks GROUP BY n.u, n.doc_id, t.id, t.license, t.size
), by_line AS (SELECT * FROM line_cosines WHERE cosine >= {licenses.COSINE}),
rest AS (SELECT doc_id, {words("text")} AS ws FROM files WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM by_line)),
enough AS (
  SELECT d.doc_id, t.id FROM rest d JOIN document_words p USING (doc_id) JOIN template_weights t ON t.w = p.w JOIN template_norms m ON m.id = t.id
  GROUP BY d.doc_id, t.id HAVING sum(t.x * t.x) >= ({licenses.COSINE} - 1e-6) * ({licenses.COSINE} - 1e-6) * any_value(m.norm) * any_value(m.norm)
), starts AS (
  SELECT doc_id, t.id, t.license, t.size, t.marks AS need, ws, unnest(generate_series(1, greatest(1, len(ws) - t.size + 1))) AS i FROM enough JOIN rest USING (doc_id) JOIN templates t ON t.id = enough.id
), windows AS (
  SELECT doc_id, id, license, size, i, list_slice(ws, i, i + size - 1) AS own FROM starts WHERE {marks(f"list_slice(ws, greatest(i - {licenses.BEFORE}, 1), i + size - 1 + {licenses.AFTER})")} = need
), window_words AS (SELECT doc_id, id, license, size, i, len(own) AS n, unnest(own) AS w FROM windows),
window_weights AS (SELECT doc_id, id, any_value(license) AS license, any_value(size) AS size, i, any_value(n) AS n, w, count(*) AS k, count(*) * any_value(idf) AS x FROM window_words JOIN idf USING (w) GROUP BY doc_id, id, i, w),
by_window AS (
  SELECT a.doc_id, any_value(a.license) AS license, any_value(a.size) AS size, round(sum(a.x * coalesce(b.x, 0)) / sqrt(sum(a.x * a.x)) / any_value(m.norm), 6) AS cosine
  FROM window_weights a JOIN template_norms m ON m.id = a.id LEFT JOIN template_weights b ON b.id = a.id AND b.w = a.w
  GROUP BY a.doc_id, a.id, a.i HAVING sum(a.k) >= {licenses.SHARE} * any_value(a.n) AND round(sum(a.x * coalesce(b.x, 0)) / sqrt(sum(a.x * a.x)) / any_value(m.norm), 6) >= {licenses.COSINE}
), own AS (
  SELECT doc_id, license AS own_license, cosine FROM (SELECT doc_id, license, size, cosine FROM by_line UNION ALL SELECT doc_id, license, size, cosine FROM by_window)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, cosine DESC, license DESC) = 1
), scanned AS (SELECT m.*, own_license, cosine FROM marked m LEFT JOIN own USING (doc_id)),
holders AS (
  SELECT dir AS above, own_license AS license FROM scanned WHERE holder AND own_license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, own_license DESC) = 1
), nearest AS (
  SELECT s.doc_id, h.above, h.license FROM scanned s JOIN holders h ON s.own_license IS NULL AND (h.above = '' OR s.dir = h.above OR starts_with(s.dir, h.above || '/'))
  QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY length(h.above) DESC) = 1
)
SELECT s.doc_id, s.path, s.own_license, s.cosine, coalesce(s.own_license, n.license) AS license,
  CASE WHEN s.own_license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'directory' ELSE 'none' END AS basis, n.above AS licence_dir
FROM scanned s LEFT JOIN nearest n USING (doc_id)
"""
