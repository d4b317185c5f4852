"""The registered queries of the text operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, chat, decontaminate, embedding, exact_dedup, html_text, lexical, lm, repair, secrets, sharding, simhash, toxicity
from .common import table


def op1_bpe(spark, sf_dir, path=None):
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(table(spark, sf_dir, "documents"), path, want=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secrets(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def secrets_base(spark, sf_dir):
    """The known shapes of op5_secrets alone: what SQL can express of it."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_chat(spark, sf_dir):
    return chat.format_report(table(spark, sf_dir, "conversations"))


def op9_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_lm(spark, sf_dir):
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op11_embedding(spark, sf_dir):
    return embedding.near_groups(table(spark, sf_dir, "embeddings"))


def op12_repair(spark, sf_dir):
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = [op1_bpe, op2_exact_dedup, op3_html, op4_decontaminate, op5_secrets, secrets_base, op6_toxicity, op7_sharding, op8_chat, op9_simhash, op10_lm, op11_embedding, op12_repair, op13_search, pipeline]
    return {f.__name__: f for f in named}


OP2 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP4 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM pos) p JOIN wins v ON v.k = p.k AND v.win = p.win),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY 1),
n_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)
"""


SECRETS_BASE = r"""
WITH shapes(k, kind, least) AS (VALUES (0, 'assign', 6), (1, 'access', 20), (2, 'hex', 24)),
found AS (
  SELECT doc_id, k, kind, least, CASE k WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS whole,
    CASE k WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]+', 0) END AS value,
    CASE k WHEN 0 THEN string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]+') END AS gap
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), shapes),
each AS (SELECT doc_id, k, kind, least, unnest(range(1, len(whole) + 1)) AS i, whole, value, gap FROM found),
spans AS (
  SELECT doc_id, k, kind, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s, length(whole[i]) AS n FROM each WHERE length(value[i]) >= least),
sums AS (
  SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS b, count_if(k = 2) AS h, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS line FROM spans GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256 FROM documents LEFT JOIN sums USING (doc_id)
"""


OP11 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least USING (r) LEFT JOIN degree USING (r)
"""

OP12 = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
tab AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM (SELECT unnest(range(256)) AS n)),
tabs AS (SELECT list(t ORDER BY n) AS t FROM tab),
kinds AS (
  SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c // 256, t[1 + xor(c, x) % 256])), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT key FROM raw), tabs),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw JOIN kinds USING (key) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(open AND NOT again AND NOT blank) AS truncated,
    count_if(before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY 1),
ways AS ( -- from each state: the cheapest edits of what is left, as (cost, audit, repaired); 2 = user last, 3 = assistant last
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'r': ''} AS w0, {'c': 6, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS w1, {'c': 3, 'a': 'I', 'r': chr(10) || 'assistant:'} AS w2, {'c': 0, 'a': '', 'r': ''} AS w3 FROM sums
  UNION ALL
  SELECT conv_id, i,
    list_min([x0, {'c': y2.c + 3, 'a': 'I' || y2.a, 'r': chr(10) || 'user:' || y2.r}]), list_min([x1, {'c': y2.c + 3, 'a': 'I' || y2.a, 'r': chr(10) || 'user:' || y2.r}]), y2, y3
  FROM (
    SELECT conv_id, i, x0, x1, list_min([x2, {'c': x3.c + 3, 'a': 'I' || x3.a, 'r': chr(10) || 'assistant:' || x3.r}]) AS y2, list_min([x3, {'c': x2.c + 3, 'a': 'I' || x2.a, 'r': chr(10) || 'user:' || x2.r}]) AS y3
    FROM (
      SELECT conv_id, i,
        list_min(list_filter([{'c': w0.c + 4, 'a': 'D' || w0.a, 'r': w0.r}, {'c': CASE WHEN gone OR c <> 's' THEN 1000000 ELSE w1.c + cut END, 'a': 'K' || w1.a, 'r': line || w1.r}, {'c': CASE WHEN gone OR c <> 'u' THEN 1000000 ELSE w2.c + cut END, 'a': 'K' || w2.a, 'r': line || w2.r}, {'c': CASE WHEN gone THEN 1000000 ELSE w2.c + cut + 3 END, 'a': 'R' || w2.a, 'r': chr(10) || 'user:' || text || w2.r}], lambda x: x.c < 1000000)) AS x0,
        list_min(list_filter([{'c': w1.c + 4, 'a': 'D' || w1.a, 'r': w1.r}, {'c': CASE WHEN gone OR c <> 'u' THEN 1000000 ELSE w2.c + cut END, 'a': 'K' || w2.a, 'r': line || w2.r}, {'c': CASE WHEN gone THEN 1000000 ELSE w2.c + cut + 3 END, 'a': 'R' || w2.a, 'r': chr(10) || 'user:' || text || w2.r}], lambda x: x.c < 1000000)) AS x1,
        list_min(list_filter([{'c': w2.c + 4, 'a': 'D' || w2.a, 'r': w2.r}, {'c': CASE WHEN gone OR c <> 'a' THEN 1000000 ELSE w3.c + cut END, 'a': 'K' || w3.a, 'r': line || w3.r}, {'c': CASE WHEN gone THEN 1000000 ELSE w3.c + cut + 3 END, 'a': 'R' || w3.a, 'r': chr(10) || 'assistant:' || text || w3.r}], lambda x: x.c < 1000000)) AS x2,
        list_min(list_filter([{'c': w3.c + 4, 'a': 'D' || w3.a, 'r': w3.r}, {'c': CASE WHEN gone OR c <> 'u' THEN 1000000 ELSE w2.c + cut END, 'a': 'K' || w2.a, 'r': line || w2.r}, {'c': CASE WHEN gone THEN 1000000 ELSE w2.c + cut + 3 END, 'a': 'R' || w2.a, 'r': chr(10) || 'user:' || text || w2.r}], lambda x: x.c < 1000000)) AS x3
      FROM (
        SELECT j.conv_id, j.i, j.c, j.text, chr(10) || j.role || ':' || j.text AS line, j.blank OR j.again AS gone, CASE WHEN j.open THEN 3 ELSE 0 END AS cut, w0, w1, w2, w3
        FROM ways JOIN judged j ON j.conv_id IS NOT DISTINCT FROM ways.conv_id AND j.i = ways.i - 1)))),
best AS (SELECT conv_id, w0 FROM ways WHERE i = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(w0.c AS BIGINT), 0) AS cost, coalesce(w0.a, '') AS audit, sha256(coalesce(substr(w0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
asked AS (SELECT item_id, t, count(*) AS times FROM items GROUP BY 1, 2),
total AS (SELECT count_if(len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY 1),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM dfs, total),
lengths AS (SELECT r, doc_id, 75 + (25 * len(w) * n) // l AS m FROM docs, total WHERE len(w) > 0),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r) GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op4_decontaminate": OP4, "secrets_base": SECRETS_BASE, "op11_embedding": OP11, "op12_repair": OP12, "op13_search": OP13}
