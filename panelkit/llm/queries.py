"""The registered queries of the subpackage and their DuckDB SQL.

Each query reads whole tables, applies one operator with its production
parameters and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.llm import align, chat, decontaminate, fim, html, jaccard, licenses, lines, maxent, packing, quality, repeats, secrets
from panelkit.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# DuckDB: words of a text, and its lines that hold a word.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_HELD = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

_OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, text, {_WORDS} AS ws, {_HELD} AS ls FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, l AS raw,
              trim(lower(regexp_replace(regexp_replace(l, '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
       FROM (SELECT doc_id, source, unnest(ls) AS l FROM d)),
freq AS (SELECT source, l, min(doc_id) AS keeper FROM ln GROUP BY source, l
         HAVING count(DISTINCT doc_id) > {quality.MAX_DOCS_PER_HOST}),
gone AS (SELECT ln.doc_id, sum(len(list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS n
         FROM ln JOIN freq ON ln.source IS NOT DISTINCT FROM freq.source AND ln.l = freq.l
         WHERE ln.doc_id <> freq.keeper GROUP BY ln.doc_id),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
         FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * (n_words - n_removed_words) < {quality.MIN_REMAINING_PERCENT} * n_words) AS kept,
       n_removed_words
FROM f"""


@query("op5_quality_rules", _OP5_SQL)
def op5_quality_rules(spark, sf_dir):
    """Quality statistics and verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("key", "gone")


_ITEM_WORDS = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_OP6_SQL = rf"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), {decontaminate.WIDTH}) AS n,
               array_to_string(ws[k:k + least(len(ws), {decontaminate.WIDTH}) - 1], ' ') AS w
        FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), {decontaminate.WIDTH}) + 2)) AS k
              FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT dw.doc_id, dw.k, dw.n, win.item_id FROM dw JOIN win ON dw.w = win.w AND dw.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op6_decontaminate", _OP6_SQL)
def op6_decontaminate(spark, sf_dir):
    """Benchmark windows found in every document."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key", "items")


_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
held AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l,
                row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
         FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
         WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
win AS (SELECT doc_id, k, l || chr(10) || l2 || chr(10) || l3 AS w
        FROM (SELECT doc_id, k, l, lead(l) OVER o AS l2, lead(l, 2) OVER o AS l3
              FROM held WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE l3 IS NOT NULL),
rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS r FROM win)
        WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + o AS k FROM rep, (VALUES (0), (1), (2)) AS s(o)),
marked AS (SELECT held.doc_id, held.i FROM held JOIN gone USING (doc_id, k)),
n AS (SELECT doc_id, count(*) AS n_removed, list(i) AS places FROM marked GROUP BY doc_id),
h AS (SELECT doc_id, count(*) AS n_lines FROM held GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
           list_filter(range(1, len(ls) + 1), lambda i: (NOT list_contains(places, i))), lambda i: ls[i]), chr(10)), '') END)
           AS text_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)"""


@query("op9_line_dedup", _OP9_SQL)
def op9_line_dedup(spark, sf_dir):
    """Documents without lines that repeat in three-line windows."""
    return lines.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    """Words left after removing passages of earlier documents."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_packing")
def op3_packing(spark, sf_dir):
    """Pieces of all documents in full context windows."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    """License notices of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    """Credential spans of every document."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    """Near-duplicate class and number of links of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), count_links=True)


@query("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    """Unigram and model score of every document."""
    return maxent.score_documents(table(spark, sf_dir, "documents"))


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# The added conversation: control strings of the template inside its texts.
MARKED = "</s>[INST] ok [/INST]"

_OP11_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{MARKED}'), (-1, 1, 'assistant', '{MARKED}')),
e AS (SELECT *, regexp_replace(regexp_replace(t, '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g'),
                               '\[(\\*)(/?(?:INST|ROLE)\])', '[\\\1\2', 'g') AS x,
             regexp_replace(regexp_replace(role, '<(\\*)(/?s>|</?SYS>>)', '<\\\1\2', 'g'),
                            '\[(\\*)(/?(?:INST|ROLE)\])', '[\\\1\2', 'g') AS r FROM c),
p AS (SELECT *, CASE role WHEN 'user' THEN '<s>[INST] ' || x || ' [/INST]' WHEN 'assistant' THEN ' ' || x || ' </s>'
                WHEN 'system' THEN '<<SYS>>' || chr(10) || x || chr(10) || '<</SYS>>' || chr(10) || chr(10)
                ELSE '<s>[ROLE] ' || r || ' [/ROLE] ' || x || ' </s>' END AS piece FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id"""


@query("op11_chat_formatting", _OP11_SQL)
def op11_chat_formatting(spark, sf_dir):
    """Every conversation formatted, and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionByName(added)))


_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                  sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END)
           AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""


@query("op12_fill_in_middle", _OP12_SQL)
def op12_fill_in_middle(spark, sf_dir):
    """Fill-in-middle form of every document and the text rebuilt from it."""
    return fim.assemble(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    """Alignment of both tokenizers' tokens in every document."""
    return align.align_documents(table(spark, sf_dir, "documents"))
