"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate
from .decontaminate import decontaminate
from .exact import exact_dedup
from .interaction import filter_audit
from .language import language_id
from .pieces import encode
from .quality import classify_quality
from .rules import quality_rules
from .secrets import scan_secrets
from .shared import table
from .simhash import near_dedup
from .spelling import spelling_variants
from .substrings import substring_dedup
from .tokens import token_counts


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""".replace("\'", "''")


def _secret_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: one row per passing match, from the gaps that the pattern leaves and the matches in turn."""
    return f"""
SELECT doc_id, begin AS s, {rank} AS k, '{kind}:' || begin || ':' || (begin + length(m[i])) AS span FROM (
  SELECT doc_id, m, g, i, list_sum(list_transform(x[1 : i], lambda e: length(e))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda e: length(e))), 0) AS begin
  FROM (SELECT doc_id, m, g, x, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS x
    FROM d WHERE regexp_matches(t, '{pattern}')))
) WHERE length(g[i]) >= {least}"""


_SECRETS = [
    ("assign", _ASSIGN, 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("git_token", "(?:gh[opsur]_|glpat-)[A-Za-z0-9_-]{20,}", 0, 1),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35,}", 0, 1),
    ("pay_key", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
]

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_secret_spans(kind, rank, *rule) for rank, (kind, *rule) in enumerate(_SECRETS))}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {rank}) AS n_{kind}" for rank, (kind, *_) in enumerate(_SECRETS))},
      string_agg(span, ',' ORDER BY s, k) AS spans, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in _SECRETS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
x AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM c GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept
      FROM (SELECT d.doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) AS a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN e ON d.doc_id = e.doc_id
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (SELECT *, (k - 1) // 1024 AS piece FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c)),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> 'system'),
m AS (SELECT n.*, speaker, n.role = speaker AS own,
        '<|im_start|>' || CASE WHEN n.role = speaker THEN 'assistant' WHEN n.role = 'system' THEN 'system' ELSE 'user name=' || n.role END || chr(10) AS head,
        n.text || '<|im_end|>' AS body FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER w, 0) + length(head) AS begin
      FROM m WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, speaker, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
  string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(begin AS BIGINT) || ':' || CAST(begin + length(body) AS BIGINT), ',' ORDER BY k) FILTER (own), '') AS masks
FROM o GROUP BY conv_id, speaker, piece
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS earliest FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(d.doc_id > earliest, false)} AS x
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM c AS a, c AS b, c AS g, c AS h, c AS i
      WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
r AS (SELECT part, good, toxic, x, filter_order, coalesce(list_position(list_transform(string_split(filter_order, ''), lambda k: x[ascii(k) - 64]), true), 6) AS gone
      FROM (SELECT part, good, toxic, [x.A, x.B, x.C, x.D, x.E] AS x FROM f), o),
s AS (SELECT *, substr(filter_order, step, 1) AS letter, x[ascii(substr(filter_order, step, 1)) - 64] AS fails, len(list_filter(x, lambda k: k)) AS n_fails
      FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
g AS (SELECT part, filter_order, step, letter, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
             count(*) FILTER (fails AND gone < step) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails,
             count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
      FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z0-9\x{80}-\x{10FFFF}]'))) AS n_bare_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{2022}]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_cut_lines
      FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 2 * n_words OR word_chars > 12 * n_words, 10 * n_symbols > n_words,
                 10 * n_dup_lines > 3 * n_lines, 5 * n_bare_words > n_words, 10 * n_capitals > 3 * word_chars, 10 * n_bullet_lines > 9 * n_lines,
                 10 * n_cut_lines > 3 * n_lines] AS x FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, x[1] OR x[2] AS base_failed,
       NOT (x[1] OR x[2] OR x[4] OR x[6] OR x[7]) AND len(list_filter([x[3], x[5], x[8], x[9]], lambda k: k)) <= 1 AS kept,
       CAST(list_sum(list_transform(x, lambda k, i: CASE WHEN k THEN 1 << (i - 1) ELSE 0 END)) AS BIGINT) AS bits,
       n_lines, n_bare_words, n_capitals, n_bullet_lines, n_cut_lines, NOT (x[1] OR x[2]) AS kept_base_1,
       NOT (x[1] OR x[2] OR x[3] OR x[4] OR x[5] OR x[6] OR x[7]) AS kept_general_1, kept AS kept_general_2
FROM f
"""


def _misspelt(doc: Column, run: Column) -> Column:
    """Of one in 199 runs, told by a checksum of document and run, one code point is left out."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(199)) == 0, less).otherwise(run)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), respell=_misspelt)


OP13_SQL = r"""
WITH RECURSIVE k AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS tab
      FROM (SELECT unnest(range(256)) AS i)),
x AS (SELECT doc_id, run, count(*) AS m FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
      GROUP BY ALL),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 | (unicode(c) >> 6) AS BIGINT), CAST(128 | (unicode(c) & 63) AS BIGINT)] END))),
        lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM x, k),
v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (
        SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS wild, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM s),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM c AS a JOIN c AS b ON a.wild = b.wild AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM c AS a JOIN v AS b ON a.less = b.word
      UNION SELECT a.word, b.word, b.n FROM v AS a JOIN c AS b ON b.less = a.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM e GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
      FROM v LEFT JOIN b ON v.word = b.word),
w AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT w.word, w.next, f.form FROM w JOIN f ON w.next = f.word)
SELECT f.word, form, w.at AS root, n, n_near, form_n FROM f JOIN w ON f.word = w.word WHERE w.next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_secret_scan": op4_secret_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_simhash": op7_simhash,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_quality": op10_quality,
        "op11_filter_audit": op11_filter_audit,
        "op12_quality_rules": op12_quality_rules,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_secret_scan": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_spelling_variants": OP13_SQL}
