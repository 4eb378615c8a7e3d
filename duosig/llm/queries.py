"""The operators over whole tables with production parameters, as registered queries, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, language_id, license_scan, mixing, ngram_join, periodic, pii, quotation, secret_scan, spans, url_filter, warc

#: rule, verdict
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Target weights of sources in the mixture; others weigh 1.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}

#: Vocabulary files of the two tokenizers whose tokens are aligned.
BYTE_TOKENIZER, PIECE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(rule, verdict)")


def sha_of(listed: Column) -> Column:
    return F.sha2(listed.cast("binary"), 256)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_rules(spark))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    every = spans.listed(F.concat("base", "live"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", sha_of(spans.listed(F.col("base"))).alias("base_sha256"), every.alias("spans"), F.size("live").cast("long").alias("n_live"), "examples", F.size("base").cast("long").alias("n_spans"))


def op3_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.revisit_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=SOURCE_WEIGHTS)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha_of(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_language(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotations(table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    every = spans.listed(F.concat(plain("base"), plain("added")))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], sha_of(spans.listed(plain("base"))).alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base, held = F.filter("spans", lambda s: s["base"]), F.col("spans")
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts, shares = F.transform(base, lambda s: s["start"]), F.transform(held, lambda s: s["share"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(held).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"), F.size(held).cast("long").alias("n_spans"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, drawn by their ids, repeat a stretch of their words from some word on to their end."""
    # Without blanks at either end, so that the pieces are the words.
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    drawn = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"), words.alias("_w")).withColumn("_n", F.size("_w"))
    rows = drawn.withColumns({"_g": F.floor(F.col("_h") / 10)}).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)")).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    again = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[int(_a + (i - _a) % _p)])), ' ')")
    return rows.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    # The greatest length / period, as a fraction: no other run has a greater one, and of equal ones the first by start and period counts.
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), sha_of(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), sha_of(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", F.expr("1000 * _b.length div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_secret_scan, op3_warc_revisit, op4_exact_dedup, op5_mixing, op6_decontaminate, op7_ngram_join, op8_language_id, op9_quotation_linking, op10_pii, op11_license_scan, op12_alignment, op13_periodic_runs]
    return {f.__name__: f for f in own}


_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)
_FOLD = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"

#: Canonical links and refreshes in pages would add verdicts by alias, which a recursive query over them expresses.
OP1_SQL = rf"""
WITH RECURSIVE rules(rule, verdict) AS (VALUES {_RULES}),
split AS (SELECT page_id, url, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), {_FOLD}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  translate(regexp_extract(rest, '^[^/?#]*', 0), {_FOLD}) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node FROM split),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>', 0)) AS tag FROM named),
targets AS (SELECT node, regexp_extract(tag, '(?i)(?:\shref\s*=\s*["'']?|;\s*url\s*=\s*["'']?)([^"''\s>]+)', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh\b')),
edges AS (SELECT node AS u, translate(regexp_extract(split_part(target, '://', 2), '^[^/?#]*', 0), {_FOLD}) || regexp_extract(split_part(target, '://', 2), '^[^/?#]*([^#]*)', 1) AS v FROM targets WHERE instr(target, '://') > 0),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
nodes AS (SELECT DISTINCT node, host, path FROM named WHERE host <> '' UNION SELECT DISTINCT v, regexp_extract(v, '^[^/?#]*', 0), regexp_extract(v, '^[^/?#]*([^?]*)', 1) FROM edges),
fits AS (SELECT n.host, n.path, r.rule, r.verdict, row_number() OVER (PARTITION BY n.host, n.path ORDER BY length(r.rule) DESC, r.rule DESC) AS k
  FROM (SELECT DISTINCT host, path FROM nodes) n JOIN rules r
  ON (n.host = split_part(r.rule, '/', 1) OR ends_with(n.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(n.path, substr(r.rule, instr(r.rule, '/')))),
best AS (SELECT host, path, rule, verdict FROM fits WHERE k = 1),
bad(node) AS (SELECT n.node FROM nodes n JOIN best b ON n.host = b.host AND n.path = b.path WHERE b.verdict = 'block'
  UNION SELECT ways.v FROM bad JOIN ways ON ways.u = bad.node),
linked AS (SELECT DISTINCT node FROM bad WHERE node IN (SELECT u FROM ways))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN l.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  b.rule IS NULL AND l.node IS NOT NULL AS aliased
FROM named p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN linked l ON p.node = l.node
"""

OP3_SQL = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hashed AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM payloads),
parts AS (SELECT *, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(hex, 10 * k + 1, 10))::BIGINT) AS part FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((part[(i // 8) + 1] >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts
"""

OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""

OP7_SQL = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x20\x09-\x0D]+', 0) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM texts),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sets s
"""


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_QUOTED_KEY = _KEY.replace("'", "''")

#: Spans stand where the lengths of the matches and of the pieces of text between them put them.
OP2_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(lang, '') AS repository, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT r, 0 AS k, 'assign' AS kind, regexp_extract_all(t, '(?i:{_QUOTED_KEY})', 0) AS f, string_split_regex(t, '(?i:{_QUOTED_KEY})') AS s FROM texts
  UNION ALL SELECT r, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM texts
  UNION ALL SELECT r, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+', 0), string_split_regex(t, '[0-9a-f]+') FROM texts),
places AS (SELECT r, k, kind, f[i] AS v, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
  FROM found, unnest(range(1, len(f) + 1)) AS u(i)),
base AS (SELECT r, k, kind, a, a + length(v) AS b, CASE WHEN kind = 'assign' THEN regexp_extract(v, '(?i:{_QUOTED_KEY})', 2) ELSE v END AS secret FROM places
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(v, '(?i:{_QUOTED_KEY})', 2)) >= 6 WHEN 'access' THEN length(v) >= 20 ELSE length(v) >= 24 END),
owned AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM base JOIN texts USING (r) GROUP BY secret),
judged AS (SELECT base.*, owners <= {secret_scan.MAX_OWNERS} AND repositories <= {secret_scan.MAX_REPOSITORIES} AS alone FROM base JOIN owned USING (secret)),
live AS (SELECT DISTINCT r, 3 AS k, 'live' AS kind, b - length(secret) AS a, b FROM judged WHERE alone AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]') AND length(secret) >= 8),
every AS (SELECT r, k, kind, a, b FROM judged UNION ALL SELECT r, k, kind, a, b FROM live),
listed AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k < 3) AS n_spans, count(*) FILTER (k = 3) AS n_live,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans FROM every GROUP BY r),
widely AS (SELECT r, count(*) AS examples FROM judged WHERE NOT alone GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(examples, 0) AS examples, coalesce(n_spans, 0) AS n_spans
FROM texts LEFT JOIN listed USING (r) LEFT JOIN widely USING (r)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6_SQL = rf"""
WITH item_words AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_WORD}', 0) AS w FROM benchmark),
sized AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM sized, unnest(range(1, len(w) - n + 2)) AS u(i)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_WORD}', 0) AS w FROM documents),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT DISTINCT r, i, p.n, item_id FROM places p JOIN windows w ON p.n = w.n AND p.k = w.k),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(n)) AS u(j) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM found WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

_SPACE = r"[ \t\n\x0B\f\r]"

#: Passages before lines, as the operator links them; whole conversations are looked at, with or without quotations.
OP9_SQL = rf"""
WITH RECURSIVE messages AS (SELECT row_number() OVER () AS m, conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS t FROM conversations),
split AS (SELECT m, string_split_regex(t, '\r\n|\n|\r') AS parts FROM messages),
marked AS (SELECT m, i, regexp_extract(parts[i], '^[ \t>]*>') AS mark, trim(regexp_replace(parts[i], '^[ \t>]*>', '')) AS said FROM split, unnest(range(1, len(parts) + 1)) AS u(i)),
lines AS (SELECT m, i, length(regexp_replace(mark, '[^>]', '', 'g')) AS depth, said, trim(regexp_replace(lower(said), '{_SPACE}+', ' ', 'g')) AS norm FROM marked),
ahead AS (SELECT *, lead(depth) OVER (PARTITION BY m ORDER BY i) AS next FROM lines),
own_lines AS (SELECT m, i, said FROM ahead WHERE depth = 0 AND NOT (coalesce(next, 0) > 0 AND length(said) <= {quotation.INTRODUCTION_CHARS} AND regexp_matches(said, '{quotation.INTRODUCTION}'))),
whole AS (SELECT m, max(depth) > 0 AS quotes FROM lines GROUP BY m),
joined AS (SELECT m, string_agg(said, chr(10) ORDER BY i) AS text FROM own_lines GROUP BY m),
own AS (SELECT m, conv_id, turn, role, CASE WHEN quotes THEN regexp_replace(coalesce(text, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE t END AS text FROM messages JOIN whole USING (m) LEFT JOIN joined USING (m)),
own_split AS (SELECT m, string_split_regex(text, '\r\n|\n|\r') AS parts FROM own),
own_norm AS (SELECT m, i, 0 AS depth, trim(regexp_replace(lower(trim(parts[i])), '{_SPACE}+', ' ', 'g')) AS norm FROM own_split, unnest(range(1, len(parts) + 1)) AS u(i)),
both_lines AS (SELECT m, i, depth, norm, true AS q FROM lines UNION ALL SELECT m, i, depth, norm, false FROM own_norm),
starts AS (SELECT *, CASE WHEN lag(depth) OVER w = depth AND lag(norm) OVER w <> '' THEN 0 ELSE 1 END AS new FROM both_lines WINDOW w AS (PARTITION BY q, m ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY q, m ORDER BY i) AS p FROM starts),
passages AS (SELECT q, m, p, depth, string_agg(norm, ' ' ORDER BY i) AS k, count(*) AS n, list(norm) AS norms FROM numbered WHERE norm <> '' AND (depth > 0) = q GROUP BY q, m, p, depth),
units AS (SELECT q, m, p, depth, true AS whole, n, k FROM passages UNION ALL SELECT q, m, p, depth, false, 1, unnest(norms) FROM passages WHERE n > 1),
said AS (SELECT DISTINCT conv_id, turn, k FROM units JOIN own USING (m) WHERE NOT q AND turn IS NOT NULL),
met AS (SELECT u.m, u.p, u.depth, u.whole, u.n, u.k, (SELECT max(s.turn) FROM said s WHERE s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.k = u.k AND s.turn < o.turn) AS origin FROM units u JOIN own o USING (m) WHERE u.q AND o.turn IS NOT NULL),
by_passage AS (SELECT m, p, depth, max(origin) FILTER (whole) AS w, max(n) FILTER (whole) AS wn, max(origin) FILTER (NOT whole) AS l, count(origin) FILTER (NOT whole) AS ln FROM met GROUP BY m, p, depth),
linked AS (SELECT m, depth, coalesce(w, l) AS origin, CASE WHEN w IS NOT NULL THEN wn ELSE ln END AS n FROM by_passage WHERE coalesce(w, l) IS NOT NULL),
heads AS (SELECT m, arg_min(origin, (depth, -origin)) AS reply_to, sum(n)::BIGINT AS n_linked FROM linked GROUP BY m),
links AS (SELECT conv_id, turn, max(reply_to) AS top FROM heads JOIN own USING (m) GROUP BY conv_id, turn),
chain(conv_id, turn, top) AS (SELECT * FROM links UNION SELECT c.conv_id, c.turn, l.top FROM chain c JOIN links l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.top = l.turn),
tops AS (SELECT conv_id, turn, min(top) AS top FROM chain GROUP BY conv_id, turn),
counts AS (SELECT m, sum(n)::BIGINT AS n_quoted, max(depth) AS depth FROM passages WHERE q GROUP BY m),
every AS (SELECT o.conv_id, o.turn, o.role, o.text, h.reply_to, coalesce(t.top, o.turn) AS thread, coalesce(c.n_quoted, 0) AS n_quoted, coalesce(h.n_linked, 0) AS n_linked, coalesce(c.depth, 0) AS depth
  FROM own o LEFT JOIN heads h USING (m) LEFT JOIN counts c USING (m) LEFT JOIN tops t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.turn = o.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role, md5(text)) - 1 AS position FROM every
"""

_KNOWN = ", ".join(f"({i}, '{label}', {base}, string_split('{text}', ' '))" for i, (label, text, base) in enumerate([(*x, True) for x in license_scan.PHRASES] + [(*x, False) for x in license_scan.WORDINGS]))

OP11_SQL = rf"""
WITH known(template, label, base, w) AS (VALUES {_KNOWN}),
sized AS (SELECT *, len(w) AS size, CASE WHEN base THEN {license_scan.SHORT} ELSE {license_scan.LONG} END AS k, base OR len(w) < {license_scan.LOOSE_WORDS} AS whole FROM known),
known_grams AS (SELECT template, label, base, whole, size, k, i - 1 AS tpos, array_to_string(w[i:i + k - 1], ' ') AS g FROM sized, unnest(range(1, size - k + 2)) AS u(i)),
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_WORD}', 0) AS w FROM documents),
grams AS (SELECT r, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g FROM texts, (SELECT DISTINCT k FROM sized) AS sizes, unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT r, template, label, base, whole, size, g.k, pos, tpos, pos - tpos AS off FROM grams g JOIN known_grams t ON g.k = t.k AND g.g = t.g),
diagonals AS (SELECT DISTINCT r, template, whole, size, off FROM hits),
cut AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY r, template ORDER BY off) <= CASE WHEN whole THEN 0 ELSE size // 10 END THEN 0 ELSE 1 END AS new FROM diagonals),
bands AS (SELECT r, template, off, sum(new) OVER (PARTITION BY r, template ORDER BY off) AS band FROM cut),
spans AS (SELECT r, template, label, base, whole, size, band, min(pos) AS a, max(pos) + k AS b, count(DISTINCT tpos + j) AS n
  FROM hits JOIN bands USING (r, template, off), unnest(range(0, k)) AS u(j) GROUP BY r, template, label, base, whole, size, k, band),
held AS (SELECT r, label, base, a, n / size AS share FROM spans WHERE 100 * n >= CASE WHEN whole THEN 100 ELSE {license_scan.LEAST_PERCENT} END * greatest(size, b - a)),
listed AS (SELECT r, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, max(share) AS score, count(*) AS n_spans,
  list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label)) AS labels FROM held GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans
FROM texts LEFT JOIN listed USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1_SQL, "op2_secret_scan": OP2_SQL, "op3_warc_revisit": OP3_SQL, "op4_exact_dedup": OP4_SQL,
        "op6_decontaminate": OP6_SQL, "op7_ngram_join": OP7_SQL, "op9_quotation_linking": OP9_SQL, "op11_license_scan": OP11_SQL,
    }
