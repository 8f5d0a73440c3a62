"""Queries of this package over the driver tables, with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import chat, decontaminate, html_text, licenses, ngram_join, packing, periodic, quality, sharding, spellings, substrings, token_counts, url_rules
from argentum.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(pin(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t),
s AS (SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM s WHERE w3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS x(k) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
shout AS (SELECT doc_id, count(*) AS n FROM w WHERE regexp_matches(word, '^\P{Ll}*\p{Lu}\P{Ll}*[!?]+$') GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(shout.n, 0) AS n_shouts
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN shout USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
  + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (100 * n_shouts > 30 * n_words)::BIGINT
  + 32 * (n_words > 0 AND NOT word_chars BETWEEN 2 * n_words AND 20 * n_words)::BIGINT + 64 * (n_words > 1000000)::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed FROM f
"""


@query("op7_quality_rules", _QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


_CONTROL_RE = "|".join(chat._literal(x) for x in chat.CONTROLS)
_CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\]', '', 'g'))
  + len(regexp_extract_all(role, '{_CONTROL_RE}')) + len(regexp_extract_all(text, '{_CONTROL_RE}')) + {len(chat.TURN + chat.TEXT + chat.END)} AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op8_chat_formatting", _CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), said.alias("prompt"), said.alias("completion"))
    convs = chat.gather_turns(table(spark, sf_dir, "conversations")).unionByName(probe, allowMissingColumns=True)
    rows = chat.format_turns(chat.canonical_turns(convs)).select("conv_id", "formatted", "loss_spans")
    read = rows.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op10_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op9_sharding")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


_SPACED_RE = r"[^\x20\x09-\x0D]+"
_WORDS_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LEAKS_SQL = rf"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_RE}') AS w FROM benchmark),
g AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(10, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_RE}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT x.doc_id, x.i, k.n, string_agg(x.word, ' ') OVER (PARTITION BY x.doc_id, k.n ORDER BY x.i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten,
  count(*) OVER (PARTITION BY x.doc_id, k.n ORDER BY x.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM x, (SELECT DISTINCT n FROM g) AS k),
o AS (SELECT s.doc_id, s.i, s.n, g.item FROM s JOIN g ON s.n = g.n AND s.rest >= s.n AND g.win = array_to_string(string_split(s.ten, ' ')[1:s.n], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op2_benchmark_decontamination", _LEAKS_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op1_license_scan")
def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op6_html_extraction")
def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


_REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED_RE}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, i, string_agg(word, ' ') OVER o AS win, count(*) OVER o AS n FROM x
  WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM s WHERE n = 20),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM f, range(20) AS r(k) WHERE again)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(g.i)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY d.doc_id, len(d.w)
"""


@query("op5_substring_dedup", _REPEATS_SQL)
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


_CLASSES_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACED_RE}') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, size, i, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS n FROM x
  WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, g FROM s WHERE n = 4 OR (size < 4 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op4_ngram_jaccard_join", _CLASSES_SQL)
def ngram_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in url_rules.LISTED)
_URLS_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS no, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT no, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
t AS (SELECT DISTINCT no, token FROM (
  SELECT no, 'h=' || unnest(string_split(host, '.')) AS token FROM p
  UNION ALL SELECT no, 'p=' || regexp_replace(unnest(string_split(path, '/')), '[0-9]+', '0', 'g') FROM p
  UNION ALL SELECT no, 'q=' || regexp_extract(part, '^[^=]*') FROM (SELECT no, unnest(string_split(query, '&')) AS part FROM p) WHERE part <> '') WHERE token NOT IN ('h=', 'p=')),
said AS (SELECT doc_id, CASE WHEN bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) THEN 'block' ELSE 'allow' END AS verdict FROM labels GROUP BY doc_id),
own AS (SELECT no, verdict FROM p JOIN said ON doc_id = page_id WHERE no IN (SELECT no FROM t)),
least AS (SELECT greatest({url_rules.MIN_ROWS}, ceil(count(*) * {url_rules.PER_MILLE} / 1000.0)) AS r FROM own),
often AS (SELECT token, count(*) AS n FROM own JOIN t USING (no) GROUP BY token HAVING count(*) >= (SELECT r FROM least)),
b AS (SELECT no, verdict, token FROM (SELECT no, verdict, token, row_number() OVER (PARTITION BY no ORDER BY n, token) AS k FROM own JOIN t USING (no) JOIN often USING (token)) WHERE k <= {url_rules.PER_BASKET}),
sets AS (SELECT no, verdict, [token] AS items FROM b
  UNION ALL SELECT x.no, x.verdict, [x.token, y.token] FROM b AS x JOIN b AS y ON x.no = y.no AND x.token < y.token
  UNION ALL SELECT x.no, x.verdict, [x.token, y.token, z.token] FROM b AS x JOIN b AS y ON x.no = y.no AND x.token < y.token JOIN b AS z ON x.no = z.no AND y.token < z.token),
alone AS (SELECT items, count(*) AS freq FROM sets GROUP BY items),
rules AS (SELECT items, verdict, n / freq AS confidence, n FROM (SELECT items, verdict, count(*) AS n FROM sets GROUP BY ALL) JOIN alone USING (items)
  WHERE n >= (SELECT r FROM least) AND 100 * n >= {url_rules.CONFIDENCE} * freq ORDER BY confidence DESC, n DESC, items, verdict LIMIT {url_rules.MOST_RULES}),
kept AS (SELECT items, verdict, confidence, n FROM rules AS a WHERE NOT EXISTS (SELECT 1 FROM rules AS c WHERE c.verdict = a.verdict AND len(c.items) < len(a.items) AND list_has_all(a.items, c.items) AND c.confidence >= a.confidence)),
has AS (SELECT no, list(token) AS tokens FROM t GROUP BY no),
fires AS (SELECT no, array_to_string(items, ' ') AS mined_rule, confidence, verdict FROM (
  SELECT has.no, items, confidence, verdict, row_number() OVER (PARTITION BY has.no ORDER BY confidence DESC, n DESC, items, verdict) AS k
  FROM t JOIN kept ON items[1] = token JOIN has ON has.no = t.no WHERE list_has_all(tokens, items)) WHERE k = 1),
listed AS (SELECT no, rule, verdict FROM (SELECT no, h || x AS rule, l.verdict, row_number() OVER (PARTITION BY no ORDER BY length(h || x) DESC, length(h) DESC) AS k
  FROM p JOIN (VALUES {_LISTED}) AS l(h, x, verdict) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x)) WHERE k = 1)
SELECT page_id, host, path, rule, coalesce(listed.verdict, fires.verdict, '{url_rules.DEFAULT}') AS verdict, mined_rule, confidence
FROM p LEFT JOIN listed USING (no) LEFT JOIN fires USING (no)
"""


@query("op11_url_filters", _URLS_SQL)
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, mined=url_rules.mined_rules(url_rules.labelled_urls(pages, table(spark, sf_dir, "labels"))))


#: CRC-32 of a list of bytes, by a table that SQL makes itself.
_CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295)"


_SPELLINGS_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY doc, run),
h AS (SELECT run, n, {_crc("flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, 64 + ord(x) - 128] END))")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
gaps AS (SELECT word, left(word, i - 1) || '_' || substr(word, i + 1) AS gap FROM e),
cut AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS less FROM e),
pairs AS (
  SELECT a.word, b.word AS near FROM gaps AS a JOIN gaps AS b ON a.gap = b.gap AND a.word <> b.word
  UNION ALL SELECT cut.word, less FROM cut JOIN v ON v.word = less
  UNION ALL SELECT less, cut.word FROM cut JOIN v ON v.word = less),
best AS (SELECT pairs.word, near, v.n, count(*) OVER (PARTITION BY pairs.word) AS n_near, row_number() OVER (PARTITION BY pairs.word ORDER BY v.n DESC, near) AS k FROM pairs JOIN v ON v.word = near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * v.n THEN near END AS form, CASE WHEN best.n >= 5 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
ways(word, root, more) AS (SELECT word, word, form FROM f UNION ALL SELECT ways.word, f.word, f.form FROM ways JOIN f ON f.word = ways.more)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN ways ON ways.word = f.word AND more IS NULL
"""


@query("op12_spelling_variants", _SPELLINGS_SQL)
def spellings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.group_spellings(table(spark, sf_dir, "documents"))


_RUNS_SQL = rf"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED_RE}') AS w,
  {_crc("list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ord(x)::BIGINT)")} AS h FROM documents, crc),
a AS (SELECT no, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
s AS (SELECT *, 1 + (n - a) // parts AS p FROM a),
x AS (SELECT no, i, w[1 + CASE WHEN tail AND i >= a THEN a + (i - a) % p ELSE i END] AS word, n FROM (SELECT *, unnest(range(n)) AS i FROM s)),
same AS (SELECT x.no, x.i, y.i - x.i AS q FROM x JOIN x AS y ON x.no = y.no AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT no, q, min(i) AS start, max(i) + 1 + q AS stop FROM (SELECT no, q, i, i - row_number() OVER (PARTITION BY no, q ORDER BY i) AS g FROM same) GROUP BY no, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM isle AS r WHERE NOT EXISTS (SELECT 1 FROM isle AS o WHERE o.no = r.no AND o.q < r.q AND o.start <= r.start AND o.stop >= r.stop)),
said AS (SELECT no, count(*) AS n_runs, string_agg(start || ',' || (stop - start) || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM runs GROUP BY no),
best AS (SELECT no, start, stop - start AS length, q, row_number() OVER (PARTITION BY no ORDER BY stop - start DESC, start, q) AS k FROM runs),
gone AS (SELECT DISTINCT no, i FROM (SELECT no, unnest(range(start + q, stop)) AS i FROM runs)),
kept AS (SELECT x.no, string_agg(word, ' ' ORDER BY x.i) AS left_over FROM x LEFT JOIN gone ON gone.no = x.no AND gone.i = x.i WHERE gone.i IS NULL GROUP BY x.no)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM d LEFT JOIN said USING (no) LEFT JOIN best ON best.no = d.no AND k = 1 LEFT JOIN kept ON kept.no = d.no
"""


@query("op13_periodic_runs", _RUNS_SQL)
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect_runs(table(spark, sf_dir, "documents"), plant=True)
