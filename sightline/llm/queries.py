"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontaminate, html_extract, language_id, licenses, mixing, near_dedup, secrets, token_files, url_filter
from .common import Workspace

TOKENIZER = "word_bpe_49k.json"
#: Rules of the URL filter, and the words that put a host on the block list.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LISTED_WORDS = ("casino", "poker", "porn", "xxx", "viagra", "lottery", "warez")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Workspace(spark, 'op1').path}/tokens"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.digest(token_files.read_token_files(spark, folder))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    host = url_filter.url_parts(F.col("url"))[0]
    listed = pages.select(host.alias("host")).distinct().where(F.col("host").rlike(r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"))
    return url_filter.judge_urls(pages, listed, URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(_table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_topk_search": op4_topk_search,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_html_extract": op8_html_extract,
    "op9_secrets": op9_secrets,
    "op10_near_dedup": op10_near_dedup,
}

_ASCII_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_ASCII_LOWER.format("text"))


def _rules_sql() -> tuple[str, str]:
    rules, verdicts = [], []
    for kind, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rules.append(f"{fits} THEN '{text}'")
        verdicts.append(f"{fits} THEN '{kind}'")
    return " ".join(rules), " ".join(verdicts)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _notices_sql() -> str:
    return ", ".join(f"('{label}', {_list(sorted(set(text.split())))}, {len(text.split())}, {licenses.drift(len(text.split()))})" for label, (text, _) in licenses.TEMPLATES.items())


def _keys_sql() -> str:
    seen: dict[str, int] = {}
    rows = []
    for label, at, phrase in licenses.key_phrases(licenses.TEMPLATES):
        seen[label] = seen.get(label, -1) + 1
        rows.append(f"('{label}', {seen[label]}, {at}, {_list(phrase)})")
    return ", ".join(rows)


def _phrases_sql() -> str:
    return ", ".join(f"('{label}', {_list(phrase.split())})" for phrase, label in licenses.BASE_PHRASES.items())


def _kinds_sql() -> str:
    kinds = [*secrets.BASE, ("run", secrets.CANDIDATE, 0, 20)]
    parts = []
    for number, (_, pattern, group, _) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT r, {number} AS kind, regexp_extract_all(text, '{quoted}') AS found, regexp_extract_all(text, '{quoted}', {group}) AS sized, string_split_regex(text, '{quoted}') AS gaps FROM d")
    return " UNION ALL ".join(parts)


def _alphabets_sql() -> str:
    return " ".join(f"WHEN regexp_full_match(rtrim(match, '='), '[{letters.replace('+/-_', '+/_-')}]+') THEN '{letters}'" for _, letters in secrets.ALPHABETS)


def _tail_sql(z: str) -> str:
    z = f"greatest(-12.0::DOUBLE, least(12.0::DOUBLE, {z}))"
    return f"(1 / (1 + exp(1.5976::DOUBLE * {z} + 0.07056::DOUBLE * {z} * {z} * {z})))"


ORACLES: dict[str, str] = {
    "op2_url_filter": rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_ASCII_LOWER.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut)
SELECT page_id, host, path, CASE {_rules_sql()[0]} END AS rule,
  coalesce(CASE {_rules_sql()[1]} END, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM parts""",
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[q : q + least(len(w), 13) - 1], ' ') AS win FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(q) WHERE len(w) > 0),
doc_windows AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM item_windows) AS k, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
met AS (SELECT doc_id, s, n, item_id FROM doc_windows JOIN item_windows USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS h FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || md5(coalesce(text, ''))), 1, 8))::BIGINT AS h FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
s AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE turn WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0 END::DOUBLE AS raw_slope FROM n),
-- Sources in the order in which a rising level fills them: with the first k full, the rest shares what is left by weight.
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2 * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
c AS (SELECT min(k) AS k, min_by(level, k) AS level FROM l WHERE level < full_at),
g AS (SELECT source, source_size, n, raw_slope, CASE WHEN c.k IS NULL OR l.k < c.k THEN 2.0::DOUBLE * source_size ELSE c.level * w END AS target FROM l, c),
-- Each source's schedule: target * (1 + slope * (2t - 1)), the slopes centred so that all rates add up to the total.
t AS (SELECT *, sum(target) OVER () AS total, raw_slope - sum(target * raw_slope) OVER () / nullif(sum(target) OVER (), 0) AS slope FROM g),
r AS (SELECT d.*, t.source_size, t.target, t.total, t.slope, CASE WHEN size > 0.01::DOUBLE * target THEN -1 ELSE h % CAST(ceil(n / 5000.0) AS BIGINT) END AS bucket, CASE WHEN size > 0.01::DOUBLE * target THEN -size ELSE 0 END AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, first, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
-- The time t at which slope * t^2 + (1 - slope) * t is the share of the target that lies before the document.
a AS (SELECT *, 2 * start + size < 2 * target AS once, size > 0 AND 2 * (start + source_size) + size < 2 * target AS twice, CASE WHEN start > 0 THEN 2 * (start / target) / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) ELSE 0 END AS moment FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (once::INTEGER + twice::INTEGER) AS BIGINT) AS taken, CASE WHEN once THEN CAST(round(total * moment) AS BIGINT) END AS position FROM a""",
    "op7_licenses": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
-- Every place of every key phrase, and where its notice would begin by it; a notice is where all its phrases agree.
notices AS (SELECT * FROM (VALUES {_notices_sql()}) AS t(template, notice, size, slack)),
keys AS (SELECT * FROM (VALUES {_keys_sql()}) AS t(template, nth, start, phrase)),
firsts AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p) WHERE w[p] IN (SELECT phrase[1] FROM keys)),
standing AS (SELECT r, template, nth, p - 1 - start AS begin FROM firsts JOIN keys ON keys.phrase[1] = word JOIN d USING (r) WHERE d.w[p : p + len(phrase) - 1] = phrase),
agreed AS (SELECT s.r, s.template, s.begin, n.notice, n.size, n.slack FROM standing s JOIN notices n USING (template) WHERE s.nth = 0
  AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.template = s.template AND NOT EXISTS (SELECT 1 FROM standing o WHERE o.r = s.r AND o.template = s.template AND o.nth = k.nth AND abs(o.begin - s.begin) <= n.slack))),
found AS (SELECT r, template, len(list_intersect(notice, d.w[greatest(begin, 0) + 1 : greatest(begin, 0) + size + slack])) / len(notice)::DOUBLE AS share FROM agreed JOIN d USING (r)),
base AS (SELECT r, p - 1 AS pos, label FROM d, unnest(range(1, len(w) + 1)) AS t(p), (VALUES {_phrases_sql()}) AS b(label, phrase) WHERE w[p : p + len(phrase) - 1] = phrase),
by_base AS (SELECT r, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
by_label AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, template FROM found) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  greatest(CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(best.share, 0)::DOUBLE) AS score FROM d LEFT JOIN by_base b USING (r) LEFT JOIN by_label l USING (r) LEFT JOIN best USING (r)""",
    "op9_secrets": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
found AS ({_kinds_sql()}),
each AS (SELECT r, kind, unnest(range(1, len(found) + 1)) AS nth, unnest(found) AS match, unnest(sized) AS counted, unnest(gaps[1 : len(found)]) AS gap FROM found WHERE len(found) > 0),
placed AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY r, kind ORDER BY nth) AS stop FROM each),
kept AS (SELECT r, kind, stop - length(match) AS start, stop, match FROM placed WHERE length(counted) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 WHEN 2 THEN 24 ELSE 20 END),
-- The battery: codes in the smallest alphabet that fits, and three tests against it.
runs AS (SELECT r, start, stop, rtrim(match, '=') AS body, CASE {_alphabets_sql()} END AS letters FROM kept WHERE kind = 3),
coded AS (SELECT *, list_transform(string_split(body, ''), lambda c: instr(letters, c) - 1) AS codes, length(letters)::DOUBLE AS k, length(body)::DOUBLE AS n FROM runs),
sums AS (SELECT *, list_transform(codes, lambda c: CASE WHEN 2 * c >= k - 1 THEN 1 ELSE 0 END) AS high, k / n * list_sum(list_transform(list_distinct(codes), lambda c: len(list_filter(codes, lambda x: x = c)) ** 2)) - n AS chi2,
  list_sum(list_transform(range(1, len(codes)), lambda i: (codes[i] - (k - 1) / 2) * (codes[i + 1] - (k - 1) / 2))) / ((k * k - 1) / 12 * sqrt(greatest(n - 1, 1))) AS z_serial FROM coded),
ones AS (SELECT *, list_sum(high)::DOUBLE AS n1, 1 + list_sum(list_transform(range(1, len(high)), lambda i: abs(high[i] - high[i + 1])))::DOUBLE AS runs FROM sums),
pairs AS (SELECT *, 2 * n1 * (n - n1) AS pair FROM ones),
spread AS (SELECT *, (pow(greatest(chi2, 1e-9) / (k - 1), 1 / 3.0::DOUBLE) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z_chi2, pair * (pair - n) / (n * n * greatest(n - 1, 1)) AS variance FROM pairs),
zs AS (SELECT *, CASE WHEN variance > 0 THEN (runs - (pair / n + 1)) / sqrt(greatest(variance, 1e-9)) ELSE sqrt(n) END AS z_runs FROM spread),
tested AS (SELECT *, least(1.0, 3 * least({_tail_sql("z_chi2")}, 2 * {_tail_sql("abs(z_runs)")}, 2 * {_tail_sql("abs(z_serial)")})) AS flat FROM zs),
-- Ordinary letters, and how improbably even each run is for them; the step-up rule on tenths of the logarithm.
letter AS (SELECT c, count(*)::DOUBLE AS n FROM (SELECT unnest(string_split(lower(body), '')) AS c FROM tested WHERE regexp_full_match(body, '[a-z]+|[A-Z]+|[A-Za-z]+') AND NOT regexp_full_match(body, '[0-9a-f]+|[0-9A-F]+')) GROUP BY c),
share AS (SELECT coalesce(sum((n / total) ** 2), {secrets.COINCIDENCE}) AS two, coalesce(sum((n / total) ** 3), {secrets.TRIPLE}) AS three FROM letter, (SELECT sum(n) AS total FROM letter)),
even AS (SELECT t.*, {_tail_sql("((k * ((n - 1) * two + 1) - n) - chi2) / sqrt(4 * k * k * n * greatest(three - two * two, 1e-6) + 2 * k * k * (two - 2 * three + two * two))")} AS p_text FROM tested t, share),
levels AS (SELECT floor(-10 * log10(p_text)) AS level, count(*) AS n FROM even GROUP BY 1),
cut AS (SELECT min(level) AS level FROM (SELECT level, sum(n) OVER (ORDER BY level DESC) AS above, sum(n) OVER () AS every FROM levels) WHERE every * pow(10, -level / 10) <= {secrets.RATE} * above),
random AS (SELECT r, 3 AS kind, start, stop FROM even, cut WHERE flat >= {secrets.REJECT} AND floor(-10 * log10(p_text)) >= cut.level),
base AS (SELECT r, kind, start, stop FROM kept WHERE kind < 3),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random q WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = q.r AND b.start < q.stop AND q.start < b.stop)),
named AS (SELECT r, kind, start, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'random' END || ':' || start || ':' || stop AS span FROM spans),
joined AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (r)""",
    "op10_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[q : q + 2], ' ') AS x FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS t(q) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""",
}
