"""One query per operator, each over the whole tables, and SQL twins where SQL
can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbside.llm import (
    decontamination,
    jaccard_join,
    language,
    mixing,
    periodic_runs,
    pii,
    quality_rules,
    quality_trees,
    suffix_dedup,
    token_alignment,
    toxicity,
    url_models,
    warc,
)
from curbside.llm.store import documents, table

def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_pages(table(spark, sf_dir, "pages"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(documents(spark, sf_dir))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judge_urls(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest_alignment(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_quality_trees": op7_quality_trees,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

# SQL twins.  Those without one are checked against brute force in the tests.

BLANKS = r"[ \t\n\x0B\f\r]+"

WORDS = f"""words AS (
  SELECT doc_id, text,
         list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w
  FROM documents)"""


def _count_of(characters: str) -> str:
    return (
        "length(coalesce(text, '')) - "
        f"length(regexp_replace(coalesce(text, ''), '[{characters}]', '', 'g'))"
    )


def _failed() -> str:
    bits = " | ".join(
        f"CASE WHEN {fails} THEN {1 << place} ELSE 0 END"
        for place, (_, fails) in enumerate(quality_rules.RULES)
    )
    return f"CAST({bits} AS BIGINT)"


QUALITY_SQL = f"""WITH {WORDS}, runs AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM words, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (
  SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) AS s(k) GROUP BY doc_id),
lined AS (
  SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)),
                        lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines FROM words),
measured AS (
  SELECT lined.doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         {_count_of("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         {_count_of("A-Za-z")} AS n_letters, {_count_of("A-Z")} AS n_upper, {_count_of("!")} AS n_exclaims
  FROM lined LEFT JOIN repeated ON repeated.doc_id = lined.doc_id),
ledger AS (SELECT *, {_failed()} AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & {quality_rules.mask("base")} <> 0 AS base_failed,
       failed & {quality_rules.mask("base") | quality_rules.mask("v1")} = 0 AS kept, failed
FROM ledger"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""WITH RECURSIVE {WORDS.replace("coalesce(text, '')", _LOWER)},
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
digests AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS digest FROM shingles GROUP BY doc_id),
classes AS (SELECT digest, min(doc_id) AS rep FROM digests GROUP BY digest),
held AS (SELECT doc_id, s FROM shingles WHERE doc_id IN (SELECT rep FROM classes)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (
  SELECT rep, rep FROM classes UNION SELECT r.node, e.b FROM reach r JOIN either e ON e.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN digests USING (doc_id)
LEFT JOIN classes USING (digest) LEFT JOIN least ON least.node = rep"""

CANONICAL = r"""lower(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*', 0), '^[Ww][Ww][Ww]\.', ''), ':(80|443)$', ''))
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(asked) = 0 THEN '' ELSE '?' || array_to_string(asked, '&') END"""

REVISITS_SQL = rf"""WITH bared AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') AS bare FROM pages),
parted AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                                  lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS asked FROM bared),
known AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, {CANONICAL} AS canonical,
         1700000000 + page_id * 60 AS first FROM parted),
later AS (
  SELECT *, first + page_id % 7 * 3600 + 30 AS ts,
         CASE WHEN page_id % 5 = 0 THEN 'old' WHEN page_id % 7 <> 0 THEN digest END AS tag FROM known),
joined AS (
  SELECT r.page_id * 2 + 1 AS record_id, r.url, r.canonical, r.ts, r.tag, f.page_id AS found,
         f.first AS found_ts, f.digest AS found_digest
  FROM later r LEFT JOIN known f ON f.canonical = r.canonical AND f.first < r.ts
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY f.first DESC NULLS LAST, f.page_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN found IS NULL THEN 'missing' WHEN tag IS NULL THEN 'unchecked'
                 WHEN tag = found_digest THEN 'resolved' ELSE 'changed' END AS outcome FROM joined)
SELECT record_id, url, canonical, ts, outcome, found * 2 AS refers_to, found_ts AS refers_to_ts,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN found_digest END AS digest,
       CASE WHEN outcome IN ('resolved', 'unchecked')
            THEN 'content-type: text/html' || chr(10) || 'date: t' || ts || chr(10) || 'etag: ' || found_digest
            END AS headers
FROM judged"""

def _url_case(result: str) -> str:
    """The rules as a CASE, the longest first."""
    rules = sorted(url_models.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') "
        f"THEN '{host + path if result == 'rule' else verdict}'"
        for verdict, host, path in rules
    )
    return f"CASE {cases} END"


def _url_level(k: int) -> str:
    """Chances of the last letter of the grams of k letters, in both models."""
    sums = ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in ("n", "allowed", "blocked"))
    seen = ", ".join(
        f"sum({s}) OVER c AS all_{s}, count(*) FILTER ({s} > 0) OVER c AS kinds_{s}" for s in ("allowed", "blocked")
    )
    chance = ", ".join(
        f"CASE WHEN all_{s} > 0 THEN ({s} + kinds_{s} * less_{s}) / (all_{s} + kinds_{s}) ELSE less_{s} END AS p_{s}"
        for s in ("allowed", "blocked")
    )
    if k == 1:
        less = "SELECT *, 1 / even AS less_allowed, 1 / even AS less_blocked FROM seen1"
    else:
        less = (
            f"SELECT seen{k}.*, s.p_allowed AS less_allowed, s.p_blocked AS less_blocked "
            f"FROM seen{k} JOIN chance{k - 1} s ON s.gram = right(seen{k}.gram, {k - 1})"
        )
    return f"""level{k} AS (SELECT right(gram, {k}) AS gram, {sums} FROM grams GROUP BY 1),
seen{k} AS (SELECT *, count(*) OVER c AS even, {seen} FROM level{k} WINDOW c AS (PARTITION BY left(gram, {k - 1}))),
less{k} AS ({less}), chance{k} AS (SELECT gram, {chance} FROM less{k})"""


_URL_ORDER, _URL_PAD = url_models.ORDER, f"repeat(chr({ord(url_models.START)}), {url_models.ORDER - 1})"
_URL_STEP = f"CAST(floor(score * {url_models.STEPS}) AS BIGINT)"

URL_SQL = f"""WITH rested AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rested),
split AS (SELECT *, {_url_case("rule")} AS rule, {_url_case("verdict")} AS ruled, host || path AS text FROM parted),
texts AS (SELECT text, max(ruled) AS ruled, max(ruled) IS NOT NULL AND md5(text) < '{url_models.ASIDE}' AS aside FROM split GROUP BY text),
letters AS (
  SELECT text, ruled, aside, substr({_URL_PAD} || text || chr({ord(url_models.END)}), i, {_URL_ORDER}) AS gram
  FROM texts, unnest(range(1, length(text) + 2)) AS r(i)),
grams AS (
  SELECT gram, count(*) AS n, count(*) FILTER (ruled = 'allow' AND NOT aside) AS allowed,
         count(*) FILTER (ruled = 'block' AND NOT aside) AS blocked FROM letters GROUP BY gram),
{", ".join(_url_level(k) for k in range(1, _URL_ORDER + 1))},
scores AS (
  SELECT text, ruled, aside, round(sum(ln(p_allowed) - ln(p_blocked)) / (length(text) + 1), 6) AS score
  FROM letters JOIN chance{_URL_ORDER} USING (gram) GROUP BY text, ruled, aside),
steps AS (
  SELECT {_URL_STEP} AS step, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scores WHERE aside GROUP BY 1),
ends AS (SELECT step, sum(a) AS a, sum(b) AS b FROM (FROM steps UNION ALL SELECT step + 1, 0, 0 FROM steps) GROUP BY step),
errors AS (
  SELECT step, coalesce(sum(a) OVER below, 0) / nullif(sum(a) OVER (), 0)
               + (1 - coalesce(sum(b) OVER below, 0) / nullif(sum(b) OVER (), 0)) AS error
  FROM ends WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT step FROM errors WHERE error IS NOT NULL ORDER BY round(error, 9), abs(step), step LIMIT 1), 0) AS step)
SELECT page_id, host, path, rule,
       coalesce(split.ruled, CASE WHEN {_URL_STEP} >= (SELECT step FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM split JOIN scores USING (text)"""

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": JACCARD_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op6_warc_revisits": REVISITS_SQL,
    "op11_url_filter": URL_SQL,
}
