"""Queries of the text operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodium.llm import exact_dedup, licenses, line_dedup, pii, url_filter
from episodium.llm.common import UPPER
from episodium.llm.registry import query, table

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def _licence_sql() -> str:
    """The rules are applied one after the other to the joined identifiers."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    steps, last = [], "marked"
    for i, (name, seq) in enumerate(licenses.RULES):
        text = " " + "  ".join(seq) + " "
        steps.append(
            f"r{i} AS (SELECT doc_id, n_sentences, sentence_ids, replace(rest, '{text}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{text}') AND NOT list_contains(found, '{name}') "
            f"THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"r{i}"
    white = " \\t\\n\\x0b\\x0c\\r"
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(regexp_replace(
    regexp_replace({_FOLDED}, '[-/:_]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}.{white}]', '', 'g'),
    '[.]+([{white}]|\\z)', chr(10), 'g'), chr(10)) AS parts FROM documents),
sentences AS (SELECT r, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM docs),
clean AS (SELECT r, pos, trim(regexp_replace(raw, '[{white}.]+', ' ', 'g')) AS sentence FROM sentences),
per_doc AS (SELECT r, count(*) FILTER (sentence <> '') AS n_sentences,
    coalesce(string_agg(id, ' ' ORDER BY pos) FILTER (id IS NOT NULL), '') AS sentence_ids
    FROM clean LEFT JOIN known USING (sentence) GROUP BY r),
marked AS (SELECT doc_id, n_sentences, sentence_ids,
    CASE WHEN sentence_ids = '' THEN ' ' ELSE ' ' || replace(sentence_ids, ' ', '  ') || ' ' END AS rest,
    []::VARCHAR[] AS found FROM docs JOIN per_doc USING (r)),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(found, ' ') AS licences,
    len(list_filter(string_split(translate(rest, '|', ' '), ' '), lambda x: x <> '')) AS unmatched
FROM {last}
"""


@query("op1_license_scan", _licence_sql())
def license_scan(spark, sf_dir):
    return licenses.recognise(table(spark, sf_dir, "documents"))


@query(
    "op5_exact_dedup",
    f"""
WITH keyed AS (SELECT doc_id, sha256({_FOLDED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
""",
)
def exact_duplicates(spark, sf_dir):
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Host labels of advertising, gambling and spam sites, whose pages make up the list of URLs.
LISTED_HOSTS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def _url_sql() -> str:
    hosts = ", ".join(f"'{h}'" for h in LISTED_HOSTS)
    ranked = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in ranked
    )
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host,
    regexp_extract(regexp_replace(after, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)[.]', ''), ':[0-9]*$', '')
    || regexp_replace(regexp_replace(path, '[.]html$', ''), '/+$', '') AS canonical,
    CASE {rule} END AS found FROM parts),
listed AS (SELECT DISTINCT canonical FROM named
    WHERE list_has_any(string_split(host, '.'), [{hosts}]))
SELECT page_id, host, path, string_split(found, ' ')[2] AS rule,
    coalesce(string_split(found, ' ')[1],
        CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
    canonical IN (SELECT canonical FROM listed) AS listed
FROM named
"""


@query("op6_url_filter", _url_sql())
def url_verdicts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_from_hosts(pages, LISTED_HOSTS), URL_RULES)


@query(
    "op9_line_dedup",
    f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
marked AS (SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS dropped
    FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def line_duplicates(spark, sf_dir):
    rows = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The key of the registered query; a real run passes its own.
PII_KEY = "example key"


@query("op10_pii_pseudonyms")
def pii_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
