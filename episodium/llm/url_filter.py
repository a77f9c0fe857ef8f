"""URL verdicts: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The listed URLs make up a Bloom filter whose blocks are 64-bit words: a URL's hash names its word
and four bits in it.  URLs whose bits are not all set are not listed; the possible hits alone go on
to an exact join with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.llm.common import column, fold, small
from episodium.workspace import settle

URLS_PER_WORD = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(url.contains("://"), F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    host = fold(F.regexp_extract(after, "^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(after, "^[^/?#]*", ""), "^[^?#]*", 0)
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """One name for the variants of a page: no www. or m., port, .html ending or slash at the end."""
    host = F.regexp_replace(F.regexp_replace(host, "^(www|m)[.]", ""), ":[0-9]*$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, "[.]html$", ""), "/+$", ""))


def _bits(url: Column) -> Column:
    """Four bits of a word, from 24 bits of the URL's second hash."""
    code = F.xxhash64(F.lit("bits"), url)
    shifts = [F.shiftright(code, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), s) for s in shifts])


def bloom_words(listed: DataFrame, n_listed: int) -> tuple[DataFrame, int]:
    """((word, bits) of the listed URLs, number of words the hash is dealt to)."""
    n_words = max(16, -(-n_listed // URLS_PER_WORD))
    url = F.col("url")
    words = listed.groupBy(F.pmod(F.xxhash64(url), F.lit(n_words)).alias("word")).agg(
        F.bit_or(_bits(url)).alias("bits")
    )
    return words, n_words


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages``.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains of it if the path
    starts with the rule's.  The longest rule wins (host and path together, then the longer host).
    Without a rule a URL is blocked if its canonical form is a ``url`` of ``listed``, else allowed.
    Null urls and those without ``://`` have an empty host and path and are allowed; repeated rows
    are judged each; an empty list blocks nothing.
    """
    listed = settle(listed.select("url").filter("url is not null").distinct(), "listed-urls")
    n_listed = listed.count()
    words, n_words = bloom_words(listed, n_listed)
    words = small(words, min(n_listed, n_words))

    host, path = host_and_path(column(pages, url_col))
    rows = pages.select(column(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [
        ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        for _, h, p in ranked
    ]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ranked)], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ranked)], F.lit(None).cast("string"))
    url = canonical(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), by_rule.alias("by_rule"), url.alias("canonical"))
    probed = (
        rows.withColumn("word", F.pmod(F.xxhash64("canonical"), F.lit(n_words)))
        .join(words, "word", "left")
        .withColumn(
            "possible",
            F.coalesce(F.col("bits").bitwiseAND(_bits(F.col("canonical"))) == _bits(F.col("canonical")), F.lit(False)),
        )
    )
    exact = small(listed.select(F.col("url").alias("canonical"), F.lit(True).alias("found")), n_listed)
    hits = probed.filter("possible").join(exact, "canonical", "left")
    rest = probed.filter("not possible").withColumn("found", F.lit(None).cast("boolean"))
    return hits.unionByName(rest).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("found"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("found", F.lit(False)).alias("listed"),
    )


def listed_from_hosts(pages: DataFrame, labels: Sequence[str], url_col: str = "url") -> DataFrame:
    """A list to block: canonical URLs of the pages whose host has one of the ``labels``."""
    host, path = host_and_path(column(pages, url_col))
    rows = pages.select(host.alias("host"), path.alias("path"))
    return rows.filter(F.arrays_overlap(F.split("host", "[.]"), F.array(*map(F.lit, labels)))).select(
        canonical(F.col("host"), F.col("path")).alias("url")
    )
