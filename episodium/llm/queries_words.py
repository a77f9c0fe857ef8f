"""Queries of the spelling, resampling and piece operators, and the SQL twins of the first two."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from episodium.llm import pieces, resample, spelling
from episodium.llm.common import UPPER
from episodium.llm.registry import query, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The checksum of a string from its bytes in hexadecimal: a table of 256 numbers, made by rule.
_CRC_TABLE = """
steps AS (SELECT i AS byte, i::BIGINT AS value, 0 AS k FROM range(256) r(i) UNION ALL
    SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, k + 1
    FROM steps WHERE k < 8),
crc AS (SELECT list(value ORDER BY byte) AS t FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    digits = f"regexp_extract_all(hex(encode({text})), '..')"
    digit = "strpos('0123456789ABCDEF', {}) - 1"
    byte = f"({digit.format('x[1]')}) * 16 + {digit.format('x[2]')}"
    found = f"list_transform({digits}, lambda x: {byte})"
    return f"xor(list_reduce({found}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


_WORD_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
marked AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc),
damaged AS (SELECT n, CASE WHEN h % 199 = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked),
words AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
    FROM pairs GROUP BY word),
formed AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL
    SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""

_RESAMPLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT true AS is_source, doc_id, text, row_number() OVER () AS r FROM documents
    UNION ALL SELECT false, item_id, text, -row_number() OVER () FROM benchmark),
split AS (SELECT is_source, r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
runs AS (SELECT is_source, r, unnest(list_concat(words, list_concat(
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
    ))) AS feature FROM split),
counted AS (SELECT is_source, r, feature, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM counted), crc),
found AS (SELECT is_source, r, bucket, n FROM counted JOIN hashed USING (feature)),
total AS (SELECT coalesce(sum(n) FILTER (is_source), 0) AS s, coalesce(sum(n) FILTER (NOT is_source), 0) AS t FROM found),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (is_source), 0) AS sb, coalesce(sum(n) FILTER (NOT is_source), 0) AS tb
    FROM found GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((tb + 1)::DOUBLE * (s + 10000)::DOUBLE
    / ((sb + 1)::DOUBLE * (t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, total),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
    FROM found JOIN gains USING (bucket) WHERE is_source GROUP BY r),
scored AS (SELECT doc_id, r, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM texts JOIN split USING (is_source, r) LEFT JOIN weights USING (r) WHERE is_source),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
    FROM noisy WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM noisy LEFT JOIN ranked USING (r)
"""


@query("op11_spelling_variants", _WORD_SQL)
def spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_target_resampling", _RESAMPLE_SQL)
def target_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_sentencepiece")
def sentence_pieces(spark, sf_dir):
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
