"""The parts of the operators' results that SQL can say, as queries of their own with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .kneser_ney import score_held_out
from .quality import base_statistics
from .secrets import find_secrets
from .sharding import LAW, sizes
from .url_rules import RULES, UPPER, split_url, stated


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and base rules of the quality operator, of every row; null and empty texts have no words."""
    return base_statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_stated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and stated rule of every page; null urls have none."""
    rule, says = stated(RULES)
    return split_url(table(spark, sf_dir, "pages")).select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and checksum of every row and the law of the shards; null texts count one byte."""
    return sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strong spans of each kind every row has; null texts have none."""
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, known tokens and the single-word score of every row, beside the model that gives them."""
    scored = score_held_out(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


WORD = r"'[^\x20\x09-\x0D]+'"
CRC = """
crc_table AS (
    SELECT list(c ORDER BY i) AS entries
    FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
)"""


def _crc(bytes_of: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_of}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT"


QUALITY = f"""
WITH numbered AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), split AS (
    SELECT r, doc_id, t, regexp_extract_all(t, {WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM numbered
), windows AS (
    SELECT r, i, w[i:i + 4] AS s FROM split, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) > 4
), repeated AS (
    SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM repeated, range(5) AS o(k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
       coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM split LEFT JOIN covered USING (r)
"""

URLS = f"""
WITH split AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(h, p, says) AS (
    VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), longest AS (
    SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(says, length(h || p)) AS says
    FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule, says FROM split LEFT JOIN longest USING (page_id, host, path)
"""

SIZES = f"""
WITH {CRC}, encoded AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
)
SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size, '{LAW}' AS law,
       {_crc("list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT)")} AS text_crc32
FROM encoded, crc_table
"""

SECRETS = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
)
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex
FROM t
"""

SCORES = f"""
WITH {CRC}, numbered AS (
    SELECT row_number() OVER () AS r, doc_id, {_crc("list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::UBIGINT)")} % 5 = 1 AS held_out,
           list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), {WORD}), '') AS w
    FROM documents, crc_table
), tokens AS (
    SELECT r, unnest(w) AS token FROM numbered
), learned AS (
    SELECT token, count(*) AS c FROM tokens JOIN numbered USING (r) WHERE NOT held_out GROUP BY token
), totals AS (
    SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM learned
), scored AS (
    SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS score
    FROM tokens LEFT JOIN learned USING (token), totals GROUP BY r
)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n::BIGINT AS train_tokens, round(score, 4) AS base_score
FROM numbered JOIN scored USING (r), totals
"""

QUERIES = {f.__name__: f for f in (quality_base, url_stated_rules, shard_sizes, secret_counts, word_scores)}
ORACLE_SQL = {"quality_base": QUALITY, "url_stated_rules": URLS, "shard_sizes": SIZES, "secret_counts": SECRETS, "word_scores": SCORES}
