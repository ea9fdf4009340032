"""Registered queries of the training-data operators, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lexical, line_dedup, lm, mixing, parity_join, prefix_trie, quality, rules, substring_dedup, token_output, topk, warc
from tidemark.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.tiktoken"

# ASCII white space for DuckDB's trim, and its way to lower-case A-Z only.
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL twin if there is one."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of encoding and decoding every document."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, {SQL_LOWER.format(f"trim(line, {SQL_SPACE})")} AS key
  FROM (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
  )
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT l.*, s.key IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op5_line_dedup", LINE_DEDUP_SQL)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document and the digest of what stays."""
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the verdict of the rule cascade for every document."""
    return rules.apply_rules(read(spark, sf_dir, "documents"))


@query("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and link component of every document."""
    return parity_join.link_documents(read(spark, sf_dir, "documents"))


@query("op2_compression_quality")
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and prediction of every document, learned outside the held-out fold."""
    documents = read(spark, sf_dir, "documents")
    model = quality.fit(documents, read(spark, sf_dir, "labels"))
    return quality.score_documents(documents, model)


WARC_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
),
digests AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
),
firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM digests WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


@query("op3_warc_archives", WARC_SQL)
def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives in the shared folder and read back from there."""
    folder = scratch(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, payloads=False).drop("target_uri")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op6_exact_top_k", TOP_K_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every hundredth one."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and automaton score of every document, learned outside the held-out fold."""
    return lm.score_documents(read(spark, sf_dir, "documents"))


@query("op9_token_shards")
def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token shards in the shared folder, and every sequence read back."""
    folder = scratch(spark, "token-shards")
    path = public_tokenizers.path(VOCABULARY)
    index = token_output.write_shards(
        read(spark, sf_dir, "documents"), folder, path, public_tokenizers.PATTERN
    )
    stored = token_output.read_shards(spark, folder).select("slot", F.sha2("ids", 256).alias("ids_sha256"))
    # Spark cannot know how much a reader of few file names returns, and would broadcast it.
    return index.join(stored.hint("merge"), "slot")


SQL_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SQL = rf"""
WITH terms AS (
  SELECT doc_id, {SQL_LOWER.format(f"unnest(regexp_extract_all(text, '{SQL_TERM}'))")} AS term FROM documents
),
asked AS (
  SELECT DISTINCT item_id, {SQL_LOWER.format(f"unnest(regexp_extract_all(text, '{SQL_TERM}'))")} AS term FROM benchmark
),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, whole GROUP BY term
),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


@query("op12_lexical_search", LEXICAL_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return lexical.search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


TRIE_SQL = """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
    left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
),
packed AS (
  SELECT conv_id, list({'id': id, 'chars': chars} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv_id
),
headed AS (
  SELECT conv_id, turns, (xor(list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
    ), 4294967295) % 6)::BIGINT AS h
  FROM packed
),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns
  FROM headed c LEFT JOIN packed b ON b.conv_id = c.conv_id - c.conv_id % 100
),
passing AS (
  SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda x: x.id), '') AS path,
    coalesce(turns[d].chars, 0) AS chars, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
  SELECT path, d, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM passing GROUP BY path, d
),
families AS (
  SELECT p.path, p.conv_id AS parent_conv_id, count(*) AS n_children
  FROM nodes c JOIN nodes p ON c.d > 0 AND p.path = left(c.path, 32 * (c.d - 1)) GROUP BY p.path, p.conv_id
),
below AS (
  SELECT left(path, 32 * k) AS path, sum((n_children IS NULL)::BIGINT)::BIGINT AS n_leaves,
    sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT n.*, n_children, unnest(range(d + 1)) AS k FROM nodes n LEFT JOIN families f USING (path))
  GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children,
  n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN families f USING (path)
LEFT JOIN nodes p ON n.d > 0 AND p.path = left(n.path, 32 * (n.d - 1))
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations as a node of their trie."""
    packed = prefix_trie.pack_turns(read(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_nodes(prefix_trie.rebuild(packed))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


SUBSTRING_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)
),
later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
),
covered AS (
  SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM later) GROUP BY doc_id
),
kept AS (
  SELECT doc_id, i, word FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split)
  ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM covered) USING (doc_id, i)
),
joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(j.text, '')) AS kept_sha256
FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN joined j USING (doc_id)
"""


@query("op13_substring_dedup", SUBSTRING_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated passages cost every document, and the digest of what stays."""
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
