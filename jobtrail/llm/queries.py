"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.llm import (ball_tree, bpe, fingerprints, language, language_model, licenses, mixing, near_duplicates, nearest, prefix_trie,
                          sharding, token_files, url_filter)
from jobtrail.llm.shared import fresh_folder

# The public vocabulary the queries encode with: entries, and the id put after each document.
TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(), END_ID, VOCABULARY)
    return token_files.map_token_parts(spark, folder)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the corpus, sources weighted by the square root of their bytes."""
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), power=0.5, epochs=1.0, seed=7)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source, a hundred to a directory in the order of their ids."""
    number = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(number / 10_000).cast("string"),
                       (F.floor(number / 100) % 100).cast("string"), number.cast("string"))
    return licenses.scan_licenses(table(spark, sf_dir, "documents").withColumn("path", path))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.contiguous_shards(table(spark, sf_dir, "documents"), 40)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"), language.id_remainder(7) == 2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"), language.id_remainder(5) == 0)


#: Fixed values of the query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_frame(spark, URL_RULES))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turns, up to eight, are those of the first conversation of their five."""
    sequences = prefix_trie.conversation_keys(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    length = (F.crc32(conv.cast("string")) % 9).cast("int")
    return prefix_trie.prefix_trie(prefix_trie.with_heads_of(sequences, conv - conv % 5, length, 8))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_mixing, op4_near_duplicates, op5_nearest, op6_licenses, op7_shards, op8_language_model, op9_bpe, op10_language,
                                 op11_url_filter, op12_prefix_trie, op13_ranked_search)}


MIXING_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents GROUP BY source),
whole AS (SELECT sum(bytes)::DOUBLE AS all_bytes, sum(pow(bytes::DOUBLE, 0.5)) AS all_weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, 0.5) / all_weight * all_bytes / bytes ELSE 1.0 END AS rate
  FROM sizes, whole),
pieces AS (SELECT source, rate, greatest(1, ceil(rate / 8.0))::INT AS n, rate / greatest(1, ceil(rate / 8.0)) AS mean
           FROM rates),
draws AS (
  SELECT d.*, p.source AS _s, p.mean,
         ('0x' || substr(md5('7|' || d.doc_id || '|' || k.k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source, generate_series(1, p.n) AS k(k)),
counts AS (
  SELECT doc_id, sum(list_count(list_filter(list_transform(range(0, 70), lambda j:
           list_sum(list_transform(range(0, j + 1), lambda i: exp(-mean + i * ln(mean) - lgamma(i + 1))))),
           lambda c: c <= u)))::BIGINT AS n
  FROM draws GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS mix_copy,
       ('0x' || substr(md5('order7|' || d.doc_id || '|' || c.copy), 1, 15))::BIGINT AS mix_order
FROM documents d JOIN counts USING (doc_id), generate_series(0, n - 1) AS c(copy)
"""


def _url_filter_sql() -> str:
    """Rules by comparing every page with every rule; trust and distrust round by round."""
    link = url_filter.LINK.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    rounds = "".join(f"""
    m{k} AS (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
      SELECT * FROM seeds UNION ALL
      SELECT kind, dest, floor(mass::DOUBLE * {url_filter.DAMPING}::DOUBLE * share)::BIGINT FROM flow JOIN m{k - 1} USING (kind, host))
      GROUP BY kind, host),""" for k in range(1, url_filter.ROUNDS + 1))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
    named AS (SELECT row_number() OVER () AS row_no, page_id, html,
        coalesce({lower.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT n.row_no, n.page_id, n.host, n.path,
        arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
      FROM named n LEFT JOIN rules r ON (n.host = r.rhost OR suffix(n.host, '.' || r.rhost)) AND prefix(n.path, r.rpath)
      GROUP BY ALL),
    found AS (SELECT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM named),
    linked AS (SELECT src, dst, count(*) AS links FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
    known AS (SELECT host FROM named WHERE host <> '' UNION SELECT src FROM linked UNION SELECT dst FROM linked),
    parents AS (SELECT host, regexp_extract(host, '^[^.]*[.](.*[.].*)$', 1) AS parent FROM known),
    kin AS (SELECT * FROM parents WHERE parent <> '' AND parent NOT LIKE '.%'),
    links AS (SELECT src, dst, sum(links)::BIGINT AS links FROM (
        SELECT * FROM linked UNION ALL SELECT host, parent, 1 FROM kin UNION ALL SELECT parent, host, 1 FROM kin) GROUP BY ALL),
    ways AS (SELECT 'trust' AS kind, src AS host, dst AS dest, links FROM links
             UNION ALL SELECT 'distrust', dst, src, links FROM links),
    flow AS (SELECT kind, host, dest, links::DOUBLE / (sum(links) OVER (PARTITION BY kind, host))::DOUBLE AS share FROM ways),
    counts AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
      FROM ruled WHERE host <> '' GROUP BY host),
    uncrawled AS (SELECT k.host, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
      FROM known k JOIN rules r ON (k.host = r.rhost OR suffix(k.host, '.' || r.rhost)) AND prefix('/', r.rpath)
      WHERE k.host NOT IN (SELECT host FROM counts) GROUP BY k.host),
    seeds AS (SELECT CASE WHEN allowed * 2 > n THEN 'trust' ELSE 'distrust' END AS kind, host, {url_filter.UNIT}::BIGINT AS mass
      FROM counts WHERE allowed * 2 > n OR blocked * 2 > n
      UNION ALL SELECT CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END, host, {url_filter.UNIT} FROM uncrawled),
    m0 AS (SELECT * FROM seeds),{rounds}
    scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0)::BIGINT AS trust,
      coalesce(sum(mass) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM m{url_filter.ROUNDS} GROUP BY host)
    SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) >= {int(url_filter.LIMIT * url_filter.UNIT)}
      AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
      coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
    FROM ruled r LEFT JOIN scores s ON s.host = r.host"""


# Every prefix as a list of turns; subtrees by joining nodes with all of their prefixes.
PREFIX_TRIE_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
  FROM turns),
parts AS (
  SELECT v.c, 1 AS part, p, r, t FROM convs v JOIN turns u ON u.c = v.c - v.c % 5 AND p <= h
  UNION ALL SELECT v.c, 2, p, r, t FROM convs v JOIN turns u ON u.c = v.c AND p > h),
whole AS (SELECT c, list({'r': r, 't': t} ORDER BY part, p) AS path FROM parts GROUP BY c),
rebuilt AS (SELECT v.c, coalesce(path, []) AS path FROM convs v LEFT JOIN whole w USING (c)),
steps AS (SELECT c, path[1:d] AS node, d = len(path) AS ended
          FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, len(node) AS depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN len(node) > 0 THEN strlen(node[-1].t) ELSE 0 END AS saved
  FROM steps GROUP BY node),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (node)),
subtrees AS (
  SELECT top, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT saved, n_children, node[1:d] AS top FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own)) GROUP BY top)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs,
  o.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN subtrees s ON s.top = o.node LEFT JOIN own p ON o.depth > 0 AND p.node = o.node[1:o.depth - 1]
"""

# Every document scored for every item that shares a term with it.
RANKED_SEARCH_SQL = r"""
WITH words AS (
  SELECT d.row_no, d.doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents) d),
sizes AS (SELECT row_no, count(*) AS n FROM words GROUP BY row_no),
whole AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS length FROM sizes),
tf AS (SELECT row_no, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
weights AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, whole GROUP BY term, all_docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, row_no, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * all_docs) // length)))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (row_no), whole
  GROUP BY item_id, row_no, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
           FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING_SQL, "op11_url_filter": _url_filter_sql(), "op12_prefix_trie": PREFIX_TRIE_SQL,
            "op13_ranked_search": RANKED_SEARCH_SQL}
