"""The queries of this subpackage, each over its whole table, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Shards that documents are dealt to, and slots of the lookup table.
SHARDS, SLOTS = [f"shard-{k:02d}" for k in range(16)], 65_537


def op1_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign

    return assign(_documents(spark, sf_dir), "doc_id", SHARDS, SLOTS)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store_texts

    return store_texts(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), _tokenizer(), end_id=0, capacity=2048)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)


def op5_token_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches: all documents under both versions; every tenth deleted; revised counts of every seventh; and one sent twice."""
    from ._shared import materialize, new_path
    from .token_counts import VERSIONS, Ledger, changes, count_tokens, revisions

    docs = _documents(spark, sf_dir)
    counts = docs.select("doc_id", "source", "lang", *(count_tokens(F.col("text"), v).alias(v) for v in VERSIONS))
    counts = materialize(counts, "counts")
    both = lambda f: reduce(DataFrame.union, [f(v) for v in VERSIONS])
    ledger = Ledger(spark, new_path(spark, "ledger"))
    ledger.commit("inserts", both(lambda v: changes(counts, 1, F.col(f"`{v}`"), F.lit(v))))
    gone = counts.where("doc_id % 10 = 3")
    deletes = both(lambda v: changes(gone, -1, F.col(f"`{v}`"), F.lit(v)))
    ledger.commit("deletes", deletes)
    ledger.commit("deletes", deletes)
    # the end mark was left out of these documents' counts
    revised = counts.where("doc_id % 7 = 2 and doc_id % 10 != 3")
    ledger.commit("revised", both(lambda v: revisions(revised, F.col(f"`{v}`"), F.col(f"`{v}`") + 1, F.lit(v))))
    return ledger.totals()


OP5_SQL = r"""
WITH counts AS (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'words-2', coalesce(len(regexp_extract_all(text, '[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]+')), 0) FROM documents),
deltas AS (
  SELECT 1 AS batch, source, lang, tokenizer, 1 AS d, n FROM counts
  UNION ALL SELECT 2, source, lang, tokenizer, -1, -n FROM counts WHERE doc_id % 10 = 3
  UNION ALL SELECT 3, source, lang, tokenizer, 0, 1 FROM counts WHERE doc_id % 7 = 2 AND doc_id % 10 <> 3),
summed AS (SELECT batch, source, lang, tokenizer, sum(d) AS d, sum(n) AS n FROM deltas GROUP BY ALL)
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS tokens,
       count(*) FILTER (d <> 0 OR n <> 0) AS batches
FROM summed GROUP BY source, lang, tokenizer HAVING sum(d) <> 0 OR sum(n) <> 0
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_groups

    return line_groups(_documents(spark, sf_dir), min_words=1).drop("digest")


def op8_threshold_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_edits

    return compare_with_edits(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_documents(spark, sf_dir))


#: All pairs of documents that share a run of two words and whose sizes allow a link, and the documents that links lead to.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS MATERIALIZED (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(_documents(spark, sf_dir), _tokenizer(), end_id=1))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_documents(spark, sf_dir), least=30, top=50)


#: Every group, every term, every pair of a language's sources.
OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, source) AS total,
             sum(all_n) OVER (PARTITION BY lang, source) AS all_total FROM a),
p AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p,
         1 + CAST((1000000000::HUGEINT * (all_n + 5)) // (all_total + 5 * v) AS BIGINT) AS q FROM s),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL
      SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_documents(spark, sf_dir), least=100, percent=100, top=2000)


#: All phrases of one to five words, each cut of each candidate, and all longer candidates around each.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: list_slice(ws, i, i + m - 1))) AS words
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, m, words, array_to_string(words, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, m, words HAVING count(*) >= 100),
inner_of AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(list_slice(words, i, i + k - 1), ' '))))) AS phrase
             FROM f WHERE m > 2),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inner_of GROUP BY ALL),
cuts AS (SELECT f.lang, f.phrase, f.a, unnest(range(1, m)) AS k, words FROM f LEFT JOIN covered c ON c.lang = f.lang AND c.phrase = f.phrase
         WHERE m > 1 AND (c.longer IS NULL OR c.longer < f.a)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n,
                  CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
           FROM cuts c JOIN total t ON t.lang = c.lang
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.words, 1, c.k), ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.words, c.k + 1, len(c.words)), ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored),
o AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM best WHERE pick = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, labels)


#: All subsets of the labelled URLs' tokens instead of FP-growth; only tokens that are frequent enough in URLs to block can be in a rule.
OP13_SQL = r"""
WITH cut AS (
  SELECT page_id, url, contains(coalesce(url, ''), '://') AS has, regexp_replace(coalesce(url, ''), '^.*?://', '', 's') AS rest FROM pages),
parts AS (
  SELECT page_id, url, has, CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM cut),
marked AS (
  SELECT page_id, url, host, path,
         list_transform(string_split_regex(host, '[.\-]'), lambda x: CASE WHEN x <> '' THEN 'h:' || x END) AS h,
         list_transform(string_split(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'), '/'), lambda x: CASE WHEN x <> '' THEN 'p:' || x END) AS p,
         list_transform(string_split(regexp_replace(regexp_extract(low, '^[^?#]*\?([^#]*)', 1), '=[^&]*', '', 'g'), '&'), lambda x: CASE WHEN x <> '' THEN 'q:' || x END) AS q,
         list_transform(string_split(regexp_extract(low, '#(.*)$', 1), ' '), lambda x: CASE WHEN x <> '' THEN 'f:' || x END) AS f, has
  FROM parts),
page AS MATERIALIZED (
  SELECT page_id, url, host, path, CASE WHEN has THEN list_sort(list_distinct(list_filter(list_concat(h, p, q, f), lambda x: x IS NOT NULL))) ELSE [] END AS items FROM marked),
labelled AS MATERIALIZED (
  SELECT row_number() OVER () AS id, items, coalesce(toxic = 1, FALSE) OR coalesce(quality = 0, FALSE) AS bad FROM page JOIN labels ON page_id = doc_id
  WHERE toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL)),
least AS (SELECT greatest(CAST(ceil(0.01 * count(*) - 1e-9) AS BIGINT), 5) AS least FROM labelled),
token AS (SELECT id, bad, unnest(items) AS t FROM labelled),
single AS MATERIALIZED (SELECT t, count(*) AS freq, count(*) FILTER (bad) AS bad_freq FROM token GROUP BY t),
small AS (SELECT id, bad, list_sort(list(t)) AS items FROM token JOIN single USING (t), least WHERE bad_freq >= least GROUP BY ALL),
masks AS (SELECT id, bad, items, unnest(range(1, CAST(power(2, len(items)) AS BIGINT))) AS mask FROM small),
sets AS (SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS rule, count(*) AS freq, count(*) FILTER (bad) AS support FROM masks GROUP BY 1),
mined AS MATERIALIZED (SELECT rule, support, CAST(support AS DOUBLE) / CAST(freq AS DOUBLE) AS confidence FROM sets, least WHERE support >= least AND CAST(support AS DOUBLE) / CAST(freq AS DOUBLE) >= CAST(0.6 AS DOUBLE)),
kept AS (SELECT * FROM mined r WHERE NOT EXISTS (SELECT 1 FROM mined s WHERE len(s.rule) < len(r.rule) AND s.confidence >= r.confidence AND list_has_all(r.rule, s.rule))),
met AS (SELECT page_id, array_to_string(rule, ' ') AS text, confidence, support FROM page, kept WHERE list_has_all(items, rule)),
best AS (SELECT page_id, count(*) AS n, min({'c': -confidence, 's': -support, 'text': text}) AS b FROM met GROUP BY page_id),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(name, start, verdict)),
fits AS (SELECT page_id, arg_max({'rule': name || start, 'verdict': verdict}, length(name || start)) AS r FROM page, rules
         WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page.page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN n IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       b.text AS mined, -b.c AS confidence, coalesce(n, 0) AS n_mined
FROM page LEFT JOIN fits ON fits.page_id = page.page_id LEFT JOIN best ON best.page_id = page.page_id
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _op1_sql() -> str:
    """The lookup table as text, a letter a slot; placement itself is SQL. (The table is tested against plain code.)"""
    from .sharding import lookup_table

    table = "".join(chr(65 + s) for s in lookup_table(SHARDS, SLOTS))
    return f"""
WITH placed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents),
found AS (SELECT doc_id, slot, CAST(ascii(substr('{table}', CAST(slot AS INTEGER) + 1, 1)) - 65 AS INTEGER) AS shard FROM placed)
SELECT doc_id, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 2, '0') AS shard_name FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_maglev_sharding": _op1_sql(), "op4_minhash_near_dedup": OP4_SQL, "op5_token_count_rollup": OP5_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL, "op13_url_rules": OP13_SQL}
