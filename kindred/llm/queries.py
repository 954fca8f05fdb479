"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import capfilters, langid, maxscore, ngramjoin, packing, pagediff, pieces, quality, resample, secretscan, substrings, tieredindex, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_scores(table(spark, sf_dir, "embeddings"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tieredindex.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_maxscore": op4_maxscore,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_tiered_search": op11_tiered_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_secret_scan": op13_secret_scan,
}

#: The least key that links (a, b) lead to from each of some rows.
REACH = "reach AS (SELECT r AS a, r AS b FROM {rows} UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), groups AS (SELECT reach.a AS r, min({key}) AS component_id FROM reach JOIN {rows} ON reach.b = {rows}.r GROUP BY 1)"

EMBEDDING_NEARDUP = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT x.r AS a, y.r AS b FROM rows x JOIN rows y ON x.label = y.label AND x.r <> y.r WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
{REACH.format(rows="rows", key="vec_id")},
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM rows JOIN groups USING (r) LEFT JOIN n USING (r)
"""

WORDS = r"[^\x20\x09-\x0D]+"

NGRAM_JACCARD = f"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
shingles AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM rows),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON a = p.r JOIN sizes q ON b = q.r WHERE 5 * c >= 4 * (p.n + q.n - c)),
{REACH.format(rows="rows", key="doc_id")},
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept FROM rows JOIN groups USING (r) LEFT JOIN n USING (r)
"""

SUBSTRING_DEDUP = f"""
WITH rows AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' '))) AS s FROM rows WHERE len(w) >= 20),
later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM rows),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM rows LEFT JOIN kept USING (doc_id)
"""

MAXSCORE = """
WITH rows AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

TIERED_SEARCH = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where doc_id is not null
), docs as (select r, doc_id, w, len(w) as n from words where len(w) > 0),
totals as (select count(*) as n_docs, sum(n)::bigint as n_words from docs),
asked as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from benchmark
), terms as (select i, item_id, term, count(*) as q from (select i, item_id, unnest(w) as term from asked) group by all),
postings as (
  select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(w) as term from docs) where term in (select term from terms) group by all
), dfs as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, totals group by term, n_docs),
scored as (
  select t.i, t.item_id, p.r, p.doc_id, sum(t.q * d.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * n_docs) // n_words))))::bigint as score
  from terms t join postings p using (term) join dfs d using (term), totals group by all
)
select item_id, rank::int as rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""

#: The checksum of a word is folded over its bytes, with a table made of its polynomial.
RESAMPLING = r"""
with crc as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as crcs
  from (select unnest(range(256))::bigint as i)
), found as (
  select 'd' as kind, row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', row_number() over (), null, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), tokens as (select kind, r, unnest(w) as word from found),
counted as (select kind, r, word, count(*) as n from tokens group by all),
words as (select word, hex(encode(word)) as h from (select distinct word from counted)),
hashed as (
  select word, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from words, crc
), sums as (
  select b.bucket, coalesce(sum(n) filter (kind = 'd'), 0) as s, coalesce(sum(n) filter (kind = 'b'), 0) as t
  from (select unnest(range(10000)) as bucket) b left join hashed using (bucket) left join counted using (word) group by all
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * ((select sum(s) from sums) + 10000))::double / ((s + 1) * ((select sum(t) from sums) + 10000))::double))::bigint as gain from sums
), weights as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join hashed using (word) join gains using (bucket) where kind = 'd' group by r),
scored as (
  select r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from found left join weights using (r) where kind = 'd'
), placed as (
  select r, row_number() over (order by score desc, doc_id) as place, 10 * count(*) over () // 100 as drawn from scored where n_features >= 20 and doc_id is not null
)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from scored left join placed using (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": EMBEDDING_NEARDUP,
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op4_maxscore": MAXSCORE,
    "op11_tiered_search": TIERED_SEARCH,
    "op12_importance_resampling": RESAMPLING,
}
