"""The queries of the corpus operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, sentencepiece_codec, sharding, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
     g AS (SELECT x, max(page_id) AS holder FROM d WHERE n >= 1000 GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.x AS payload_digest,
       CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM d LEFT JOIN g ON d.x = g.x
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_tree.read_back(*chat_tree.build(rows))


# <n backslashes| becomes <n+1 backslashes|, so a text grows by one for each such place
OP3_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 10 + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def _words(text: str) -> str:
    """SQL for the words of a text as a list."""
    return rf"list_filter(string_split(regexp_replace(lower({text}), '[\x00-/:-@\[-`{{-\x7f]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _pairs(words: str) -> str:
    """SQL for the distinct neighbours in a list of words; of one word, itself."""
    return f"CASE WHEN len({words}) = 1 THEN {words} ELSE list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])) END"


# every passage of 128 words, 64 apart, against every segment of 64 words of an item, scored by BM25 over the segment's own score
OP4_SQL = rf"""
WITH it AS (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
     cut AS (SELECT *, [[regexp_extract(t, '(?s)^(.*\?)(.*)$', 1), regexp_extract(t, '(?s)^(.*\?)(.*)$', 2)], [regexp_extract(t, '(?s)^(.*)\n(.*)$', 1), regexp_extract(t, '(?s)^(.*)\n(.*)$', 2)], [regexp_extract(t, '(?s)^(.*[.!])(\s.*)$', 1), regexp_extract(t, '(?s)^(.*[.!])(\s.*)$', 2)]] AS c FROM it),
     halves AS (SELECT item_id, w, list_filter(list_transform(c, lambda x: [{_words("x[1]")}, {_words("x[2]")}]), lambda x: len(x[1]) > 0 AND len(x[2]) > 0)[1] AS h FROM cut),
     items AS (SELECT item_id, w, coalesce(h[1], w[:len(w) - len(w) // 3]) AS q, CASE WHEN h IS NULL THEN w[len(w) - len(w) // 3 + 1:] ELSE h[2] END AS a FROM halves),
     seg AS (SELECT item_id, k, w[64 * k + 1 : 64 * k + 64] AS s FROM (SELECT item_id, w, unnest(range((len(w) + 63) // 64)) AS k FROM items)),
     total AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT avg(len(s)) FROM seg) AS mean),
     df AS (SELECT x, count(*) AS f FROM (SELECT unnest(list_distinct(w)) AS x FROM items) GROUP BY x),
     tf AS (SELECT item_id, k, len(s) AS l, x, len(list_filter(s, lambda y: y = x)) AS c FROM (SELECT *, unnest(list_distinct(s)) AS x FROM seg)),
     raw AS (SELECT item_id, k, x, ln(1 + (n - f + 0.5) / (f + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * l / mean)) AS v FROM tf JOIN df USING (x), total),
     impact AS (SELECT item_id, k, x, v / sum(v) OVER (PARTITION BY item_id, k) AS v FROM raw),
     docs AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
     passage AS (SELECT doc_id, p, unnest(list_distinct(w[64 * p + 1 : 64 * p + 128])) AS x FROM (SELECT doc_id, w, unnest(range((len(w) + 63) // 64)) AS p FROM docs)),
     hit AS (SELECT doc_id, p, item_id, k, sum(v) AS score FROM passage JOIN impact USING (x) GROUP BY ALL HAVING sum(v) >= 0.5 - 1e-9),
     best AS (SELECT doc_id, p, item_id, max(score) AS score FROM hit GROUP BY ALL),
     near AS (SELECT best.*, q, a, docs.w[greatest(1, 64 * p - len(items.w) + 1) : 64 * p + 128 + len(items.w)] AS around FROM best JOIN docs USING (doc_id) JOIN items USING (item_id)),
     shares AS (SELECT doc_id, item_id, score, list_concat(around, {_pairs("around")}) AS seen, {_pairs("q")} AS q, {_pairs("a")} AS a FROM near),
     judged AS (SELECT doc_id, item_id, score, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, seen)) / len(q) END AS question_overlap, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, seen)) / len(a) END AS answer_overlap FROM shares)
SELECT doc_id, item_id, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap FROM judged WHERE question_overlap >= 0.5 AND answer_overlap >= 0.5
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, question_overlap DESC, answer_overlap DESC) = 1
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/lang/n/; the shortest ones stand for licence files of their source
    or of source/lang."""
    length, source, lang = F.coalesce(F.length("text"), F.lit(0)), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    place = (
        F.when(length < 100, F.concat(source, F.lit("/LICENSE-"), "doc_id"))
        .when(length < 200, F.concat(source, F.lit("/"), lang, F.lit("/LICENSE-"), "doc_id"))
        .otherwise(F.concat(source, F.lit("/"), lang, F.lit("/"), F.pmod("doc_id", F.lit(10)), F.lit("/"), "doc_id", F.lit(".txt")))
    )
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), place.alias("path"), "text")
    return license_scan.license_of(files).withColumnRenamed("file_id", "doc_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
     ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
            AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
     links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
               WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= 0.98),
     reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
     root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) LEFT JOIN root USING (vec_id)
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents").select("doc_id", "text"))


# a document's shingles; pairs of texts that share one; classes of equal texts count once in the pairs
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM w),
     kinds AS (SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS k, doc_id, len(s) AS n, s FROM sets),
     one AS (SELECT k, any_value(n) AS n, any_value(s) AS s FROM kinds WHERE n > 0 GROUP BY k),
     flat AS (SELECT k, n, unnest(s) AS x FROM one),
     links AS (SELECT a.k AS a, b.k AS b FROM flat a JOIN flat b ON a.x = b.x AND a.k <> b.k AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
               GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
     reach(a, b) AS (SELECT k, k FROM one UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
     first AS (SELECT k, min(doc_id) AS doc_id FROM kinds WHERE n > 0 GROUP BY k),
     root AS (SELECT a AS k, min(doc_id) AS component_id FROM reach JOIN first ON first.k = b GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM kinds LEFT JOIN root USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_language_id": op2_language_id, "op3_chat_tree": op3_chat_tree, "op4_decontaminate": op4_decontaminate, "op5_license_scan": op5_license_scan, "op6_embedding_dedup": op6_embedding_dedup, "op7_url_filter": op7_url_filter, "op8_sentencepiece": op8_sentencepiece, "op9_sharding": op9_sharding, "op10_jaccard_join": op10_jaccard_join}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_chat_tree": OP3_SQL, "op4_decontaminate": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op10_jaccard_join": OP10_SQL}
