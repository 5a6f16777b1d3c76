"""Registered queries of the dealt operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.llm import (
    decontaminate,
    hard_negatives,
    language_model,
    licenses,
    line_dedup,
    near_dedup,
    packing,
    prefix_trie,
    quality_rules,
    resampling,
    sanitise,
    sharding,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL["op1_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS lost FROM k LEFT JOIN o ON o.key = k.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents", "doc_id", "text"))


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents", "doc_id", "text", "lang", "source"))


_WORDS = r"[^\x20\x09-\x0D]+"
_NONSYMBOLS = "[^#*$%&|<>]"
_FENCED = " ".join(
    f"max(CASE WHEN feature = '{n}' THEN a - greatest({quality_rules.REACH} * (b - a), {least}) END) AS {n}_low, "
    f"max(CASE WHEN feature = '{n}' THEN b + greatest({quality_rules.REACH} * (b - a), {least}) END) AS {n}_high,"
    for n, (_, least) in quality_rules.FEATURES.items()).rstrip(",")
SQL["op10_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i+4]) AS times FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM h, range(0, 5) AS x(o) WHERE times > 1 GROUP BY r),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{_WORDS}') GROUP BY ALL),
m AS (SELECT r, sum(n - 1) AS dup, sum(n) AS n FROM l GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '{_NONSYMBOLS}', '', 'g'))::BIGINT AS n_symbols, coalesce(m.dup, 0)::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_lines
      FROM d LEFT JOIN p USING (r) LEFT JOIN m USING (r)),
f AS (SELECT *, 1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
             1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_size FROM c),
u AS (SELECT lang, source, feature, (v >> s) << s AS v FROM (
        SELECT *, greatest(length(bin(v)) - {quality_rules.BITS}, 0) AS s FROM (
          SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_size']) AS feature,
                 unnest([symbols, dup_lines, repeats, word_size]) AS v FROM f))),
q AS (SELECT lang, source, feature, count(*) AS n, list_sort(list(v)) AS vs FROM u GROUP BY ALL),
z AS (SELECT lang, feature, count(*) AS n, list_sort(list(v)) AS vs FROM u GROUP BY ALL),
e AS (SELECT q.lang, q.source, q.feature,
             (q.n * q.vs[(q.n + 3) // 4] + {quality_rules.PRIOR} * z.vs[(z.n + 3) // 4]) // (q.n + {quality_rules.PRIOR}) AS a,
             (q.n * q.vs[(3 * q.n + 3) // 4] + {quality_rules.PRIOR} * z.vs[(3 * z.n + 3) // 4]) // (q.n + {quality_rules.PRIOR}) AS b
      FROM q JOIN z ON q.lang IS NOT DISTINCT FROM z.lang AND q.feature = z.feature),
y AS (SELECT lang, source, {_FENCED} FROM e GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND symbols <= symbols_high AND dup_lines <= dup_lines_high
         AND repeats <= repeats_high AND word_size BETWEEN word_size_low AND word_size_high AS kept
FROM f JOIN y ON f.lang IS NOT DISTINCT FROM y.lang AND f.source IS NOT DISTINCT FROM y.source
"""


@query
def op8_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    found = sanitise.find_personal_data(table(spark, folder, "documents", "doc_id", "text"))
    each = [sanitise.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(sanitise.KINDS)]
    return found.select("doc_id", *each, F.sha2(sanitise.shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        sanitise.shown(F.col("spans")).alias("spans"))


@query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), width=2)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"), word_vocabulary())


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(table(spark, folder, "documents", "doc_id", "text"))


@query
def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    source = warc.archive_pages(table(spark, folder, "pages", "page_id", "url", "html"))
    return warc.archived(spark, warc.deduplicated_archives(spark, source))


SQL["op2_warc_revisits"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
o AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to FROM o
"""


@query
def op6_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return resampling.resample(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return decontaminate.contaminated_regions(docs, table(spark, folder, "benchmark", "item_id", "text"))


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents", "doc_id", "text"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings", "vec_id", "embedding", "label").select("vec_id", "embedding", label))


SQL["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 5
"""


SQL["op13_prefix_trie"] = f"""
WITH o AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, l, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
           lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x = -1 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, x) END), 4294967295) % 4 AS h FROM o),
p AS (SELECT h.c, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, len(l) AS n, d, l[1:d] AS k FROM p, unnest(range(0, len(l) + 1)) AS x(d)),
g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY k, d),
f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
e AS (SELECT g.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(g.k[d].t, '{_WORDS}')) END AS saved FROM g LEFT JOIN f ON f.k = g.k),
s AS (SELECT e.k[1:y] AS k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM e, unnest(range(0, d + 1)) AS z(y) GROUP BY 1)
SELECT e.conv_id, e.d AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM e JOIN s ON s.k = e.k LEFT JOIN g u ON e.d > 0 AND u.d = e.d - 1 AND u.k = e.k[1:e.d - 1]
"""
