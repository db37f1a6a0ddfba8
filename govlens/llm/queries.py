"""The queries of this subpackage: thin applications of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens.llm.collocations import collocations
from govlens.llm.common import table
from govlens.llm.decontamination import contamination
from govlens.llm.divergence import source_divergence
from govlens.llm.embedding_dedup import near_duplicates
from govlens.llm.exact_packing import pack_exactly
from govlens.llm.html_text import extract_text
from govlens.llm.jaccard import jaccard_components
from govlens.llm.line_dedup import dedup_lines
from govlens.llm.packing import pack_documents
from govlens.llm.quality import select_quality
from govlens.llm.sharding import shard_documents
from govlens.llm.suffix_dedup import remove_repeats
from govlens.llm.tokens import token_counts

TOKENIZER, BYTE_TOKENIZER = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_exactly(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_ALL = [
    *(op1_embedding_dedup, op2_packing, op3_line_dedup, op4_html_text, op5_decontamination, op6_jaccard_join, op7_sharding),
    *(op8_suffix_dedup, op9_token_counts, op10_quality, op11_exact_packing, op12_source_divergence, op13_collocations),
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = d.doc_id""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT doc_id, p, substr(x, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 200 <= len(x) THEN md5(substr(x, 2 * p + 1, 200)) END AS s FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 1)) AS p FROM d)),
again AS (SELECT doc_id, p, byte, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 THEN 1 ELSE 0 END AS again FROM bytes),
gone AS (SELECT doc_id, p, byte, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM again),
runs AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 THEN 1 ELSE 0 END AS opens FROM gone),
sums AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(opens) AS BIGINT) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (gone = 0), '') AS kept FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)""",
    "op3_line_dedup": """
WITH lines AS (SELECT doc_id, text IS NULL AS none, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, line, pos, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS n FROM lines),
next AS (SELECT doc_id, line, pos, n, lead(line, 1) OVER o AS l1, lead(n, 1) OVER o AS n1, lead(pos, 1) OVER o AS p1, lead(line, 2) OVER o AS l2, lead(pos, 2) OVER o AS p2
         FROM worded WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT doc_id, pos, pos AS last, line AS run FROM next WHERE n >= 50
         UNION ALL SELECT doc_id, pos, p1, line || chr(10) || l1 FROM next WHERE p1 IS NOT NULL AND n + n1 >= 50
         UNION ALL SELECT doc_id, pos, p2, line || chr(10) || l1 || chr(10) || l2 FROM next WHERE p2 IS NOT NULL),
ranked AS (SELECT doc_id, pos, last, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM runs WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM ranked WHERE nth > 1),
kept AS (SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS body FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CAST(strlen(body) AS BIGINT) AS kept_bytes, sha256(body) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op5_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM iw WHERE len(w) > 0)),
grams AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, p, n, item_id FROM grams JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY 1, 2),
ln AS (SELECT lang, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(gn.n, 0) + 5 * v.v) AS BIGINT) AS p
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
q AS (SELECT lc.lang, lc.term, CAST(1 + (1000000000::HUGEINT * (lc.c + 5)) // (ln.n + 5 * v.v) AS BIGINT) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_collocations": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]') AS s FROM documents),
s AS (SELECT lang, regexp_extract_all(unnest(s), '[^\x20\x09]+') AS w FROM d),
u AS (SELECT lang, unnest(w) AS phrase FROM s),
u1 AS (SELECT lang, phrase, count(*) AS f FROM u GROUP BY 1, 2),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u1 GROUP BY 1),
u2 AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM s WHERE len(w) > 1) GROUP BY 1, 2 HAVING count(*) >= 10),
u3 AS (SELECT lang, x AS phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM s WHERE len(w) > 2) GROUP BY 1, 2 HAVING count(*) >= 10),
three AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w FROM u3),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, w[1] || ' ' || w[2] AS phrase FROM three UNION ALL SELECT lang, f, w[2] || ' ' || w[3] FROM three) GROUP BY 1, 2),
cuts AS (SELECT u2.lang, u2.phrase, u2.f AS a, 1 AS k, string_split(u2.phrase, ' ')[1] AS x, string_split(u2.phrase, ' ')[2] AS y FROM u2 LEFT JOIN longer l ON l.lang = u2.lang AND l.phrase = u2.phrase WHERE l.f IS NULL OR 100 * l.f < 50 * u2.f
         UNION ALL SELECT lang, phrase, f, 1, w[1], w[2] || ' ' || w[3] FROM three UNION ALL SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM three),
parts AS (SELECT * FROM u1 UNION ALL SELECT * FROM u2),
scored AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts c JOIN parts x ON x.lang = c.lang AND x.phrase = c.x JOIN parts y ON y.lang = c.lang AND y.phrase = c.y),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
