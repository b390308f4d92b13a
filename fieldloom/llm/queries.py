"""The registered queries of the training-data operators and their SQL.

Every query runs its operator over the whole table it is meant for, with production
parameters.  Where SQL can express the result, ``oracle_sql`` has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import crc_mod, cut, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the 50k byte-level BPE."""
    import public_tokenizers

    from fieldloom.llm.token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and unigram scores of all texts, learned from those that are not held out."""
    from fieldloom.llm.lm_scoring import Model, score, trained_on

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Model(docs.filter(trained_on()))
    return score(docs.select("doc_id", (~trained_on()).alias("held_out"), "text"), model)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights."""
    from fieldloom.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned from the documents that are not held out."""
    from fieldloom.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all texts, learned from the labels that are not held out."""
    from fieldloom.llm.quality_classifier import FEATURES, classify, features, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(features(docs).select("doc_id", *FEATURES))
    held_out = crc_mod("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~held_out)
    model = fit(rows.join(labels, "doc_id"))
    return classify(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all whole texts: base spans and those that patterns discover."""
    from fieldloom.llm.pii import BASE, count_of, find_pii, listed

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of("base", kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by two-word shingles."""
    from fieldloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), f AS (SELECT s, count(*) AS f FROM s GROUP BY s
), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS k FROM s JOIN f USING (s)
), p AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT r.* FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(0.8 * n) + 1) a
  JOIN (SELECT r.* FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(0.8 * n) + 1) b ON a.s = b.s AND a.doc_id < b.doc_id
), e AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.s = x.s
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  GROUP BY p.a, p.b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), t AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), g AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT g.x, t.b FROM g JOIN t ON t.a = g.y
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM g GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all whole texts."""
    from fieldloom.llm.decontamination import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages: rules, and where none fits the host's reputation.

    The outcomes that the reputation learns from are weak labels of the pages' own html.
    """
    from fieldloom.llm.url_filters import filter_urls, page_outcome

    pages = table(spark, sf_dir, "pages")
    outcomes = pages.select("url", page_outcome(F.col("html"), F.col("url")).alias("good"))
    return filter_urls(pages.select("page_id", "url"), outcomes)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers per language and source over every whole text."""
    from fieldloom.llm.quality_rules import quality_digest

    return quality_digest(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the frequent words of all whole texts."""
    from fieldloom.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 in plain SQL: the table of the reflected polynomial.
CRC_SQL = """crc AS (SELECT list(c ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(k)))"""


def crc_sql(text: str) -> str:
    """The crc32 of a text expression, where ``crc`` of CRC_SQL is joined."""
    of = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || hex(encode({text}))[2*i+1:2*i+2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL}, r AS (
  SELECT key, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY key, run
), h AS (SELECT run, n, {crc_sql("(key || ':' || run)")} AS h FROM r, crc
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)
), p AS (
  SELECT a.word AS a, b.word AS b, b.n AS bn FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word
), m AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY bn DESC, b) AS form, max(bn) AS form_n FROM p GROUP BY a
), f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN m ON m.word = w.word
), c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f l ON l.word = c.root AND l.form IS NULL
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by a two-pass shuffle; only the measures of the texts travel."""
    from fieldloom.llm.sharding import measured, shard

    docs = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return shard(docs.select("doc_id", "size", "text_crc32"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards the distribution of the benchmark's words."""
    from fieldloom.llm.importance_resampling import importance

    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), f AS (SELECT doc_id, unnest(w) AS f FROM d
), g AS (SELECT unnest(w) AS f FROM b
), k AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g), crc
), s AS (SELECT bucket, count(*)::DOUBLE AS s FROM f JOIN k USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM g JOIN k USING (f) GROUP BY bucket
), tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt
), gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot
), sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS sum FROM f JOIN k USING (f) JOIN gain USING (bucket) GROUP BY doc_id
), x AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (sum - ((sum % n) + n) % n) // n END::BIGINT AS weight,
    ('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT AS h
  FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
), y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_counts": op1_token_counts, "op2_lm_scoring": op2_lm_scoring, "op3_mixing": op3_mixing, "op4_language_id": op4_language_id, "op5_quality_classifier": op5_quality_classifier, "op6_pii": op6_pii, "op7_near_dedup": op7_near_dedup, "op8_decontamination": op8_decontamination, "op9_url_filters": op9_url_filters, "op10_quality_rules": op10_quality_rules, "op11_spelling_variants": op11_spelling_variants, "op12_sharding": op12_sharding, "op13_importance_resampling": op13_importance_resampling}


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": OP7_SQL, "op8_decontamination": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op13_importance_resampling": OP13_SQL}
