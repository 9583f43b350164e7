"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, pivot_negatives, quality_fm, quality_rules, storage, token_counts, token_file, turn_repair
from .textbatch import crc_remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by the factorisation machine. Null and empty texts are scored from their statistics; repeated rows are scored each; a null doc_id is not held out and has no label; an empty table gives no rows; other columns but n_chars are not looked at."""
    docs = _read(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 4) == 2
    machine = quality_fm.fit(docs.where(~F.coalesce(held, F.lit(False))), _read(spark, sf_dir, "labels").where(~F.coalesce(held, F.lit(False))))
    scored = quality_fm.score(docs, machine)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under Brown classes. A null text is empty and has one token, its end; repeated rows are scored each; a null doc_id is not held out; other columns are not looked at."""
    docs = _read(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 10) == 0
    out = brown_lm.score(docs, held, row=storage.file_row())
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. A null text counts as empty and fails the base rules; null languages and sources are groups of their own; repeated rows count each; equal values at a cutoff are kept; other columns are not looked at."""
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes. A null text has size 0 and is never taken; null sources come last; rows with the same id are taken alike, those without an id by their text; other columns are not looked at."""
    return mixing.plan(_read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of linked texts. A null text, or one without words, links with nothing; rows with the same id are one document; a null id counts as the smallest; other columns are not looked at."""
    return ngram_join.join(_read(spark, sf_dir, "documents"), size=4, threshold=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated and similar lines. A null text stays null and has no lines; of equal occurrences the one of the smallest id, then the first in the table, stays; repeated rows are rows of their own; other columns are not looked at."""
    return line_dedup.report(_read(spark, sf_dir, "documents"), row=storage.file_row())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words within benchmark windows. A null or empty text has no words; items without words have no windows; repeated rows are scanned each; other columns are not looked at."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language. Null texts and those without a letter are `und` with score 0; equal sizes go to the language with more rows; repeated rows are judged each; other columns are not looked at."""
    docs = _read(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 4) == 2
    dictionaries = language_id.learn(docs.where(~held))
    found = language_id.identify(docs, dictionaries)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens. Null and empty texts have none; repeated rows are counted each; other columns are not looked at."""
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text. Null and empty html gives an empty text; repeated rows are extracted each; other columns are not looked at."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive. Rows with a null label, vector, component or id, or a component that is not finite, take no part; equal scores go to the smaller id; repeated rows are rows of their own; without anchors or rows there is no result; other columns are not looked at."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivot_negatives.mine(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in files of token ids. A null text counts as empty and has its end id alone; rows without a doc_id come first; repeated rows stand each; an empty table gives no rows; other columns are not looked at."""
    import public_tokenizers

    path = f"{storage.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_file.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end=2, row=storage.file_row())
    return token_file.read(spark, path)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation. Nulls are one space each, but a null turn has no number and comes first, and a null conv_id is a conversation; repeated turns are duplicates; a conversation without a turn left has zeros; an empty table gives no rows; other columns are not looked at."""
    convs = _read(spark, sf_dir, "conversations")
    found = turn_repair.report(turn_repair.damage(convs)).withColumnRenamed("conv_id", "_conv")
    every = convs.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_brown_class_lm, op3_quality_rules, op4_source_mixing, op5_ngram_jaccard_join, op6_line_dedup, op7_benchmark_decontamination, op8_language_id, op9_token_counts, op10_html_extraction, op11_hard_negatives, op12_token_file, op13_turn_repair)}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WHITE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_FAR = "{'c': 1000000000, 'a': '', 't': ''}"
_MORE = lambda s, cost, edit, turn="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {s}.t || {turn}}}"
_LEAST = lambda *s: f"list_aggregate([{', '.join(s)}], 'min')"
_ADDED = lambda role: f"chr(10) || '{role}:'"
_KEPT = "CASE f WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END"
_TURN = lambda role: f"chr(10) || {role} || ':' || text"
_ONLY = lambda initial: f"(CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE 1000000000 END + {_KEPT})"
_ROUNDED = "v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0)::INT)"
SQL: dict[str, str] = {
    "op7_benchmark_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
  i AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM s), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM i),
  x AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n), h AS (SELECT r, p, x.n, item_id FROM x JOIN bw ON x.n = bw.n AND array_to_string(w[p:p + x.n - 1], ' ') = k),
  c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r), t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op3_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WHITE_WORDS} AS w FROM documents),
  i AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3), g AS (SELECT r, p, count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS n FROM i),
  h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
  y AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
  c AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(y.n, 0)::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN y USING (r) LEFT JOIN h USING (r)),
  b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
  k(ratio, below, above) AS (VALUES ('symbols', NULL, 60), ('length', 1500, 1500), ('lines', NULL, 30), ('repeats', NULL, 400)),
  v AS (SELECT r, lang, source, base_failed, ratio, below, above, (CASE ratio WHEN 'symbols' THEN n_symbols WHEN 'length' THEN word_chars WHEN 'lines' THEN n_dup_lines ELSE n_repeat_words END * 1000) // greatest(n_words, 1) AS v FROM b, k),
  x AS (SELECT *, {_ROUNDED} AS u FROM v),
  s AS (SELECT 2 AS level, lang, source, ratio, u FROM x WHERE NOT base_failed UNION ALL SELECT 1, lang, NULL, ratio, u FROM x WHERE NOT base_failed UNION ALL SELECT 0, NULL, NULL, ratio, u FROM x WHERE NOT base_failed),
  o AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, ratio ORDER BY u) AS upto, count(*) OVER (PARTITION BY level, lang, source, ratio) AS total FROM s),
  q AS (SELECT level, lang, source, ratio, max(total) AS total, min(u) FILTER (upto * 4 >= total) AS q1, min(u) FILTER (upto * 4 >= total * 3) AS q3 FROM o GROUP BY level, lang, source, ratio),
  m AS (SELECT x.r, bool_or(u > p.q3 + greatest(3 * (p.q3 - p.q1), above) OR coalesce(u < p.q1 - greatest(3 * (p.q3 - p.q1), below), false) AND below IS NOT NULL) AS bad FROM x
    LEFT JOIN q a ON a.level = 2 AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source AND a.ratio = x.ratio AND a.total >= 200
    LEFT JOIN q e ON e.level = 1 AND e.lang IS NOT DISTINCT FROM x.lang AND e.ratio = x.ratio AND e.total >= 200 JOIN q z ON z.level = 0 AND z.ratio = x.ratio
    JOIN q p ON p.ratio = x.ratio AND p.level = CASE WHEN a.level IS NOT NULL THEN 2 WHEN e.level IS NOT NULL THEN 1 ELSE 0 END AND (p.level = 0 OR p.lang IS NOT DISTINCT FROM x.lang) AND (p.level < 2 OR p.source IS NOT DISTINCT FROM x.source) GROUP BY x.r)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM b LEFT JOIN m USING (r)""",
    "op11_hard_negatives": """WITH e AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.n, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.n <> e.n WHERE a.vec_id % 100 = 0),
  p AS (SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS slot FROM s WHERE same QUALIFY slot <= 5)
  SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.n, slot ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.n = s.n AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_turn_repair": f"""WITH RECURSIVE b AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS b FROM range(256) r(i)),
  o AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  m AS (SELECT o.*, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, b[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d FROM o, b),
  x AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, id, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS e FROM m WHERE d <> 0),
  y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, e) AS i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, e) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f FROM x),
  z AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM y),
  g AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id),
  r AS (SELECT conv_id, n, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM g
    UNION ALL SELECT q.conv_id, n, y.i, {_MORE("s0", 2, "D")}, {_LEAST(_MORE("s1", 2, "D"), _MORE("s0", _ONLY("s"), "K", _TURN("role")))},
      {_LEAST(_MORE("s2", 2, "D"), _MORE("s9", _ONLY("u"), "K", _TURN("role")), _MORE("s9", f"1 + {_KEPT}", "R", _TURN("'user'")))}, {_LEAST(_MORE("s3", 2, "D"), _MORE("s2", _ONLY("a"), "K", _TURN("role")), _MORE("s2", f"1 + {_KEPT}", "R", _TURN("'assistant'")))}
    FROM (SELECT *, {_LEAST("s0", "s1", "s3")} AS s9 FROM (SELECT * REPLACE ({_LEAST("s3", _MORE("s2", 5, "I", _ADDED("assistant")))} AS s3) FROM (SELECT * REPLACE ({_LEAST("s2", *(_MORE(x, 5, "I", _ADDED("user")) for x in ("s0", "s1", "s3")))} AS s2) FROM r WHERE i < n))) q
    JOIN y ON y.conv_id IS NOT DISTINCT FROM q.conv_id AND y.i = q.i + 1),
  v AS (SELECT conv_id, {_LEAST("s0", "s3", _MORE("s2", 5, "I", _ADDED("assistant")))} AS w FROM r WHERE i = n)
  SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit,
    sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op5_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)), u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
  r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x), m AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id))::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON x = doc_id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)