"""One query per operator over its whole table, with the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import (
    bpe,
    chat_perspectives,
    collocations,
    exact_dedup,
    jaccard_join,
    language_gru,
    line_rules,
    packing,
    quality_gam,
    secret_scan,
    token_alignment,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH m AS (
      SELECT DISTINCT conv_id, turn, replace(coalesce(nullif(role, ''), 'unknown'), '<|', '< |') AS role,
             replace(coalesce(text, ''), '<|', '< |') AS text, coalesce(floor(turn / 256), 0)::BIGINT AS part
      FROM conversations
    ), d AS (
      SELECT conv_id, turn, role, text, part, (place // 512)::BIGINT AS split, ((n - 1) // 512)::BIGINT AS last
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
                   count(*) OVER (PARTITION BY conv_id, part) AS n FROM m)
    ), k AS (SELECT DISTINCT conv_id, part, split FROM d),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY part, split) = 1),
    heads AS (
      SELECT d.conv_id, d.turn, d.role, d.text, d.part, d.split FROM d JOIN f
      ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND d.part = f.part AND d.split = f.split WHERE role = 'system'
    ), tails AS (
      SELECT conv_id, CASE WHEN split < last THEN part ELSE part + 1 END AS part,
             CASE WHEN split < last THEN split + 1 ELSE 0 END AS split, turn, role, text
      FROM d WHERE role <> 'system' QUALIFY row_number() OVER (
        PARTITION BY conv_id, part, split ORDER BY turn DESC NULLS LAST, role DESC, text DESC) <= 16
    ), shown AS (
      SELECT k.conv_id, k.part, k.split, 0 AS kind, turn, role, text FROM k JOIN heads h
      ON k.conv_id IS NOT DISTINCT FROM h.conv_id AND (k.part <> h.part OR k.split <> h.split)
      UNION ALL
      SELECT k.conv_id, k.part, k.split, 1, turn, role, text FROM k JOIN tails t
      ON k.conv_id IS NOT DISTINCT FROM t.conv_id AND k.part = t.part AND k.split = t.split
      UNION ALL
      SELECT conv_id, part, split, 2, turn, role, text FROM d
    ), v AS (
      SELECT s.speaker, m.*, kind = 2 AND m.role = s.speaker AS own, '<|im_start|>' || CASE WHEN m.role = s.speaker
               THEN 'assistant' WHEN m.role = 'system' THEN 'system' ELSE 'user name=' || m.role END || chr(10) || m.text
             || '<|im_end|>' || chr(10) AS segment
      FROM (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system') s
      JOIN shown m ON s.conv_id IS NOT DISTINCT FROM m.conv_id
    ), w AS (
      SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, part, split, speaker
                                           ORDER BY kind, turn NULLS FIRST, role, text) AS stop FROM v
    )
    SELECT conv_id, part, split, speaker, count(*) AS n_messages, string_agg(segment, '' ORDER BY stop) AS text,
           coalesce(string_agg((stop - length(segment) + 22)::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY stop)
             FILTER (WHERE own), '') AS masks
    FROM w GROUP BY conv_id, part, split, speaker
    """
)
def op1_chat_perspectives(spark, sf_dir):
    views = chat_perspectives.chat_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    return views.withColumn("masks", F.array_join(spans, ","))


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
                 [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
          FROM d),
    g AS (SELECT doc_id, i, words[i:i + 2] AS gram
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
    t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
    r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    l AS (SELECT host, text, line, sum(len(string_split(line, ' '))) AS words
          FROM (SELECT host, text, trim(unnest(string_split(
                         lower(regexp_replace(text, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10)))) AS line
                FROM (SELECT DISTINCT host, text FROM d))
          WHERE line <> '' GROUP BY ALL),
    h AS (SELECT host, text, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS documents
          FROM d GROUP BY host, text),
    f AS (SELECT host, line FROM l JOIN h USING (host, text) GROUP BY host, line HAVING sum(documents) > 20),
    m AS (SELECT host, text, sum(words) AS removed FROM l JOIN f USING (host, line) GROUP BY host, text)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed,
           NOT base_failed AND NOT n_words - words_removed < 0.2 * n_words AS kept
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
          FROM (SELECT doc_id, len(words)::BIGINT AS n_words,
                       length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                       coalesce(r.n, 0) AS n_repeat_words, coalesce(m.removed, 0)::BIGINT AS words_removed
                FROM w LEFT JOIN r USING (doc_id) LEFT JOIN m USING (host, text)))
    """
)
def op3_line_rules(spark, sf_dir):
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


@query(
    """
    WITH normal AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS normal FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(normal) AS text_sha256
    FROM normal WINDOW w AS (PARTITION BY normal)
    """
)
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_quality_gam(spark, sf_dir):
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_language_gru(spark, sf_dir):
    return language_gru.languages(table(spark, sf_dir, "documents"))


@query()
def op6_jaccard_components(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


@query()
def op7_bpe_codec(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


@query()
def op8_toxicity_kneser_ney(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_secret_grammar(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(named, ",")

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(of("learned")).cast("long").alias("n_learned"),
    )


@query()
def op10_best_two_fit(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query(
    """
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents
    ), w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS words FROM p),
    f AS MATERIALIZED (
      SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS g, any_value(words[i:i + k - 1]) AS ws,
             lang || chr(10) || array_to_string(words[i:i + k - 1], ' ') AS id, count(*) AS f
      FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES (1), (2), (3)) t(k)
      WHERE i + k - 1 <= len(words) GROUP BY lang, k, array_to_string(words[i:i + k - 1], ' ')),
    c AS MATERIALIZED (SELECT *, f::HUGEINT AS a FROM f WHERE k > 1 AND f >= 10),
    halves AS (SELECT c.*, cut, lang || chr(10) || array_to_string(ws[1:cut], ' ') AS head,
                      lang || chr(10) || array_to_string(ws[cut + 1:k], ' ') AS tail
               FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
    cuts AS (SELECT c.lang, c.g, c.a, cut, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f::HUGEINT * y.f::HUGEINT) AS score
             FROM halves c JOIN f x ON x.id = head JOIN f y ON y.id = tail),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    longer AS (SELECT lang, h, max(a) AS b FROM (
                 SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS h FROM c WHERE k = 3)
               GROUP BY lang, h),
    kept AS (SELECT m.* FROM lowest m LEFT JOIN longer o ON o.lang = m.lang AND o.h = m.g WHERE b IS NULL OR 100 * b < 50 * a),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
    SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase,
           a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
    """
)
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op12_token_alignment(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


URL_RULES = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in url_filter.RULES)
URL_WORDS = ", ".join(f"'{word}'" for word in url_filter.BLOCKED_WORDS)


@query(
    f"""
    WITH rest AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM rest
    ), rules AS (
      SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
      FROM (VALUES {URL_RULES}) t(verdict, rule)
    ), hosts AS (
      SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
        ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)
      GROUP BY host, path
    )
    SELECT p.page_id, p.host, p.path, h.rule,
           coalesce(h.verdict, CASE WHEN list_has_any(regexp_split_to_array(p.host, '[.-]'), [{URL_WORDS}])
                                    THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts p LEFT JOIN hosts h ON p.host = h.host AND p.path = h.path
    """
)
def op13_url_filter(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))
