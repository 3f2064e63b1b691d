"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, collocations, embed_dedup, filter_audit, html_extract, line_dedup, minhash, mixing, packing, quality, suffix_dedup, token_files, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mix_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("kept", "kept_sha256")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archive(spark, folder)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return filter_audit.audit(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return token_files.read_token_files(spark, folder)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pack_sequences": op2_pack_sequences,
    "pack_conversations": pack_conversations,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rank": op7_quality_rank,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_text": op9_html_text,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_files": op13_token_files,
}

_DRAWS = ", ".join(f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{k // 4}'), {1 + 8 * (k % 4)}, 8))::BIGINT / 4294967296.0::DOUBLE" for k in range(mixing.SEEDS))

ORACLE_SQL = {
    "op1_mix_sources": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM t),
o AS (SELECT *, row_number() OVER s AS pos,
  (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0) AS rest,
  (sum(weight) OVER ()) - coalesce(sum(weight) OVER p, 0) AS open
  FROM w WINDOW s AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST),
  p AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest / open AS level, min(CASE WHEN rest / open * weight <= cap THEN pos END) OVER () AS first FROM o),
g AS (SELECT source, source_size, CASE WHEN pos < coalesce(first, pos + 1) THEN cap
  ELSE (max(CASE WHEN pos = first THEN level END) OVER ()) * weight END AS target FROM f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM g),
u AS (SELECT d.doc_id, d.size, r.*, [{_DRAWS}] AS draws
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT source, s, abs(sum(CASE WHEN draws[s] < rate - floor(rate) THEN size ELSE 0 END) - (any_value(target) - floor(any_value(rate)) * any_value(source_size))) AS miss
  FROM u, range(1, {mixing.SEEDS + 1}) AS q(s) GROUP BY source, s),
b AS (SELECT source, s FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, s) = 1)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draws[b.s] < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
q AS (SELECT lang, doc, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS body FROM p),
w AS (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM q),
x AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM x),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
c3 AS (SELECT f3.lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, f3.f AS a,
  a1.f AS la, b1.f AS ra, a2.f AS lb, b2.f AS rb
  FROM f3 JOIN f1 a1 USING (lang, w1) JOIN f2 a2 USING (lang, w1, w2)
  JOIN f2 b1 ON b1.lang = f3.lang AND b1.w1 = f3.w2 AND b1.w2 = f3.w3 JOIN f1 b2 ON b2.lang = f3.lang AND b2.w1 = f3.w3),
h3 AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
c2 AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, a1.f AS l, b1.f AS r
  FROM f2 JOIN f1 a1 ON a1.lang = f2.lang AND a1.w1 = f2.w1 JOIN f1 b1 ON b1.lang = f2.lang AND b1.w1 = f2.w2
  LEFT JOIN h3 ON h3.lang = f2.lang AND h3.w1 = f2.w1 AND h3.w2 = f2.w2
  WHERE f2.f >= 10 AND (h3.f IS NULL OR 100 * h3.f < 50 * f2.f)),
s AS (SELECT lang, phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c2
  UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN la ELSE lb END, CASE WHEN s1 <= s2 THEN ra ELSE rb END, least(s1, s2)
  FROM (SELECT *, 1000000::HUGEINT * a * a // (la::HUGEINT * ra) AS s1, 1000000::HUGEINT * a * a // (lb::HUGEINT * rb) AS s2 FROM c3)),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS bad
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f AS (SELECT i, chr((65 + i)::INTEGER) AS letter FROM range(5) AS r(i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS p
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, k::INTEGER AS step, (1 << p[k])::BIGINT AS own,
  coalesce(list_sum(list_transform(p[1:k - 1], lambda x: (1 << x)::BIGINT)), 0)::BIGINT AS earlier FROM o, range(1, 6) AS r(k))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step""",
}
