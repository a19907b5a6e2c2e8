"""The registered queries of this subpackage, and check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillweave.llm import audit, decontaminate, fingerprints, langid, licenses, lines, mixing, neardup, pages, resample, tokens, toxicity, vafile
from tillweave.llm.common import LOWER, SHARED_SQL_SPACES, UPPER, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = langid.identify(docs.drop("lang"), langid.fit(docs))
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_files(docs, tokens.public_tokenizer())


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample.draw(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP2_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{mixing.SEED}' || coalesce(':' || doc_id, '')) AS hash FROM documents),
src AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
lim AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY key = '', key) - 1) % 3) + 1] AS weight, {mixing.REPEATS} * source_size AS lim FROM src),
lev AS (SELECT *, lim / weight AS ratio,
        ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY lim / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM lim),
aim AS (SELECT key, source_size, least(lim::DOUBLE, weight * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 0)) AS target FROM lev),
seat AS (SELECT *, round(sum(target) OVER () / {mixing.BLOCK_WORDS})::BIGINT AS seats FROM aim),
won AS (SELECT key, count(*) AS quota FROM (
        SELECT key, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, key, k) AS rank
        FROM seat, LATERAL (SELECT unnest(range(seats)) AS k) WHERE target > 0) WHERE rank <= seats GROUP BY key),
quota AS (SELECT seat.key, source_size, target, coalesce(quota, 0) AS quota,
          least({16 ** mixing.SHARD_DIGITS}, pow(2, length(bin(greatest(1, source_size // {mixing.SHARD_WORDS}))) - 1)::INT) AS shards
          FROM seat LEFT JOIN won USING (key)),
placed AS (SELECT s.*, source_size, target, quota, ('0x' || substr(hash, 1, {mixing.SHARD_DIGITS}))::INT % shards AS shard FROM sized s JOIN quota USING (key)),
shard AS (SELECT key, shard, quota, sum(size) AS shard_size FROM placed GROUP BY ALL),
swon AS (SELECT key, shard, count(*) AS got FROM (
         SELECT key, shard, quota, row_number() OVER (PARTITION BY key ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS rank
         FROM shard, LATERAL (SELECT unnest(range(quota)) AS k) WHERE shard_size > 0) WHERE rank <= quota GROUP BY ALL),
take AS (SELECT key, shard, shard_size::BIGINT AS shard_size, least(coalesce(got, 0) * {mixing.BLOCK_WORDS}, {mixing.REPEATS} * shard_size)::BIGINT AS take
         FROM shard LEFT JOIN swon USING (key, shard)),
run AS (SELECT p.*, shard_size, take, sum(size) OVER (PARTITION BY key, shard ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS run_end
        FROM placed p JOIN take USING (key, shard))
SELECT doc_id, size, source_size, target,
       CASE WHEN shard_size = 0 THEN 0 ELSE size * (take // shard_size)
       + greatest(0, least(run_end, take % shard_size) - run_end + size) END::BIGINT AS taken FROM run
"""

OP8_SQL = f"""
WITH v AS (SELECT vec_id, [floor({vafile.SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.x, c.x)])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP7_SQL = f"""
WITH line AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
              generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {SHARED_SQL_SPACES}), '{UPPER}', '{LOWER}') AS key FROM line),
many AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key
         HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCUMENTS}),
marked AS (SELECT keyed.*, many.key IS NOT NULL AND doc_id <> first_id AS gone FROM keyed LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP12_SQL = f"""
WITH codes AS (SELECT list(list_reduce([n] || [0 FOR _ IN range(8)], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS crc
               FROM (SELECT unnest(range(256)) AS n)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
aim AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM (SELECT words FROM doc UNION ALL SELECT words FROM aim)),
bucket AS (SELECT word, xor(4294967295, list_reduce([4294967295] || [('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT FOR i IN range(1, length(hex(word)) // 2 + 1)],
           lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) % {resample.BUCKETS} AS bucket FROM vocabulary, codes),
used AS (SELECT doc_id, bucket FROM (SELECT doc_id, unnest(words) AS word FROM doc) JOIN bucket USING (word)),
s AS (SELECT bucket, count(*) AS s FROM used GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(words) AS word FROM aim) JOIN bucket USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {resample.BUCKETS})
         / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {resample.BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weight AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM used JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('{resample.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM doc LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resample.MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
           count(*) OVER (PARTITION BY n_features >= {resample.MIN_WORDS}) * {resample.PERCENT} // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {resample.MIN_WORDS} AND place <= most THEN place END AS rank FROM ranked
"""

OP13_SQL = """
WITH RECURSIVE base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
              regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
            + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
            + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM base LEFT JOIN marks USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failing GROUP BY ALL),
walk AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, -1 AS number, 0 AS gone
         UNION ALL SELECT filter_order || chr(65 + k::INT), step + 1, gone, k::INT, gone | (1 << k::INT) FROM walk, range(5) r(k) WHERE gone & (1 << k::INT) = 0),
steps AS (SELECT o.filter_order, w.step, w.before, w.number, w.gone FROM walk o JOIN walk w ON o.step = 5 AND w.step > 0 AND starts_with(o.filter_order, w.filter_order)),
found AS (SELECT part, filter_order, step, any_value(number) AS number,
          sum(n) FILTER (WHERE fails & gone = 0) AS kept, sum(n) FILTER (WHERE fails & before = 0 AND fails & (1 << number) > 0) AS removed,
          sum(n) FILTER (WHERE fails & before > 0 AND fails & (1 << number) > 0) AS redundant, sum(n) FILTER (WHERE fails = 1 << number) AS unique_fails,
          sum(good) FILTER (WHERE fails & before = 0 AND fails & (1 << number) > 0) AS good_lost,
          sum(toxic) FILTER (WHERE fails & before = 0 AND fails & (1 << number) > 0) AS toxic_lost
          FROM cell CROSS JOIN steps GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, number), 0)::BIGINT AS shapley FROM found
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_top_k": op8_top_k,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_output": op10_token_output,
    "op11_fingerprints": op11_fingerprints,
    "op12_resampling": op12_resampling,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op2_mixing": OP2_SQL, "op7_line_dedup": OP7_SQL, "op8_top_k": OP8_SQL, "op12_resampling": OP12_SQL, "op13_filter_audit": OP13_SQL}
