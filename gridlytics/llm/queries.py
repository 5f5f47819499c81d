"""Registered queries of the operators in this package. `QUERIES` and `ORACLES` are read by `__spark_entry__`."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.llm import boilerplate, conversations, decontam, importance, langid, minhash, packing, quality, repetition, secrets
from gridlytics.llm import simple8b, storage, toxicity, warc

#: Where the public tokenizer files are; a parameter of the operators that use one.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(table(spark, sf_dir, "pages"))


def remainder(id_col: str, by: int):
    """The crc32 of an id as text, modulo `by`."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(remainder("doc_id", 5) != 0), "quality")
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archive(table(spark, sf_dir, "pages"), storage.new_folder(spark, "warc"))
    return warc.read_archive(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    return langid.identify(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.staged_pieces(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    digests = pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.placed(digests)


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_tokens(
        table(spark, sf_dir, "documents"), storage.new_folder(spark, "tokens"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1
    )
    return simple8b.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.train(docs, labels.where(remainder("doc_id", 3) != 1), "toxic")
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits", "n_misspelled",
        "n_quoted", "worst_term",
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies, gone = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(rows, copies=copies, gone=gone)


QUERIES = {
    f.__name__: f for f in (
        op1_repetition, op2_secrets, op3_minhash, op4_main_text, op5_quality, op6_warc, op7_language, op8_packing, op9_simple8b,
        op10_decontamination, op11_importance, op12_toxicity, op13_conversations,
    )
}

#: The CRC-32 of the strings `s` of a CTE `strings`, as column `crc` of a CTE `hashed`: one byte a round.
CRC = """
        remainders(k, v, round) AS (
          SELECT k, k, 0 FROM range(256) r(k)
          UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, round + 1 FROM remainders WHERE round < 8),
        bytewise(k, v) AS MATERIALIZED (SELECT k, v FROM remainders WHERE round = 8),
        rounds(s, h, left_over, crc) AS (
          SELECT s, hex(encode(s)), octet_length(encode(s)), 4294967295 FROM strings
          UNION ALL
          SELECT s, substr(h, 3), left_over - 1, xor(v, crc >> 8)
          FROM rounds JOIN bytewise ON k = xor(crc, CAST('0x' || substr(h, 1, 2) AS BIGINT)) & 255 WHERE left_over > 0),
        hashed AS MATERIALIZED (SELECT s, xor(crc, 4294967295) AS crc FROM rounds WHERE left_over = 0)"""

#: The other operators have no SQL form: models, markup, tokenizers, packing and ranked retrieval. Tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op3_minhash": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 1 THEN w
                              ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s
          FROM words),
        members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        common AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
          FROM members a JOIN members b USING (shingle) WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
        links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (nx + ny - c)),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op6_warc": """
        WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        holders AS (SELECT digest, max(page_id) AS holder FROM payloads WHERE n >= 1000 GROUP BY 1)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN holder <> page_id THEN holder END AS refers_to
        FROM payloads LEFT JOIN holders USING (digest)""",
    "op11_importance": rf"""
        WITH RECURSIVE texts AS (
          SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents
          UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
        words AS MATERIALIZED (
          SELECT side, k, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
          FROM texts),
        found AS MATERIALIZED (
          SELECT side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM words),
        strings AS (SELECT DISTINCT s FROM found),
        {CRC},
        buckets AS MATERIALIZED (SELECT side, k, crc % 10000 AS bucket FROM found JOIN hashed USING (s)),
        gains AS (
          SELECT bucket, CAST(floor(1000 * ln(CAST(sum(CASE WHEN side = 't' THEN 1 ELSE 0 END) + 1 AS DOUBLE)
                   * (SELECT count(*) + 10000 FROM buckets WHERE side = 'd')
                 / (CAST(sum(CASE WHEN side = 'd' THEN 1 ELSE 0 END) + 1 AS DOUBLE) * (SELECT count(*) + 10000 FROM buckets WHERE side = 't')))) AS BIGINT) AS gain
          FROM buckets GROUP BY 1),
        weights AS (
          SELECT k, count(*) AS n, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
          FROM buckets JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
        scored AS (
          SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS meant,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                   (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
          FROM words LEFT JOIN weights USING (k) WHERE side = 'd'),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY meant ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY meant) AS n FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN meant AND r <= n * 25 // 100 THEN r END AS rank
        FROM ranked""",
    "op13_conversations": rf"""
        WITH RECURSIVE strings AS (
          SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
        {CRC},
        struck AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS kind
          FROM conversations JOIN hashed ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
          FROM struck WHERE kind <> 0),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM damaged),
        turns AS MATERIALIZED (
          SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
                 CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
                 lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
          FROM placed),
        -- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
        moves(q, edit, initial, p, price) AS (
          SELECT q, 'D', CAST(NULL AS VARCHAR), q, 4 FROM range(4) r(q)
          UNION ALL SELECT q, 'R', NULL, CASE WHEN q = 2 THEN 3 ELSE 2 END, 3 FROM range(4) r(q)
          UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
        inserts(q, p, added, lines) AS (
          SELECT q, q, '', CAST([] AS VARCHAR[]) FROM range(4) r(q)
          UNION ALL SELECT q, CASE WHEN p = 2 THEN 3 ELSE 2 END, added || 'I', list_append(lines, CASE WHEN p = 2 THEN 'assistant:' ELSE 'user:' END)
          FROM inserts WHERE len(added) < 3),
        paths(conv_id, i, q, best) AS (
          SELECT conv_id, CAST(0 AS BIGINT), p, min({{'cost': 3 * len(added), 'audit': added, 'lines': lines}})
          FROM (SELECT DISTINCT conv_id FROM turns) JOIN inserts ON q = 0 GROUP BY 1, 2, 3
          UNION ALL
          SELECT t.conv_id, t.i, n.p, min({{
              'cost': best.cost + price + CASE WHEN edit <> 'D' AND fault IS NOT NULL THEN 3 ELSE 0 END + 3 * len(added),
              'audit': best.audit || edit || added,
              'lines': list_concat(best.lines, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
                                                    ELSE [CASE WHEN m.p = 2 THEN 'user:' ELSE 'assistant:' END || text] END, n.lines)}})
          FROM paths JOIN turns t ON t.conv_id IS NOT DISTINCT FROM paths.conv_id AND t.i = paths.i + 1
               JOIN moves m ON m.q = paths.q AND (m.initial IS NULL OR m.initial = t.initial) AND (edit = 'D' OR fault IS NULL OR fault = 'truncated')
               JOIN inserts n ON n.q = m.p
          GROUP BY 1, 2, 3),
        repaired AS (
          SELECT paths.conv_id, min(best) AS best
          FROM paths JOIN (SELECT conv_id, max(i) AS i FROM turns GROUP BY 1) e ON e.conv_id IS NOT DISTINCT FROM paths.conv_id AND e.i = paths.i
          WHERE q IN (0, 3) GROUP BY 1),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                 count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM turns GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(best.cost AS BIGINT), 0) AS cost,
               coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
             LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
