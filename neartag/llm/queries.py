"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neartag.llm import bpe, conversations, decontaminate, langid, licenses, lines, quality, rans, shards, simhash, spelling, topk, warc
from neartag.llm.common import remainder, small_batches
from neartag.plans.staging import Staging


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, staging=Staging(spark))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{Staging(spark).path}/tokens"
    rans.write_tokens(table(spark, sf_dir, "documents"), target, vocabulary("byte_bpe_50k.json"), end_id=0)
    return rans.read_tokens(spark, target)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, Staging(spark)))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Staging(spark), shingle=4, distance=4)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))
    return found.select("doc_id", "item_id", "overlap")


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items hold question and answer in one text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "response_id", "target", "payload_digest", "title", F.size("links").cast("bigint").alias("n_links"), "conversion_id",
        "text_digest", F.sha2("conversion", 256).alias("conversion_sha256"), "metadata_id", F.sha2("metadata", 256).alias("metadata_sha256"), "error")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.fit_documents(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 24, Staging(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").cast("bigint").alias("n_notices"), F.aggregate("spans", F.lit(0), lambda n, s: n + s.edits).cast("bigint").alias("n_edits"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(table(spark, sf_dir, "conversations"), Staging(spark))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), Staging(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run for run in (
        op1_topk, op2_bpe, op3_token_files, op4_line_dedup, op5_simhash, op6_decontaminate, op7_language, op8_warc, op9_quality, op10_shards,
        op11_licenses, op12_conversations, op13_spelling)
}


def sql_words(text: str) -> str:
    """Words as the operator cuts them: at ASCII characters that are no letters or digits."""
    return rf"list_filter(string_split_regex(lower({text}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def sql_shingles(key: str, table: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(ws[i:i + 4], ' ') AS s FROM (
    SELECT {key}, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM (SELECT {key}, {sql_words('text')} AS ws FROM {table}) WHERE len(ws) > 0)"""


def sql_crc32(text: str) -> str:
    """crc32 of a string of Latin-1 characters, by the table of its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        table.append(value)
    data = f"""flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
      ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END))"""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {data}),
      lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])))"""


# SQL for DuckDB.  Sharding, fingerprints by XXH64, tokens, coded files, compression, page
# markup and boosting have none; tests hold those queries against brute force.
ORACLE: dict[str, str] = {
    "op1_topk": """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
    FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20""",
    "op4_line_dedup": r"""WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
  k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  j AS (SELECT k.*, d.keeper IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d ON d.key = k.key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op6_decontaminate": f"""WITH item AS ({sql_shingles('item_id', 'benchmark')}), doc AS ({sql_shingles('doc_id', 'documents')}),
  n AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id)
  SELECT d.doc_id, i.item_id, count(*)::DOUBLE / any_value(n.n) AS overlap
  FROM doc d JOIN item i ON i.s = d.s JOIN n ON n.item_id = i.item_id GROUP BY d.doc_id, i.item_id HAVING count(*)::DOUBLE / any_value(n.n) >= 0.8""",

    "op12_conversations": rf"""WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
  damaged AS (SELECT coalesce(conv_id::VARCHAR, '') AS id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM given WHERE k <> 0),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
      regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged),
  faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      left(lag(role) OVER (PARTITION BY id ORDER BY i), 1) || left(role, 1) AS pair FROM numbered),
  r AS MATERIALIZED (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM faults),
  counted AS (SELECT id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
      count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY id),
  step(t, initial, u) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
  ins(s, t, c, a) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
      (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
  edit AS (SELECT f.fault, g.initial, t.t, t.t AS u, 4 AS c, 'D' AS a FROM (VALUES ('blank'), ('duplicate'), ('truncated'), ('')) f(fault),
      (VALUES ('s'), ('u'), ('a'), ('x')) g(initial), (VALUES (0), (1), (2), (3)) t(t)
    UNION ALL SELECT f.fault, step.initial, t, u, f.c, 'K' FROM step, (VALUES ('truncated', 3), ('', 0)) f(fault, c)
    UNION ALL SELECT f.fault, g.initial, t, u, f.c + 3, 'R' FROM (SELECT DISTINCT t, u FROM step WHERE initial <> 's'), (VALUES ('truncated', 3), ('', 0)) f(fault, c),
      (VALUES ('s'), ('u'), ('a'), ('x')) g(initial)),
  path(id, i, s, m) AS (SELECT id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': ''}} FROM counted
    UNION ALL SELECT p.id, p.i + 1, e.u, min({{'c': p.m.c + x.c + e.c, 'a': p.m.a || x.a || e.a}}) FROM path p JOIN ins x ON x.s = p.s
      JOIN r ON r.id = p.id AND r.i = p.i + 1 JOIN edit e ON e.fault = r.fault AND e.initial = r.initial AND e.t = x.t GROUP BY p.id, p.i, e.u),
  best AS MATERIALIZED (SELECT p.id, min({{'c': p.m.c + x.c, 'a': p.m.a || x.a}}) AS m FROM path p JOIN counted USING (id) JOIN ins x ON x.s = p.s
    WHERE p.i = n AND x.t IN (0, 3) GROUP BY p.id),
  letters AS (SELECT id, unnest(string_split(m.a, '')) AS e, generate_subscripts(string_split(m.a, ''), 1) AS pos FROM best),
  placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o,
      count(*) FILTER (e <> 'D') OVER (PARTITION BY id) AS total FROM letters WINDOW w AS (PARTITION BY id ORDER BY pos)),
  lines AS (SELECT p.id, string_agg(CASE WHEN e = 'K' THEN r.role WHEN (total - o) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':'
      || CASE WHEN e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS repaired
    FROM placed p LEFT JOIN r ON r.id = p.id AND r.i = p.i WHERE e <> 'D' GROUP BY p.id)
  SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(m.c, 0)::BIGINT AS cost, coalesce(m.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS id FROM conversations) o
    LEFT JOIN counted c ON c.id = o.id LEFT JOIN best b ON b.id = o.id LEFT JOIN lines l ON l.id = o.id""",
    "op13_spelling": rf"""WITH RECURSIVE r AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS run FROM documents),
  d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run),
  h AS (SELECT run, n, {sql_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM d),
  w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
  v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
  less AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS rest FROM i),
  gap AS (SELECT word, n, word[:i - 1] || '_' || word[i + 1:] AS rest FROM i),
  near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(n) AS m, arg_min(other, (-n, encode(other))) AS form FROM near GROUP BY word),
  f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN form END AS form,
    CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
  chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word
    JOIN f e ON e.word = c.at WHERE e.form IS NULL""",
}
