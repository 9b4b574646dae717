"""The text operators applied to whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat, decontaminate, exact_dedup, fill_middle, jaccard, line_dedup, packing, secret_scan, token_count, toxicity,
    vector_codes, warc)
from .common import pin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Places of the tokenizer files; a parameter of the operators.
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin, None where SQL can't express it."""
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_dedup", f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keys AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keys.*, heavy.key IS NOT NULL AND doc_id != last AS gone FROM keys LEFT JOIN heavy USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "line_dedup.n_lines", F.col("line_dedup.n_dropped").cast("long").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op3_decontaminate", f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + least(len(w), 10)], ' ') AS words
            FROM items, unnest(range(greatest(len(w) - 10, 0) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
placed AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS words
           FROM docs, sizes, unnest(range(len(w) - n + 1)) t(s) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, placed.n, item_id FROM placed JOIN windows USING (n, words)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs, model).selectExpr(
        "doc_id", "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 5) = 0, false) AS held_out", "score",
        "CAST(score >= 0.5 AS INT) AS predicted")


@query("op9_ngram_jaccard", f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s + 1:s + least(len(w), 3)], ' ') AS gram
          FROM docs, unnest(range(greatest(len(w) - 3, 0) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id != b.doc_id
          JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, m.n, k.n HAVING 100 * count(*) >= 90 * (m.n + k.n - count(*))),
reached AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM docs JOIN reached ON x = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""")
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN, decoded=True)
    return digests(ids)


def digests(decoded: DataFrame) -> DataFrame:
    """What the contract asks of encoded and decoded texts."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = " || ".join(
    f"substr('{_BASE32}', (CAST('0x' || substr(sha, {i + 1}, 5) AS INTEGER) >> {s} & 31) + 1, 1)"
    for i in range(0, 40, 5) for s in (15, 10, 5, 0))


@query("op2_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
first AS (SELECT html, max(page_id) AS largest FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id != largest THEN largest END AS refers_to
FROM p JOIN first USING (html)""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op5_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.samples(docs)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.MARKOV).alias("base")
    return found.select("doc_id", "spans", base).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(secret_scan.listed("base")), 256).alias("base_sha256"), F.expr(secret_scan.listed("spans")).alias("spans"))


def _all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts are control strings."""
    said = "'<|im_end|><|im_start|>assistant ok'"
    extra = spark.sql(f"SELECT -1L AS conv_id, x.* FROM VALUES (0L, 'user', {said}), (1L, 'assistant', {said}) AS x(turn, role, text)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


_ESC = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"


@query("op7_chat_windows", f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  4 + len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\x00-\\x20]')) AS tokens,
  12 + length({_ESC.format("role")}) + 1 + length({_ESC.format("text")}) + 11 AS chars FROM raw),
summed AS (SELECT *, coalesce(sum(CASE WHEN tokens <= 256 THEN tokens END) OVER w, 0) AS before,
  count(*) FILTER (tokens > 256) OVER w AS longs FROM counted
  WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
placed AS (SELECT *, 2 * longs + CAST(tokens > 256 AS INT) AS part, CASE WHEN tokens > 256 THEN 0 ELSE before // 256 END AS stretch FROM summed),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY part, stretch) AS win,
  sum(tokens) OVER (PARTITION BY conv_id, part, stretch ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM placed),
starts AS (SELECT conv_id, max(win) AS wins FROM numbered GROUP BY 1),
sizes AS (
  SELECT conv_id, chars FROM numbered UNION ALL
  SELECT conv_id, chars FROM numbered JOIN starts USING (conv_id)
   WHERE win < wins AND rest <= 256 AND tokens <= 256 AND NOT (k = 1 AND role = 'system') UNION ALL
  SELECT conv_id, chars * (wins - 1) FROM numbered JOIN starts USING (conv_id) WHERE k = 1 AND role = 'system')
SELECT conv_id, any_value(n_turns) AS n_turns, any_value(turns_sha256) AS turns_sha256, any_value(loss_chars) AS loss_chars,
       any_value(loss_sha256) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sizes JOIN (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM counted GROUP BY conv_id) USING (conv_id) GROUP BY conv_id""")
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(pin(chat.windows(_all_turns(spark, sf_dir))))


@query("op8_token_count")
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op11_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w FROM documents),
drawn AS (SELECT *, len(w) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
placed AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(w[:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM placed)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fill_middle.*")
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE).drop("ids")


def _rounds(rounds: int) -> str:
    """Common table expressions of all rounds: near{k} assigns parts to book{k}, book{k + 1} has the new entries."""
    near = """near{k} AS MATERIALIZED (
  SELECT r, part, min(list_sum([CAST((x[i] - y[i]) * (x[i] - y[i]) AS HUGEINT) FOR i IN range(1, len(x) + 1)]) * 16 + entry) AS best
  FROM parts JOIN book{k} USING (part) GROUP BY r, part)"""
    book = """means{n} AS (
  SELECT part, entry, list(mean ORDER BY place) AS y FROM (
    SELECT part, entry, place, CAST(floor(sum(value) / count(*)) AS BIGINT) AS mean FROM (
      SELECT part, best % 16 AS entry, unnest(x) AS value, generate_subscripts(x, 1) AS place FROM parts JOIN near{k} USING (r, part))
    GROUP BY part, entry, place) GROUP BY part, entry),
book{n} AS MATERIALIZED (SELECT part, entry, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN means{n} m USING (part, entry))"""
    steps = [s.format(k=k, n=k + 1) for k in range(rounds) for s in (near, book)]
    return ",\n".join([*steps, near.format(k=rounds)])


@query("op13_vector_codes", f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS x FROM kept, range(8) t(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, x AS y FROM parts WHERE r < 16),
{_rounds(6)},
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book6),
coded AS (SELECT r, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error
          FROM near6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest""")
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
