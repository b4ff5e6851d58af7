"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.config import scratch_path
from agora.llm import (chat_format, decontaminate, exact_dedup, hard_negatives, license_scan, lm_trie, minhash_join, packing, quality_gbt,
                       spelling, suffix_dedup, token_files, url_lists)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The contract's own conversation: texts that look like a template's marks.
PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, expanded, and read back from the examples."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    return chat_format.digest(chat_format.expand(rows.unionByName(probe)))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(items, 256).alias("items_sha256"),
                        decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles."""
    return minhash_join.near_groups(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families of every document's paragraphs."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("families", F.concat_ws(",", "families"))


# Stand-in input from ``pages``: fetch days, and one dated list entry per page.
CAPTURES_SQL = """
SELECT page_id, url, CAST('2023-01-01' AS DATE) + CAST((page_id * 7919) % 730 AS INT) AS day FROM pages
"""
ENTRIES_SQL = """
SELECT CASE page_id % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'optout' END AS list,
       CASE page_id % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' WHEN 2 THEN 'prefix' ELSE 'url' END AS kind,
       CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)
                        WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/?#]*?([^./?#]+[.][^./?#]+)([/?#]|$)', 1)
                        WHEN 2 THEN regexp_extract(url, '^[a-z]+://([^/?#]+/?[^/?#]*)', 1)
                        ELSE regexp_extract(url, '^[a-z]+://([^#]+)', 1) END AS pattern,
       CASE WHEN page_id % 5 = 4 THEN 'remove' ELSE 'add' END AS action,
       CAST('2022-07-01' AS DATE) + CAST((page_id * 6007) % 900 AS INT) AS day
FROM pages
"""


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries active for each page on the day it was fetched."""
    pages = table(spark, sf_dir, "pages")
    captures = spark.sql(CAPTURES_SQL.replace("pages", "{pages}"), pages=pages)
    entries = spark.sql(ENTRIES_SQL.replace("FROM pages", "FROM {pages}"), pages=pages)
    found = url_lists.evaluate(captures, entries, id_col="page_id")
    return found.select("page_id", "n_active", F.concat_ws(",", "lists").alias("lists"),
                        F.sha2(F.concat_ws(",", "entries"), 256).alias("entries_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learnt from those that are not held out; every observed context counts."""
    return lm_trie.score_texts(table(spark, sf_dir, "documents"), least_context=1)[0]


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat 50-byte strings of earlier documents."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of every document's normalised text."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_gbt.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100; labels where 7 divides the id are moved on."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from its token ids in Parquet."""
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.digest(spark, path)


def misspelt(runs: DataFrame) -> DataFrame:
    """The contract's own noise: where 31 divides the crc32 of id and run, one code point of the run is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")).cast("binary"))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2))")
    return runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents that occur twice or more."""
    words = misspelt(spelling.letter_runs(table(spark, sf_dir, "documents")))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return spelling.variant_groups(counts).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_minhash": op3_minhash,
    "op4_license_scan": op4_license_scan,
    "op5_url_lists": op5_url_lists,
    "op6_lm_score": op6_lm_score,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_spelling": op13_spelling,
}

OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, role = 'assistant' AS reply,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         15 + length(role) + length(role) - length(replace(role, chr(92), ''))
            + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', ''))
            + length(text) + length(text) - length(replace(text, chr(92), '')) + length(text) - length(replace(text, '<', '')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS chars FROM sized)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE reply), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE reply), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (WHERE reply OR k = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         list_aggregate(list_slice(w, k, k + least(13, len(w)) - 1), 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, k, list_aggregate(list_slice(w, k, k + n - 1), 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p.n, k FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
         FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS root, a AS node FROM edges
  UNION
  SELECT r.root, e.b FROM reach r JOIN edges e ON e.a = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least ON least.node = w.doc_id
"""

OP5_SQL = f"""
WITH captures AS ({CAPTURES_SQL}), entries AS ({ENTRIES_SQL}),
daily AS (SELECT list, kind, pattern, day, max(action) AS action FROM entries GROUP BY ALL),
states AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM daily),
active AS (SELECT * FROM states WHERE action = 'add'),
parts AS (
  SELECT page_id, day, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM captures),
hosts AS (
  SELECT page_id, day, regexp_extract(rest, '^[^/?]*') AS authority, substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS path
  FROM parts),
clean AS (
  SELECT page_id, day, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')) AS host, path,
         string_split(regexp_replace(path, '[?].*$', ''), '/') AS segments FROM hosts),
asked AS (
  SELECT page_id, day, 'host' AS kind, host AS pattern FROM clean
  UNION SELECT page_id, day, 'url', host || path FROM clean
  UNION SELECT page_id, day, 'domain', array_to_string(string_split(host, '.')[k:], '.')
        FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM clean)
  UNION SELECT page_id, day, 'prefix', host || array_to_string(segments[1:k], '/')
        FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS k FROM clean)),
found AS (
  SELECT DISTINCT page_id, list, kind, pattern FROM asked JOIN active USING (kind, pattern)
  WHERE active.day <= asked.day AND (until IS NULL OR asked.day < until)),
named AS (
  SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         array_to_string(list_sort(list(list || '|' || kind || '|' || pattern)), ',') AS entries
  FROM found GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists,
       sha256(coalesce(entries, '')) AS entries_sha256
FROM pages p LEFT JOIN named USING (page_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""

# crc32 by its table of 256 remainders, byte by byte.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
remainders AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents),
seen AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS x FROM seen),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                                          list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
                             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS h
  FROM coded, remainders),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
links AS (
  SELECT x.word, y.word AS near, y.n FROM holes x JOIN holes y ON x.rest = y.rest AND x.k = y.k AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.rest = y.word),
best AS (
  SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near FROM links
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
way AS (
  SELECT word, word AS reached, form AS next FROM formed
  UNION ALL SELECT way.word, formed.word, formed.form FROM way JOIN formed ON formed.word = way.next)
SELECT f.word, f.form, reached AS root, f.n, CAST(n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN way ON way.word = f.word AND way.next IS NULL
"""

ORACLE_SQL = {"op11_hard_negatives": OP11_SQL, "op13_spelling": OP13_SQL, "op1_chat_format": OP1_SQL, "op5_url_lists": OP5_SQL, "op3_minhash": OP3_SQL, "op2_decontaminate": OP2_SQL, "op8_exact_dedup": OP8_SQL}
