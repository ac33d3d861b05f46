"""The operators applied to their whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lexical, minhash, packing, pieces, pivots, quality, sharding, spelling, suffix_dedup, toxicity, vptree
from .common import read

#: Bytes that a shard of op1 may hold.
SHARD_BYTES = 1 << 20


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.shard(docs, size=F.col("n_bytes"), limit=SHARD_BYTES)


OP1_SQL = f"""
WITH w AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h
  FROM documents),
levels AS (
  SELECT d.depth AS depth, w.h >> (32 - d.depth) AS prefix, sum(n_bytes) AS b, count(*) AS n,
         (sum(n_bytes) > {SHARD_BYTES} AND min(h) < max(h) AND d.depth < 32) AS open
  FROM w, (SELECT CAST(range AS INTEGER) AS depth FROM range(33)) d GROUP BY 1, 2),
leaves AS (
  SELECT l.* FROM levels l LEFT JOIN levels p ON p.depth = l.depth - 1 AND p.prefix = (l.prefix >> 1)
  WHERE NOT l.open AND (l.depth = 0 OR p.open))
SELECT w.doc_id, w.n_bytes, l.depth AS shard_depth, CAST(l.prefix AS BIGINT) AS shard_prefix,
       CAST(l.b AS BIGINT) AS shard_bytes, CAST(l.n AS BIGINT) AS shard_docs, 0 AS shard_part
FROM w JOIN leaves l ON l.prefix = (w.h >> (32 - l.depth))"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.expand(turns.unionByName(fixed)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</', '\e'), concat(':', chr(10)), '\c'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</', '\e'), concat(':', chr(10)), '\c')) + 14 AS chars,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, factor=0.5)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_distance(q.e, v.e) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    voters = quality.fit(docs, read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return quality.score(docs, voters).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_inner_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read(spark, sf_dir, "documents"), words=4, percent=80)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


OP11_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, * FROM documents)),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY r),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
i AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS q, * FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
s AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY q, item_id, r, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


#: The checksum is worked out bit by bit: four hex digits are two bytes, each with eight steps.
OP12_SQL = """
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM o WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, e: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM g),
s AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM c a JOIN w b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM c a JOIN w b ON a.cut = b.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(p.near) AS form, min(p.near_n) AS form_n
  FROM w LEFT JOIN b ON w.word = b.word LEFT JOIN p ON p.word = w.word AND p.near_n = b.top AND b.top >= 10 * w.n GROUP BY ALL),
r AS (
  SELECT word, word AS now, 0 AS step FROM f
  UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.now WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(now, step) AS root FROM r GROUP BY word) e ON e.word = f.word"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (
  SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
a AS (
  SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(ws) >= k)),
m AS (SELECT a.r, a.i, a.k, v.item FROM a JOIN v ON a.k = v.k AND a.win = v.win),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, coalesce(item, '') AS item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r"""


QUERIES = {f.__name__: f for f in (op1_sharding, op2_chat_formatting, op3_suffix_dedup, op4_packing, op5_vantage_point_search, op6_sentencepiece, op7_quality_classifier, op8_toxicity, op9_pivot_top_k, op10_minhash_near_dedup, op11_lexical_search, op12_spelling_variants, op13_decontamination)}
SQL = {"op1_sharding": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op5_vantage_point_search": OP5_SQL, "op9_pivot_top_k": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_decontamination": OP13_SQL}
