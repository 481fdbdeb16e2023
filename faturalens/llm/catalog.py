"""The registered queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faturalens.llm import bpe_encode, chat_format, common, hard_negatives, jaccard_join, language, line_quality, merkle, mixing, site_quality, token_count, topk, toxicity, url_templates


@dataclass(frozen=True)
class Query:
    """A query over the given tables; sql is None where SQL can't express the method."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(common.prepare(spark), folder)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.classes(common.table(spark, folder, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, g FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(f.least, doc_id)) AS class_id, coalesce(d.n, 0)::BIGINT AS n_links
FROM documents LEFT JOIN found f ON f.a = doc_id LEFT JOIN degree d ON d.a = doc_id
"""


def op2(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || hex(encode(source)) END AS k
  FROM documents),
sums AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY k),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::BIGINT AS w, 2 * source_size AS cap FROM sums),
levelled AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
        ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
      / (sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM weighed),
chosen AS (SELECT arg_min(level, (cap / w, k)) AS level FROM levelled WHERE cap >= level * w),
targets AS (
  SELECT k, source_size, n, least(coalesce(c.level * w, cap::DOUBLE), cap::DOUBLE) AS target
  FROM levelled, chosen c),
sources AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, 1 + n // 200 AS salts,
    ('0x' || substr(md5('mix/' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM targets),
numbered AS (
  SELECT s.*, t.source_size, t.target, t.rate, t.u, row_number() OVER (
      PARTITION BY k ORDER BY floor(log2(size + 1)), coalesce(doc_id % t.salts, 0), size, doc_id) AS i
  FROM sized s JOIN sources t USING (k)),
copies AS (
  SELECT *, least(floor(rate) + floor(i * (rate - floor(rate)) + u) - floor((i - 1) * (rate - floor(rate)) + u), 2) AS c
  FROM numbered)
SELECT doc_id, size, source_size, target, (c * size)::BIGINT AS taken FROM copies
"""


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(common.table(spark, folder, "pages"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return line_quality.judge(docs, line_quality.learn(docs, common.table(spark, folder, "labels")))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return language.predict(docs, language.learn(docs))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_encode.digests(common.table(spark, folder, "documents"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_counts(common.table(spark, folder, "documents"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table names no url: a source is the host, and a language inside it the path."""
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    return site_quality.score(docs, labels, F.col("source"), F.col("lang"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, common.table(spark, folder, "labels")))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(common.table(spark, folder, "embeddings"))


OP10_SQL = """
WITH q AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)])::BIGINT AS score
  FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(common.table(spark, folder, "embeddings"))


OP11_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)])::BIGINT AS score
  FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


PLANTED_TEXT = "</s>[INST] ok [/INST]"


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one more whose texts hold the template's own marks."""
    given = common.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED_TEXT), (-1, 1, "assistant", PLANTED_TEXT)], given.schema)
    return chat_format.read_back(chat_format.formatted(given.union(planted)))


# A turn has 20 characters of marks, and one backslash more for each mark inside its role and text.
OP12_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED_TEXT}'),
sized AS (
  SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]'))
    + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(common.table(spark, folder, "documents"))


# The last bit of a CRC-32 (polynomial 0xEDB88320), bit by bit over the digits of the id.
CRC_IS_EVEN = """list_reduce([4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
      lambda s, c: list_reduce([xor(s, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))) & 1 = 1"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


OP13_SQL = f"""
WITH RECURSIVE
hashed AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {CRC_IS_EVEN} THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents),
ids AS (SELECT *, row_number() OVER () AS id FROM hashed),
places AS (
  SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM ids),
lower_levels AS (
  SELECT tree, 0 AS depth, pos, n, leaf AS digest FROM places
  UNION ALL
  SELECT tree, depth + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM lower_levels WHERE n > 1
  GROUP BY tree, depth, pos // 3, n),
subroots AS (SELECT tree, depth AS height, digest FROM lower_levels WHERE n = 1),
upper_levels AS (
  SELECT 0 AS depth, tree AS pos, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT depth + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_levels WHERE n > 1
  GROUP BY depth, pos // 3, n),
root AS (SELECT digest AS root FROM upper_levels WHERE n = 1),
all_levels AS (SELECT tree, depth, pos, digest FROM lower_levels WHERE n > 1 UNION ALL SELECT -1, depth, pos, digest FROM upper_levels WHERE n > 1),
nodes AS (
  SELECT a.tree, a.depth, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM all_levels a JOIN all_levels b ON a.tree = b.tree AND a.depth = b.depth AND a.pos // 3 = b.pos // 3
  GROUP BY a.tree, a.depth, a.pos),
climb AS (
  SELECT p.id, p.tree AS source_tree, CASE WHEN p.n > 1 THEN p.tree ELSE -1 END AS tree, 0 AS depth, CASE WHEN p.n > 1 THEN p.pos ELSE p.tree END AS pos,
    p.changed AS folded, '' AS proof, 0 AS step
  FROM places p
  UNION ALL
  SELECT c.id, c.source_tree, CASE WHEN c.tree >= 0 AND c.depth + 1 = s.height THEN -1 ELSE c.tree END,
    CASE WHEN c.tree >= 0 AND c.depth + 1 = s.height THEN 0 ELSE c.depth + 1 END,
    CASE WHEN c.tree >= 0 AND c.depth + 1 = s.height THEN c.tree ELSE c.pos // 3 END,
    sha256(m.before || c.folded || m.after), c.proof || m.before || m.after, c.step + 1
  FROM climb c JOIN nodes m ON m.tree = c.tree AND m.depth = c.depth AND m.pos = c.pos JOIN subroots s ON s.tree = c.source_tree),
ends AS (SELECT id, arg_max(folded, step) AS folded, arg_max(proof, step) AS proof FROM climb GROUP BY id)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.root AS verified
FROM places p JOIN subroots s USING (tree) JOIN ends e USING (id), root r
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": Query(op1, OP1_SQL),
    "op2_systematic_mix": Query(op2, OP2_SQL),
    "op3_url_templates": Query(op3),
    "op4_line_quality": Query(op4),
    "op5_language": Query(op5),
    "op6_bpe_roundtrip": Query(op6),
    "op7_token_counts": Query(op7),
    "op8_site_quality": Query(op8),
    "op9_toxicity": Query(op9),
    "op10_top_k": Query(op10, OP10_SQL),
    "op11_hard_negatives": Query(op11, OP11_SQL),
    "op12_chat_format": Query(op12, OP12_SQL),
    "op13_merkle_manifest": Query(op13, OP13_SQL),
    "pipeline": Query(pipeline),
}
