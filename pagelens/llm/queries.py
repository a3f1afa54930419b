"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_pack import pack_and_read

    return pack_and_read(table(spark, sf_dir, "documents"), word_tokenizer(), end_id=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_documents

    return predict_documents(table(spark, sf_dir, "documents"))


#: Where the corpus' documents lie: some at the top of their source, some by language, some in parts below that.
DOCUMENT_PATH = "concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 = 2 THEN concat('part-', doc_id % 5) END, concat(doc_id, '.txt'))"


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    files = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(DOCUMENT_PATH).alias("path"))
    return license_scan(files).select("doc_id", "license", "score", "via", "license_dir")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .common import held_out

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The registered queries' key; a caller of the operator brings a secret one.
PSEUDONYM_KEY = b"pagelens demonstration key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=2048)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_score

    return lm_score(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import rebuilt_prefix_trie

    return rebuilt_prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_language_id, op3_decontaminate, op4_licenses, op5_ngram_join, op6_quality, op7_pii, op8_vectors, op9_packing, op10_lm_scoring, op11_exact_dedup, op12_whitening, op13_conversation_trie)}


def _license_sql() -> str:
    """op4 in SQL: all units of all files, without anchors, and covered directories as prefixes of paths."""
    from .licenses import PARAGRAPH_END, SENTENCE_END, TERM, parts

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate(parts()))
    path = DOCUMENT_PATH.replace("concat('part-', doc_id % 5)", "'part-' || (doc_id % 5)").replace("concat(doc_id, '.txt')", "doc_id || '.txt'")
    newline = "chr(10)"
    return rf"""
WITH parts(part, license, text) AS (VALUES {values}),
pterm AS (SELECT part, term, count(*)::DOUBLE AS n FROM (SELECT part, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM parts) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS n FROM pterm GROUP BY term),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {path} AS path FROM documents),
placed AS (SELECT *, trim(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/?[^/]*$', ''), '/') AS dir FROM docs),
pieces AS (
  SELECT r, text AS unit FROM docs WHERE text IS NOT NULL
  UNION SELECT r, unnest(string_split(regexp_replace(text, '{SENTENCE_END}', '\1' || {newline}, 'g'), {newline})) FROM docs
  UNION SELECT r, unnest(regexp_split_to_array(text, '{PARAGRAPH_END}')) FROM docs),
unit AS (SELECT row_number() OVER () AS u, p.r, p.unit, p.unit = d.text AS whole FROM pieces p JOIN docs d USING (r)),
total AS (SELECT (SELECT count(*) FROM docs) + (SELECT count(*) FROM parts) AS n),
dterm AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM docs) GROUP BY term),
idf AS (SELECT v.term, ln((1 + t.n) / (1 + v.n + coalesce(d.n, 0))::DOUBLE) + 1 AS w FROM vocab v CROSS JOIN total t LEFT JOIN dterm d USING (term)),
psize AS (SELECT part, sqrt(sum(pow(n * w, 2))) AS size, sum(n) AS terms FROM pterm JOIN idf USING (term) GROUP BY part),
uterm AS (SELECT u, term, count(*)::DOUBLE AS n FROM (SELECT u, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM unit) GROUP BY ALL),
norms AS (SELECT u, sqrt(sum(pow(n * coalesce(w, (SELECT ln(1 + n::DOUBLE) + 1 FROM total)), 2))) AS norm FROM uterm LEFT JOIN idf USING (term) GROUP BY u),
dots AS (SELECT u, part, sum(a.n * w * b.n * w) AS dot FROM uterm a JOIN pterm b USING (term) JOIN idf USING (term) GROUP BY u, part),
hits AS (SELECT r, license, round(dot / size / norm, 6) AS score, terms, whole FROM dots JOIN psize USING (part) JOIN parts USING (part) JOIN norms USING (u) JOIN unit USING (u) WHERE round(dot / size / norm, 6) >= 0.6),
own AS (SELECT r, license, score, whole FROM (SELECT r, license, score, bool_or(whole) OVER (PARTITION BY r) AS whole, row_number() OVER (PARTITION BY r ORDER BY score DESC, terms DESC, license) AS k FROM hits) WHERE k = 1),
cover AS (SELECT dir, license FROM (SELECT p.dir, o.license, row_number() OVER (PARTITION BY p.dir ORDER BY o.score DESC, o.license) AS k FROM own o JOIN placed p USING (r) WHERE o.whole) WHERE k = 1),
near AS (SELECT p.r, c.dir, c.license, row_number() OVER (PARTITION BY p.r ORDER BY length(c.dir) DESC) AS k FROM placed p JOIN cover c ON c.dir = p.dir OR c.dir = '' OR starts_with(p.dir, c.dir || '/'))
SELECT p.doc_id, coalesce(o.license, n.license) AS license, o.score, CASE WHEN o.r IS NOT NULL THEN 'own' WHEN n.r IS NOT NULL THEN 'inherited' ELSE 'none' END AS via, CASE WHEN o.r IS NULL THEN n.dir END AS license_dir
FROM placed p LEFT JOIN own o USING (r) LEFT JOIN near n ON n.r = p.r AND n.k = 1
"""


_DEDUP_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
placed AS (SELECT doc_id, plain, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w AS k FROM texts WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(plain) AS text_sha256 FROM placed
"""

_TRIE_SQL = r"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT h.c, t.r AS k, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c - h.c % 5 AND t.r <= h.h
  UNION ALL SELECT h.c, t.r + 100000, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.r > h.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, {'role': role, 'text': text} AS turn FROM rebuilt),
path AS (SELECT c, list(turn ORDER BY d) AS turns FROM placed GROUP BY c UNION ALL SELECT c, [] FROM heads WHERE c NOT IN (SELECT c FROM placed)),
prefix AS (SELECT c, d, CASE WHEN d = 0 THEN '' ELSE sha256(to_json(turns[:d])) END AS key, CASE WHEN d = 0 THEN NULL WHEN d = 1 THEN '' ELSE sha256(to_json(turns[:d - 1])) END AS above, CASE WHEN d = 0 THEN 0 ELSE strlen(turns[d].text) END AS bytes, d = len(turns) AS ends
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM path)),
node AS (SELECT key, any_value(above) AS above, d, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM prefix GROUP BY key, d),
child AS (SELECT above, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM prefix a JOIN prefix b ON a.c = b.c AND b.d >= a.d),
total AS (SELECT b.top, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((n.n - 1) * n.bytes) AS saved FROM below b JOIN node n ON n.key = b.key LEFT JOIN child c ON c.above = b.key GROUP BY b.top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN total t ON t.top = n.key LEFT JOIN child c ON c.above = n.key LEFT JOIN node p ON p.key = n.above
"""


ORACLES: dict[str, str] = {"op4_licenses": _license_sql(), "op11_exact_dedup": _DEDUP_SQL, "op13_conversation_trie": _TRIE_SQL}
