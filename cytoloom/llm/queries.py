"""The numbered operators over the whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm import collocations, cover_tree, html_crf, language_id, line_rules, mixing, order_minhash, packing, permutation_index, prefix_trie, quality_knn, secret_scan, warc
from cytoloom.llm.shared import crc_mod

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The share of tokens that each domain, a pair of marks of the labels table, is to have.
DOMAIN_WEIGHTS = {"quality0_toxic0": 0.09, "quality0_toxic1": 0.01, "quality1_toxic0": 0.80, "quality1_toxic1": 0.10}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, label): the pair of marks of each row that has both."""
    return labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.format_string("quality%d_toxic%d", "quality", "toxic").alias("label"))


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(docs, marks)
    scored = quality_knn.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), ["page_id"])


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, domains(table(spark, sf_dir, "labels")))
    return mixing.mix(docs, model, DOMAIN_WEIGHTS, carry_text=False).select("doc_id", "domain", "tokens", "rate", "copies")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=secret_scan.RULES)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secret_scan.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(F.encode(secret_scan.as_text(base), "UTF-8"), 256).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans"))


def op8_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract(pages, html_crf.train()).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), cover_tree.quantised(F.col("embedding")).alias("v"))
    return cover_tree.top_k(data.where("vec_id % 20 = 0"), data, k=20)


def op10_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    told = language_id.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(data.where("vec_id % 100 = 0"), data, k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), max_n=4, least=30, inside=80, top=2000)


QUERIES = {f.__name__: f for f in (op1_quality_knn, op2_packing_dp, op3_order_minhash, op4_warc_derivatives, op5_line_rules, op6_mixing_rates, op7_secret_scan, op8_html_crf, op9_cover_tree, op10_language_ecoc, op11_permutation_index, op12_prefix_trie, op13_collocations)}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_line_rules() -> str:
    q, word = _quoted, _quoted(line_rules.WORD)
    phrase = " OR ".join(f"contains(lower(x), {q(p)})" for p in line_rules.BOILERPLATE)
    after = " || ".join(f"chr({ord(c)})" for c in line_rules.AFTER)
    fails = f"right(rtrim(x, {after}), 1) NOT IN ({', '.join(map(q, line_rules.MARKS))}) OR len(regexp_split_to_array(x, {q(line_rules.SEPARATOR)})) > {line_rules.MOST_SEPARATORS} OR regexp_matches(x, {q(line_rules.NOISE)}) OR {phrase}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
three AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM three) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS whole, coalesce(list_sum(list_transform(list_filter(l, lambda x: NOT ({fails})), lambda x: length(x))), 0) AS rest
  FROM w LEFT JOIN covered USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN whole > 0 THEN 1 - CAST(rest AS DOUBLE) / CAST(whole AS DOUBLE) ELSE 0 END <= 0.5 AS kept FROM v"""


def _sql_secret_scan() -> str:
    parts = []
    for n, r in enumerate(secret_scan.RULES):
        x, kind = _quoted(r.regex), _quoted(r.kind)
        long_enough = f"AND length(regexp_extract(m[k], {x}, {r.group})) >= {r.least}" if r.least > 1 else ""
        parts.append(f"""SELECT rid, {n} AS n, {kind} AS kind, s, e FROM (SELECT rid, k, m,
  list_sum(list_transform(p[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) AS s,
  list_sum(list_transform(p[1:k], lambda y: length(y))) + list_sum(list_transform(m[1:k], lambda y: length(y))) AS e
  FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT rid, regexp_extract_all(t, {x}) AS m, regexp_split_to_array(t, {x}) AS p FROM d WHERE regexp_matches(t, {x})))) WHERE true {long_enough}""")
    base = ", ".join(map(_quoted, secret_scan.BASE))
    span = "concat_ws(':', kind, CAST(CAST(s AS BIGINT) AS VARCHAR), CAST(CAST(e AS BIGINT) AS VARCHAR))"
    counts = ", ".join(f"count(*) FILTER (kind = {_quoted(k)}) AS n_{k}" for k in secret_scan.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT rid, {counts}, string_agg({span}, ',' ORDER BY s, n) FILTER (kind IN ({base})) AS b, string_agg({span}, ',' ORDER BY s, n) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


_SQL_COVER_TREE = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

# The crc32 of a short text: its bytes one after the other, and of each byte eight bits.
_SQL_PREFIX_TRIE = """
WITH RECURSIVE t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS r FROM t),
crc AS (SELECT c, CAST(c AS VARCHAR) AS x, 1 AS i, CAST(4294967295 AS BIGINT) AS v, 0 AS bit FROM (SELECT DISTINCT c FROM o)
  UNION ALL SELECT c, x, i + bit // 8, CASE WHEN bit = 8 THEN v ELSE xor(u >> 1, 3988292384 * (u & 1)) END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END
  FROM (SELECT *, CASE WHEN bit = 0 THEN xor(v, CAST(ascii(x[i]) AS BIGINT)) ELSE v END AS u FROM crc WHERE i <= length(x))),
h AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i > length(x)),
s AS (SELECT h.c, h, least(h, coalesce(n, 0)) AS given FROM h LEFT JOIN (SELECT c AS base, count(*) AS n FROM o GROUP BY 1) ON base = h.c - h.c % 20),
b AS (SELECT s.c, r - h + given AS d, k, w FROM s JOIN o ON o.c = s.c AND r > h UNION ALL SELECT s.c, r, k, w FROM s JOIN o ON o.c = s.c - s.c % 20 AND r <= given),
p AS (SELECT c, d, w, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS node, coalesce(string_agg(k, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up FROM b
  UNION ALL SELECT c, 0, 0, '', NULL FROM s),
n AS (SELECT node, d AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY ALL),
kids AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
e AS (SELECT node, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, arg_max(node, d) AS node FROM p GROUP BY 1) GROUP BY 1),
below AS (SELECT a.node, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((n_convs - 1) * n.w) AS saved_tokens FROM n JOIN p a ON a.c = n.conv_id AND a.d <= n.depth LEFT JOIN kids ON kids.node = n.node GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN below ON below.node = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN e ON e.node = n.node LEFT JOIN n m ON m.node = n.up"""

_SQL_COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM g, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cut AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
s AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.phrase = best.phrase WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000"""

ORACLE_SQL = {"op5_line_rules": _sql_line_rules(), "op7_secret_scan": _sql_secret_scan(), "op9_cover_tree": _SQL_COVER_TREE, "op12_prefix_trie": _SQL_PREFIX_TRIE, "op13_collocations": _SQL_COLLOCATIONS}
