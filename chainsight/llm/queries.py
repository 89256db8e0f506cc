"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_quality, op2_license, op3_chat, op4_simhash, op5_mtree, op6_packing, op7_cdc, op8_sharding, op9_mixing, op10_edits, op11_quality_fm, op12_variants, op13_prefix
from .common import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_license.license_scan(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return op3_chat.read_back(op3_chat.formatted_conversations(rows))


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", op4_simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.packed(table(spark, sf_dir, "documents"), window=1024, end=0)


def op7_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_cdc.passages(table(spark, sf_dir, "documents"))


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op8_sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op9_mixing.placed(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets three edits that its own row determines: a deletion, an insertion, a replacement."""
    docs = table(spark, sf_dir, "documents")
    n, h = F.length("text"), F.xxhash64("doc_id")

    def at(k):
        return F.pmod(h + F.lit(k), F.greatest(n, F.lit(1)).cast("long")).cast("int")

    def edit(where, deleted, inserted):
        return F.struct(where.alias("at"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))

    edits = F.array(edit(at(1), 9, F.lit("")), edit(at(1009), 0, F.concat(F.lit(" revised "), F.col("source"), F.lit("\n"))), edit(at(500_009), 5, F.col("lang")))
    out = op10_edits.apply_edits(op10_edits.build_trees(docs, edits))
    return out.select("doc_id", "tokens_before", "tokens_after", "reencoded_chars", "text_chars", F.size("seg_lengths").cast("long").alias("n_segments"))


def op11_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_line_frequency, op2_license_scan, op3_chat_formatting, op4_simhash_pivots, op5_mtree_search,
                                   op6_nnls_packing, op7_cdc_dedup, op8_label_propagation, op9_ipf_mixing, op10_edit_counts,
                                   op11_factorisation_machine, op12_spelling_variants, op13_prefix_trie)}
# ---------------------------------------------------------------- DuckDB SQL, where SQL can express a query

_TAIL = "\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|SYS>|/SYS>|INST\\]|/INST\\]"

_OP3 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '([<\\[])(\\\\*)({_TAIL})', '\\1\\2\\\\\\3', 'g')) + length('<|im_end|>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM v q, v x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _op9(mix: op9_mixing.Mix = op9_mixing.Mix()) -> str:
    """The raking unrolled: one step a marginal and sweep."""
    steps, last = [], "seed"
    for i in range(mix.sweeps):
        for d in op9_mixing.DIMS:
            steps.append(f"s{i}_{d} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * goal_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {last})")
            last = f"s{i}_{d}"
    goals = ", ".join(f"g{d} AS (SELECT {d}, p / sum(p) OVER () * (SELECT sum(tokens) FROM cells) AS goal_{d} FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {mix.alpha}) AS p FROM cells GROUP BY {d}))" for d in op9_mixing.DIMS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0) AS tokens,
  CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty' WHEN regexp_matches(text, '(?i)licen[sc]e|rights reserved|copyright') THEN 'legal'
       WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#*$%&]{{3}}') THEN 'symbols' WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact'
       ELSE 'prose' END AS topic FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3 HAVING sum(tokens) > 0),
{goals},
seed AS (SELECT cells.*, goal_source, goal_lang, goal_topic, tokens::DOUBLE AS w FROM cells JOIN gsource USING (source) JOIN glang USING (lang) JOIN gtopic USING (topic)),
{", ".join(steps)},
r AS MATERIALIZED (SELECT source, lang, topic, w / tokens AS ratio FROM {last}),
p AS (SELECT source, lang, topic, round(ratio / (SELECT max(ratio) FROM r), 9) AS probability FROM r)
SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(probability, 1.0), 6) AS probability,
       ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-1') || ':{mix.seed}'), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(probability, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


# CRC-32 by its table, which a rule makes; the bytes are those of text in U+0000 to U+07FF
_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t)"""


def _crc(text: str) -> str:
    octets = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END))"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT]), 4294967295::BIGINT))"


_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS MATERIALIZED (SELECT run, c, {_crc('k')} AS h FROM d, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
one AS (SELECT a.word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
        UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.s = v.word
        UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.s = v.word),
f AS MATERIALIZED (SELECT v.word, any_value(v.n) AS n, count(near) AS n_near, (array_agg(near ORDER BY m DESC, near))[1] AS best, max(m) AS m FROM v LEFT JOIN one USING (word) GROUP BY v.word),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN best END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM f),
chain AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT c.word, g.form, step + 1 FROM chain c JOIN g ON c.root = g.word WHERE g.form IS NOT NULL)
SELECT word, form, arg_max(root, step) AS root, any_value(n) AS n, any_value(n_near) AS n_near, form_n FROM chain JOIN g USING (word) GROUP BY word, form, form_n"""

_OP13 = f"""
WITH {_CRC_TABLE},
c AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
             {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS own FROM c GROUP BY c),
h AS MATERIALIZED (SELECT c, own, c - c % 20 AS b, CAST(crc % 4 AS INT) AS h FROM (SELECT c, own, {_crc('CAST(c AS VARCHAR)')} AS crc FROM l, tab)),
r AS MATERIALIZED (SELECT h.c, coalesce(l.own[1:h.h], []) || h.own[h.h + 1:] AS seq FROM h LEFT JOIN l ON l.c = h.b),
p AS MATERIALIZED (SELECT c, d, seq[1:d] AS p, len(seq) = d AS over FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE over), '')) AS ends_sha256 FROM p GROUP BY p, d),
k AS MATERIALIZED (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
o AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.p[n.d].text, '[^ \t-\r]+')) ELSE 0 END AS saved FROM n LEFT JOIN k USING (p, d)),
s AS (SELECT a.p[1:t] AS p, t AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS t FROM o) a GROUP BY ALL)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (p, d) LEFT JOIN n u ON o.d > 0 AND u.p = o.p[1:o.d - 1] AND u.d = o.d - 1"""


ORACLE = {"op3_chat_formatting": _OP3, "op5_mtree_search": _OP5, "op9_ipf_mixing": _op9(), "op12_spelling_variants": _OP12, "op13_prefix_trie": _OP13}
