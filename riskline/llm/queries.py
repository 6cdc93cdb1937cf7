"""The corpus operators as registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.llm import (bpe, chosen_path, hash_tree, importance, langid, line_dedup, piece_table, sentencepiece, spelling,
                          token_counts, url_rules, va_file, winnow)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The rules of the URL query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_importance_resampling")
def q_importance(spark, d):
    return importance.resample(table(spark, d, "documents"), table(spark, d, "labels"),
                               (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("op2_url_rules")
def q_url_rules(spark, d):
    return url_rules.judge_urls(table(spark, d, "pages"), url_rules.rules_table(spark, URL_RULES))


ORACLE["op2_url_rules"] = r"""
WITH rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'),
       ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM rules),
u AS (SELECT page_id, row_number() OVER () AS n,
       translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
hit AS (SELECT u.n, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
       FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.n)
SELECT u.page_id, u.host, u.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict
FROM u LEFT JOIN hit USING (n)
"""


@query("op3_winnowing")
def q_winnowing(spark, d):
    found = winnow.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", winnow.covered_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE["op3_winnowing"] = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item_id FROM places p JOIN windows USING (n, t)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


@query("op4_token_counts")
def q_token_counts(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op5_line_dedup")
def q_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, dropped_col="dropped_lines")
    return out.withColumn("n_dropped", F.size("dropped_lines"))


@query("op6_va_file_top_k")
def q_top_k(spark, d):
    return va_file.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE["op6_va_file_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
       FROM embeddings WHERE embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
       FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


@query("op7_hash_tree_shards")
def q_shards(spark, d):
    topology = hash_tree.regular_topology(4, 5, 2)
    return hash_tree.assign_shards(table(spark, d, "documents"), topology, hash_tree.with_new_region(topology))


@query("op8_chosen_path")
def q_near_duplicates(spark, d):
    return chosen_path.near_duplicates(table(spark, d, "documents")).drop("row")


ORACLE["op8_chosen_path"] = r"""
WITH RECURSIVE lowered AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM lowered WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM lowered UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM lowered l JOIN least ON least.a = l.doc_id LEFT JOIN sizes USING (doc_id)
"""


@query("op9_language_id")
def q_language_id(spark, d):
    docs = table(spark, d, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held), tokenizer("piece_bpe_32k.model"))
    out = langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_sentencepiece")
def q_sentencepiece(spark, d):
    model = tokenizer("piece_bpe_32k.model")
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = sentencepiece.encode_documents(docs, model).drop("text")
    out = sentencepiece.decode_documents(ids, model)
    return out.select("doc_id", "piece_ids", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), "decoded")


@query("op11_bpe")
def q_bpe(spark, d):
    model = tokenizer("word_bpe_49k.json")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.decode_documents(bpe.encode_documents(docs, model).drop("text"), model)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("token_ids")).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_fill_in_middle")
def q_fill_in_middle(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return piece_table.fill_in_middle(docs, digests=True).drop("text")


ORACLE["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
       regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(u) + 1) AS x,
       CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(u) + 1) AS y, CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS a,
       CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS b FROM t),
p AS (SELECT doc_id, text, n, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS pre,
       coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS mid,
       coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS suf,
       CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR a >= 50 THEN 'plain'
            WHEN b < 80 THEN 'spm' ELSE 'psm' END AS form FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@query("op13_spelling_variants")
def q_spelling(spark, d):
    return spelling.group_variants(spelling.count_words(table(spark, d, "documents")))


ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
       SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
       lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) AS h FROM told, crc),
words AS MATERIALIZED (SELECT word, sum(n) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
       ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS MATERIALIZED (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS p FROM places),
shorter AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS p FROM places),
less AS MATERIALIZED (SELECT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.p),
near AS (SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y ON x.p = y.p AND x.word <> y.word
       UNION ALL SELECT a, b FROM less UNION ALL SELECT b, a FROM less),
ranked AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r
       FROM near JOIN words w ON w.word = b),
named AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN b END AS form,
       CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
way(word, place, step) AS (SELECT word, word, 0 FROM named UNION ALL
       SELECT way.word, named.form, step + 1 FROM way JOIN named ON named.word = way.place WHERE named.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, step) AS root FROM way GROUP BY word)
SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM named JOIN roots USING (word)
"""
