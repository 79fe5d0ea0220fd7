"""The registered queries of the training-data operators, and their SQL.

Each applies its operator, with production parameters, to whole tables and
derives its columns from the operator's own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import codes, decontaminate, exact, fim, langid, minhash, mixing, neighbours, secrets, sharding, substrings, tokenfile, toxicity
from graphloom.llm.common import crc32_of, table

#: Shards 0 to 15, all of one weight; grown by one.
SHARDS = {s: 1.0 for s in range(16)}
GROWN = SHARDS | {16: 1.0}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), crc32_of(F.col("doc_id")) % 4
    found = langid.identify(docs, langid.fit(docs, part != 2))
    return found.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.example_findings(spark)))
    return found.select("doc_id", "begin", "end", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score")


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("copies", F.lit(1))["position"].alias("position"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokenfile.read_documents(written)


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_records(table(spark, sf_dir, "documents"), SHARDS, GROWN)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), crc32_of(F.col("doc_id")) % 5
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"), part != 0)
    return scored.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return codes.with_label_error(rows).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.restored(fim.transform(table(spark, sf_dir, "documents")))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed("output").alias("output_sha256"), hashed("text").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_secret_scan, op3_learned_partitions, op4_suffix_dedup, op5_source_mixing, op6_decontamination, op7_token_files, op8_rendezvous_shards, op9_circulant_minhash, op10_toxicity, op11_heavy_hitter_dedup, op12_vector_codes, op13_fill_in_middle)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_source_mixing": MIXING_SQL,
        "op6_decontamination": DECONTAMINATION_SQL,
        "op9_circulant_minhash": NEAR_DUPLICATE_SQL,
        "op11_heavy_hitter_dedup": EXACT_SQL,
        "op12_vector_codes": CODES_SQL,
        "op13_fill_in_middle": FIM_SQL,
    }


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, md5(coalesce(cast(doc_id AS varchar), '')) AS h,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size
  FROM documents),
s AS (SELECT k, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY k) AS r FROM d GROUP BY k),
w AS (SELECT *, (r - 1) % 3 + 1 AS w, (r % 5) / 2.0::double - 1.0::double AS slope FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w::double, k) AS q FROM w),
l AS (SELECT *, cast(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double)
             / cast(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double) AS level FROM o),
f AS (SELECT min(q) AS q FROM l WHERE level * w <= 3 * source_size),
t AS (SELECT l.k, l.source_size, l.slope, least((SELECT level FROM l JOIN f USING (q)) * w, cast(3 * source_size AS double)) AS target FROM l),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
p AS (SELECT c.doc_id, c.size, t.source_size, t.target, t.slope, c.a,
             greatest(0, least(size, floor(target) - a)) + greatest(0, least(size, floor(target) - a - source_size)) + greatest(0, least(size, floor(target) - a - 2 * source_size)) AS taken
      FROM c JOIN t USING (k))
SELECT doc_id, size, source_size, target, cast(taken AS bigint) AS taken,
       CASE WHEN taken = 0 THEN NULL WHEN a = 0 THEN 0.0::double
            ELSE 2.0::double * (a / target) / ((1.0::double - slope) + sqrt((1.0::double - slope) * (1.0::double - slope) + 4.0::double * slope * (a / target))) END AS position
FROM p
"""

DECONTAMINATION_SQL = r"""
WITH i AS (SELECT cast(item_id AS varchar) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS phrase
      FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM g),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
x AS (SELECT d.rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
h AS (SELECT x.rid, x.k, x.n, g.item FROM x JOIN g USING (n, phrase)),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM h, unnest(range(k, k + n)) AS u(j) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

NEAR_DUPLICATE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT rid, hash(array_to_string(w[k:k + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid < y.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY 1)
SELECT doc_id, cast(coalesce(n, 0) AS bigint) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _codes_round(k: int) -> str:
    """The SQL of one assignment by codebook c<k>, and of the means after it."""
    step = f"""
a{k} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, min(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 64 + j) AS best
       FROM p JOIN c{k} USING (part) GROUP BY vec_id, part)"""
    if k == 2:
        return step
    return (
        step
        + f""",
s{k} AS (SELECT part, best % 64 AS j, u.d AS d, sum(v[u.d])::bigint AS s, count(*)::bigint AS n FROM a{k}, unnest(range(1, 5)) AS u(d) GROUP BY 1, 2, 3),
m{k} AS (SELECT part, j, list((s - ((s % n) + n) % n) // n ORDER BY d) AS e FROM s{k} GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT part, j, coalesce(m{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN m{k} USING (part, j)),"""
    )


CODES_SQL = (
    """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * 4 + 1:part * 4 + 4] AS v FROM k, unnest(range(16)) AS u(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM k QUALIFY j < 64),
c0 AS MATERIALIZED (SELECT part, j, v AS e FROM p JOIN f USING (vec_id)),"""
    + "".join(_codes_round(k) for k in range(3))
    + """,
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM c2),
r AS (SELECT vec_id, string_agg(printf('%02x', (best % 64)::int), '' ORDER BY part) AS code, sum(best // 64)::bigint AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h
"""
)

FIM_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::bigint AS n, sha256('1:' || coalesce(doc_id::varchar, '')) AS x FROM documents),
g AS (SELECT *, ('0x' || x[1:8])::bigint AS h1, ('0x' || x[9:16])::bigint AS h2, ('0x' || x[17:24])::bigint AS h3, ('0x' || x[25:32])::bigint AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
