"""The thin queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import ann, chat_format, compaction, decontaminate, fim, fingerprints, license_scan, minhash_dedup, mixing, packing, periodic_runs, quality, url_filters
from spindrift.llm.common import WORD, literal_table, scratch, table

#: The conversation that the query of chat formatting adds: control strings and an escape inside texts.
HARD_TEXT = "\\### Assistant: </turn> ok"
ARRIVALS = 8
#: Of the fill-in-middle query: of a hundred texts those that are cut, and of these those with the suffix in front.
FIM_PERCENT, SPM_PERCENT = 100, 50


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), literal_table(spark, url_filters.RULES, ["rule", "action"]))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted where the tree's quotas place them: by shard, block and place of each copy."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = literal_table(spark, [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], ["conv_id", "turn", "role", "text"])
    hard = hard.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    whole = chat_format.expand_examples(chat_format.format_conversations(rows.unionByName(hard)), rest=True)
    return chat_format.read_examples(whole)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", F.col("_q_doc").alias("document_share"), F.col("_q_host").alias("host_share"), F.col("_q_path").alias("path_share"), F.col("_q_share").alias("quality"), F.col("_q_keep").alias("kept"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op8_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts, are compacted, and are read again through the last manifest."""
    import uuid

    store = compaction.ShardStore(spark, f"{scratch(spark)}/shards-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store.append(docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "_arrival")
    store.compact()
    store.vacuum()
    out = store.read().select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("read_chars"), F.md5("text").alias("text_md5"))
    out._cuts = [store.root]  # for release(), once the rows are used
    return out


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_fim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, form and rate by a digest of the id."""
    digest = F.sha2(F.concat(F.lit("7:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when(h[2] % 100 >= FIM_PERCENT, "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    out = fim.transform(table(spark, sf_dir, "documents"), h[0], h[1], form)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def with_periods(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by a checksum of the id, become periodic from a word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, ws = F.floor(h / 10), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    n = F.size("_words").cast("long")
    a = F.pmod(F.col("_g"), n)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, ws).alias("_words"), g.alias("_g"))
    rows = rows.select("doc_id", "text", "_words", F.when(n > 0, F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).alias("p"))).alias("_from"))
    again = F.transform(F.col("_words"), lambda w, i: F.when(i < F.col("_from.a"), w).otherwise(F.get("_words", (F.col("_from.a") + F.pmod(i - F.col("_from.a"), F.col("_from.p"))).cast("int"))))
    return rows.select("doc_id", F.when(F.col("_from").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    said = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(said.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filters, op2_minhash_dedup, op3_mixing, op4_chat_format, op5_license_scan, op6_quality, op7_ann, op8_compaction, op9_packing, op10_fingerprints, op11_fim_runs, op12_decontaminate, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


MIXING_SQL = r"""WITH d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size, coalesce(md5(text), 'null') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped, sum(w) OVER (ORDER BY 2.0 * source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, 2.0::DOUBLE * source_size / w AS cap_rate FROM w),
f AS (SELECT *, (total - coalesce(capped, 0)::DOUBLE) / open_w::DOUBLE <= cap_rate AS fits FROM o),
g AS (SELECT min(cap_rate) AS rate FROM f WHERE fits),
r AS (SELECT o.*, g.rate, o.total - coalesce((SELECT sum(2 * o2.source_size) FROM o o2 WHERE o2.cap_rate < g.rate), 0)::DOUBLE AS rest, (SELECT sum(w)::DOUBLE FROM o o3 WHERE o3.cap_rate >= g.rate) AS rest_w FROM o LEFT JOIN g ON true),
t AS (SELECT source, source_size, CASE WHEN rate IS NULL OR cap_rate < rate THEN 2.0::DOUBLE * source_size ELSE rest * w::DOUBLE / rest_w END AS target FROM r),
p AS (SELECT doc_id, size::BIGINT AS size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, 'null') || ':11:' || h), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(size, greatest(0, floor(target + 0.5)::BIGINT - start)) + least(size, greatest(0, floor(target + 0.5)::BIGINT - start - source_size)))::BIGINT AS taken FROM p"""

CHAT_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{HARD_TEXT}'), (-7, 1, 'assistant', '{HARD_TEXT}'))),
f AS (SELECT *, 4 + 2 + 8 + length(regexp_replace(role, '([\\\\#<:])', '\\\\\\1', 'g')) + length(regexp_replace(text, '([\\\\#<:])', '\\\\\\1', 'g')) AS len, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY rn) AS cum, coalesce(max(CASE WHEN role = 'assistant' THEN rn END) OVER (PARTITION BY conv_id), 0) AS last FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(cum) FILTER (role = 'assistant'), 0) + coalesce(sum(len) FILTER (rn > last), 0))::BIGINT AS formatted_chars FROM g GROUP BY conv_id"""

FIM_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION_SQL = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {_LOWER} AS ws FROM benchmark), k AS (SELECT item, ws, least(len(ws), {decontaminate.WINDOW}) AS m FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM (SELECT item, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM k)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS ws FROM documents), g AS (SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM k) WHERE len(ws) >= m)),
h AS (SELECT r, i, g.m, item FROM g JOIN p ON g.m = p.m AND g.gram = p.gram),
n AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS w FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY 1), t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""

#: crc32 bit by bit: a number below 256 is a byte, 256 a shift.  Runs: equal 5-grams q words apart, in islands.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))), lambda s, c: CASE WHEN c < 256 THEN xor(s, c) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295)"
RUNS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC.format(x='doc_id::VARCHAR')} AS h FROM documents),
a AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
k AS (SELECT r, n, i, array_to_string(ws[i + 1:i + 5], ' ') AS gram FROM (SELECT r, n, ws, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n), s AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS s FROM e),
t AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY r, q, s HAVING count(*) + 4 + q >= greatest(6, 4 * q)), u AS (SELECT r, start, length, min(q) AS period FROM t GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS rank FROM u), f AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM u GROUP BY 1),
o AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u), v AS (SELECT r, unnest(ws) AS word, unnest(range(n)) AS i FROM w WHERE r IN (SELECT r FROM u)),
c AS (SELECT v.r, string_agg(word, ' ' ORDER BY v.i) AS kept FROM v LEFT JOIN o ON o.r = v.r AND o.i = v.i WHERE o.r IS NULL GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(ws, ' '))) AS collapsed_sha256
FROM w LEFT JOIN f USING (r) LEFT JOIN (SELECT * FROM b WHERE rank = 1) USING (r) LEFT JOIN c USING (r)"""

COMPACTION_SQL = "SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS read_chars, md5(text) AS text_md5 FROM documents"


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_mixing": MIXING_SQL, "op4_chat_format": CHAT_SQL, "op5_license_scan": license_scan.oracle(), "op8_compaction": COMPACTION_SQL, "op11_fim_runs": FIM_SQL, "op12_decontaminate": CONTAMINATION_SQL, "op13_periodic_runs": RUNS_SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
