"""Queries of metrics, costs, comparisons and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import codebleu_tokens
from spindrift.operators import ingest, metrics, report, significance
from spindrift.operators.running import running_sums
from spindrift.plans.base import SQL_DOT, registry, sql_strip, table

QUERIES, ORACLES, query = registry()

TYPES = ["click", "error", "purchase", "signup", "view"]
_R = "r AS (SELECT event_type AS method, user_id AS instance, value >= 50 AS resolved, value >= 10 AS applied, value AS seconds, (props->>'$.k')::BIGINT AS tokens, ts, event_id FROM events)"


def _hour() -> Column:
    """Running sums of the log go hour by hour, so that a method's rows are no single task's."""
    return F.date_trunc("hour", F.col("ts"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """The event log as a run log: the type is the method, the user the instance, the value its seconds."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select(F.col("event_type").alias("method"), F.col("user_id").alias("instance"), (F.col("value") >= 50).alias("resolved"), (F.col("value") >= 10).alias("applied"), F.col("value").alias("seconds"), k.alias("tokens"), "ts", "event_id")


_DIFF = "CASE WHEN regexp_matches(lower(text), 'refactor|architecture|redesign|complex|multiple') THEN 'hard' WHEN regexp_matches(lower(text), 'typo|simple|minor|documentation|comment') THEN 'easy' ELSE 'medium' END"


@query(f"""SELECT difficulty, source, count(*) AS total, sum(quality)::BIGINT AS resolved, (count(*) - sum(quality))::BIGINT AS unresolved, round(avg(quality) * 100, 6) AS rate FROM (SELECT source, quality, {_DIFF} AS difficulty FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((), (source), (difficulty))""")
def resolution_by_repo_difficulty(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("source", metrics.difficulty(F.col("text")).alias("difficulty"), (F.col("quality") == 1).alias("ok"))
    return metrics.resolution(rows, "ok", [[], ["source"], ["difficulty"]])


_ATT = "a AS (SELECT conv_id, length(text) % 2 = 0 AS ok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.length("text") % 2 == 0).alias("ok"), F.length("text").alias("chars"))


_PASS = f"WITH {_ATT} SELECT conv_id, count(*) AS num_attempts, max(ok::INT) AS any_resolved, " + ", ".join(f"CASE WHEN count(*) >= {k} THEN max((ok AND n <= {k})::INT) END AS pass_at_{k}" for k in (1, 2, 3)) + " FROM a GROUP BY 1"


@query(_PASS)
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pass_at_k(_attempts(spark, d), "conv_id", "turn", "ok", (1, 2, 3))


@query("SELECT " + ", ".join(f"count(pass_at_{k}) AS n_{k}, round(avg(pass_at_{k}) * 100, 6) AS pass_at_{k}" for k in (1, 2, 3)) + f" FROM ({_PASS})")
def pass_at_k_overall(spark: SparkSession, d: str) -> DataFrame:
    each = metrics.pass_at_k(_attempts(spark, d), "conv_id", "turn", "ok", (1, 2, 3))
    return each.agg(*(x for k in (1, 2, 3) for x in (F.count(f"pass_at_{k}").alias(f"n_{k}"), F.round(F.avg(f"pass_at_{k}") * 100, 6).alias(f"pass_at_{k}"))))


@query(f"""WITH q AS (SELECT label AS qlabel, min(vec_id) AS query, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY 1), s AS (SELECT query, qlabel, vec_id AS doc, round({SQL_DOT.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 20), p AS (SELECT query, qlabel, list(doc ORDER BY rank) AS pred FROM h GROUP BY 1, 2), g AS (SELECT label, list(vec_id) AS gold FROM embeddings GROUP BY 1)
SELECT query, """ + ", ".join(f"round(len(list_intersect(gold, pred[1:{k}])) / len(gold) * 100, 6) AS recall_{k}, CASE WHEN list_has_any(gold, pred[1:{k}]) THEN 100.0::DOUBLE ELSE 0 END AS hit_{k}" for k in (1, 5, 10)) + ", round(list_sum(list_transform(gold, lambda x: CASE WHEN list_contains(pred, x) THEN 1.0::DOUBLE / list_position(pred, x) ELSE 0 END)) / len(gold), 6) AS mrr FROM p JOIN g ON label = qlabel")
def recall_hit_mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    from spindrift.operators import dense
    from spindrift.plans.retrieval import _vectors

    rows, asked = _vectors(spark, d)
    hits = dense.search(rows, asked, 20).groupBy("query", "qlabel").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("pred"))
    gold = rows.groupBy(F.col("label").alias("qlabel")).agg(F.collect_list("doc").alias("gold"))
    g, p = F.col("gold"), F.col("pred")
    at = [x for k in (1, 5, 10) for x in (F.round(metrics.recall_at(g, p, k), 6).alias(f"recall_{k}"), metrics.hit_at(g, p, k).alias(f"hit_{k}"))]
    return hits.join(gold, "qlabel").select("query", *at, F.round(metrics.mrr(g, p), 6).alias("mrr"))


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS line FROM lineitem), r AS (SELECT l_orderkey AS k, l_suppkey AS a, l_suppkey + l_quantity::BIGINT AS b FROM lineitem),
h AS (SELECT g.k, g.line, EXISTS (SELECT 1 FROM r WHERE r.k = g.k AND g.line BETWEEN r.a - 3 AND r.b + 3) AS hit FROM g)
SELECT k, count(*) AS gold_lines, count(*) FILTER (hit) AS hit_lines, round(count(*) FILTER (hit) / count(*) * 100, 6) AS line_accuracy FROM h GROUP BY 1""")
def line_overlap_range_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    gold = rows.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("line"))
    ranges = rows.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("first"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("last"))
    return metrics.line_accuracy(gold, ranges, "k")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document and the next one by id: the order is found on ids alone, in one task for each of 1,000 ranges of them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", F.floor(F.col("doc_id") / 1000).alias("part"))
    w = Window.partitionBy("part").orderBy("doc_id")
    inside = ids.select("doc_id", "part", F.lead("doc_id").over(w).alias("next"))
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("first_after"))
    pairs = inside.join(after, "part").select("doc_id", F.coalesce("next", "first_after").alias("next")).where("next is not null")
    return docs.join(pairs, "doc_id").join(docs.select(F.col("doc_id").alias("next"), F.col("text").alias("other")), "next").drop("next")


_P = "p AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS other FROM documents QUALIFY other IS NOT NULL)"
_TOK = r"""regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '#[^\n]*', '', 'g'), '(?s)\x22\x22\x22.*?\x22\x22\x22', repeat(chr(34), 6), 'g'), '(?s)\x27\x27\x27.*?\x27\x27\x27', repeat(chr(39), 6), 'g'), '"[^"]*"', '""', 'g'), '\x27[^\x27]*\x27', repeat(chr(39), 2), 'g'), '[a-zA-Z0-9_]+|[^a-zA-Z0-9_	

 ]')"""
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS side, {n} AS n, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: array_to_string({s}[i : i + {n} - 1], chr(1)))) AS g FROM t" for s in ("r", "h") for n in (1, 2, 3, 4))


@query(f"""WITH {_P}, t AS (SELECT doc_id, {_TOK.format(x='text')} AS r, {_TOK.format(x='other')} AS h FROM p), g AS ({_GRAMS}), c AS (SELECT doc_id, n, g, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM g GROUP BY 1, 2, 3),
q AS (SELECT doc_id, n, CASE WHEN sum(h) > 0 THEN sum(least(r, h)) / sum(h) ELSE 0 END AS p FROM c GROUP BY 1, 2), m AS (SELECT doc_id, sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / 4 AS m, max(p) AS x FROM q GROUP BY 1)
SELECT doc_id, round(CASE WHEN x > 0 THEN exp(m) * CASE WHEN len(r) > 0 THEN least(1.0, len(h) / len(r)) ELSE 0 END ELSE 0 END, 6) AS score FROM t LEFT JOIN m USING (doc_id)""")
def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d).select("doc_id", codebleu_tokens(F.col("text")).alias("r"), codebleu_tokens(F.col("other")).alias("h"))
    return metrics.ngram_overlap(t, "doc_id", "r", "h")


_SET = "list_distinct(list_filter(list_transform(string_split({x}, chr(10)), lambda s: " + sql_strip("s") + "), lambda s: s <> ''))"


@query(f"WITH {_P}, s AS (SELECT doc_id, {_SET.format(x='text')} AS a, {_SET.format(x='other')} AS b FROM p) SELECT doc_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS jaccard FROM s")
def line_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", F.round(metrics.line_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query(f"WITH {_P} SELECT doc_id, round(CASE WHEN greatest(length(text), length(other)) = 0 THEN 1 ELSE len(list_filter(regexp_extract_all(text, '(?s).'), lambda c: contains(other, c))) / greatest(length(text), length(other)) END, 6) AS similarity FROM p")
def char_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("doc_id", F.round(metrics.char_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


@query(f"""WITH s AS (SELECT source, substr(md5(array_to_string(list_sort({_SET.format(x='text')}), chr(10))), 1, 16) AS sig FROM documents), c AS (SELECT source, sig, count(*) AS c FROM s GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY source) AS p FROM c)
SELECT source, sum(c)::BIGINT AS members, count(*) AS clusters, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy, round(1 - sum(p * p), 6) AS diversity, max(c) AS largest FROM p GROUP BY 1""")
def signature_clusters_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", metrics.signature(F.col("text")).alias("sig"))
    return metrics.cluster_entropy(rows, "source", "sig")


_MODEL = "CASE turn % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4o' ELSE 'other' END"


@query(f"""WITH t AS (SELECT {_MODEL} AS model, CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS prompt, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS completion FROM conversations), s AS (SELECT model, count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens FROM t GROUP BY 1)
SELECT *, round(prompt_tokens / 1000 * CASE model WHEN 'gpt-4' THEN 0.03 WHEN 'gpt-4o-mini' THEN 0.00015 WHEN 'gpt-4o' THEN 0.005 ELSE 0.02 END + completion_tokens / 1000 * CASE model WHEN 'gpt-4' THEN 0.06 WHEN 'gpt-4o-mini' THEN 0.0006 WHEN 'gpt-4o' THEN 0.015 ELSE 0.02 END, 6) AS cost FROM s""")
def token_cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    n, reply = F.floor(F.length("text") / 4).cast("long"), F.col("role") == "assistant"
    model = F.element_at(F.array(*map(F.lit, ["gpt-4", "gpt-4o-mini", "gpt-4o", "other"])), (F.col("turn") % 4 + 1).cast("int"))
    t = table(spark, d, "conversations").select(model.alias("model"), F.when(reply, 0).otherwise(n).alias("p"), F.when(reply, n).otherwise(0).alias("c"))
    s = t.groupBy("model").agg(F.count("*").alias("calls"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))
    return s.withColumn("cost", F.round(metrics.cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens")), 6))


@query(f"""WITH {_R}, w AS (SELECT method, event_id, (sum(tokens) OVER o)::DOUBLE AS t, (sum(resolved::INT) OVER o)::DOUBLE AS k FROM r WINDOW o AS (PARTITION BY method ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT method, event_id, CASE WHEN k = 0 THEN 'infinity'::DOUBLE ELSE t / 1000 * 0.02::DOUBLE / k END AS cost_per_resolved FROM w""")
def cost_per_resolved(spark: SparkSession, d: str) -> DataFrame:
    so_far = running_sums(results(spark, d), ["method"], ["ts", "event_id"], {"t": F.col("tokens"), "k": F.col("resolved").cast("int")}, _hour())
    return so_far.select("method", "event_id", F.when(F.col("k") == 0, F.lit(float("inf"))).otherwise(F.col("t") / 1000 * metrics.COST_PER_1K / F.col("k")).alias("cost_per_resolved"))


@query(f"WITH {_ATT}, f AS (SELECT conv_id, min(n) FILTER (ok) AS attempts FROM a GROUP BY 1) SELECT attempts, count(*) AS instances FROM f WHERE attempts IS NOT NULL GROUP BY 1")
def attempts_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = _attempts(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return n.where("ok").groupBy("conv_id").agg(F.min("n").alias("attempts")).groupBy("attempts").agg(F.count("*").alias("instances"))


@query("""SELECT conv_id, count(*) AS attempts, sum(length(text) // 4)::BIGINT AS all_tokens, coalesce(sum(length(text) // 4) FILTER (length(text) % 2 = 0), 0)::BIGINT AS valid_tokens, arg_min(md5(text), turn) FILTER (length(text) % 2 = 0) AS first_valid FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def attempt_folding(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of all attempts and of those with a result, and the first of those."""
    a = table(spark, d, "conversations").where("role = 'assistant'").withColumn("ok", F.length("text") % 2 == 0).withColumn("t", F.floor(F.length("text") / 4))
    first = F.min_by(F.when(F.col("ok"), F.md5("text")), F.when(F.col("ok"), F.col("turn")))
    return a.groupBy("conv_id").agg(F.count("*").alias("attempts"), F.sum("t").cast("long").alias("all_tokens"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("t"))), F.lit(0)).cast("long").alias("valid_tokens"), first.alias("first_valid"))


@query(f"WITH {_R} SELECT method, count(*) AS total, sum(resolved::INT)::BIGINT AS resolved, round(avg(resolved::INT) * 100, 2) AS resolution_rate, round(avg(applied::INT) * 100, 2) AS apply_rate, round(avg(seconds), 4) AS avg_seconds, sum(tokens)::BIGINT AS tokens FROM r GROUP BY 1")
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return report.compare(results(spark, d))


@query(f"WITH {_R}, m AS (SELECT method, avg(resolved::INT) AS x FROM r GROUP BY 1 ORDER BY x DESC, method LIMIT 1) SELECT count(DISTINCT r.method) AS methods, count(DISTINCT instance) AS instances, any_value(m.method) AS best_method, round(any_value(x) * 100, 2) AS best_rate FROM r, m")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(results(spark, d))


@query(f"""WITH {_R}, g AS (SELECT method, count(*)::DOUBLE AS n, sum(resolved::INT)::DOUBLE AS k FROM r GROUP BY 1), x AS (SELECT a.method AS method_a, b.method AS method_b, a.n AS na, a.k AS ka, b.n AS nb, b.k AS kb FROM g a JOIN g b ON a.method < b.method),
y AS (SELECT *, na + nb AS n, ka + kb AS hit, 2 * (asin(sqrt(ka / na)) - asin(sqrt(kb / nb))) AS h FROM x)
SELECT method_a, method_b, round((ka / na - kb / nb) * 100, 2) AS difference, CASE WHEN na * nb * hit * (n - hit) > 0 THEN round(n * greatest(0, abs(ka * (nb - kb) - kb * (na - ka)) - n / 2) ** 2 / (na * nb * hit * (n - hit)), 6) END AS chi2, round(h, 4) AS cohen_h, CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM y""")
def pairwise_chi2_cohen(spark: SparkSession, d: str) -> DataFrame:
    return report.pairwise(results(spark, d), p_values=False)


#: erfc by its power series, which has six good places up to 5, where the value is below a millionth.
_ERFC = "CASE WHEN z = 0 THEN 1 WHEN z > 5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * z * exp(n * ln(z * z) - lgamma(n + 1)) / (2 * n + 1))) END"


@query(f"""WITH c AS ({ORACLES['pairwise_chi2_cohen']}), z AS (SELECT *, sqrt(chi2 / 2)::DOUBLE AS z FROM c), p AS (SELECT * EXCLUDE (z), CASE WHEN z IS NULL THEN NULL ELSE round(abs({_ERFC}), 6) END AS p FROM z)
SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p""")
def pairwise_p_values(spark: SparkSession, d: str) -> DataFrame:
    return report.pairwise(results(spark, d))


@query(f"""WITH {_R}, g AS (SELECT method, count(*) AS n, avg(resolved::INT) AS p FROM r GROUP BY 1), w AS (SELECT *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS m FROM g)
SELECT method, n, round(p * 100, 2) AS rate, round(least(greatest(c - m, 0), 1) * 100, 2) AS lower, round(least(greatest(c + m, 0), 1) * 100, 2) AS upper FROM w""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    return report.wilson(results(spark, d))


@query(f"WITH {_R} SELECT instance, " + ", ".join(f"max(resolved::INT) FILTER (method = '{t}') AS {t}" for t in TYPES) + " FROM r GROUP BY 1")
def per_instance_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.grid(results(spark, d), "instance", "method", TYPES, F.max(F.col("resolved").cast("int")))


@query(f"WITH {_R} SELECT instance % 10 AS repo, " + ", ".join(f"coalesce(round(avg(resolved::INT) FILTER (method = '{t}') * 100, 6), 0) AS {t}" for t in TYPES) + " FROM r GROUP BY 1")
def repo_method_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("repo", F.col("instance") % 10)
    return report.grid(rows, "repo", "method", TYPES, F.round(F.avg(F.col("resolved").cast("int")) * 100, 6), 0.0)


@query(f"WITH {_R} SELECT method, event_id, count(*) OVER o AS seen, sum(resolved::INT) OVER o AS resolved_so_far, round(avg(resolved::INT) OVER o * 100, 6) AS running_rate FROM r WINDOW o AS (PARTITION BY method ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_progress(spark: SparkSession, d: str) -> DataFrame:
    return report.running(results(spark, d), "method", ["ts", "event_id"], "resolved", _hour()).select("method", "event_id", "seen", "resolved_so_far", "running_rate")


@query(f"WITH {_R} SELECT method, event_id, count(*) OVER o AS requests, (sum(tokens) OVER o)::BIGINT AS tokens_60s FROM (SELECT *, epoch_us(ts) AS us FROM r) WINDOW o AS (PARTITION BY method ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("method").orderBy("us").rangeBetween(-60_000_000, 0)
    rows = results(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.select("method", "event_id", F.count("*").over(w).alias("requests"), F.sum("tokens").over(w).alias("tokens_60s"))


@query(f"WITH {_R}, g AS (SELECT method, round(avg(resolved::INT), 6) AS rate, round(avg(seconds), 6) AS seconds, avg(tokens) AS tokens FROM r GROUP BY 1) SELECT method, metric, value FROM (UNPIVOT g ON rate, seconds, tokens INTO NAME metric VALUE value)")
def metric_unpivot(spark: SparkSession, d: str) -> DataFrame:
    g = results(spark, d).groupBy("method").agg(F.round(F.avg(F.col("resolved").cast("int")), 6).alias("rate"), F.round(F.avg("seconds"), 6).alias("seconds"), F.avg("tokens").alias("tokens"))
    return report.unpivot(g, ["method"], ["rate", "seconds", "tokens"])


@query("SELECT event_type, min((props->>'$.k')::BIGINT) AS least, max((props->>'$.k')::BIGINT) AS most, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy(F.col("method").alias("event_type")).agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum("tokens").alias("total"))


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o_custkey = c_custkey")
def prediction_join(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", F.col("o_orderkey").alias("position"))
    return ingest.join_predictions(customers, orders, "c_custkey").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Runs with tests, code similarity and localization of each event."""
    e = F.col("event_id")
    names = lambda p, n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(p), i.cast("string")))  # noqa: E731
    some = lambda p, n: F.when(n > 0, names(p, n)).otherwise(F.array().cast("array<string>"))  # noqa: E731
    place = F.map_from_entries(F.filter(F.array(F.struct(F.lit("file").alias("k"), (e % 5).cast("double").alias("v")), F.when(e % 2 == 0, F.struct(F.lit("line").alias("k"), (e % 3).cast("double").alias("v")))), lambda x: x.isNotNull()))
    return results(spark, d).withColumns({"tests_passed": some("p", e % 4), "tests_failed": some("f", e % 3), "codebleu": (e % 10) / 10, "localization": place, "error": F.when(e % 50 == 0, F.concat(F.lit("failed "), e.cast("string")))})


_O = _R + ", o AS (SELECT *, event_id % 4 AS tp, event_id % 3 AS tf, (event_id % 10) / 10 AS codebleu FROM r)"


@query(f"WITH {_O} SELECT method, instance, resolved, applied, tp::INT AS tests_passed, tf::INT AS tests_failed, codebleu, seconds FROM o")
def detailed_results(spark: SparkSession, d: str) -> DataFrame:
    return report.detailed(_outcomes(spark, d))


@query(f"""WITH {_O} SELECT method, count(*) AS total, sum(resolved::INT)::BIGINT AS resolved, round(avg(resolved::INT) * 100, 6) AS resolution_rate, round(avg(applied::INT) * 100, 6) AS apply_rate, round(avg(codebleu), 6) AS avg_codebleu, round(avg(seconds), 6) AS avg_seconds,
round(sum(event_id % 5) / count(*), 6) AS file_score, round(sum(event_id % 3) FILTER (event_id % 2 = 0) / count(*), 6) AS line_score FROM o GROUP BY 1""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    out = report.evaluation_summary(_outcomes(spark, d), ["method"])
    return out.withColumn("file_score", F.col("localization")["file"]).withColumn("line_score", F.col("localization")["line"]).drop("localization")


@query(f"""WITH {_O} SELECT method, 'resolution' AS chart, 'rate' AS label, round(avg(resolved::INT) * 100, 6) AS value FROM o GROUP BY 1 UNION ALL SELECT method, 'time', 'avg_seconds', round(avg(seconds), 6) FROM o GROUP BY 1
UNION ALL SELECT method, 'localization', 'file', round(avg(event_id % 5), 6) FROM o GROUP BY 1 UNION ALL SELECT method, 'localization', 'line', round(avg(event_id % 3), 6) FROM o WHERE event_id % 2 = 0 GROUP BY 1""")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    return report.series(_outcomes(spark, d))


@query(f"WITH {_O} SELECT method, instance, 'failed ' || event_id AS error, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') AS at FROM o WHERE event_id % 50 = 0")
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.errors(_outcomes(spark, d))


@query(f"WITH {_O} SELECT method, event_id, CASE WHEN tp + tf > 0 THEN tp / (tp + tf) ELSE 0 END AS share, CASE WHEN tp + tf > 0 THEN tp / (tp + tf) * 100 ELSE 0 END AS percent FROM o")
def test_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    p, f = F.col("tests_passed"), F.col("tests_failed")
    return _outcomes(spark, d).select("method", "event_id", metrics.test_pass_rate(p, f).alias("share"), metrics.test_pass_rate(p, f, True).alias("percent"))


@query(f"WITH {_R}, l AS (SELECT method, unnest(['seconds', 'tokens']) AS metric, unnest([seconds, tokens::DOUBLE]) AS value FROM r) SELECT method, metric, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM l GROUP BY 1, 2")
def aggregated_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(results(spark, d), ["seconds", "tokens"], ["method"])


@query(f"WITH {_R} SELECT method, event_id, round(avg(applied::INT) OVER o * 100, 6) AS running_rate, count(*) OVER o AS seen FROM r WINDOW o AS (PARTITION BY method ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_apply_rate(spark: SparkSession, d: str) -> DataFrame:
    return report.running(results(spark, d), "method", ["ts", "event_id"], "applied", _hour()).select("method", "event_id", "running_rate", "seen")


@query(f"WITH {_ATT}, c AS (SELECT conv_id, count(*) AS attempts FROM a GROUP BY 1) SELECT conv_id, attempts, round(avg(attempts) OVER w, 6) AS mean_so_far, max(attempts) OVER w AS most_so_far FROM (SELECT *, conv_id % 5 AS grp FROM c) WINDOW w AS (PARTITION BY grp ORDER BY conv_id ROWS UNBOUNDED PRECEDING)")
def running_attempts(spark: SparkSession, d: str) -> DataFrame:
    n = _attempts(spark, d).groupBy("conv_id").agg(F.count("*").alias("attempts")).withColumn("grp", F.col("conv_id") % 5)
    return report.running_attempts(n, "grp", ["conv_id"], "attempts").drop("grp")


_FS = "fs AS (SELECT l_orderkey AS k, list(l_partkey % 3) AS gold, list(l_suppkey % 3) AS pred FROM lineitem GROUP BY 1)"


@query(f"WITH {_FS}, e AS (SELECT k, k % 8 AS grp, list_sort(list_distinct(gold)) = list_sort(list_distinct(pred)) AS exact FROM fs) SELECT k, exact, round(avg(exact::INT) OVER (PARTITION BY grp ORDER BY k ROWS UNBOUNDED PRECEDING) * 100, 6) AS running_rate FROM e")
def file_set_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_partkey") % 3).alias("gold"), F.collect_list(F.col("l_suppkey") % 3).alias("pred")).withColumn("grp", F.col("k") % 8)
    return metrics.file_sets(rows, "grp", ["k"], "gold", "pred").drop("grp")


@query("WITH p AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 7) AS gold, list(l_suppkey % 7 ORDER BY l_linenumber, l_suppkey % 7) AS pred FROM lineitem GROUP BY 1) SELECT k, " + ", ".join(f"round(len(list_intersect(gold, pred[1:{n}])) / len(gold) * 100, 6) AS recall_{n}, CASE WHEN list_has_any(gold, pred[1:{n}]) THEN 100.0::DOUBLE ELSE 0 END AS hit_{n}" for n in (1, 3, 5, 10)) + ", round(list_sum(list_transform(gold, lambda x: CASE WHEN list_contains(pred, x) THEN 1.0::DOUBLE / list_position(pred, x) ELSE 0 END)) / len(gold), 6) AS mrr, round(len(list_intersect(gold, pred[1:5])) / len(gold) * 100, 6) AS score FROM p")
def localization_scores(spark: SparkSession, d: str) -> DataFrame:
    pred = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 7).alias("x")))), lambda s: s["x"])
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 7).alias("gold"), pred.alias("pred"))
    return metrics.localization(rows, ["k"], "gold", "pred")


def _method_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two methods' values of the same instance, each its mean."""
    v = results(spark, d).groupBy("method", "instance").agg(F.avg("tokens").alias("x"))
    a, b = v.toDF("method_a", "instance", "x"), v.toDF("method_b", "instance", "y")
    return a.join(b, "instance").where("method_a < method_b")


_PAIRS = f"{_R}, v AS (SELECT method, instance, avg(tokens) AS x FROM r GROUP BY 1, 2), mp AS (SELECT a.method AS method_a, b.method AS method_b, a.x AS x, b.x AS y FROM v a JOIN v b ON a.instance = b.instance AND a.method < b.method)"


@query(f"WITH {_PAIRS}, g AS (SELECT method_a, method_b, sum((x >= 50 AND y < 50)::INT)::BIGINT AS only_a, sum((x < 50 AND y >= 50)::INT)::BIGINT AS only_b FROM mp GROUP BY 1, 2) SELECT *, CASE WHEN only_a + only_b > 0 THEN round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b), 6) END AS chi2 FROM g")
def pairwise_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return report.mcnemar(_method_pairs(spark, d).select("method_a", "method_b", (F.col("x") >= 50).alias("a"), (F.col("y") >= 50).alias("b")))


@query(f"WITH {_PAIRS}, g AS (SELECT method_a, method_b, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS s FROM mp GROUP BY 1, 2) SELECT method_a, method_b, n, round(m, 6) AS mean_difference, CASE WHEN n > 1 AND s > 0 THEN round(m / (s / sqrt(n)), 6) END AS t, CASE WHEN n > 1 AND s > 0 THEN round(m / s, 6) END AS cohen_d FROM g")
def pairwise_t(spark: SparkSession, d: str) -> DataFrame:
    return report.paired_t(_method_pairs(spark, d))


@query("SELECT event_type AS method, " + ", ".join(f"coalesce(round(avg(CASE WHEN user_id % 4 = {e} THEN (value >= 50)::INT END) * 100, 6), 0) AS e{e}" for e in range(4)) + " FROM events GROUP BY 1")
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    """Resolution rates of methods in four experiments, a column for each."""
    rows = results(spark, d).withColumn("experiment", F.concat(F.lit("e"), (F.col("instance") % 4).cast("string")))
    return report.grid(rows, "method", "experiment", [f"e{i}" for i in range(4)], F.round(F.avg(F.col("resolved").cast("double")) * 100, 6), 0.0)


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{"|".join(metrics.HARD)}') THEN 'high' WHEN regexp_matches(lower(text), '{"|".join(metrics.EASY)}') THEN 'low' WHEN n > 10 THEN 'high' WHEN n < 3 THEN 'low' ELSE 'medium' END AS complexity FROM (SELECT doc_id, text, len(string_split(text, chr(10) || chr(10))) AS n FROM documents)""")
def prompt_complexity(spark: SparkSession, d: str) -> DataFrame:
    """By words of the text, then by the number of its paragraphs."""
    return table(spark, d, "documents").select("doc_id", metrics.complexity(F.col("text"), F.size(F.split("text", "\n\n", -1))).alias("complexity"))


def _sql_ranks(table_: str, by: str, value: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2"


@query(f"""WITH {_PAIRS}, d AS (SELECT method_a, method_b, x - y AS d FROM mp), k AS (SELECT *, abs(d) AS a FROM d WHERE d <> 0), rk AS (SELECT *, {_sql_ranks('k', 'method_a, method_b', 'a')} AS rank, count(*) OVER (PARTITION BY method_a, method_b, a) AS t FROM k),
g AS (SELECT method_a, method_b, count(*)::DOUBLE AS n, sum(rank) FILTER (d > 0) AS up, sum(rank) FILTER (d < 0) AS down, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY 1, 2), h AS (SELECT *, (up - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS zz FROM g), e AS (SELECT *, abs(zz) / sqrt(2) AS z FROM h)
SELECT method_a, method_b, n::BIGINT AS n, up::DOUBLE AS w_plus, down::DOUBLE AS w_minus, round(zz, 6) AS z, round({_ERFC}, 6) AS p FROM e""")
def pairwise_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return significance.wilcoxon(_method_pairs(spark, d), ["method_a", "method_b"])


def _sql_beta(x: str, a: str, b: str) -> str:
    """The regularized incomplete beta function by its series, on the side below a half."""
    one = "CASE WHEN {y} <= 0 THEN 0 ELSE exp({p} * ln({y}) + {q} * ln(1 - {y}) + lgamma({p} + {q}) - lgamma({p}) - lgamma({q})) / {p} * list_sum(list_transform(range(0, 2000), lambda n: exp(lgamma({p} + {q} + n) - lgamma({p} + {q}) + lgamma({p} + 1) - lgamma({p} + 1 + n) + n * ln({y})))) END"
    return f"CASE WHEN {x} > 0.5 THEN 1 - {one.format(y=f'(1 - {x})', p=b, q=a)} ELSE {one.format(y=x, p=a, q=b)} END"


@query(f"""WITH {_PAIRS}, rk AS (SELECT method_a, method_b, {_sql_ranks('mp', 'method_a, method_b', 'x')} AS rx, {_sql_ranks('mp', 'method_a, method_b', 'y')} AS ry FROM mp),
g AS (SELECT method_a, method_b, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY 1, 2), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM g), b AS (SELECT *, ((n - 2) / (n - 2 + t * t))::DOUBLE AS x, ((n - 2) / 2)::DOUBLE AS a, 0.5::DOUBLE AS b FROM t)
SELECT method_a, method_b, n, round(rho, 6) AS rho, round(t, 6) AS t, round({_sql_beta('x', 'a', 'b')}, 6) AS p FROM b""")
def pairwise_spearman(spark: SparkSession, d: str) -> DataFrame:
    return significance.spearman(_method_pairs(spark, d), ["method_a", "method_b"])


_QUARTERS = "qv AS (SELECT user_id % 4 AS part, event_type AS g, value FROM events), gs AS (SELECT part, g, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM qv GROUP BY 1, 2)"


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 4).alias("part"), F.col("event_type").alias("group"), "value")


@query(f"""WITH {_QUARTERS}, t AS (SELECT part, count(*) AS groups, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS grand, sum(n * v) AS within FROM gs GROUP BY 1), b AS (SELECT t.*, (SELECT sum(gs.n * (m - grand) ** 2) FROM gs WHERE gs.part = t.part) AS between FROM t),
f AS (SELECT part, groups, n, between / (groups - 1) / (within / (n - groups)) AS f, ((n - groups) / 2)::DOUBLE AS a, ((groups - 1) / 2)::DOUBLE AS b, ((n - groups) / (n - groups + between / (within / (n - groups))))::DOUBLE AS x FROM b)
SELECT part, groups, n, round(f, 6) AS f, round({_sql_beta('x', 'a', 'b')}, 6) AS p FROM f""")
def variance_anova(spark: SparkSession, d: str) -> DataFrame:
    """Values by type of event, for each quarter of the users."""
    return significance.anova(_quarters(spark, d), ["part"])


@query(f"""WITH {_QUARTERS}, t AS (SELECT part, count(*) AS k, sum(n) - count(*) AS df, sum(n * v) / (sum(n) - count(*)) AS ms FROM gs GROUP BY 1),
pr AS (SELECT x.part, x.g AS a, y.g AS b, x.m - y.m AS d, abs(x.m - y.m) / sqrt(ms / 2 * (1 / x.n + 1 / y.n)) AS q, k, df::DOUBLE AS df FROM gs x JOIN gs y ON x.part = y.part AND x.g < y.g JOIN t ON t.part = x.part),
sg AS (SELECT unnest(range(-40, 41)) / 40 AS u), zg AS (SELECT unnest(range(-60, 61)) / 7.5 AS y), zf AS (SELECT y, CASE WHEN y >= 0 THEN 1 - e / 2 ELSE e / 2 END AS phi FROM (SELECT y, ({_ERFC}) AS e FROM (SELECT y, (abs(y) / sqrt(2))::DOUBLE AS z FROM zg))),
w0 AS (SELECT part, a, b, d, q, k, df, u, y, phi, 1 + u * 8 / sqrt(2 * df) AS s FROM pr, sg, zf), w1 AS (SELECT *, y - q * s AS l, (abs(y - q * s) / sqrt(2))::DOUBLE AS z FROM w0 WHERE s > 0), w2 AS (SELECT *, ({_ERFC}) AS e FROM w1),
w3 AS (SELECT part, a, b, d, q, k, df, s, sum(exp(-y * y / 2) / sqrt(2 * pi()) * greatest(phi - CASE WHEN l >= 0 THEN 1 - e / 2 ELSE e / 2 END, 0) ** (k - 1)) / 7.5 AS inner_ FROM w2 GROUP BY part, a, b, d, q, k, df, s),
w4 AS (SELECT part, a, b, d, q, sum(exp(ln(2) + df / 2 * ln(df / 2) - lgamma(df / 2) + (df - 1) * ln(s) - df * s * s / 2) * inner_ * k) * 8 / sqrt(2 * max(df)) / 40 AS below FROM w3 GROUP BY part, a, b, d, q)
SELECT part, a, b, round(d, 6) AS difference, round(q, 6) AS q, round(greatest(least(1 - below, 1), 0), 6) AS p FROM w4""")
def variance_tukey(spark: SparkSession, d: str) -> DataFrame:
    return significance.tukey(_quarters(spark, d), ["part"])


@query("SELECT doc_id, contains(p, '---') AND contains(p, '+++') AS form, CASE doc_id % 3 WHEN 0 THEN true ELSE false END AS resolved FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+y' WHEN 1 THEN '--- a/x' || chr(10) || '+++ b/x' || chr(10) || 'no hunk' ELSE 'text' END AS p FROM documents)")
def resolved_lightly(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("doc_id") % 3 == 0, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+y").when(F.col("doc_id") % 3 == 1, "--- a/x\n+++ b/x\nno hunk").otherwise("text")
    return table(spark, d, "documents").select("doc_id", metrics.patch_format_ok(p).alias("form"), metrics.resolved_lightly(p).alias("resolved"))


@query("SELECT event_type, event_id, '$' || CASE WHEN k < 9.97 THEN format('{:.6f}', k / 997) WHEN k < 997 THEN format('{:.4f}', k / 997) ELSE format('{:.2f}', k / 997) END AS cost FROM (SELECT event_type, event_id, (props->>'$.k')::BIGINT * 13 AS k FROM events)")
def cost_texts(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select(F.col("method").alias("event_type"), "event_id", metrics.dollars(F.col("tokens") * 13 / 997).alias("cost"))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10) ON n_nationkey = c_nationkey")
def patch_join(spark: SparkSession, d: str) -> DataFrame:
    """Patches with their instance and its place, by id; what is missing is null."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey")
    places = customers.join(table(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").select("id", "n_name")
    return ingest.join_patches(orders, customers.drop("c_nationkey"), places, "id").select("o_orderkey", "c_name", "n_name")


@query("SELECT source, count(*) AS instances, CASE WHEN source IN ('src1', 'src2') THEN 'index of ' || source END AS index_path FROM documents GROUP BY 1")
def repo_index_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    made = docs.where(F.col("source").isin("src1", "src2")).select("source").distinct().withColumn("index_path", F.concat(F.lit("index of "), "source"))
    return ingest.repo_indexes(docs, made, "source")


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') ORDER BY doc_id LIMIT 30) WHERE doc_id % 2 = 0")
def limited_instances(spark: SparkSession, d: str) -> DataFrame:
    """Repositories, limit, then the list of ids: the batch order of filters."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ingest.select_instances(docs, ["src1", "src2"], include=docs.where("doc_id % 2 = 0"), n=30, limit_first=True, col="doc_id", repo="source").select("doc_id")


@query("SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 0.0::DOUBLE WHEN turn <= 1 THEN 0.9::DOUBLE WHEN turn = 2 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM conversations")
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", metrics.confidence(F.col("turn"), F.length("text") % 3 != 0).alias("confidence"))


@query("SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1")
def perplexity_by_type(spark: SparkSession, d: str) -> DataFrame:
    return metrics.perplexity(table(spark, d, "events").withColumn("logprob", -F.col("value") / 100), "event_type", "logprob")


@query(f"WITH {_R} SELECT method, max(seconds * 2 + tokens) AS worst, median(seconds * 2 + tokens) AS middle, count(*) AS n FROM r GROUP BY 1")
def custom_metric(spark: SparkSession, d: str) -> DataFrame:
    """A metric of one's own: a value of each row, and its aggregates."""
    return metrics.custom(results(spark, d), F.col("seconds") * 2 + F.col("tokens"), {"worst": F.max, "middle": F.median, "n": F.count}, ["method"])


@query("SELECT event_id, event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 0) AS resolved FROM events")
def tests_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Must-pass tests f1, f2 and tests p1 that passed before, against what ran."""
    e = F.col("event_id")
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")  # noqa: E731
    passed = F.when(e % 3 == 2, a("f1", "p1")).otherwise(a("f1", "f2", "p1", "x"))
    failed = F.when((e % 3 == 1) & (e % 2 == 1), a("p1")).otherwise(a("y"))
    return table(spark, d, "events").select("event_id", metrics.resolved_by_tests(a("f1", "f2"), a("p1"), passed, failed).alias("resolved"))
