"""Queries of file scans, symbols, graphs, parsers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators import callgraph, chunking, explore, explorer, metrics
from spindrift.plans import sources
from spindrift.plans.base import registry, table
from spindrift.streaming import limiter, progress
from spindrift.tables import adopt, fresh

QUERIES, ORACLES, query = registry()


_FILES, _SYMBOLS = sources.FILES, sources.SYMBOLS
files = sources.files


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, content FROM l WHERE regexp_matches(content, '(?i)licen[sc]e')""")
def regex_scan(spark: SparkSession, d: str) -> DataFrame:
    return explore.grep(table(spark, d, "documents"), "licen[sc]e", "doc_id", "text", most=None)


@query("SELECT doc_id, len(ls) AS total_lines, array_to_string(ls[3:7], chr(10)) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def view_window(spark: SparkSession, d: str) -> DataFrame:
    return explore.view(table(spark, d, "documents"), 2, 5, "doc_id", "text")


@query("SELECT url FROM pages WHERE contains(lower(url), '/fr/') ORDER BY url LIMIT 20")
def find_file(spark: SparkSession, d: str) -> DataFrame:
    return explore.find_files(table(spark, d, "pages"), "/FR/", "url")


#: Keywords of benchmark texts by each variant's rule; words are runs of letters, digits and _.
_TOKENS = r"regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')"
_FOUND = {
    "refined": rf"list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*')) || list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*') AND (contains(w, '_') OR length(w) > 5)) || regexp_extract_all(text, '[\"'']([^\"'']+)[\"'']', 1)",
    "layered": rf"list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]*')) || list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*') AND length(w) > 3) || regexp_extract_all(text, '[\"'']([^\"'']+)[\"'']', 1) || list_filter({_TOKENS}, lambda w: regexp_full_match(lower(w), '(error|exception|fail|bug|issue|problem)s?'))",
    "stepwise": rf"list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*')) || list_filter({_TOKENS}, lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]*') AND (contains(w, '_') OR length(w) > 4))",
}


def _sql_keywords(variant: str) -> str:
    found = _FOUND[variant].replace("{{", "{").replace("}}", "}")
    return f"k0 AS (SELECT item_id, list_filter({found}, lambda w: length(w) > 2) AS ws FROM benchmark), kw AS (SELECT item_id, list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda y: lower(y)), lower(w)) = i)[1:{explore.MOST_KEYWORDS[variant]}] AS ws FROM k0)"


@query(" UNION ALL ".join(f"(WITH {_sql_keywords(v)} SELECT item_id, '{v}' AS variant, array_to_string(ws, ' ') AS words FROM kw)" for v in _FOUND))
def problem_keywords(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    parts = [items.select("item_id", F.lit(v).alias("variant"), F.array_join(explore.problem_keywords(F.col("text"), v), " ").alias("words")) for v in _FOUND]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _words(spark: SparkSession, d: str, variant: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(explore.problem_keywords(F.col("text"), variant)).alias("word"))


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, with a path."""
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("doc"), "text")


_DOCS = "source || '/' || lang || '_' || doc_id || '.py'"
_HITS = f"""w AS (SELECT DISTINCT item_id AS query, lower(unnest(ws)) AS word FROM kw), l AS (SELECT {_DOCS} AS doc, unnest(string_split(lower(text), chr(10))) AS x FROM documents),
h AS (SELECT doc, word, count(*) AS lines FROM l JOIN (SELECT DISTINCT word FROM w) ON contains(x, word) GROUP BY 1, 2)"""
_TESTS = "tests AS (SELECT item_id AS query, unnest(string_split('tests.Test_' || ['en', 'de', 'fr', 'es'][item_id % 4 + 1] || '_1.src' || item_id % 3 || '.De_1', '.')) AS part FROM benchmark)"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    name = F.concat(F.lit("tests.Test_"), F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (i % 4 + 1).cast("int")), F.lit("_1.src"), (i % 3).cast("string"), F.lit(".De_1"))
    return table(spark, d, "benchmark").select(i.alias("query"), name.alias("test"))


def _sql_files(variant: str, layered: bool) -> str:
    name = f"replace(regexp_extract(lower(doc), '([^/]*)$', 1), '.py', '')" if layered else "lower(doc)"
    per, more, test, pick = (1.5, 2.0, 1.5, "length(part) > 3") if layered else (1.0, 0.5, 2.0, "(contains(part, '_') OR regexp_matches(part, '^[A-Z]'))")
    return f"""{_sql_keywords(variant)}, {_HITS}, {_TESTS}, s AS (SELECT query, doc, (lines * ({per} + CASE WHEN contains({name}, word) THEN {more} ELSE 0 END))::DOUBLE AS score FROM h JOIN w USING (word)
UNION ALL SELECT query, doc, {test}::DOUBLE FROM tests JOIN (SELECT {_DOCS} AS doc FROM documents) ON contains(lower(doc), lower(part)) WHERE {pick}),
fs AS (SELECT query, doc, sum(score) AS score FROM s GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fs QUALIFY rank <= 5)"""


@query(f"WITH {_sql_files('refined', False)} SELECT * FROM top")
def file_scoring(spark: SparkSession, d: str) -> DataFrame:
    return explore.file_scores(_paged(spark, d), _words(spark, d, "refined"), _tests(spark, d))


@query(f"WITH {_sql_files('layered', True)} SELECT * FROM top")
def file_scoring_layered(spark: SparkSession, d: str) -> DataFrame:
    return explore.file_scores(_paged(spark, d), _words(spark, d, "layered"), _tests(spark, d), layered=True)


_EDGES = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, p, k, q, f: table(spark, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("child"), F.concat(F.lit(q), F.col(f).cast("string")).alias("parent"))
    return pair("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(pair("customer", "c", "c_custkey", "n", "c_nationkey"))


_CLOSE = f"WITH RECURSIVE {_EDGES}, r AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.child, e.parent, depth + 1 FROM r JOIN e ON e.child = r.ancestor WHERE depth < 50)"


@query(f"{_CLOSE} SELECT child, ancestor, min(depth) AS depth FROM r GROUP BY 1, 2")
def hierarchy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return explore.closure(_edges(spark, d))


@query(f"{_CLOSE} SELECT ancestor, count(DISTINCT child) AS descendants, max(depth) AS height FROM r GROUP BY 1")
def hierarchy_descendants(spark: SparkSession, d: str) -> DataFrame:
    return explore.closure(_edges(spark, d)).groupBy("ancestor").agg(F.count_distinct("child").alias("descendants"), F.max("depth").alias("height"))


@query(f"""WITH {_SYMBOLS} SELECT name AS caller, callee, count(*) AS calls FROM (SELECT DISTINCT name, unnest(string_split(calls, ',')) AS callee FROM sy WHERE calls <> '') GROUP BY 1, 2""")
def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    """By bare names."""
    return explore.call_edges(explore.symbols(files(spark, d))).groupBy("caller", "callee").agg(F.count("*").alias("calls"))


@query(f"WITH {sources.RESOLVED} SELECT * FROM rs")
def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.resolve(callgraph.facts(files(spark, d)))


@query(f"""WITH RECURSIVE {sources.RESOLVED}, e AS (SELECT DISTINCT caller, callee FROM rs WHERE callee IS NOT NULL), c AS (SELECT caller, callee FROM e UNION SELECT c.caller, e.callee FROM c JOIN e ON e.caller = c.callee),
n AS (SELECT caller AS function FROM e UNION SELECT callee FROM e)
SELECT function, (SELECT count(*) FROM e WHERE callee = function) AS callers, (SELECT count(*) FROM e WHERE caller = function) AS callees, (SELECT count(*) FROM c WHERE callee = function) AS all_callers, (SELECT count(*) FROM c WHERE caller = function) AS all_callees FROM n""")
def call_reach(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.reach(callgraph.resolve(callgraph.facts(files(spark, d))))


@query("""WITH s AS (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events)
SELECT caller, callee, count(*) AS calls FROM s WHERE callee IS NOT NULL GROUP BY 1, 2""")
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"))
    return steps.where("callee is not null").groupBy("caller", "callee").agg(F.count("*").alias("calls"))


_LOG = "string_agg('t.py::e' || event_id || CASE WHEN value >= 30 THEN ' PASSED' ELSE ' FAILED' END, chr(10) ORDER BY event_id)"


@query(f"""WITH o AS (SELECT user_id, {_LOG} || chr(10) || '=== ' || count(*) FILTER (value < 30) || ' failed, ' || count(*) FILTER (value >= 30) || ' passed ===' AS out FROM events GROUP BY 1)
SELECT user_id, len(regexp_extract_all(out, 'PASSED')) AS n_passed, len(regexp_extract_all(out, 'FAILED')) AS n_failed, regexp_extract(out, '(\\d+) passed', 1)::INT AS said_passed, regexp_extract(out, '(\\d+) failed', 1)::INT AS said_failed, regexp_extract(out, '(\\S+::\\S+) FAILED', 1) AS first_failed FROM o""".replace("\\\\", "\\"))
def test_output_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("t.py::e"), F.col("event_id").cast("string"), F.when(F.col("value") >= 30, " PASSED").otherwise(" FAILED"))
    out = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("ls"), F.count(F.when(F.col("value") < 30, 1)).alias("f"), F.count(F.when(F.col("value") >= 30, 1)).alias("p"))
    out = out.select("user_id", F.concat(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.format_string("\n=== %d failed, %d passed ===", "f", "p")).alias("out"))
    t = out.withColumn("t", explore.test_outcomes(F.col("out")))
    n = lambda s: F.size(F.filter("t", lambda x: x["status"] == s))
    first = F.coalesce(F.get(F.filter("t", lambda x: x["status"] == "FAILED"), F.lit(0))["test"], F.lit(""))
    return t.select("user_id", n("PASSED").alias("n_passed"), n("FAILED").alias("n_failed"), explore.test_summary(F.col("out"), "passed").alias("said_passed"), explore.test_summary(F.col("out"), "failed").alias("said_failed"), first.alias("first_failed"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'syntax|indentation') THEN 'syntax' WHEN regexp_matches(lower(text), 'test|assert') THEN 'test_failure' WHEN regexp_matches(lower(text), 'apply|patch') THEN 'apply_error' WHEN regexp_matches(lower(text), 'type|name|attribute|import') THEN 'semantic' ELSE 'unknown' END AS category FROM conversations""")
def error_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", metrics.error_category(F.col("text")).alias("category"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/', '_') AS key FROM pages")
def repo_path_map(spark: SparkSession, d: str) -> DataFrame:
    whole = F.regexp_extract("url", "^[a-z]+://([^?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.replace(whole, F.lit("/"), F.lit("_")).alias("key"))


_CHUNKED = "array_to_string(list_transform(range(line, stop + 1), lambda i: ls[i]), chr(10))"


@query(rf"""WITH {sources.LINE_CTES}, fs AS (SELECT path, broken, string_split(content, chr(10)) AS ls FROM f),
ip AS (SELECT path, list_filter(ls, lambda x: regexp_matches(x, '^(import|from) ')) AS imports, ls, broken FROM fs), tl AS (SELECT * FROM df WHERE up IS NULL),
rest AS (SELECT l.path, string_agg(l.x, chr(10) ORDER BY l.line) AS content FROM ln0 l WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.path = l.path AND l.line BETWEEN tl.line AND tl.stop) GROUP BY 1),
c AS (SELECT path, CASE WHEN sort = 'class' THEN 'class' ELSE 'function' END AS chunk_type, name, line, stop, {_CHUNKED} AS content FROM tl JOIN ip USING (path) WHERE sort = 'class' OR stop > line
  UNION ALL SELECT m.path, 'method', m.up || '.' || m.name, m.line, m.stop, {_CHUNKED.replace('line', 'm.line').replace('stop', 'm.stop')} FROM df m JOIN tl ON tl.path = m.path AND tl.line = m.up_line JOIN ip ON ip.path = m.path WHERE m.kind = 'method'
  UNION ALL SELECT path, 'module', NULL, 1, len(ls), content FROM rest JOIN ip USING (path) UNION ALL SELECT path, 'module', NULL, 1, len(ls), array_to_string(ls, chr(10)) FROM ip WHERE broken)
SELECT path, chunk_type, name, line AS start_line, stop AS end_line, array_to_string(imports, ',') AS imports, md5(content) AS content_md5 FROM c JOIN ip USING (path)""")
def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.ast_chunks(files(spark, d)).select("path", "chunk_type", "name", "start_line", "end_line", F.array_join("imports", ",").alias("imports"), F.md5("content").alias("content_md5"))


@query(f"WITH {_SYMBOLS} SELECT * FROM sy")
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("bases", "args", "calls")]
    return explore.symbols(files(spark, d)).select("path", "kind", "name", "owner", "start_line", "end_line", *joined)


@query(f"WITH {_SYMBOLS} SELECT path, kind, name, start_line FROM sy WHERE contains(lower(name), 'go_') AND kind = 'method' ORDER BY path, start_line LIMIT 10")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return explore.search_symbols(explore.symbols(files(spark, d)), "GO_", kind="method", exact=False).select("path", "kind", "name", "start_line")


@query("SELECT conv_id, turn, 'src/m' || conv_id || '.py' AS path, turn::VARCHAR AS line, '7' AS col, 'E50' || turn % 10 AS code, 'too ' || role AS message FROM conversations")
def lint_parse(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    out = F.concat(F.lit("checked 1 file\nsrc/m"), F.col("conv_id").cast("string"), F.lit(".py:"), t.cast("string"), F.lit(":7: E50"), (t % 10).cast("string"), F.lit(" too "), F.col("role"), F.lit("\nFound 1 error."))
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(explore.lint_rows(out)))


@query("""WITH l AS (SELECT conv_id, turn, role, unnest(range(turn % 4)) AS i FROM conversations)
SELECT conv_id, turn, CASE i % 2 WHEN 0 THEN 'src/a b/m' || conv_id || '.py' ELSE 'm' || i || '.py' END AS path, (turn * 10 + i)::VARCHAR AS line, (i + 1)::VARCHAR AS col, CASE WHEN conv_id % 2 = 0 THEN ['E501', 'W291', 'F401', 'C901'][i % 4 + 1] ELSE ['C0114', 'W0611', 'R0913', 'E0001'][i % 4 + 1] END AS code, 'said: ' || role || ' (' || i || ')' AS message FROM l""")
def lint_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of none to three findings in the form of either linter, between other lines."""
    t, c = F.col("turn"), F.col("conv_id")
    codes = F.when(c % 2 == 0, F.array(*map(F.lit, ["E501", "W291", "F401", "C901"]))).otherwise(F.array(*map(F.lit, ["C0114", "W0611", "R0913", "E0001"])))
    path = lambda i: F.when(i % 2 == 0, F.concat(F.lit("src/a b/m"), c.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("m"), i.cast("string"), F.lit(".py")))
    line = lambda i: F.concat(path(i), F.lit(":"), (t * 10 + i).cast("string"), F.lit(":"), (i + 1).cast("string"), F.lit(": "), F.get(codes, i % 4), F.when(c % 2 == 0, " ").otherwise(": "), F.lit("said: "), F.col("role"), F.lit(" ("), i.cast("string"), F.lit(")"))
    found = F.when(t % 4 > 0, F.transform(F.sequence(F.lit(0), F.greatest(t % 4 - 1, F.lit(0)).cast("int")), line)).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.lit("************* Module m\n"), F.array_join(found, "\n"), F.lit("\n\nYour code has been rated at 7.5/10\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(explore.lint_rows(out)))


@query("""WITH l AS (SELECT conv_id, turn, unnest(range(turn % 5 + 1)) AS i FROM conversations)
SELECT conv_id, turn, CASE (conv_id + i) % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'renamed' ELSE 'deleted' END AS change, CASE WHEN (conv_id + i) % 4 = 2 THEN 'new/f' || i || '.py' ELSE 'src/f' || i || '.py' END AS path, CASE WHEN (conv_id + i) % 4 = 2 THEN 'src/f' || i || '.py' END AS old_path FROM l""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    name = lambda top, i: F.concat(F.lit(top), i.cast("string"), F.lit(".py"))
    line = lambda i: F.concat(F.element_at(F.array(*map(F.lit, ["A", "M", "R087", "D"])), ((c + i) % 4 + 1).cast("int")), F.lit("\t"), name("src/f", i), F.when((c + i) % 4 == 2, F.concat(F.lit("\t"), name("new/f", i))).otherwise(""))
    out = F.array_join(F.transform(F.sequence(F.lit(0), (t % 5).cast("int")), line), "\n")
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(explore.changed_files(out)))


@query("""SELECT conv_id, turn, unnest(['main', 'topic/' || turn, 'fix-' || conv_id, 'main']) AS name, unnest([NULL, NULL, 'origin', 'origin']) AS remote, unnest([turn % 2 = 0, turn % 2 = 1, false, false]) AS current FROM conversations""")
def branch_list(spark: SparkSession, d: str) -> DataFrame:
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    star = lambda odd: F.when(F.col("turn") % 2 == odd, "* ").otherwise("  ")
    out = F.concat(star(0), F.lit("main\n"), star(1), F.lit("topic/"), t, F.lit("\n  remotes/origin/HEAD -> origin/main\n  remotes/origin/fix-"), c, F.lit("\n  remotes/origin/main\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(explore.branches(out)))


_ASKED = "q AS (SELECT * FROM (VALUES (1, 'run'), (1, 'BaseOf1'), (2, 'make_3'), (2, 'part'), (2, 'PartOf2'), (3, 'go_'), (3, 'Deep')) v(query, word))"


def _name_words(spark: SparkSession) -> DataFrame:
    rows = [(1, "run"), (1, "BaseOf1"), (2, "make_3"), (2, "part"), (2, "PartOf2"), (3, "go_"), (3, "Deep")]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(q).alias("query"), F.lit(w).alias("word")) for q, w in rows))))


_NAME = "CASE WHEN lower(name) = lower(word) THEN 2.0 ELSE 1.0 END"


@query(f"""WITH {_SYMBOLS}, {_ASKED}, s AS (SELECT query, path, name, kind, owner, sum({_NAME})::DOUBLE AS score FROM sy JOIN q ON contains(lower(name), lower(word)) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, name, owner NULLS FIRST) AS rank FROM s QUALIFY rank <= 10""")
def symbol_scoring(spark: SparkSession, d: str) -> DataFrame:
    return explore.symbol_scores(explore.symbols(files(spark, d)), _name_words(spark))


_TOP_FILES = "tf AS (SELECT q.query, f.path, row_number() OVER (PARTITION BY q.query ORDER BY (k * 7) % 23, k) AS rank, ((k * 7) % 5)::DOUBLE AS score FROM f, (SELECT DISTINCT query FROM q) q WHERE NOT broken QUALIFY rank <= 5)"


def _top_files(spark: SparkSession, d: str) -> DataFrame:
    """Five files of each query, as a file scoring would give them."""
    w = Window.partitionBy("query").orderBy((F.col("k") * 7) % 23, "k")
    both = files(spark, d).where(~F.contains("content", F.lit("def broken(:"))).crossJoin(F.broadcast(_name_words(spark).select("query").distinct()))  # three queries
    return both.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query", "path", "rank", ((F.col("k") * 7) % 5).cast("double").alias("score"))


_CLASSES = f"""{_SYMBOLS}, {_ASKED}, {_TOP_FILES}, c0 AS (SELECT query, path, name, sum({_NAME} + CASE WHEN (query, path) IN (SELECT (query, path) FROM tf) THEN 1 ELSE 0 END)::DOUBLE AS score FROM sy JOIN q ON contains(lower(name), lower(word)) WHERE kind = 'class' AND regexp_matches(word, '^[A-Z]') GROUP BY ALL
UNION ALL SELECT tf.query, sy.path, sy.name, 0.5 + (SELECT count(*) FROM q WHERE q.query = tf.query AND contains(lower(sy.name), lower(q.word))) FROM sy JOIN tf ON tf.path = sy.path AND tf.rank <= 3 WHERE kind = 'class'),
cs AS (SELECT query, path, name, sum(score)::DOUBLE AS score FROM c0 GROUP BY ALL), ct AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, name) AS rank FROM cs QUALIFY rank <= 10)"""


def _class_scores(spark: SparkSession, d: str) -> DataFrame:
    return explore.class_scores(explore.symbols(files(spark, d)), _name_words(spark), _top_files(spark, d))


@query(f"WITH {_CLASSES} SELECT * FROM ct")
def class_scoring(spark: SparkSession, d: str) -> DataFrame:
    return _class_scores(spark, d)


_FUNCTIONS = f"""{_CLASSES}, f0 AS (SELECT query, path, name, kind, owner, sum({_NAME} + CASE WHEN (query, path) IN (SELECT (query, path) FROM tf) THEN 1 ELSE 0 END + CASE WHEN owner IS NOT NULL AND (query, owner) IN (SELECT (query, name) FROM ct) THEN 1.5 ELSE 0 END)::DOUBLE AS score
FROM sy JOIN q ON contains(lower(name), lower(word)) WHERE kind <> 'class' AND (regexp_matches(word, '^[a-z]') OR contains(word, '_')) GROUP BY ALL), ft AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, name, owner NULLS FIRST) AS rank FROM f0 QUALIFY rank <= 20)"""


@query(f"WITH {_FUNCTIONS} SELECT * FROM ft")
def function_scoring(spark: SparkSession, d: str) -> DataFrame:
    return explore.function_scores(explore.symbols(files(spark, d)), _name_words(spark), _top_files(spark, d), _class_scores(spark, d))


@query(f"""WITH {_FUNCTIONS} SELECT query, 'function' AS stratum, path, name, 0.9::DOUBLE AS relevance FROM ft UNION ALL SELECT query, 'class', path, name, 0.8::DOUBLE FROM ct UNION ALL SELECT query, 'file', path, NULL, 0.7::DOUBLE FROM tf""")
def context_strata(spark: SparkSession, d: str) -> DataFrame:
    symbols, words, top, classes = explore.symbols(files(spark, d)), _name_words(spark), _top_files(spark, d), _class_scores(spark, d)
    return explore.strata(top, classes, explore.function_scores(symbols, words, top, classes))


_IMPORTANT = " + ".join(f"CASE WHEN list_contains(list_transform(ms, lambda m: contains(m, '{w}')), true) THEN 0.2 ELSE 0 END" for w in explore.IMPORTANT)


@query(f"""WITH {_SYMBOLS}, {_ASKED}, {_TOP_FILES}, mt AS (SELECT path, owner AS name, list(DISTINCT name) AS ms FROM sy WHERE kind = 'method' GROUP BY 1, 2),
s0 AS (SELECT tf.query, sy.path, kind, sy.name, start_line, end_line, tf.score AS fs, CASE WHEN kind = 'class' THEN coalesce(ms, []) ELSE [] END AS ms, row_number() OVER (PARTITION BY query, sy.path, kind ORDER BY start_line, sy.name) AS n FROM sy JOIN tf USING (path) LEFT JOIN mt ON mt.path = sy.path AND mt.name = sy.name WHERE kind <> 'method'),
l AS (SELECT query, path, kind, name, start_line, end_line, round(1.0::DOUBLE + CASE WHEN contains(name, '_') THEN 0.5 ELSE 0 END + CASE WHEN length(name) > 10 THEN 0.3 ELSE 0 END + 0.1 * len(ms) + {_IMPORTANT} + fs, 6) AS score FROM s0 WHERE n <= CASE WHEN kind = 'class' THEN 5 ELSE 10 END)
SELECT query, path, kind, name, start_line, end_line, score, round(least(1.0, score / 5), 6) AS relevance, row_number() OVER (PARTITION BY query ORDER BY score DESC, path, start_line, name) AS rank FROM l QUALIFY rank <= 15""")
def located_symbols(spark: SparkSession, d: str) -> DataFrame:
    return explore.located_symbols(explore.symbols(files(spark, d)), _top_files(spark, d))


@query()
def codebleu(spark: SparkSession, d: str) -> DataFrame:
    """Each file against the next one by number; tested against a plain computation."""
    from spindrift.functions.text import codebleu_tokens

    f = files(spark, d).select(F.col("k").alias("key"), "content")
    pairs = f.select("key", F.col("content").alias("ref")).join(f.select((F.col("key") - 1).alias("key"), F.col("content").alias("hyp")), "key")
    pairs = pairs.withColumns({f"{c}_tokens": codebleu_tokens(F.col(c)) for c in ("ref", "hyp")})
    pairs = pairs.withColumns({f"{c}_heavy": metrics.keyword_weighted(F.col(f"{c}_tokens")) for c in ("ref", "hyp")})
    sides, heavy = ({c: F.col(f"{c}_{kind}") for c in ("ref", "hyp")} for kind in ("tokens", "heavy"))
    counts = {f"{name}_{c}": F.size(t) for name, of in (("ngram", sides), ("weighted", heavy)) for c, t in of.items()}
    same = {"ngram_same": metrics.clipped_ngrams(*sides.values()), "weighted_same": metrics.clipped_ngrams(*heavy.values())}
    counted = pairs.select("key", metrics.code_match(F.col("ref"), F.col("hyp")).alias("m"), *(c.alias(n) for n, c in (counts | same).items()))
    scores = {n: metrics.ngram_score(F.col(f"{n}_same"), F.col(f"{n}_ref"), F.col(f"{n}_hyp")) for n in ("ngram", "weighted")}
    both = counted.select("key", *(c.alias(n) for n, c in scores.items()), "m.*")
    parts = {"ngram": F.col("ngram"), "weighted": F.col("weighted"), "syntax": F.col("syntax_match"), "flow": F.col("flow_match")}
    return both.withColumn("codebleu", F.round(metrics.codebleu(parts, dict.fromkeys(parts, 0.25)), 6))


#: The shape of a file: its tokens, without what strings hold, with names and numbers alike.
_SHAPE = r"array_to_string(list_transform(regexp_extract_all(regexp_replace(content, '[\"][^\"\n]*[\"]', '', 'g'), '\w+|[^\w ]|\n *'), lambda t: CASE WHEN t IN ('def', 'class', 'async', 'return', 'import', 'from', 'as', 'for', 'in') THEN t WHEN regexp_full_match(t, '\d+') THEN '1' WHEN regexp_full_match(t, '\w+') THEN 'w' ELSE t END), ' ')"


@query(f"""WITH {_FILES}, s AS (SELECT CASE WHEN broken THEN content ELSE {_SHAPE} END AS sig FROM f), c AS (SELECT sig, count(*) AS c FROM s GROUP BY 1), p AS (SELECT *, c / sum(c) OVER () AS p FROM c)
SELECT 'files' AS "group", sum(c)::BIGINT AS members, count(*) AS clusters, round(sum(-p * ln(p)) / ln(count(*)), 6) AS entropy, round(1 - sum(p * p), 6) AS diversity, max(c) AS largest FROM p""")
def syntax_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select(F.lit("files").alias("group"), metrics.syntax_signature(F.col("content")).alias("sig"))
    return metrics.cluster_entropy(rows, "group", "sig")


@query("""WITH l AS (SELECT user_id AS instance, event_id AS iteration, CASE event_type WHEN 'view' THEN 'view' ELSE 'search' END AS action, 'f' || event_id % 7 AS path, 'hit ' || event_id AS found FROM events)
SELECT instance, 'search' AS kind, found AS item FROM (SELECT * FROM l WHERE action = 'search' QUALIFY row_number() OVER (PARTITION BY instance ORDER BY iteration DESC) <= 10) UNION ALL SELECT DISTINCT instance, 'file', path FROM l WHERE path <> 'f3'""")
def explorer_state(spark: SparkSession, d: str) -> DataFrame:
    """The last ten searches of each instance and the files that it saw, without those whose chunks are there."""
    e = F.col("event_id")
    log = table(spark, d, "events").select(F.col("user_id").alias("instance"), e.alias("iteration"), F.when(F.col("event_type") == "view", "view").otherwise("search").alias("action"), F.concat(F.lit("f"), (e % 7).cast("string")).alias("path"), F.concat(F.lit("hit "), e.cast("string")).alias("found"))
    return explore.state_rows(log, seen=log.where("path = 'f3'").select("instance", "path"))


@query("SELECT user_id, count(*) AS actions, count(DISTINCT event_type) AS kinds, count(DISTINCT props->>'$.k') AS items, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000 AS seconds FROM events GROUP BY 1")
def action_log(spark: SparkSession, d: str) -> DataFrame:
    return explore.action_stats(table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")), "user_id", "event_type", "ts", "k")


@query("""SELECT conv_id, turn, CASE WHEN turn < 3 AND conv_id % 2 = 0 THEN 'grep' WHEN turn < 6 AND conv_id % 3 = 0 THEN 'view_file' WHEN turn < 9 THEN 'search_class' ELSE 'search_method' END AS action, turn >= 5 OR (turn >= 3 AND conv_id % 5 >= 3 AND turn >= 1 AND turn >= 2) AS stops FROM conversations""")
def explorer_steps(spark: SparkSession, d: str) -> DataFrame:
    i, c, yes = F.col("turn"), F.col("conv_id"), F.lit(True)
    can = {"grep": c % 2 == 0, "view_file": c % 3 == 0, "search_class": yes, "search_method": yes, "get_class_hierarchy": yes}
    return table(spark, d, "conversations").select("conv_id", "turn", explore.next_action(i, can).alias("action"), explore.stops(i, {"files": c % 5, "classes": i, "methods": i}, 3, 5).alias("stops"))


#: Items as problems that name a class, and two of three a function.
_PROBLEM = "'See BaseOf' || CAST(item_id AS STRING) || ' and PartOf' || CAST(item_id * 2 AS STRING) || CASE WHEN item_id % 3 > 0 THEN ', make_' || CAST(item_id AS STRING) ELSE '' END || ': ' || text"
_ROUNDS = 20
_SQL_TOOL = """CASE WHEN i < 3 AND len(ws) > 0 THEN 'grep' WHEN i < 6 AND len(files) > 0 THEN 'view_file' WHEN i < 9 AND len(up) > 0 THEN 'search_class' WHEN i < 12 AND len(low) > 0 THEN 'search_method' WHEN i < 15 AND len(cs) > 0 THEN 'get_class_hierarchy' ELSE 'find_file' END"""
_SQL_WORD = """CASE WHEN i < 3 AND len(ws) > 0 THEN ws[i % len(ws) + 1] WHEN i < 6 AND len(files) > 0 THEN files[i % len(files) + 1] WHEN i < 9 AND len(up) > 0 THEN up[i % len(up) + 1] WHEN i < 12 AND len(low) > 0 THEN low[i % len(low) + 1] WHEN i < 15 AND len(cs) > 0 THEN cs[i % len(cs) + 1] ELSE '.py' END"""


@query(f"""WITH RECURSIVE {_SYMBOLS}, pb AS (SELECT item_id, {_PROBLEM} AS text FROM benchmark), {_sql_keywords('stepwise').replace('FROM benchmark', 'FROM pb')},
ks AS (SELECT item_id AS instance, ws, list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]')) AS up, list_filter(ws, lambda w: contains(w, '_') OR regexp_matches(w, '^[a-z]')) AS low FROM kw),
wd AS (SELECT DISTINCT unnest(ws) AS word FROM ks), fl AS (SELECT path, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f),
gh AS (SELECT word, path, line FROM fl JOIN (SELECT DISTINCT ws[i] AS word FROM (SELECT ws, unnest([1, 2, 3]) AS i FROM ks) WHERE ws[i] IS NOT NULL) ON contains(lower(x), lower(word)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY path, line) <= 10),
ch AS (SELECT word, name, path, start_line FROM sy JOIN wd ON contains(lower(name), lower(word)) WHERE kind = 'class' AND regexp_matches(word, '^[A-Z]') QUALIFY row_number() OVER (PARTITION BY word ORDER BY path, start_line, name) <= 5),
mh AS (SELECT word, name, path, start_line FROM sy JOIN wd ON contains(lower(name), lower(word)) WHERE kind <> 'class' AND (contains(word, '_') OR regexp_matches(word, '^[a-z]')) QUALIFY row_number() OVER (PARTITION BY word ORDER BY path, start_line, name) <= 5),
aw AS (SELECT 'grep' AS tool, word, list(path ORDER BY path) AS found FROM (SELECT DISTINCT word, path FROM gh) GROUP BY 2
  UNION ALL SELECT 'search_class', word, list(name ORDER BY o) FROM (SELECT word, name, min((path, start_line)) AS o FROM ch GROUP BY 1, 2) GROUP BY 2 UNION ALL SELECT 'search_method', word, list(name ORDER BY o) FROM (SELECT word, name, min((path, start_line)) AS o FROM mh GROUP BY 1, 2) GROUP BY 2),
st AS (SELECT instance, ws, up, low, 0 AS i, []::VARCHAR[] AS files, []::VARCHAR[] AS seen, []::VARCHAR[] AS cs, []::VARCHAR[] AS ms, '' AS tool, '' AS word, []::VARCHAR[] AS found, false AS done FROM ks
  UNION ALL SELECT instance, ws, up, low, i, files, seen, cs, ms, tool, word, found, i >= {_ROUNDS} OR (i >= 3 AND len(seen) >= 3 AND len(cs) >= 1 AND len(ms) >= 2) AS done FROM (
    SELECT instance, ws, up, low, i + 1 AS i, CASE WHEN t = 'grep' THEN files || list_filter(found, lambda x: NOT list_contains(files, x)) ELSE files END AS files, CASE WHEN t = 'view_file' AND NOT list_contains(seen, w) THEN list_append(seen, w) ELSE seen END AS seen,
      CASE WHEN t = 'search_class' THEN cs || list_filter(found, lambda x: NOT list_contains(cs, x)) ELSE cs END AS cs, CASE WHEN t = 'search_method' THEN ms || list_filter(found, lambda x: NOT list_contains(ms, x)) ELSE ms END AS ms, t AS tool, w AS word, found
    FROM (SELECT p.*, coalesce(aw.found, []) AS found FROM (SELECT instance, ws, up, low, i, files, seen, cs, ms, {_SQL_TOOL} AS t, {_SQL_WORD} AS w FROM st WHERE NOT done) p LEFT JOIN aw ON aw.tool = p.t AND aw.word = p.w)))
SELECT instance, i AS iteration, tool, word AS parameter, array_to_string(found, ',') AS results, len(seen) AS viewed, len(cs) AS classes, len(ms) AS methods FROM st WHERE i > 0""")
def exploration_loop(spark: SparkSession, d: str) -> DataFrame:
    """All items explore the sources made of documents."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("instance"), explore.problem_keywords(F.expr(_PROBLEM), "stepwise").alias("keywords"))
    given = files(spark, d)
    return explorer.explore_all(items, explorer.answers(items, given, explore.symbols(given)), most=_ROUNDS)


@query("SELECT conv_id, turn, substr(md5(conv_id::VARCHAR), 1, 8) AS commit, 'A <a@b>' AS author, 'Mon' AS date, 'Fix ' || turn || chr(10) || chr(10) || 'More.' AS message FROM conversations")
def commit_log(spark: SparkSession, d: str) -> DataFrame:
    log = F.concat(F.lit("commit "), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 8), F.lit("\nAuthor: A <a@b>\nDate:   Mon\n\n    Fix "), F.col("turn").cast("string"), F.lit("\n\n    More.\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(explore.commit_rows(log)))


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    return progress.read_files(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of a file stream, at its end the batch's."""
    q = progress.update_table(progress.running_counts(_events_stream(spark, d)), "stream_counts_out")
    q.awaitTermination()
    return spark.table("stream_counts_out")


@query("""WITH b AS (SELECT time_bucket(INTERVAL 60 seconds, ts::TIMESTAMP) AS start, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY 1)
SELECT start, start + INTERVAL 60 seconds AS "end", requests, tokens FROM b WHERE start + INTERVAL 60 seconds <= (SELECT max(ts::TIMESTAMP) - INTERVAL 2 minutes FROM events)""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """A file stream's totals by minute, those that its watermark closed."""
    at = fresh(spark, "windows")
    out = progress.sliding_totals(_events_stream(spark, d), slide="60 seconds")
    progress.fold_table(out, f"{at}/checkpoint", f"{at}/rows").awaitTermination()
    rows = spark.read.schema("start timestamp, end timestamp, requests long, tokens double").parquet(f"{at}/rows")
    return adopt(rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "requests", "tokens"), at)


#: Requests of the limiter's query: a second of theirs is a thousand of the events; in BATCHES parts by time, of which a tenth comes a part later.
BATCH_MS, BATCHES, LATE_MS = 1_000_000, 3, 120_000


@query(f"""WITH RECURSIVE e AS (SELECT event_type AS client, event_id AS id, (epoch_us(ts) - 1704067200000000) // 1000000 AS arrival, floor(value * 60)::BIGINT AS tokens FROM events),
p AS (SELECT *, least(arrival // {BATCH_MS} + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END, {BATCHES - 1}) AS part FROM e), m AS (SELECT part, max(arrival) AS most FROM p GROUP BY 1),
w AS (SELECT part, greatest(0, coalesce(max(most) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {LATE_MS}) AS mark, max(most) OVER () - {LATE_MS} AS last FROM m),
q AS (SELECT client, id, p.arrival, greatest(p.arrival, mark) AS eff, tokens FROM p JOIN w USING (part) WHERE greatest(p.arrival, mark) < last),
o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY eff, id) AS n, sum(tokens) OVER (PARTITION BY client ORDER BY eff, id ROWS UNBOUNDED PRECEDING) AS c FROM q),
j AS (SELECT o.client, o.n, count(*) FILTER (b.n < o.n AND b.c - b.tokens < o.c - {limiter.TOKENS}) AS j FROM o JOIN o b ON o.client = b.client AND b.n < o.n OR (o.client = b.client AND o.n = 1 AND b.n = 1) GROUP BY 1, 2),
k AS (SELECT client, n, eff, j FROM o JOIN j USING (client, n)),
r AS (SELECT client, n, [eff] AS t FROM k WHERE n = 1 UNION ALL SELECT k.client, k.n, list_append(r.t, greatest(k.eff, r.t[-1], CASE WHEN k.n > {limiter.REQUESTS} THEN r.t[k.n - {limiter.REQUESTS}] + {limiter.SPAN_MS} ELSE 0 END, CASE WHEN k.j > 0 THEN r.t[k.j] + {limiter.SPAN_MS} ELSE 0 END)) FROM r JOIN k ON k.client = r.client AND k.n = r.n + 1),
f AS (SELECT client, t FROM r QUALIFY row_number() OVER (PARTITION BY client ORDER BY n DESC) = 1), u AS (SELECT client, unnest(t) AS admitted, generate_subscripts(t, 1) AS n FROM f)
SELECT client, id, arrival, tokens, admitted, admitted - arrival AS delay FROM u JOIN o USING (client, n)""")
def rate_limit_admission(spark: SparkSession, d: str) -> DataFrame:
    """Requests come in parts, the stream is started anew for each; a tenth comes behind its watermark."""
    at = fresh(spark, "limiter")
    us, e = F.unix_micros(F.col("ts").cast("timestamp")), table(spark, d, "events")
    asked = e.select(F.col("event_type").alias("client"), F.col("event_id").alias("id"), F.floor((us - 1704067200000000) / 1_000_000).cast("long").alias("arrival"), F.floor(F.col("value") * 60).cast("long").alias("tokens"))
    part = F.least(F.floor(F.col("arrival") / BATCH_MS) + F.when(F.col("id") % 10 == 3, 1).otherwise(0), F.lit(BATCHES - 1))
    for i in range(BATCHES):
        asked.where(part == i).write.parquet(f"{at}/asked/{i}")
        stream = spark.readStream.schema(asked.schema).parquet(f"{at}/asked/*")
        limiter.run_limited(limiter.limit(stream, f"{LATE_MS} milliseconds"), f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return adopt(spark.read.schema(limiter.OUT).parquet(f"{at}/rows"), at)


@query("SELECT event_id, event_type, value FROM events")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """A file stream, appended with checkpoints in small files; a second run adds nothing."""
    at = fresh(spark, "append")
    for _ in range(2):
        progress.checkpoint_every(_events_stream(spark, d), f"{at}/rows", f"{at}/checkpoint", 2000, "event_id").awaitTermination()
    return adopt(spark.read.parquet(f"{at}/rows").select("event_id", "event_type", "value"), at)
