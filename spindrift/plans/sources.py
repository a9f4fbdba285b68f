"""Python files made of documents: one rule, written once, that Spark and DuckDB both evaluate; and CTEs that read the files back by lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.plans.base import table

_PART = "k % 4 < 3"
#: (condition, line): k the document's number, j the one before, q its folder, a and b two of the document's words.
LINES = [
    ("", '"""{a} {b}."""'),
    ("", "import os"),
    ("k % 3 = 1", "from p{q}.m{j} import make_{j}"),
    ("k % 3 = 2", "from p{q}.m{j} import make_{j} as build, BaseOf{j}"),
    ("k % 5 = 2", "import p{q}.m{j} as before"),
    ("", ""),
    ("", ""),
    ("k % 2 = 0", "def shared(x):"),
    ("k % 2 = 0", '    return os.path.join(x, "{b}")'),
    ("k % 2 = 0", ""),
    ("k % 2 = 0", ""),
    ("k % 4 = 0", "@staticmethod"),
    ("", "def make_{k}(x):"),
    ("", "    y = shared(x)"),
    ("k % 3 = 1", "    y = make_{j}(y)"),
    ("k % 3 = 2", "    y = build(y)"),
    ("k % 5 = 2", "    before.make_{j}(y)"),
    ("k % 10 > 6", "    for {a}_i in y:"),
    ("k % 10 > 6", "        print({a}_i)"),
    ("", "    return len(y)"),
    ("", ""),
    ("", ""),
    ("", "class BaseOf{k}:"),
    ("", "    def run(self):"),
    ("", "        return self.stop()"),
    ("", ""),
    ("", "    def stop(self):"),
    ("", "        return make_{k}(self)"),
    (_PART, ""),
    (_PART, ""),
    (f"{_PART} AND k % 3 = 2", "class PartOf{k}(BaseOf{j}):"),
    (f"{_PART} AND k % 3 <> 2", "class PartOf{k}(BaseOf{k}):"),
    (f"{_PART} AND k % 6 = 0", "    @property"),
    (f"{_PART} AND k % 3 = 0", "    async def run(self):"),
    (f"{_PART} AND k % 3 <> 0", "    def run(self, {a}_a):"),
    (_PART, "        self.stop()"),
    (_PART, "        super().run()"),
    (_PART, "        return self.go_{a}(1)"),
    (_PART, ""),
    (_PART, "    def go_{a}(self, z):"),
    (f"{_PART} AND k % 7 = 3", "        def inner(z):"),
    (f"{_PART} AND k % 7 = 3", "            return shared(z)"),
    (f"{_PART} AND k % 7 = 3", ""),
    (f"{_PART} AND k % 7 = 3", "        return inner(z)"),
    (f"{_PART} AND k % 7 <> 3", "        return BaseOf{k}().run()"),
    (f"{_PART} AND k % 9 = 4", ""),
    (f"{_PART} AND k % 9 = 4", "    class Deep:"),
    (f"{_PART} AND k % 9 = 4", "        def run(self):"),
    (f"{_PART} AND k % 9 = 4", "            return z_{b}(1)"),
    ("k % 11 = 10", "def broken(:"),
]


def _line(text: str) -> str:
    for name in "kjqab":
        text = text.replace("{" + name + "}", f"' || CAST({name} AS STRING) || '")
    return f"'{text}' || chr(10)"


_FOLDER = "CAST(floor(({x}) / 10) AS BIGINT) % 5"
CONTENT = " || ".join(f"CASE WHEN {c} THEN {_line(t)} ELSE '' END" if c else _line(t) for c, t in LINES)
PATH = "'p' || CAST(g AS STRING) || '/m' || CAST(k AS STRING) || '.py'"


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content, k: a file for each document."""
    ws = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x).between(4, 12))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("k"), (F.col("doc_id") - 1).alias("j"), F.coalesce(F.get(ws, 0), F.lit("item")).alias("a"), F.coalesce(F.get(ws, 1), F.lit("node")).alias("b"))
    rows = rows.withColumns({"q": F.expr(_FOLDER.format(x="k - 1")), "g": F.expr(_FOLDER.format(x="k"))})
    return rows.select(F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"), "k")


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) BETWEEN 4 AND 12)"
#: f(k, path, content, broken)
FILES = f"""fw AS (SELECT doc_id AS k, doc_id - 1 AS j, coalesce({_WORDS}[1], 'item') AS a, coalesce({_WORDS}[2], 'node') AS b, {_FOLDER.format(x='doc_id - 1')} AS q, {_FOLDER.format(x='doc_id')} AS g FROM documents),
fx AS (SELECT k, {PATH} AS path, {CONTENT} AS content FROM fw), f AS (SELECT *, contains(content, 'def broken(:') AS broken FROM fx)"""

#: ln: lines of files that parse; df: definitions with the line after their end's last, the innermost one around (up) and their qualified name.
LINE_CTES = rf"""{FILES}, ln0 AS (SELECT path, k, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f WHERE NOT broken),
ln AS (SELECT *, (length(x) - length(ltrim(x))) // 4 AS indent FROM ln0 WHERE x <> ''),
d0 AS (SELECT path, line, indent, regexp_extract(x, '(?:class|def) (\w+)', 1) AS name, CASE WHEN regexp_matches(x, '^ *class ') THEN 'class' ELSE 'def' END AS sort, regexp_extract(x, '\(([^)]*)\)', 1) AS inside FROM ln WHERE regexp_matches(x, '^ *(async def|def|class) ')),
d1 AS (SELECT d.path, d.line, min(n.line) AS nxt FROM d0 d LEFT JOIN ln n ON n.path = d.path AND n.line > d.line AND n.indent <= d.indent GROUP BY 1, 2),
d2 AS (SELECT d0.*, (SELECT max(n.line) FROM ln n WHERE n.path = d0.path AND (d1.nxt IS NULL OR n.line < d1.nxt)) AS stop FROM d0 JOIN d1 USING (path, line)),
d3 AS (SELECT d.path, d.line, arg_max(u.name, u.line) AS up, arg_max(u.sort, u.line) AS up_sort, max(u.line) AS up_line FROM d2 d JOIN d2 u ON u.path = d.path AND u.line < d.line AND u.stop >= d.line AND u.indent < d.indent GROUP BY 1, 2),
df AS (SELECT d2.*, up, up_sort, up_line, CASE WHEN sort = 'class' THEN 'class' WHEN up_sort = 'class' THEN 'method' ELSE 'function' END AS kind FROM d2 LEFT JOIN d3 USING (path, line))"""

#: sy: what the symbol table has, read from the lines.
SYMBOLS = rf"""{LINE_CTES}, cl AS (SELECT path, line, unnest(regexp_extract_all(x, '([A-Za-z_]\w*)\(', 1)) AS called FROM ln WHERE NOT regexp_matches(x, '^ *(async def|def|class) ')),
sy AS (SELECT d.path, kind, d.name, up AS owner, d.line AS start_line, stop AS end_line, CASE WHEN kind = 'class' THEN inside ELSE '' END AS bases, CASE WHEN kind = 'class' THEN '' ELSE replace(inside, ', ', ',') END AS args,
  CASE WHEN kind = 'class' THEN '' ELSE coalesce((SELECT string_agg(DISTINCT called, ',' ORDER BY called) FROM cl WHERE cl.path = d.path AND cl.line > d.line AND cl.line <= d.stop), '') END AS calls FROM df d WHERE coalesce(up_sort, 'class') = 'class')"""

_QUAL = "CASE WHEN u2.up IS NOT NULL THEN u2.up || '.' || d.up || '.' || d.name WHEN d.up IS NOT NULL THEN d.up || '.' || d.name ELSE d.name END"
#: rs: calls resolved.  Definitions are at most three deep, bases one step up.
RESOLVED = rf"""{LINE_CTES}, dq AS (SELECT d.*, {_QUAL} AS qual, CASE WHEN u2.up IS NOT NULL THEN u2.up || '.' || d.up WHEN d.up IS NOT NULL THEN d.up ELSE '' END AS scope FROM df d LEFT JOIN df u2 ON u2.path = d.path AND u2.line = d.up_line),
im AS (SELECT path, regexp_extract(x, '^from (\S+) import', 1) AS module, unnest(string_split(regexp_extract(x, '^from \S+ import (.*)$', 1), ', ')) AS item FROM ln WHERE regexp_matches(x, '^from ')),
nm AS (SELECT path, module, regexp_extract(item, '^(\w+)', 1) AS there, CASE WHEN contains(item, ' as ') THEN regexp_extract(item, ' as (\w+)', 1) ELSE item END AS word FROM im),
mo AS (SELECT path, regexp_extract(x, '^import (\S+)', 1) AS module, CASE WHEN contains(x, ' as ') THEN regexp_extract(x, ' as (\w+)', 1) ELSE regexp_extract(x, '^import (\S+)', 1) END AS receiver FROM ln WHERE regexp_matches(x, '^import ')),
tk AS (SELECT path, line, unnest(list_filter(regexp_extract_all(x, '[A-Za-z_0-9.]+\('), lambda t: NOT starts_with(t, '.') AND t <> 'super(') || regexp_extract_all(regexp_replace(x, '([A-Za-z_0-9]+)\(\)\.', '\1@.', 'g'), '[A-Za-z_0-9]+@\.[A-Za-z_0-9]+\(')) AS t FROM ln WHERE NOT regexp_matches(x, '^ *(async def|def|class) ')),
ca0 AS (SELECT DISTINCT path, line, replace(nullif(regexp_extract(t, '^(.*)\.[^.]+\($', 1), ''), '@', '()') AS receiver, regexp_extract(t, '([A-Za-z_0-9]+)\($', 1) AS name FROM tk),
ca AS (SELECT c.path, c.line, receiver, c.name, coalesce(arg_max(d.qual, d.line), '') AS scope, arg_max(d.qual, d.line) FILTER (d.sort = 'class') AS owner FROM ca0 c LEFT JOIN dq d ON d.path = c.path AND d.line < c.line AND d.stop >= c.line GROUP BY 1, 2, 3, 4),
tp AS (SELECT replace(regexp_replace(path, '\.py$', ''), '/', '.') AS module, name, path || ':' || qual AS node, kind FROM dq WHERE scope = ''),
wd AS (SELECT DISTINCT path, scope, word FROM (SELECT path, scope, name AS word FROM ca WHERE receiver IS NULL UNION ALL SELECT path, scope, replace(receiver, '()', '') FROM ca WHERE receiver IS NOT NULL UNION ALL SELECT path, scope, inside FROM dq WHERE kind = 'class' AND inside <> '')),
lo AS (SELECT w.path, w.scope, w.word, arg_max(d.path || ':' || d.qual, length(d.scope)) AS node, arg_max(d.kind, length(d.scope)) AS kind FROM wd w JOIN dq d ON d.path = w.path AND d.name = w.word AND coalesce(d.up_sort, 'def') <> 'class' AND (d.scope = '' OR d.scope = w.scope OR starts_with(w.scope, d.scope || '.')) GROUP BY 1, 2, 3),
lk AS (SELECT *, 'local' AS how FROM lo UNION ALL SELECT w.path, w.scope, w.word, tp.node, tp.kind, 'imported' FROM wd w JOIN nm USING (path, word) JOIN tp ON tp.module = nm.module AND tp.name = nm.there WHERE (w.path, w.scope, w.word) NOT IN (SELECT (path, scope, word) FROM lo)),
an AS (SELECT path || ':' || qual AS node, path || ':' || qual AS anc, 0 AS depth FROM dq WHERE kind = 'class' UNION ALL SELECT d.path || ':' || d.qual, lk.node, 1 FROM dq d JOIN lk ON lk.path = d.path AND lk.scope = d.scope AND lk.word = d.inside AND lk.kind = 'class' WHERE d.kind = 'class'),
me AS (SELECT path || ':' || scope AS anc, name, path || ':' || qual AS node FROM dq WHERE kind = 'method'),
ms AS (SELECT an.node, an.depth, me.name, me.node AS target FROM an JOIN me USING (anc)),
hit AS (SELECT c.*, lk.node AS callee, how FROM ca c JOIN lk ON lk.path = c.path AND lk.scope = c.scope AND lk.word = c.name WHERE receiver IS NULL
  UNION ALL SELECT c.*, arg_min(target, depth), 'self' FROM ca c JOIN ms ON ms.node = c.path || ':' || owner AND ms.name = c.name WHERE receiver = 'self' GROUP BY ALL
  UNION ALL SELECT c.*, arg_min(target, depth), 'super' FROM ca c JOIN ms ON ms.node = c.path || ':' || owner AND ms.name = c.name AND depth >= 1 WHERE receiver = 'super()' GROUP BY ALL
  UNION ALL SELECT c.*, tp.node, 'module' FROM ca c JOIN mo USING (path, receiver) JOIN tp ON tp.module = mo.module AND tp.name = c.name
  UNION ALL SELECT c.*, arg_min(target, depth), 'class' FROM ca c JOIN lk ON lk.path = c.path AND lk.scope = c.scope AND lk.word = replace(c.receiver, '()', '') AND lk.kind = 'class' JOIN ms ON ms.node = lk.node AND ms.name = c.name GROUP BY ALL),
rs AS (SELECT c.path, c.path || ':' || c.scope AS caller, c.line, c.receiver, c.name, callee, coalesce(how, 'unknown') AS how FROM ca c LEFT JOIN hit h ON h.path = c.path AND h.line = c.line AND h.name = c.name AND h.receiver IS NOT DISTINCT FROM c.receiver)"""
