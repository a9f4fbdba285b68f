"""Search queries from problem statements, with built-in regular expressions and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.functions.text import strip

#: Words that are no keywords.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just and but if or because until while this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom whose am""".split()
#: Words that name an action.
ACTIONS = """fix handle process parse convert transform validate check verify get set create build generate compute calculate update delete remove add insert find search load save read write send receive encode decode serialize deserialize format""".split()
#: What a report asks for, and what it is called.
ASKS = [("(?i)(?:should|needs? to|must)\\s+(\\w+)", "requirement"), ("(?i)(?:fix|correct|repair)\\s+(\\w+)", "fix"), ("(?i)(?:add|implement|create)\\s+(\\w+)", "add"), ("(?i)(?:remove|delete|eliminate)\\s+(\\w+)", "remove"), ("(?i)(?:update|change|modify)\\s+(\\w+)", "update"), ("(?i)(?:handle|catch|process)\\s+(\\w+)", "handle")]


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _in(word: Column, words: list[str]) -> Column:
    return F.lower(word).isin(words)


def distinct_by_lower(words: Column) -> Column:
    """The first of words that differ in case only, in order."""
    low = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def keywords(text: Column) -> Column:
    words = F.filter(_all(text, r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), lambda w: (F.length(w) > 2) & ~_in(w, STOP_WORDS))
    return distinct_by_lower(words)


#: What an identifier, a name in mixed case and a dotted name are.
_SNAKE, _CAMEL, _DOTTED = r"\b[a-z][a-z0-9_]*[a-z0-9]\b", r"\b[a-zA-Z][a-zA-Z0-9]*[a-z][A-Z][a-zA-Z0-9]*\b", r"\b[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+\b"


def symbols(text: Column) -> Column:
    snake = F.filter(_all(text, _SNAKE), lambda s: F.contains(s, F.lit("_")) | (F.length(s) > 5))
    camel = _all(text, _CAMEL)
    dotted = _all(text, _DOTTED)
    return F.array_distinct(F.concat(snake, camel, dotted))


def _query(query: Column, kind: str, weight: float, source: str, when: Column) -> Column:
    return F.when(when, F.struct(query.alias("query_text"), F.lit(kind).alias("query_type"), F.lit(weight).alias("weight"), F.lit(source).alias("source")))


def keyword_queries(text: Column, boost: float = 1.5) -> list[Column]:
    kw = keywords(text)
    acts = F.filter(kw, lambda w: _in(w, ACTIONS))
    others = F.filter(F.slice(kw, 1, 5), lambda w: ~_in(w, ACTIONS))
    action = F.concat(F.get(acts, F.lit(0)), F.lit(" "), F.array_join(F.slice(others, 1, 2), " "))
    return [_query(F.array_join(F.slice(kw, 1, 8), " "), "keywords", boost, "keyword_extraction", F.size(kw) > 0), _query(action, "action_keywords", round(boost * 1.2, 6), "keyword_extraction", (F.size(acts) > 0) & (F.size(kw) > 1) & (F.size(others) > 0))]


def symbol_queries(text: Column) -> list[Column]:
    found = symbols(text)
    code = F.filter(found, lambda s: F.contains(s, F.lit("_")) | s.rlike("^.+[A-Z]"))
    return [_query(F.array_join(F.slice(found, 1, 5), " "), "code_symbols", 1.3, "symbol_extraction", F.size(found) > 0), _query(F.concat(F.lit("def "), F.get(code, F.lit(0))), "function_search", 1.4, "symbol_extraction", F.size(code) > 0)]


#: An error's name, a quoted message, a line of a traceback; labels and weights of the queries made of them.
_ERROR, _SAID, _TRACE = r"\b([A-Z][a-zA-Z]*Error|Exception|Warning|AssertionError)\b", "(?i)[\"']([^\"']*(?:error|exception|failed)[^\"']*)[\"']", r'File "([^"]+)", line (\d+)'


def error_queries(text: Column) -> list[Column]:
    kind = F.regexp_extract(text, _ERROR, 1)
    said = F.regexp_extract(text, _SAID, 1)
    words = F.slice(F.filter(F.split(said, r"\s+"), lambda w: w != ""), 1, 5)
    path = F.regexp_extract(text, _TRACE, 1)
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".py"), F.lit(""))
    src = "error_extraction"
    return [_query(F.concat(kind, F.lit(" handle catch")), "error_handling", 1.4, src, kind != ""), _query(F.concat(F.lit("raise "), kind), "error_source", 1.3, src, kind != ""), _query(F.array_join(words, " "), "error_message", 1.2, src, said != ""), _query(F.concat(name, F.lit(" error")), "file_error", 1.3, src, path != "")]


def language_queries(text: Column) -> list[Column]:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), "`([^`]+)`", "$1"), r"\[([^\]]+)\]\([^\)]+\)", "$1")
    first = strip(F.get(F.split(plain, "[.!?]+"), F.lit(0)))
    how = F.regexp_extract(text, r"(?i)(?:how|what|when|where)\s+(?:to|do|is|are|does|can|should)\s+(.+)", 1)
    return [_query(F.substring(first, 1, 200), "natural_language", 1.0, "reformulation", F.length(first) > 20), _query(F.concat(F.lit("how to "), F.substring(how, 1, 100)), "how_to", 1.1, "reformulation", how != "")]


def ask_queries(text: Column) -> list[Column]:
    """The first kind of ask that is found, with up to three of its objects."""
    named = [F.when(F.size(_all(text, p, 1)) > 0, F.concat(F.lit(f"{n} "), F.array_join(F.slice(_all(text, p, 1), 1, 3), " "))) for p, n in ASKS]
    q = F.coalesce(*named)
    return [_query(q, "action_focus", 1.2, "action_extraction", q.isNotNull())]


def simple_query(text: Column, most: int = 500) -> Column:
    """The statement itself, its first characters."""
    return F.substring(strip(text), 1, most)


def keyword_query(text: Column, most: int = 10) -> Column:
    """The first keywords, between spaces."""
    return F.array_join(F.slice(keywords(text), 1, most), " ")


#: Words that a search leaves out, and words that name an action in one.
SEARCH_STOPS = """the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into through during before after above below between under again further then once""".split()
SEARCH_ACTIONS = """fix handle process parse convert transform validate check verify get set create build generate compute calculate update delete remove add insert find search""".split()


def variants(queries: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """id, variant, text: the query, it without stop words if that leaves fewer, its identifiers if two or more, and its actions with the
    first three identifiers; the first `most` of these."""
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    content = F.filter(words, lambda w: ~_in(w, SEARCH_STOPS))
    terms = _all(F.col(text_col), "[a-zA-Z_][a-zA-Z0-9_]*")
    acts = F.filter(words, lambda w: _in(w, SEARCH_ACTIONS))
    found = [F.col(text_col), F.when((F.size(content) > 0) & (F.size(content) < F.size(words)), F.array_join(content, " ")), F.when(F.size(terms) >= 2, F.array_join(terms, " ")), F.when(F.size(acts) > 0, F.array_join(F.concat(acts, F.slice(terms, 1, 3)), " "))]
    return queries.select(F.col(id_col), F.posexplode(F.slice(F.array_compact(F.array(*found)), 1, most)).alias("variant", "text"))


STRATEGIES = {"keywords": keyword_queries, "code_symbols": symbol_queries, "error_patterns": error_queries, "natural_language": language_queries, "action_focus": ask_queries}


def generate(problems: DataFrame, id_col: str = "item_id", text_col: str = "text", strategies: tuple[str, ...] = ("keywords", "code_symbols", "error_patterns", "natural_language"), most: int = 5, original: bool = True) -> DataFrame:
    """id, ordinal, query_text, query_type, weight, source: distinct queries by lower case, the heaviest of equals, heaviest first."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [_query(text, "original", 1.0, "original", F.lit(True))] * original + [q for s in strategies for q in STRATEGIES[s](text)]
    rows = problems.select(F.col(id_col), F.posexplode(F.array(*parts)).alias("pos", "q")).where("q is not null").select(id_col, "pos", "q.*")
    key = F.lower(strip(F.col("query_text")))
    same = Window.partitionBy(id_col, key)
    best = rows.withColumn("n", F.row_number().over(same.orderBy(F.desc("weight"), "pos"))).withColumn("first", F.min("pos").over(same)).where("n = 1")
    w = Window.partitionBy(id_col).orderBy(F.desc("weight"), "first")
    return best.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= most).drop("n", "first", "pos")
