"""An explorer that thinks and acts by rule, for all instances at once: each round is a join of their state with what the tools find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrift.operators import explore
from spindrift.tables import cut, reading, release

#: Hits of a text search and of a symbol search.
MOST_HITS, MOST_SYMBOLS = 10, 5


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _in_order(rows: DataFrame, tool: str, most: int, order: list[str]) -> DataFrame:
    """rows(word, item, ...) -> tool, word, found: the first `most` rows' items, each once, in order."""
    w = Window.partitionBy("word").orderBy(*order)
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    once = first.groupBy("word", "item").agg(F.min("n").alias("n"))
    return once.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("found")).select(F.lit(tool).alias("tool"), "word", "found")


def answers(instances: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """tool, word, found: what each search that an instance can ask for finds; words are those of the first rounds' searches, each looked up once.

    grep: files of the first MOST_HITS lines by path, search_class and search_method: names of the first MOST_SYMBOLS by path and line.
    """
    rounds = [i for i in range(explore.BANDS[0][1])]
    n = F.size("keywords")
    asked = instances.where(n > 0).select(F.explode(F.array_distinct(F.array(*(F.get("keywords", F.pmod(F.lit(i), n)) for i in rounds)))).alias("word"))
    grep = asked.select("word").distinct().select(F.col("word").alias("query"), "word")
    hits = explore.line_hits(files, grep, "path", "content").select(F.col("query").alias("word"), F.col("doc").alias("item"), "lines")
    w = Window.partitionBy("word").orderBy("item")
    # A file has a line at least, so no more than MOST_HITS files are among the first lines.
    near = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_HITS)
    near = near.withColumn("before", F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("before", F.lit(0)) < MOST_HITS)
    found = [_in_order(near, "grep", MOST_HITS, ["item"])]
    words = instances.select(F.explode("keywords").alias("word")).distinct().select(F.col("word").alias("query"), "word")
    for tool, which, kept in (("search_class", F.col("word").rlike("^[A-Z]"), symbols.where("kind = 'class'")), ("search_method", method_word(F.col("word")), symbols.where("kind <> 'class'"))):
        named = explore._name_hits(kept, words.where(which)).select("word", F.col("name").alias("item"), "path", "start_line")
        found.append(_in_order(named, tool, MOST_SYMBOLS, ["path", "start_line", "item"]))
    out = cut(found[0].unionByName(found[1]).unionByName(found[2]))
    release(hits)
    return out


def method_word(word: Column) -> Column:
    return F.contains(word, F.lit("_")) | word.rlike("^[a-z]")


def _pick(items: Column, i: Column) -> Column:
    return F.get(items, F.pmod(i, F.size(items)))


def _more(have: Column, new: Column) -> Column:
    return F.concat(have, F.array_except(new, have))


def explore_all(instances: DataFrame, found: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """instances(instance, keywords), answers() -> instance, iteration (from 1), tool, parameter, results, viewed, classes, methods (counts after it).

    Every instance does the action that its state allows by the bands of iterations, the tools' findings are joined, the state is a table
    for the next round; an instance ends at `most` rounds, or past `least` with enough files viewed and symbols found.  So there are as
    many rounds as the longest instance has, whatever their number, and no state is collected.  Instances without keywords only list files.
    """
    words = F.coalesce("keywords", _none())
    state = instances.select("instance", words.alias("keywords"), F.lit(0).alias("iteration"), *(_none().alias(c) for c in ("files", "seen", "found_classes", "found_methods")))
    rounds: list[DataFrame] = []
    i = F.col("iteration")
    upper = F.filter("keywords", lambda k: k.rlike("^[A-Z]"))
    lower = F.filter("keywords", method_word)
    can = {"grep": F.size("keywords") > 0, "view_file": F.size("files") > 0, "search_class": F.size(upper) > 0, "search_method": F.size(lower) > 0, "get_class_hierarchy": F.size("found_classes") > 0}
    takes = {"grep": F.col("keywords"), "view_file": F.col("files"), "search_class": upper, "search_method": lower, "get_class_hierarchy": F.col("found_classes")}
    while True:
        acting = state.withColumn("tool", explore.next_action(i, can))
        word = F.coalesce(*(F.when(F.col("tool") == t, _pick(c, i)) for t, c in takes.items()), F.lit(".py"))
        got = acting.withColumn("word", word).join(found, ["tool", "word"], "left").withColumn("found", F.coalesce("found", _none()))
        add = lambda have, tool, new: F.when(F.col("tool") == tool, _more(F.col(have), new)).otherwise(F.col(have))
        after = got.withColumns({"files": add("files", "grep", F.col("found")), "seen": add("seen", "view_file", F.array("word")), "found_classes": add("found_classes", "search_class", F.col("found")), "found_methods": add("found_methods", "search_method", F.col("found")), "iteration": i + 1})
        enough = {"files": F.size("seen"), "classes": F.size("found_classes"), "methods": F.size("found_methods")}
        now = cut(after.withColumn("done", explore.stops(F.col("iteration"), enough, least, most)))
        rounds.append(now)
        state = now.where(~F.col("done")).select("instance", "keywords", "iteration", "files", "seen", "found_classes", "found_methods")
        if state.isEmpty():
            break
    log = rounds[0]
    for r in rounds[1:]:
        log = log.unionByName(r)
    out = log.select("instance", "iteration", "tool", F.col("word").alias("parameter"), F.array_join("found", ",").alias("results"), F.size("seen").alias("viewed"), F.size("found_classes").alias("classes"), F.size("found_methods").alias("methods"))
    return reading(out, found, *rounds)
