"""Text expressions: tokenizers, token estimates, diff parsing.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token of code is; identifiers and operator runs of one character are none.
CODE_TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]+|[0-9]+|[{}()\[\];,.=+\-*/<>!&|]{2,}"
CHARS_PER_TOKEN = 4


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def code_tokens(c: Column, lowercase: bool = True, split_camel: bool = True) -> Column:
    """Identifiers, numbers and operator runs; camelCase is split; one-character tokens go unless digits.

    The whole text is split at capitals, which are inside identifiers only: its parts are again identifiers, or one letter.
    """
    text = F.coalesce(c, F.lit(""))
    if split_camel:
        text = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)", " $1"), "([A-Z][a-z]+)", " $1")
    found = F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))
    return F.transform(found, F.lower) if lowercase else found


def whitespace_tokens(c: Column, lowercase: bool = True) -> Column:
    c = F.lower(c) if lowercase else c
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    """A token for each four characters."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def truncate(c: Column, tokens: int | Column, side: str = "right") -> Column:
    """The first tokens' characters (side='right' cuts the end), or the last ones."""
    n = (F.lit(tokens) if isinstance(tokens, int) else tokens) * CHARS_PER_TOKEN
    return F.substring(c, F.lit(1), n) if side == "right" else F.when(F.length(c) <= n, c).otherwise(F.substring(c, F.length(c) - n + 1, n))


def windows(c: Column, width: int, overlap: int) -> Column:
    """array of (start, piece): windows of width characters that overlap; the last one ends at the text's end."""
    n, step = F.length(c), width - overlap
    last = F.greatest(F.ceil((n - width) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.substring(c, i * step + 1, F.lit(width)).alias("piece")))).otherwise(F.expr("array()").cast("array<struct<start:int,piece:string>>"))


def line_number(c: Column, position: Column) -> Column:
    """1-based line of a 0-based character position."""
    head = F.substring(c, F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


# Unified diffs


def diff_code(patch: Column) -> Column:
    """Added and context lines, without their prefix."""
    keep = F.filter(lines(patch), lambda x: (x.startswith("+") & ~x.startswith("+++")) | x.startswith(" "))
    return F.array_join(F.transform(keep, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


def diff_files(patch: Column) -> Column:
    """Files of +++ and --- headers, distinct, in order; /dev/null is none."""
    heads = F.filter(lines(patch), lambda x: x.startswith("--- ") | x.startswith("+++ ") | x.startswith("diff --git "))
    names = F.transform(heads, lambda x: F.when(x.startswith("diff --git "), F.regexp_extract(x, r" b/(\S+)", 1)).otherwise(F.regexp_extract(x, r"^(?:---|\+\+\+) (?:[ab]/)?(\S+)", 1)))
    return F.array_distinct(F.filter(names, lambda x: (x != "") & (x != "/dev/null")))


def diff_names(patch: Column) -> Column:
    """Names of functions and classes on changed lines, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^[+-]\s*(?:async\s+)?(?:def|class)\s+(\w+)"), F.lit(1)))


def diff_lines(patch: Column, compat: bool = False) -> Column:
    """Touched line numbers of the new file.  compat: removed lines advance the counter too."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        head = F.regexp_extract(x, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
        added = x.startswith("+") & ~x.startswith("+++")
        removed = x.startswith("-") & ~x.startswith("---")
        moves = F.when(added | x.startswith(" "), 1).when(removed, int(compat)).otherwise(0)
        return F.when(head != "", F.struct(head.cast("int").alias("at"), s["out"].alias("out"))).when(s["at"] == 0, s).otherwise(F.struct((s["at"] + moves).alias("at"), F.when(added, F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out")))

    return F.aggregate(lines(patch), start, step, lambda s: F.array_distinct(s["out"]))


def codebleu_tokens(code: Column) -> Column:
    """Words and punctuation marks, without comments, strings blanked, those in triple quotes first."""
    c = F.regexp_replace(code, r"#[^\n]*", "")
    c = F.regexp_replace(F.regexp_replace(c, r'(?s)""".*?"""', '""""""'), r"(?s)'''.*?'''", "''''''")
    c = F.regexp_replace(F.regexp_replace(c, r"\"[^\"]*\"", "\"\""), r"'[^']*'", "''")
    return F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), F.lit(0))


#: Encodings of models' tokenizers, by name or by how the name begins, in this order.
ENCODINGS = [("gpt-5", "cl100k_base"), ("gpt-5-mini", "cl100k_base"), ("gpt-5-pro", "cl100k_base"), ("gpt-4o", "o200k_base"), ("gpt-4o-mini", "o200k_base"), ("claude-4.5-sonnet", "cl100k_base"), ("claude-4.5", "cl100k_base")]


def encoding_of(model: Column) -> Column:
    """The encoding of a model's name: of the equal name, else of the first one that it begins with, else the commonest."""
    exact = F.element_at(F.create_map(*(F.lit(x) for pair in ENCODINGS for x in pair)), model)
    begun = F.coalesce(*(F.when(model.startswith(n), F.lit(e)) for n, e in ENCODINGS))
    return F.coalesce(exact, begun, F.lit("cl100k_base"))


def import_names(source: Column) -> Column:
    """Import statements by regular expression, for files that don't parse."""
    return F.transform(F.regexp_extract_all(source, F.lit(r"(?m)^\s*((?:import|from)\s+[^\n]+)"), F.lit(1)), strip)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, lower-cased; none: empty."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=[^.])(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def relative(path: Column, root: str) -> Column:
    """path below root, or the path itself."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


#: Where a reply holds its patch.
PATCH_BLOCKS = [r"(?s)```diff\n(.*?)```", r"(?s)```\ndiff(.*?)(?:```|$)"]


def patch_of(reply: Column) -> Column:
    """The first patch in a reply: a fenced block with old and new file headers, else the lines from the first header on; null: none."""
    whole = lambda x: F.when(x.startswith("diff"), x).otherwise(F.concat(F.lit("diff "), x))
    ok = lambda x: F.contains(x, F.lit("---")) & F.contains(x, F.lit("+++"))
    fenced = [F.get(F.filter(F.transform(F.regexp_extract_all(reply, F.lit(p), F.lit(1)), lambda x: whole(strip(x))), ok), F.lit(0)) for p in PATCH_BLOCKS]
    bare = F.nullif(F.regexp_extract(reply, r"(?ms)(^(?:diff --git|---).*)", 1), F.lit(""))
    return F.coalesce(*fenced, F.when(ok(reply), bare))


def confidence_of(reply: Column) -> Column:
    """The confidence that a reply states, 0 if it states none."""
    return F.coalesce(F.nullif(F.regexp_extract(reply, r"(?i)confidence(?: score)?[:\s]+(0?\.\d+|1\.0|0|1)", 1), F.lit("")).cast("double"), F.lit(0.0))


def test_list(c: Column) -> Column:
    """A test list from JSON array text, or from lines; null: empty."""
    from_lines = F.filter(F.transform(lines(c), strip), lambda x: x != "")
    return F.coalesce(F.when(strip(c).startswith("["), F.from_json(c, "array<string>")), from_lines, F.expr("array()").cast("array<string>"))
