"""Record and file sources and sinks."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Folders and files that a code scan leaves out.
EXCLUDED = ["**/test*", "**/tests/**", "**/__pycache__/**", "**/*.pyc", "**/node_modules/**", "**/.git/**", "**/build/**", "**/dist/**", "**/.venv/**", "**/venv/**"]
MAX_FILE_BYTES = 1 << 20


def read_jsonl(spark: SparkSession, path: str, schema: StructType, keep_bad: bool = False) -> DataFrame:
    """One record a line; blank lines are skipped, bad ones dropped or kept in _corrupt_record."""
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())])).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good records, and the lines (text) that are none: for a count, a warning or a table of their own."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", StructType([*schema.fields, StructField("_corrupt_record", StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record is null").select(*(F.col(f"r.`{f.name}`") for f in schema.fields)), rows.where("r._corrupt_record is not null").select(F.col("value").alias("line"))


def read_dataset(spark: SparkSession, name: str, root: str, aliases: dict[str, str] | None = None, split: str | None = None) -> DataFrame:
    """A Parquet data set below root by its name or alias, one split of it if named (folder or file name)."""
    base = f"{root.rstrip('/')}/{(aliases or {}).get(name, name)}"
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{base}/{split}" if split else base)


def read_json(spark: SparkSession, path: str, schema: StructType, id_col: str = "instance_id") -> DataFrame:
    """A list of records, or a map of id to record whose key fills a missing id."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    one = schema.simpleString()
    listed = whole.where(F.col("v").startswith("[")).select(F.inline(F.from_json("v", f"array<{one}>")))
    mapped = whole.where(F.col("v").startswith("{")).select(F.explode(F.from_json("v", f"map<string,{one}>")).alias("k", "r")).select("k", "r.*")
    mapped = mapped.withColumn(id_col, F.coalesce(id_col, "k")).drop("k")
    return listed.unionByName(mapped.select(*listed.columns))


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json(spark, path, schema)
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format: {path}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, model_patch, model_name_or_path; the last of repeated ids in a file counts."""
    schema = StructType.fromDDL("instance_id string, model_patch string, model_name_or_path string")
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("n"))
    else:
        found = read_json(spark, path, schema)  # one file, one task: its order is the rows' order
        rows = found.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("n"))
    w = Window.partitionBy("r.instance_id").orderBy(F.desc("n"))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("r.*")


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def prediction_of(predictions: DataFrame, instance: str) -> DataFrame:
    return predictions.where(F.col("instance_id") == instance)


def write_results_json(df: DataFrame, path: str, by: str = "method") -> None:
    """Results as JSON lines, a folder for each method; nested columns stay nested."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_results(df: DataFrame, path: str, by: str = "method") -> None:
    """Results by method, so that a method's are read alone."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def glob_regex(globs: list[str]) -> str:
    """One regular expression for globs on relative paths with /."""

    def one(g: str) -> str:
        out = re.escape(g).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        return f"(?:{out})"

    return "^(?:" + "|".join(map(one, globs)) + ")$"


def excluded(path: Column, globs: list[str] | None = None) -> Column:
    return path.rlike(glob_regex(globs or EXCLUDED))


def read_repository(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".py",), most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), length, content of the text files below root; UTF-8, or Latin-1 where that fails.  Spark reads no row of an empty file."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    files = files.withColumn("rel", rel).where((F.col("length") <= most_bytes) & F.col("rel").rlike("(?:" + "|".join(map(re.escape, extensions)) + ")$") & ~excluded(F.col("rel")))
    binary = F.contains(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), F.lit("\0"))  # a character for each byte
    # Bytes 80 to 9F are control characters in Latin-1 but letters and quotes in Windows-1252, which lacks five of them.
    latin = F.decode("content", "ISO-8859-1")
    controls = [chr(i) for i in range(0x80, 0xA0)]
    known = {c: x for c in controls if (x := c.encode("latin-1").decode("cp1252", "ignore"))}
    other = F.when(latin.rlike("[" + "".join(c for c in controls if c not in known) + "]"), latin).otherwise(F.translate(latin, "".join(known), "".join(known.values())))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(other)
    return files.where(~binary).select(F.col("rel").alias("path"), "length", text.alias("content"))


def find(files: DataFrame, glob: str | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """files(path, content) by glob and extension, with their number of lines."""
    out = files.where(F.col("path").rlike(glob_regex([glob]))) if glob else files
    out = out.where(F.col("path").rlike("(?:" + "|".join(map(re.escape, extensions)) + ")$")) if extensions else out
    return out.withColumn("lines", F.when(F.length("content") == 0, 0).otherwise(F.size(F.split("content", "\n", -1))))


def listing(files: DataFrame) -> DataFrame:
    """kind, path, size: every file with its length in bytes and every folder above one with the sum of its files', each once.
    files(path, content), or (path, length)."""
    size = F.col("length").cast("long") if "length" in files.columns else F.octet_length("content").cast("long")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("path"), size.alias("size")).groupBy("path").agg(F.sum("size").alias("size"))
    return files.select(F.lit("file").alias("kind"), "path", size.alias("size")).unionByName(folders.select(F.lit("folder").alias("kind"), "path", "size"))


def structure(files: DataFrame) -> DataFrame:
    """Distinct folders with their files' number."""
    return files.groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"))


def read_experiments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All results.json below root, one row for each method, named by the parent folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "results.json").text(root, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(name.alias("experiment"), F.explode(F.from_json("value", f"map<string,{schema}>")).alias("method", "record"))


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def substitute(value, env: dict[str, str] | None = None):
    """${NAME} and ${NAME:-default} in strings, lists and dicts."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return {k: substitute(v, env) for k, v in value.items()} if isinstance(value, dict) else value


def load_config(path: str, env: dict[str, str] | None = None) -> dict:
    with open(path) as f:
        raw = f.read()
    try:
        data = json.loads(raw)
    except ValueError:
        import yaml

        data = yaml.safe_load(raw)
    return substitute(data or {}, env)


#: Ready settings by name: methods, instances and attempts of a run.
PRESETS: dict[str, dict] = {
    "default": {"dataset": {"split": "lite"}, "methods": ["hybrid"], "execution": {"workers": 4, "attempts": 3}},
    "minimal": {"dataset": {"split": "lite", "max_instances": 10}, "methods": ["sparse"], "execution": {"workers": 1, "attempts": 1}},
    "agentic": {"dataset": {"split": "lite"}, "methods": ["stepwise", "layered", "refined"], "execution": {"workers": 4, "attempts": 3}},
    "rag": {"dataset": {"split": "lite"}, "methods": ["sparse", "dense", {"name": "hybrid", "weights": {"sparse": 0.3, "dense": 0.7}}], "execution": {"workers": 4, "attempts": 3}},
    "full": {"dataset": {"split": "full"}, "methods": ["sparse", "dense", "hybrid", "stepwise", "layered", "refined"], "execution": {"workers": 8, "attempts": 3}},
}


def configured(config: dict | str) -> dict:
    """A configuration over its preset (its `preset`, or the name given): dictionaries are merged, other values replaced."""
    own = {"preset": config} if isinstance(config, str) else dict(config)
    name = own.pop("preset", None)
    if name is not None and name not in PRESETS:
        raise KeyError(f"no preset named {name}; there are {sorted(PRESETS)}")

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return merge(PRESETS[name] if name else {}, own)


def method_entries(config: dict) -> dict[str, dict]:
    """Methods by name with their settings, whether given as a list of names, a list of entries or a mapping."""
    given = config.get("methods", [])
    if isinstance(given, dict):
        return {k: dict(v or {}) for k, v in given.items()}
    named = [{"name": m} if isinstance(m, str) else dict(m) for m in given]
    if missing := [m for m in named if "name" not in m]:
        raise ValueError(f"a method without a name: {missing[0]}")
    return {m.pop("name"): m for m in named}
