"""A retrieval chain made of a configuration: index, queries, search, filter, reranking, context budget, by the names of spindrift.library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import spindrift.library  # noqa: F401  # registers the operators by name
from spindrift import registry
from spindrift.operators import context, fusion, querygen, sparse
from spindrift.sources.records import configured
from spindrift.tables import reading

#: What a chain does where its configuration doesn't say: settings by step.
SETTINGS: dict[str, dict] = {
    "tokenizer": {"name": "code"},
    "retriever": {"top_k": 20, "min_score": 0.0},
    "queries": {"strategies": [], "most": 5},
    "reranker": {"name": None, "rerank_k": 50, "top_k": 20},
    "context": {"max_tokens": 8000},
}
#: Chains by name, over SETTINGS.
CHAINS: dict[str, dict] = {
    "sparse": {},
    "expanded": {"queries": {"strategies": ["keywords", "code_symbols", "error_patterns"]}},
    "reranked": {"retriever": {"top_k": 50}, "reranker": {"name": "overlap"}},
}


@dataclass
class Chain:
    settings: dict[str, dict]

    def hits(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """docs(doc, content), items(query, text) -> query, doc, score, rank."""
        tokenizer = registry.get("tokenizer", self.settings["tokenizer"]["name"])
        how, asked = self.settings["retriever"], self.settings["queries"]
        again = self.settings["reranker"]
        index = sparse.build(docs, "doc", {"content": 1}, tokenizer)
        fetch = max(how["top_k"], again["rerank_k"]) if again["name"] else how["top_k"]
        if asked["strategies"]:
            made = querygen.generate(items.select("query", "text"), "query", "text", tuple(asked["strategies"]), asked["most"])
            keyed = made.withColumn("key", F.concat_ws("#", F.col("query").cast("string"), F.col("ordinal").cast("string")))
            found = sparse.search_index(index, keyed, fetch, "key", "query_text", tokenizer=tokenizer).withColumnRenamed("query", "key")
            found = fusion.merge_queries(found.join(keyed.select("key", "query", F.col("ordinal").alias("variant"), "weight"), "key"), fetch)
        else:
            found = sparse.search_index(index, items, fetch, "query", "text", tokenizer=tokenizer)
        found = fusion.threshold(found, how["min_score"])
        if again["name"] == "overlap":
            tokens = found.join(docs.select("doc", "content"), "doc").join(items.select("query", tokenizer(F.col("text")).alias("qt")), "query").withColumn("dt", tokenizer(F.col("content"))).drop("content")
            found = fusion.rerank(tokens, fusion.overlap_score(F.col("qt"), F.col("dt")), again["rerank_k"], again["top_k"])
        elif again["name"]:
            raise KeyError(f"no reranker named {again['name']}")
        return reading(found.select("query", "doc", "score", "rank"), index.postings, index.terms, index.stats)

    def gather(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """docs(doc, content, context_type) -> the hits whose contents fit the budget, in the order of the prompt."""
        found = self.hits(docs, items)
        return context.trim_to_budget(found.drop("rank").join(docs.select("doc", "content", "context_type"), "doc"), self.settings["context"]["max_tokens"])


def build(config: dict | str) -> Chain:
    """A chain by its name, or of a configuration with a `chain` to start from; a step that isn't known is an error.

    config may name a preset of records.PRESETS as well: its own settings are merged over it.
    """
    own = {"chain": config} if isinstance(config, str) else configured(config)
    name = own.get("chain", "sparse")
    if name not in CHAINS:
        raise KeyError(f"no chain named {name}; there are {sorted(CHAINS)}")
    given = own.get("steps", {})
    if unknown := set(given) - set(SETTINGS):
        raise KeyError(f"no steps named {sorted(unknown)}; there are {sorted(SETTINGS)}")
    settings = {step: base | CHAINS[name].get(step, {}) | dict(given.get(step, {})) for step, base in SETTINGS.items()}
    for step, values in settings.items():
        if unknown := set(values) - set(SETTINGS[step]):
            raise KeyError(f"step {step} has no settings {sorted(unknown)}")
    return Chain(settings)
