"""The package's own operators by kind and name; importing this module registers them."""

from __future__ import annotations

from spindrift import registry
from spindrift.functions import text
from spindrift.operators import callgraph, chunking, context, dense, explore, explorer, fusion, ingest, metrics, querygen, report, significance, sparse, vector_graph, vector_index

OWN = {
    "tokenizer": {"code": text.code_tokens, "whitespace": text.whitespace_tokens, "codebleu": text.codebleu_tokens},
    "chunker": {"lines": chunking.line_chunks, "characters": chunking.char_chunks, "boundaries": chunking.boundary_chunks, "syntax": chunking.ast_chunks},
    "indexer": {"bm25": sparse.build, "vectors": vector_index.build, "graph": vector_graph.build},
    "retriever": {"bm25": sparse.retrieve, "dense": dense.search, "ivf": dense.ivf_search, "stored": vector_index.search, "graph": vector_graph.search, "hybrid": fusion.hybrid},
    "fusion": {"rrf": fusion.rrf, "weighted": fusion.weighted_sum, "interleave": fusion.interleave, "queries": fusion.merge_queries},
    "reranker": {"scorer": fusion.rerank, "cascade": fusion.cascade, "table": fusion.rerank_by_table},
    "queries": dict(querygen.STRATEGIES),
    "context": {"budget": context.trim_to_budget, "core": context.core_trim, "blocks": context.prompt_blocks},
    "explorer": {"files": explore.file_scores, "classes": explore.class_scores, "functions": explore.function_scores, "symbols": explore.located_symbols, "loop": explorer.explore_all, "calls": callgraph.resolve},
    "metric": {"resolution": metrics.resolution, "pass_at_k": metrics.pass_at_k, "localization": metrics.localization, "lines": metrics.line_accuracy, "files": metrics.file_sets, "ngrams": metrics.ngram_overlap, "codebleu": metrics.codebleu, "diversity": metrics.cluster_entropy, "aggregate": metrics.aggregate},
    "report": {"compare": report.compare, "summary": report.summary, "wilson": report.wilson, "pairwise": report.pairwise, "series": report.series, "evaluation": report.evaluation_summary, "wilcoxon": significance.wilcoxon, "spearman": significance.spearman, "anova": significance.anova, "tukey": significance.tukey},
    "filter": {"instances": ingest.select_instances, "split": ingest.stratified_split},
}

for _kind, _named in OWN.items():
    for _name, _operator in _named.items():
        registry.register(_kind, _name)(_operator)
