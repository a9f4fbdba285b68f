"""Quality classifier with hierarchical empirical Bayes.

A document classifier gives each text log-odds of being good.  Hosts and the paths under them have
Beta posteriors of the share of good texts, from grouped sums of that evidence: a host shrinks
towards the global share, a path towards its host, by prior strengths estimated from the spread of
hosts and paths themselves.  A document's own log-odds then move by its site's.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut, reading
from spindrift.session import share_package

#: The classifier is fitted on this many labelled rows at most, those with the smallest hash of their id.
FIT_ROWS = 20_000
#: Sites are broadcast up to so many bytes, counted first; beyond, they are joined by a shuffle.
SITE_BYTES = 32 << 20
_SYMBOLS = b"#$%&*@^~=+<>{}[]\\_`"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def features(text: str | None) -> list[float]:
    """Shares and counts that tell prose from junk; an empty text has zeros."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    words = b.split()
    w = max(1, len(words))
    upper, symbols, bars, bangs, digits = _count(b, _UPPER), _count(b, _SYMBOLS), b.count(b"|"), b.count(b"!"), _count(b, _DIGITS)
    again = sum(map(eq, words, words[1:]))
    stops = b.count(b". ") + b.count(b".\n")
    return [np.log1p(n), upper / n, np.log1p(upper), symbols / n, np.log1p(symbols), bars / w, np.log1p(bars), bangs / w, np.log1p(bangs), again / w, np.log1p(again), digits / n, stops / w, n / w, len(set(words)) / w, b.count(b"\n") / w, b.count(b"!!") / w, b.count(b"###") / w, float(not words)]


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights) + self.bias, -30, 30)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """A logistic regression over features(), fitted on at most `rows` labelled documents.

    Null labels and ids are ignored; without labels of both kinds the model says yes to everything.
    """
    share_package(docs.sparkSession)
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_fit_id")).agg(F.max(label_col).alias("_fit_label"))
    some = some.orderBy(F.xxhash64("_fit_id"), "_fit_id").limit(rows)
    # Bounded by `rows`, whatever the tables' sizes; of documents that share an id the one with the least hash is taken.
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), F.col("_id") == F.col("_fit_id"))
    found = found.groupBy("_id").agg(F.any_value("_fit_label").alias("_fit_label"), F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    data = found.select("_fit_label", _features(F.col("_text")).alias("x")).collect()
    y = np.array([r["_fit_label"] > 0 for r in data], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        k = len(features(""))
        return Model([0.0] * k, [1.0] * k, [0.0] * k, 0.0 if len(y) and y.max() == 0 else 3.0)
    x = np.array([r["x"] for r in data])
    order = np.lexsort(x.T)  # the same sum whatever order the rows came in
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in s])

    return run(text)


def evidence(model: Model, text: Column) -> Column:
    """The classifier's log-odds; only the text goes to Python."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.logit(np.array([features(t) for t in s]).reshape(len(s), -1)))

    return run(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(parts: DataFrame, k: str, n: str, mean: Column) -> Column:
    """Beta prior strength by moments, an aggregate: how much more the parts' shares k / n spread about the mean than draws of
    their sizes would, as the correlation r within a part; 1 / r - 1, within [2, 1000]."""
    own = F.sum(F.col(n) * (F.col(k) / F.col(n) - mean) ** 2 / (mean * (1 - mean)))
    r = (own - F.count("*")) / F.nullif(F.sum(n) - F.count("*"), F.lit(0.0))
    return 1 / F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(1 / 1001)), F.lit(1 / 3)) - 1


def _within(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))


def site_posteriors(scored: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """scored(host, path, p) -> _host, _path, hn, hk, n, k, host_strength, path_strength, m; one row for each path.

    hn, hk, n, k: number and sum of p of the host's and the path's rows; m: the global share.  posterior() makes shares of them.
    One grouped sum over the rows, pre-aggregated on the map side; the rest works on its paths.  Null hosts and paths are
    hosts and paths like any other.
    """
    paths = scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("k"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    world = hosts.agg(_within(F.sum("hk") / F.sum("hn")).alias("m"))
    with_m = hosts.crossJoin(world)  # one row
    host_prior = with_m.agg(_strength(with_m, "hk", "hn", F.col("m")).alias("host_strength"))
    host_post = with_m.crossJoin(host_prior).withColumnRenamed("_host", "_h")
    both = paths.join(host_post, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    mean = _within((F.col("hk") + F.col("host_strength") * F.col("m")) / (F.col("hn") + F.col("host_strength")))
    path_prior = both.agg(_strength(both, "k", "n", mean).alias("path_strength"))
    return both.crossJoin(path_prior)


def posterior(own: Column | None = None) -> tuple[Column, Column]:
    """Host's and path's shares of a row of site_posteriors(), the host's shrunk to the global share, the path's to the host's;
    without a document's own evidence `own`, if given, so that it doesn't count twice."""
    one, p = (F.lit(0.0), F.lit(0.0)) if own is None else (F.lit(1.0), own)
    host = (F.greatest(F.col("hk") - p, F.lit(0.0)) + F.col("host_strength") * F.col("m")) / (F.col("hn") - one + F.col("host_strength"))
    return host, (F.greatest(F.col("k") - p, F.lit(0.0)) + F.col("path_strength") * host) / (F.col("n") - one + F.col("path_strength"))


def judge(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = 0.5, site_weight: float = 1.0) -> DataFrame:
    """docs + _q_doc, _q_host, _q_path, _q_share, _q_keep: the text's own probability, the shares of its host and path by all
    their other texts, the probability with both, and whether that reaches the threshold.  One row for each row of docs.

    The texts are read twice, for the sites' sums and for the rows themselves.  The sites are written to the shared folder
    and measured at once; no text is shuffled unless they exceed SITE_BYTES.  Empty and null texts have features of their own; null
    hosts and paths are groups; repeated rows each count; columns of docs may have any names, but those named as the new ones are
    replaced; a table without rows gives none.
    """
    share_package(docs.sparkSession)
    odds = evidence(model, F.col(text_col))
    share_of = lambda x: 1 / (1 + F.exp(-x))
    first = docs.select(F.col(host_col).alias("_h0"), F.col(path_col).alias("_p0"), share_of(odds).alias("_p"))
    sites = cut(site_posteriors(first, "_h0", "_p0", "_p"))
    width = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("_host", "_path")) + 96
    near = F.broadcast(sites) if (sites.agg(F.sum(width)).first()[0] or 0) <= SITE_BYTES else sites
    # The row is one column inside, so that its columns' names can't meet those used here.
    rows = docs.select(F.struct("*").alias("_row"), F.col(host_col).alias("_h0"), F.col(path_col).alias("_p0"), odds.alias("_odds"))
    out = rows.join(near, F.col("_h0").eqNullSafe(F.col("_host")) & F.col("_p0").eqNullSafe(F.col("_path")), "left")
    host, path = posterior(share_of(F.col("_odds")))
    both = F.col("_odds") + site_weight * (_logit(_within(path)) - _logit(F.col("m")))
    new = {"_q_doc": share_of(F.col("_odds")), "_q_host": host, "_q_path": path, "_q_share": share_of(F.coalesce(both, F.col("_odds")))}
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (*new, "_q_keep")]
    out = out.select(*kept, *(c.alias(k) for k, c in new.items())).withColumn("_q_keep", F.col("_q_share") >= threshold)
    return reading(out, sites)
