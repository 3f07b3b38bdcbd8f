"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

A logistic classifier on surface features of the whole text gives each document a probability. Hosts and paths
pool those of their documents by grouped aggregation; a path shrinks towards its host and a host towards all
documents, the more the fewer documents it has. How strongly is estimated by the method of moments.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .quality_rules import let, words_of
from .toxicity_fm import held_out, labelled_rows

STEPS, RATE, DECAY = 400, 0.3, 1e-3
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
KEEP = 0.5
#: Documents of a site that one task joins; at most so many sites (the largest, which hold the most rows) are dealt out.
SITE_ROWS, MOST_HOT_SITES = 1 << 20, 1000
FEATURES = ("log_words", "marks", "shouts", "bars", "capitals", "distinct", "word_chars", "repeated_lines", "ends")


def features(text: str = "_t") -> Column:
    """An array of FEATURES, all finite: shares a word, but for the logarithm of the number of words."""
    n = "cast(greatest(size(w), 1) as double)"
    parts = (
        "ln(1D + size(w))",
        f"regexp_count({text}, '[#*$%&<>=_~^]+') / {n}",
        f"regexp_count({text}, '[!?]{{2,}}') / {n}",
        f"regexp_count({text}, '[|»›•·]') / {n}",
        f"regexp_count({text}, '(?<![A-Za-z])[A-Z]{{2,}}') / {n}",
        f"size(array_distinct(w)) / {n}",
        f"least(char_length(array_join(w, '')) / {n}, 40D)",
        let("x", f"split({text}, '\\n', -1)", "(size(x) - size(array_distinct(x))) / cast(size(x) as double)"),
        f"regexp_count({text}, '[.!?]') / {n}",
    )
    return F.expr(let("w", words_of(text), f"array({', '.join(f'cast({p} as double)' for p in parts)})"))


def fit(labelled: DataFrame) -> tuple[list[float], list[float]]:
    """(bias, weights on raw features) from (id, text, label); the rows are bounded by labelled_rows().

    With labels of one kind only, the weights are 0 and the bias is the log odds of their smoothed share.
    """
    rows = labelled.where("label in (0, 1)").withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit(""))).select("id", features().alias("f"), F.col("label").cast("double")).orderBy("id").collect()
    y = np.array([r["label"] for r in rows])
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return float(np.log(share / (1 - share))), [0.0] * len(FEATURES)
    x = np.array([r["f"] for r in rows])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z, w, b = (x - mean) / spread, np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
        w -= RATE * (z.T @ miss / len(y) + DECAY * w)
        b -= RATE * miss.mean()
    return float(b - (w * mean / spread).sum()), [float(v) for v in w / spread]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """How many documents the level above is worth, by the method of moments.

    groups: (n, s, q: number, sum and sum of squares of their documents' probabilities, above: mean of the level above).
    Within: the pooled variance of probabilities inside groups. Between: what the groups' means vary around the level
    above beyond what their sizes explain. Without spread between groups, the level above stands for them.
    """
    gap = F.col("s") / F.col("n") - F.col("above")
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.sum(gap * gap * F.col("n")).alias("v")).first()
    if not r["n"]:
        return LEAST_STRENGTH
    within = max(r["w"], 0.0) / max(r["n"] - r["g"], 1)
    between = (r["v"] - within * r["g"]) / r["n"]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, within / between)) if between > 0 else MOST_STRENGTH


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, classifier, host_posterior, path_posterior, score (0 to 1), kept, predicted (int), held_out of every row.

    host and path: expressions of docs (source, and source with lang, unless given); null is a host or path
    like any other. A document's own probability is left out of the path it is compared with. Null and empty
    texts count as texts without words, a text of any length counts whole; repeated rows are judged alike and count
    each time; equal scores are kept or not alike; an empty table gives no rows; other columns are ignored. Labels of held-out documents (held_out()) are never read.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    base = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    bias, weights = fit(labelled_rows(base.select("doc_id", F.col("_t").alias("text")), labels, "quality"))
    z = F.lit(bias) + sum((F.lit(w) * F.col("f")[k] for k, w in enumerate(weights)), F.lit(0.0))
    own = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    slim = staged(base.withColumn("f", features()).select("doc_id", "host", "path", own.alias("p")), "evidence")
    paths = slim.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = staged(paths, "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    share = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    mean = min(1 - 1e-6, max(1e-6, share if share is not None else 0.5))
    k_host = _strength(hosts.withColumn("above", F.lit(mean)))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k_path = _strength(sites.withColumn("above", F.col("host_posterior")))
    sites = sites.select(F.struct("host", "path").alias("site"), "n", "s", "host_posterior")
    sites = sites.select(F.xxhash64(F.to_json("site")).alias("k"), F.col("site.host").alias("h"), F.col("site.path").alias("q"), "n", "s", "host_posterior")
    # Sites of many documents are dealt out over as many salts as they need, so that none meets its documents in one task.
    sites = sites.withColumn("deal", F.ceil(F.col("n") / SITE_ROWS).cast("int"))
    hot = {r["k"]: r["deal"] for r in sites.where("deal > 1").orderBy(F.desc("n"), "k").limit(MOST_HOT_SITES).select("k", "deal").collect()}
    deal = lambda k: F.coalesce(F.create_map(*(F.lit(x) for kv in hot.items() for x in kv))[k], F.lit(1)) if hot else F.lit(1)
    sites = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), deal(F.col("k")) - 1))).drop("deal")
    slim = slim.withColumn("k", F.xxhash64(F.to_json(F.struct("host", "path"))))
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id", "p"), deal(F.col("k"))).cast("int"))
    met = slim.join(sites, (slim.k == sites.k) & (slim.salt == sites.salt) & slim.host.eqNullSafe(sites.h) & slim.path.eqNullSafe(sites.q))
    others = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(others) - F.lit(float(np.log(mean / (1 - mean)))))))
    out = met.select("doc_id", F.col("p").alias("classifier"), "host_posterior", others.alias("path_posterior"), score.alias("score"))
    return out.withColumns({"kept": F.col("score") >= keep, "predicted": (F.col("score") >= keep).cast("int"), "held_out": held_out("doc_id")})
