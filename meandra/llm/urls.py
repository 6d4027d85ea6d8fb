"""URL filters: host rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions only.

The rules label the URLs that they fit. Trees learn from a bounded sample of those and judge all
others. Features are column expressions, and the fitted trees become one too, so scoring stays in
generated code. Fitting boosts shallow trees on the collected sample, on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host with path): longest fitting rule wins (fixed values).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Bound of the labelled sample, rows.
SAMPLE = 20_000
#: Boosting: trees, depth, learning rate, least rows of a leaf, thresholds tried for a feature.
TREES, DEPTH, RATE, LEAF, BINS = 24, 3, 0.3, 5, 24
#: Suffixes and first path parts with learnt statistics, at most.
STATISTICS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda acc, c: acc - F.when((c == "") | (share(c) <= 0), F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))
    return {
        "length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(F.regexp_replace(path, "/+$", ""), "/"),
        "labels": _count(host, r"\."),
        "digit_ratio": _count(u, r"\d") / n,
        "path_digits": _count(path, r"\d"),
        "hyphens": _count(u, "[-_]"),
        "parameters": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&") + 1),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": u.startswith("https").cast("double"),
        "entropy": F.round(entropy, 6),
    }


#: Statistics of these parts are learnt: last label, last two labels, first path part.
def parts(host: Column, path: Column) -> dict[str, Column]:
    return {"suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "first": F.regexp_extract(path, "^/([^/]*)", 1)}


@dataclass(frozen=True)
class UrlModel:
    statistics: dict[str, dict[str, float]]
    bias: float
    trees: tuple

    def score(self, columns: dict[str, Column], texts: dict[str, Column]) -> Column:
        """Log-odds of block."""
        known = dict(columns)
        for name, table in self.statistics.items():
            pairs = [F.lit(x) for kv in table.items() for x in kv]
            known[name] = F.coalesce(F.try_element_at(F.create_map(*pairs), texts[name]), F.lit(0.0)) if pairs else F.lit(0.0)

        def walk(node: tuple) -> Column:
            if len(node) == 1:
                return F.lit(float(node[0]))
            name, limit, low, high = node
            return F.when(known[name] <= F.lit(float(limit)), walk(low)).otherwise(walk(high))

        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + walk(t)
        return total


def _grow(x: np.ndarray, names: list[str], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = (-RATE * g / (h + 1.0),)
    if depth == 0 or len(rows) < 2 * LEAF:
        return leaf
    best = (1e-6, -1, 0.0)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for limit in np.unique(np.quantile(v, np.linspace(0, 1, BINS + 2)[1:-1], method="lower")):
            left = v <= limit
            k = int(left.sum())
            if k < LEAF or len(rows) - k < LEAF:
                continue
            gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, f, float(limit))
    if best[1] < 0:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (names[best[1]], best[2], _grow(x, names, grad, hess, rows[left], depth - 1), _grow(x, names, grad, hess, rows[~left], depth - 1))


def _value(tree: tuple, row: dict[str, np.ndarray], n: int) -> np.ndarray:
    if len(tree) == 1:
        return np.full(n, tree[0])
    name, limit, low, high = tree
    return np.where(row[name] <= limit, _value(low, row, n), _value(high, row, n))


def fit(labelled: DataFrame, url: str = "url", sample: int = SAMPLE) -> UrlModel:
    """Trees from (url, verdict) rows: at most `sample` distinct ones, the first by a hash of the URL.

    Without labelled rows every URL is allowed; with one verdict among them it is everyone's.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    cols = features(F.col(url), host, path)
    texts = parts(host, path)
    picked = labelled.select(url, "verdict").distinct().orderBy(F.xxhash64(url), url).limit(sample)
    rows = picked.select("verdict", *(c.alias(k) for k, c in cols.items()), *(c.alias(k) for k, c in texts.items())).collect()
    y = np.array([r["verdict"] == "block" for r in rows], float)
    if not len(y) or y.min() == y.max():
        return UrlModel({}, 30.0 if len(y) and y[0] else -30.0, ())
    prior = float(np.log(y.mean() / (1 - y.mean())))
    statistics: dict[str, dict[str, float]] = {}
    x = {k: np.array([r[k] for r in rows], float) for k in cols}
    for k in texts:
        counts: dict[str, list[float]] = {}
        for r, t in zip(rows, y):
            c = counts.setdefault(r[k] or "", [0.0, 0.0])
            c[0] += t
            c[1] += 1
        top = sorted(counts.items(), key=lambda kv: (-kv[1][1], kv[0]))[:STATISTICS]
        # a rare part says little: its log-odds are drawn towards the prior
        statistics[k] = {name: round(float(np.log((b + 5 * y.mean()) / (m - b + 5 * (1 - y.mean()))) - prior), 6) for name, (b, m) in top}
        x[k] = np.array([statistics[k].get(r[k] or "", 0.0) for r in rows])
    names = list(x)
    matrix = np.stack([x[k] for k in names], axis=1)
    score = np.full(len(y), prior)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(matrix, names, p - y, np.maximum(p * (1 - p), 1e-9), np.arange(len(y)), DEPTH)
        trees.append(tree)
        score = score + _value(tree, x, len(y))
    return UrlModel(statistics, prior, tuple(trees))


def judge(pages: DataFrame, model: UrlModel | None = None, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages`.

    verdict: the longest fitting rule's, else block where the trees' log-odds `score` are over 0.
    A null url, or one without ://, has empty host and path and is judged by the trees. Repeated
    rows come back repeated. Other columns are ignored. An empty table gives an empty result.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = rule_of(host, path, rules)
    if model is None:
        model = fit(rows.select("url", ruled.alias("verdict")).filter("verdict is not null and url is not null"), sample=sample)
    rows = rows.withColumns({"host": host, "path": path, "rule": rule, "ruled": ruled})
    h, p = F.col("host"), F.col("path")
    plain = {k: f"f_{k}" for k in features(h, h, p)} | {k: f"t_{k}" for k in parts(h, p)}
    rows = rows.withColumns({plain[k]: c for k, c in (features(F.col("url"), h, p) | parts(h, p)).items()})
    cols, texts = {k: F.col(plain[k]) for k in features(h, h, p)}, {k: F.col(plain[k]) for k in parts(h, p)}
    rows = rows.withColumn("score", F.round(model.score(cols, texts), 6))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
