"""URL filter: prefix rules, and logistic regression on hashed character n-grams of host and path for the urls no rule covers.

The model is fitted on a small labelled URL table (at most ``MAX_LABELLED`` rows; a longer one is refused) and is one array of weights,
sent to the tasks as it is. Rules are looked up by the host's last one, two, ... labels, as many as the rules have, each a
join with a small table; rules of one host stay in a list, and the longest that fits wins.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and gets the model's verdict for them. Repeated
rows each give a row. Rules with null parts or labels that are null are left out; of equally long rules the one with the longer host wins.
Without labelled urls of both kinds every url gets the share of blocked labels (0 without labels). Empty tables give
empty results; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stamina.llm.common import LOWER, UPPER
from stamina.llm.textvec import mix

SIZES = (3, 4, 5)
BUCKETS = 1 << 16
MAX_LABELLED = 50_000
MAX_RULES = 500_000
CHUNK = 4096


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, row of each n-gram); grams of host and path are told apart, and both have marked ends."""
    bucket, row = [], []
    for salt, texts in ((1, hosts), (2, paths)):
        raw = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        of = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in SIZES:
            if len(data) < n:
                continue
            value = np.full(len(data) - n + 1, salt * 8 + n, np.uint64)
            for j in range(n):
                value = value * np.uint64(257) + data[j:len(data) - n + 1 + j]
            inside = of[:len(value)] == of[n - 1:]
            bucket.append((mix(value[inside]) >> np.uint64(48)).astype(np.int64) % BUCKETS)
            row.append(of[:len(value)][inside])
    return np.concatenate(bucket), np.concatenate(row)


@dataclass
class Model:
    weights: np.ndarray         # one a bucket, and the constant
    prior: float | None = None

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """P(block) of each url: mean weight of its n-grams and the constant, through the logistic curve."""
        if self.prior is not None:
            return np.full(len(hosts), self.prior)
        out = []
        for a in range(0, len(hosts), CHUNK):
            h, p = hosts[a:a + CHUNK], paths[a:a + CHUNK]
            bucket, row = _grams(h, p)
            total = np.bincount(row, self.weights[bucket], len(h)) / np.sqrt(np.maximum(np.bincount(row, minlength=len(h)), 1))
            out.append(1 / (1 + np.exp(-np.clip(total + self.weights[-1], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(hosts: list[str], paths: list[str], block: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> Model:
    """Logistic regression by adaptive gradient steps over the whole labelled table."""
    prior = float(np.mean(block)) if len(block) else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(BUCKETS + 1, np.float32), prior)
    bucket, row = _grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))
    # both kinds count the same, however many urls of each there are
    share = np.where(block == 1, 0.5 / block.sum(), 0.5 / (1 - block).sum())
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[bucket], len(hosts)) * scale + w[-1], -30, 30)))
        error = (block - p) * share
        g = np.append(np.bincount(bucket, (error * scale)[row], BUCKETS), error.sum())
        g[:-1] -= ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) * (np.abs(m) > 0)
    return Model(w.astype(np.float32))


def train(labelled: DataFrame, url: str = "url", block: str = "block") -> Model:
    """Fit on a labelled table of at most ``MAX_LABELLED`` rows."""
    rows = labelled.where(F.col(block).isNotNull()).select(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.col(block).cast("int").alias("y"))
    got = rows.orderBy("h", "p", "y").limit(MAX_LABELLED + 1).collect()
    if len(got) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls; pass a sample of them")
    return fit([r["h"] for r in got], [r["p"] for r in got], np.array([r["y"] for r in got], float))


def _candidate(host: str):
    return lambda r: F.struct((F.length(host) + F.length(r["path"])).alias("length"), F.length(host).alias("host_length"),
                              F.concat(F.col(host), r["path"]).alias("text"), r["verdict"].alias("verdict"))


def _with_rule(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds __rule (text, verdict, length): the longest rule that fits __host and __path."""
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    facts = rules.groupBy((F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("labels")).count().collect()
    small = sum(r["count"] for r in facts) <= MAX_RULES
    found = []
    for labels in sorted(r["labels"] for r in facts):
        side = rules.where(F.length("host") - F.length(F.replace("host", F.lit("."))) + 1 == labels).groupBy(F.col("host").alias(f"__h{labels}")).agg(
            F.collect_list(F.struct("path", "verdict")).alias(f"__r{labels}"))
        rows = rows.withColumn("__k", F.substring_index("__host", ".", -labels))
        rows = rows.join(F.broadcast(side) if small else side, F.col("__k") == F.col(f"__h{labels}"), "left").drop("__k")
        fits = F.filter(f"__r{labels}", lambda r: F.startswith(F.col("__path"), r["path"]))
        found.append(F.transform(fits, _candidate(f"__h{labels}")))
    if not found:
        return rows.withColumn("__rule", F.lit(None).cast("struct<length:int,host_length:int,text:string,verdict:string>"))
    every = F.concat(*[F.coalesce(f, F.array().cast("array<struct<length:int,host_length:int,text:string,verdict:string>>")) for f in found])
    return rows.withColumn("__rule", F.array_max(every))


def judge(pages: DataFrame, rules: DataFrame, model: Model, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with __host, __path, __rule (text or null), __score (P(block)) and __verdict (the rule's, else the model's)."""
    @pandas_udf(T.DoubleType())
    def block(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(host), list(path)))

    columns = pages.columns
    rows = pages.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    rows = _with_rule(rows, rules).withColumn("__score", block("__host", "__path"))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__score") >= threshold, "block").otherwise("allow"))
    return rows.select(*columns, "__host", "__path", F.col("__rule.text").alias("__rule"), "__score", verdict.alias("__verdict"))
