"""URL filters: rules first, then a logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; path: from there up to ``?``, ``#`` or the end.  A rule is a host with a path
prefix; it fits its host and all subdomains where the path starts with its
prefix, and the longest rule wins (ties: the first by text).

Rules are column expressions; the regression (256 KB of weights, whatever the
input) scores the URLs that no rule fits, in one scan without a shuffle.

Defined results: null URLs or URLs without ``://`` have empty host and path, no
rule, and the verdict of the empty URL; repeated rows are judged each; null ids
stay null; a labelled table without both verdicts judges everything ``allow``;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import mapped

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: A URL is blocked from this score on at least; ``choose_threshold`` may ask for more.
THRESHOLD = 0.5
#: Folds of that choice, and the share of wanted seed rows that it lets be blocked at most.
FOLDS, FALSE_BLOCKS = 5, 0.01
#: The labelled table is small by contract; more rows are an error, not a cut.
MAX_LABELLED = 100_000

#: Words of hosts in the labelled seed table: unwanted and wanted sites.
_UNWANTED = ("casino poker bets betting jackpot slots pills viagra pharmacy cheap discount free-gift win winner "
             "adult xxx porn escort ads adserver track tracker clickbait spam spam-mail farm-links seo-links loans payday "
             "replica warez torrent crack keygen free-stream").split()
_WANTED = ("library museum university school college science physics history geography weather news daily press "
           "journal archive forum wiki docs manual recipes garden travel city council health clinic music theatre "
           "film books reading writing language grammar maths code software hardware blog notes photo art").split()


def seed_rows() -> list[tuple[str, str]]:
    """The default labelled table ``(url, verdict)``: each word as a host of its
    own and with a neighbour, under several top-level domains and paths."""
    out = []
    tops = ("com", "net", "org", "example.com", "example.net", "example.org")
    paths = ("/", "/en/12", "/de/7/", "/fr/31.html", "/es/5?page=2", "/index.html")
    for verdict, words in (("block", _UNWANTED), ("allow", _WANTED)):
        for i, word in enumerate(words):
            near = words[(i + 1) % len(words)]
            for k, host in enumerate((word, f"www.{word}", f"{word}-{near}" if verdict == "block" else word + near)):
                out.append((f"https://{host}.{tops[(i + k) % 6]}{paths[(i + 2 * k) % 6]}", verdict))
    return out


def host(url: str | Column) -> Column:
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    name, slash, rest = rule.partition("/")
    return name.lower(), slash + rest


def matched_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, prefix = split_rule(text)
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def buckets(host_: str, path_: str) -> np.ndarray:
    """Distinct hash buckets of the character n-grams of ``^host$`` and ``^path$``."""
    found = set()
    for kind, text in ((1, f"^{host_}$"), (2, f"^{path_}$")):
        for size in SIZES:
            found.update([crc32(text[i:i + size].encode(), kind) % BUCKETS for i in range(len(text) - size + 1)])
    return np.fromiter(found, np.int64, len(found))


def fit_rows(rows: list[tuple[str, str, int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of the regression over ``(host, path, blocked)``;
    full-batch gradient descent, n-grams weighted by 1/sqrt(their number in the URL)."""
    weights = np.zeros(BUCKETS + 1)
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        weights[-1] = -20.0
        return weights
    bags = [np.sort(buckets(a, b)) for a, b, _ in rows]
    of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = np.concatenate(bags)
    value = np.concatenate([np.full(len(b), 1 / np.sqrt(max(1, len(b)))) for b in bags])
    # both verdicts weigh the same
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(steps):
        s = np.bincount(of, weights[flat] * value, minlength=len(bags)) + weights[-1]
        d = (1 / (1 + np.exp(-s)) - y) * each
        g = np.bincount(flat, d[of] * value, minlength=BUCKETS + 1) + decay / len(y) * weights
        g[-1] = d.sum()
        weights -= rate * 20 * g
    return weights


def score(weights: np.ndarray, host_: str, path_: str) -> float:
    own = np.sort(buckets(host_, path_))
    s = float(weights[own].sum() / np.sqrt(max(1, len(own))) + weights[-1])
    return float(1 / (1 + np.exp(-s)))


def _fold(host_: str) -> int:
    """Rows of one site (its first label, without www) share a fold."""
    return crc32(host_.removeprefix("www.").split(".")[0].encode()) % FOLDS


def choose_threshold(rows: list[tuple[str, str, int]]) -> float:
    """The least threshold, ``THRESHOLD`` or more, that blocks at most ``FALSE_BLOCKS`` of the wanted
    rows when each fold is scored by a model of the others: what the regression
    knows nothing about stays allowed."""
    held = []
    for k in range(FOLDS):
        own = [r for r in rows if _fold(r[0]) == k]
        rest = [r for r in rows if _fold(r[0]) != k]
        if own and rest:
            weights = fit_rows(rest)
            held += [score(weights, h, p) for h, p, y in own if not y]
    over = sorted(held, reverse=True)[int(len(held) * FALSE_BLOCKS):]
    return max(THRESHOLD, float(np.nextafter(over[0], 1.0))) if over else THRESHOLD


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """The regression from a labelled table ``url, verdict`` (allow or block), and its threshold."""
    rows = (labelled.filter(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block"))
            .select(host("url").alias("h"), path("url").alias("p"), (F.col("verdict") == "block").cast("int").alias("y"))
            .distinct().limit(MAX_LABELLED + 1).collect())
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has more than {MAX_LABELLED} rows")
    rows = sorted((r.h, r.p, r.y) for r in rows)
    return fit_rows(rows), choose_threshold(rows)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id",
          threshold: float | None = THRESHOLD) -> DataFrame:
    """``key, host, path, rule, verdict, score`` per row (score: the regression's
    probability of ``block``, null where a rule decides; blocked from ``threshold`` on; None:
    from the one chosen on held-out rows of ``labelled``)."""
    weights, chosen = fit(labelled)
    threshold = chosen if threshold is None else threshold

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [None if rule is not None else score(weights, h, p)
               for h, p, rule in zip(*(batch[c].to_pylist() for c in ("host", "path", "rule")), strict=True)]
        return batch.append_column("score", pa.array(got, pa.float64()))

    rows = pages.select(F.col(key), host("url").alias("host"), path("url").alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    scored = mapped(rows, run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double")
    by_score = F.when(F.col("score") >= F.lit(threshold), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "host", "path", "rule", F.coalesce("verdict", by_score).alias("verdict"), "score")


def rules_sql(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB: ``page_id, host, path, rule, says`` (the rule's verdict or null) of every page."""
    listed = ", ".join("('{}', '{}', '{}', '{}')".format(says, rule, *split_rule(rule)) for says, rule in rules)
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(says, rule, name, prefix) AS (VALUES {listed})
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
FROM u LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
GROUP BY page_id, host, path"""
