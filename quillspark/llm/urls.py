"""URL filters: host and path rules, then logistic regression on hashed character n-grams of host and path.

The model is trained on the small labelled table below (its size is fixed, so is the time to fit it) and is a
weight vector of 2**14 floats that travels in the closure. Scoring reads one column and needs no shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)

# Host names of the labelled URL table.
BLOCKED_HOSTS = (
    "adult-chat adultvideos bestcasino bets-today betting-tips bigpills buypills cam-girls casino-royal casinobonus "
    "cheapmeds cheap-viagra click-ads clicktracker crypto-scam escort-city fakewatches free-crack free-money freeporn "
    "gambling-den gore-videos hate-forum hot-sex jackpot-slots keygen-files livecasino malware-host nude-pics onlinepills "
    "payday-loan phish-login poker-bonus porn-tube spam-offers spammail sportbets topads torrent-hub tracking-pixel "
    "trackads viagra-shop warez-zone webspam winbig-casino win-prize xxx-cams xadult"
).split()
ALLOWED_HOSTS = (
    "academy airport animals archive architecture art-museum astronomy athletics baking bakery bank bicycle biology birds "
    "bookshop botany bridge cathedral chemistry children church cinema city-council classics clinic coast coffee college "
    "community concert cooking country culture dance dentist design drawing economy education energy engineering exhibition "
    "farmers festival film fishing flowers football forest foundation furniture gallery garden geography geology glass "
    "government harbour health heritage hiking history hospital hotel house insurance island jobs journal kitchen language "
    "law lecture library literature local-news magazine maps market mathematics medicine meteorology mountain museum music "
    "nature news-daily newspaper northern observatory opera orchestra painting parents parliament philosophy photos physics "
    "pottery public-radio railway reading recipes research restaurant river school science seminar software southern sports "
    "station statistics student theatre tourism townhall traffic training translation travel university village water "
    "weather western wiki wildlife winter-sports workshop writing yearbook"
).split()
# What surrounds a host name in the table, in turn.
PREFIXES = ("", "www.", "shop.", "info.", "de.")
TOPS = ("example.com", "example.net", "example.org")
PATHS = ("/articles/{}", "/{}.html", "/index.php?id={}", "/2020/{}/", "/category/page-{}", "/")


def labelled() -> list[tuple[str, int]]:
    """The labelled URL table (1: block): each host name under each top domain, so neither these nor paths decide."""
    rows = []
    for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)):
        for i, host in enumerate(hosts):
            for j, top in enumerate(TOPS):
                path = PATHS[(i + j) % len(PATHS)].format(101 * i + 7 * j)
                rows.append((f"http{'s' * (i % 2)}://{PREFIXES[(i + j) % len(PREFIXES)]}{host}.{top}{path}", label))
    return rows


# The rules of the contract (pattern of host and path, verdict).
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def buckets(host: str, path: str) -> np.ndarray:
    """Hash buckets of the distinct n-grams of ^host$ and ^path$; the two parts never share a key."""
    grams = {
        f"{part}{text[i:i + n]}"
        for part, text in (("h", f"^{host}$"), ("p", f"^{path}$"))
        for n in SIZES
        for i in range(len(text) - n + 1)
    }
    return np.fromiter((crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams), np.int64, len(grams))


@lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by gradient descent with L2 (on the rows' coefficients); the same in every session.

    The bias is the table's log odds, so that n-grams the table does not know leave a URL allowed.
    """
    table = labelled()
    x = np.zeros((len(table), BUCKETS), np.float32)
    for i, (url, _) in enumerate(table):
        b = buckets(*split_url(url))
        np.add.at(x[i], b, 1 / np.sqrt(max(1, len(b))))
    gram = (x @ x.T).astype(float)
    y, rows = np.array([y for _, y in table], float), np.zeros(len(table))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(1500):
        rows -= 0.3 * (1 / (1 + np.exp(-(gram @ rows + bias))) - y + 0.02 * rows)
    return x.T.astype(float) @ rows, bias


def score_url(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    """Probability that the URL is to be blocked; that of an empty host and path is 0."""
    if not host and not path:
        return 0.0
    b = buckets(host, path)
    z = weights[b].sum() / np.sqrt(max(1, len(b))) + bias
    return float(1 / (1 + np.exp(-z)))


def host_column(url: Column) -> Column:
    """The host, natively."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: Column) -> Column:
    """The path, natively."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. A rule fits its host and all subdomains."""
    rule = verdict = None
    for pattern, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = pattern.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, pattern) if rule is None else rule.when(fits, pattern)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def filter_urls(frame: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, host, path, rule (null without), score of the model, verdict (allow or block).

    A fitting rule decides, else the model's score. A null or malformed URL has an empty host and path, fits no
    rule and is allowed with score 0. URLs are judged whole, however long. Repeated rows give repeated results, an empty
    table none; other columns are not read.
    """
    weights, bias = trained()

    @F.pandas_udf("double")
    def scores(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([score_url(h, p, weights, bias) for h, p in zip(hosts, paths)], dtype="float64")

    parts = frame.select(F.col(id_col), host_column(F.col(url_col)).alias("host"), path_column(F.col(url_col)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parts.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("said"), scores("host", "path").alias("score"))
    return judged.select(
        id_col, "host", "path", "rule", "score",
        F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
    )
