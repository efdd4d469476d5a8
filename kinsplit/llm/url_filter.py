"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for what no rule fits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kinsplit.plans.names import column

# The rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

# The labelled URL table (1: block).
LABELLED = [
    ("https://news.example.net/world/2023/election-results", 0), ("https://www.library.example.edu/catalog/history", 0),
    ("https://docs.python.example/3/tutorial/introduction.html", 0), ("https://en.encyclopedia.example/wiki/photosynthesis", 0),
    ("https://blog.gardening.example/how-to-prune-roses", 0), ("https://research.university.example/papers/climate-model", 0),
    ("https://recipes.kitchen.example/bread/sourdough", 0), ("https://www.museum.example/exhibitions/modern-art", 0),
    ("https://health.clinic.example/advice/sleep", 0), ("https://forum.astronomy.example/t/telescope-mirrors", 0),
    ("https://www.weather.example/forecast/today", 0), ("https://git.example/project/readme", 0),
    ("https://law.court.example/opinions/2019/case", 0), ("https://shop.books.example/novels/classic", 0),
    ("http://m.thnd.example.net/en/482", 0), ("https://www.edan.example.net/fr/12?page=2", 0),
    ("https://school.example/lessons/algebra", 0), ("https://travel.example/guides/mountain-hiking", 0),
    ("http://tionan.example.net/en/77.html", 0), ("https://m.erthen.example.com/es/310", 0), ("http://www.onblea.example.org/de/5", 0),
    ("https://ingha.example.com/en/9?utm_source=feed", 0), ("http://ndthou.example.net/fr/64#top", 0), ("https://readwin.example.com/es/8/", 0),
    ("https://blog.thonea.example.com/en/1", 0), ("https://blog.theres.example.org/en/1/", 0), ("https://ththere.example.com/en/1", 0), ("https://www.thenat.example.com/fr/1", 0),
    ("http://tionand.example.com/de/1.html", 0), ("https://m.therion.example.net/es/1/", 0), ("https://blog.ingthe.example.net/en/1?page=2", 0), ("http://blest.example.org/fr/1", 0),
    ("https://www.handly.example.com/en/1", 0), ("https://m.ouread.example.com/en/1.html", 0), ("http://blog.shean.example.net/de/1/", 0), ("https://stable.example.com/es/1", 0),
    ("https://sports.example/football/league-table", 0), ("https://music.example/reviews/symphony", 0),
    ("http://free-casino-bonus.example/slots/jackpot?aff=99", 1), ("http://xxx-hot-videos.example/adult/watch", 1),
    ("http://cheap-viagra-pills.example/buy-now", 1), ("http://best-poker-betting.example/casino/win-cash", 1),
    ("http://login-verify-account.example/paypal/secure-update", 1), ("http://porn-tube-free.example/xxx/sex", 1),
    ("http://crack-keygen-download.example/warez/full-version", 1), ("http://get-rich-quick.example/crypto-bonus/win", 1),
    ("http://replica-watches-sale.example/cheap/rolex", 1), ("http://escort-girls.example/sex/dating", 1),
    ("http://torrent-warez.example/download/crack", 1), ("http://win-free-prize.example/claim-now/bonus", 1),
    ("http://payday-loans-cash.example/apply-now", 1), ("http://online-pharmacy-pills.example/cialis/cheap", 1),
    ("http://adult-cams-live.example/xxx/girls", 1), ("http://bet-slots-jackpot.example/casino/spin", 1),
    ("http://seo-backlinks-cheap.example/buy/links", 1), ("http://verify-bank-login.example/secure/account-update", 1),
    ("http://ads-network.example.com/track/click", 1), ("http://www.adserver-tracking.example.net/ads/pixel", 1), ("http://click-track-ads.example.com/en/3", 1),
    ("http://spam-links.example.com/farm/page", 1), ("http://link-farm.example.net/spam/en/1", 1), ("http://m.casino-online.example.net/en/40", 1),
    ("https://free-bets-today.example.com/es/2", 1), ("http://sport-bets.example.org/en/12", 1), ("http://adult-x-videos.example.net/fr/9", 1), ("https://cheap-pills-shop.example.com/en/71", 1),
    ("https://blog.casino-slots.example.net/en/1", 1), ("http://www.spam-blast.example.org/es/1/", 1), ("https://m.ads-click.example.com/de/1", 1), ("http://blog.cheap-meds.example.net/fr/1.html", 1),
    ("https://adult-chat.example.com/en/1", 1), ("http://www.free-spins.example.com/en/1", 1), ("https://m.track-ads.example.com/en/1", 1), ("http://www.link-farm.example.org/en/1/", 1),
    ("http://blog.jackpot-casino.example.net/en/1.html", 1), ("https://adult-x.example.net/de/1", 1), ("https://blog.casino-bonus.example.com/es/1", 1), ("http://blog.win-casino.example.net/fr/1", 1), ("https://blog.online-pills.example.com/en/1", 1),
    ("http://hot-singles-dating.example/adult/chat", 1), ("http://free-gift-cards.example/claim/win-prize", 1),
]
BUCKETS, GRAMS = 1 << 14, (3, 4, 5)
_DIGITS = re.compile(r"[0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// up to /, ?, # or the end, A-Z lower-cased; path up to ?, # or the end. Null or no ://: both empty."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it, and whose path begins the url's; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and path, each marked by where it is, runs of digits as one 0; distinct buckets."""
    got = set()
    for mark, s in (("h", _DIGITS.sub("0", f"^{host}$")), ("p", _DIGITS.sub("0", f"^{path.lower()}$"))):
        for n in GRAMS:
            got.update(crc32((mark + s[i : i + n]).encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(s) - n + 1))
    return np.fromiter(got, np.int64, len(got))


def _split(url: str) -> tuple[str, str]:
    after = url.split("://", 1)[1]
    end = min([i for c in "/?#" if (i := after.find(c)) >= 0], default=len(after))
    path = after[end:]
    return after[:end].lower(), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def train(labelled=LABELLED, ridge: float = 0.02, steps: int = 400, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Gradient descent on the mean log loss with L2; features are scaled down by the root of their number, so long urls weigh as others."""
    xs = [grams(*_split(u)) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.array([w[x].sum() / np.sqrt(len(x)) for x in xs]) + b
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = ridge * w / len(y)
        for x, e in zip(xs, d):
            g[x] += e / np.sqrt(len(x))
        w -= rate * g
        b -= rate * d.sum()
    return w, b


def block_probability(host: str, path: str, w: np.ndarray, b: float) -> float:
    x = grams(host, path)
    return float(1 / (1 + np.exp(-(w[x].sum() / np.sqrt(max(1, len(x))) + b))))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (null where a rule decides).

    A null url, or one without ``://``, has an empty host and path, which fit no rule and are scored like others.
    Rows with equal or null ids are rows of their own, and urls may be of any length. Other columns are not looked at,
    whatever their names. An empty table gives no rows.
    """
    w, b = train(labelled)
    w = w.astype(np.float32)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path, rule in parts:
            yield pd.Series([None if r is not None else block_probability(h, p, w, b) for h, p, r in zip(host, path, rule)], dtype="float64")

    host, path = url_parts(column(url_col))
    rows = df.select(column(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("score", score("host", "path", "rule"))
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "score")
