"""URL verdicts: host and path rules first, else a logistic regression on hashed character n-grams.

The regression is trained from a small labelled URL table (``LABELLED`` unless the caller brings one; at most
``MAX_LABELLED`` rows are allowed, more is an error and never a silent cut). Features are the distinct 3- to
5-grams of ``host`` and of ``path``, hashed to 2^18 slots, so a model is one array of fixed size.

Defined results: a null url, or one without "://", has empty host and path, matches no rule and gets the method's
verdict for an empty url (allow). Rows are independent, so repeated rows come back repeated and an empty table gives an
empty table; a null page id is kept; other columns are ignored. Of two equally long rules the first in order wins. Long
urls are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled table, 1 for unwanted.
LABELLED = (
    ("http://spam-farm.example.org/en/12", 1), ("https://spam-farm.example.com/fr/4?page=2", 1), ("http://spamfarm.test/buy-now", 1),
    ("http://cheap-pills.example.com/en/450", 1), ("https://www.cheap-pills.example.org/de/7", 1), ("http://cheappills.test/order", 1),
    ("https://best-casino-bonus.test/free-spins", 1), ("http://online-casino.example.com/slots/1", 1), ("http://casino-royal.test/jackpot", 1),
    ("http://adult-videos.test/xxx/1", 1), ("https://xxx-cams.example.org/live", 1), ("http://hot-singles.test/chat-now", 1),
    ("http://free-download-crack.test/keygen.exe", 1), ("https://warez-torrents.test/crack/55", 1), ("http://serial-keygen.example.com/get", 1),
    ("http://payday-loans-fast.test/apply", 1), ("https://get-rich-quick.test/money", 1), ("http://win-free-phone.test/prize?claim=1", 1),
    ("http://replica-watches.test/cheap/rolex", 1), ("https://buy-followers.test/cheap-likes", 1), ("http://seo-links-farm.test/backlinks", 1),
    ("http://click-here-now.test/ads/redirect?u=5", 1), ("https://malware-update.test/flash-player.exe", 1), ("http://phish-login.test/verify-account", 1),
    ("http://viagra-store.test/pills/discount", 1), ("http://diet-pills-online.test/buy", 1), ("https://betting-tips-win.test/odds", 1),
    ("http://junk-mirror.example.net/spam/9", 1), ("http://link-farm.example.org/index.html", 1), ("https://ad-tracker.test/pixel/popunder", 1),
    ("http://free-bets.test/en/odds", 1), ("https://m.free-bets.test/today", 1), ("https://m.ads-track.test/click", 1), ("http://ads-track.test/en/9", 1),
    ("https://m.casino-win.test/en/1", 1), ("http://casino-win.test/slots", 1), ("https://blog.adult-x.test/fr/3", 1), ("http://adult-x.test/gallery", 1),
    ("https://www.example.com/en/148.html", 0), ("http://blog.example.org/de/612", 0), ("https://m.example.net/fr/25#top", 0),
    ("https://news.example.com/en/2024/story-17", 0), ("http://library.example.org/catalogue/88", 0), ("https://docs.example.net/guide/install", 0),
    ("https://university.test/research/papers/12", 0), ("http://museum.test/exhibitions/autumn", 0), ("https://weather.test/city/paris", 0),
    ("https://recipes.test/soup/tomato", 0), ("http://gardening.test/roses/pruning", 0), ("https://forum.test/thread/5521", 0),
    ("https://wiki.test/article/History_of_glass", 0), ("http://journal.test/volume/3/issue/2", 0), ("https://school.test/lessons/algebra", 0),
    ("https://www.theren.example.com/en/77", 0), ("http://therin.example.org/es/676", 0), ("https://blog.thther.example.com/fr/853/", 0),
    ("https://m.tiontion.example.org/de/9?utm_source=feed", 0), ("http://ththan.example.com/en/960", 0), ("https://ththed.example.org/en/453#top", 0),
    ("https://travel.test/guides/lisbon", 0), ("http://health.test/advice/sleep", 0), ("https://science.test/physics/light", 0),
    ("https://parliament.test/bills/2023/44", 0), ("http://orchestra.test/concerts/may", 0), ("https://code.test/project/readme", 0),
    ("https://photos.test/album/mountains", 0), ("http://chess.test/openings/london", 0), ("https://cycling.test/routes/coast", 0),
)
MAX_LABELLED = 10_000
SLOTS = 1 << 18
Labelled = Sequence[tuple[str, int]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between "://" and the next "/", "?" or "#" (A-Z lower-cased), and from there to "?" or "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """A struct of verdict and rule text, null where no rule fits."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def slots_of(host: str, path: str) -> np.ndarray:
    grams = {f"{part}{text[i:i + n]}" for part, text in (("h:", f"^{host}$"), ("p:", f"^{path}$")) for n in (3, 4, 5) for i in range(len(text) - n + 1)}
    return np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) % SLOTS for g in grams), np.int64, len(grams))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    tail = rest[cut:]
    end = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def fit(labelled: Labelled = LABELLED, rounds: int = 400, rate: float = 2.0, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on unit-length rows; the table is small, so this is milliseconds."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table has {len(labelled)} rows; {MAX_LABELLED} are allowed")
    rows = [(slots_of(*_split(url)), label) for url, label in labelled if url is not None and label is not None]
    rows = [(s, y) for s, y in rows if len(s)]
    weights, bias = np.zeros(SLOTS), 0.0
    if len({y for _, y in rows}) < 2:
        return weights, -1.0 if not any(y for _, y in rows) else 1.0
    flat = np.concatenate([s for s, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    unit = (1 / np.sqrt(np.bincount(row)))[row]
    y = np.array([y for _, y in rows], float)
    used, column = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, unit * w[column]) + bias)))
        w -= rate * (np.bincount(column, unit * (p - y)[row], len(used)) + penalty * w)
        bias -= rate * (p - y).mean()
    weights[used] = w
    return weights, bias


def judge_urls(pages: DataFrame, labelled: Labelled = LABELLED, rules: Sequence[tuple[str, str, str]] = RULES,
               threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score for every row; a rule that fits decides alone."""
    weights, bias = fit(labelled)
    used = np.flatnonzero(weights)
    small = (used.astype(np.int32), weights[used].astype(np.float32))  # what tasks get: non-zero weights only

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.zeros(SLOTS)
        full[small[0]] = small[1]
        for batch in batches:
            margins = []
            for host, path in zip(batch["host"], batch["path"], strict=True):
                slots = slots_of(host, path) if host or path else []
                margins.append(full[slots].sum() / np.sqrt(len(slots)) + bias if len(slots) else -np.inf)
            yield batch.assign(score=1 / (1 + np.exp(-np.array(margins, float))))

    url = F.col("url")
    host, path = host_and_path(url)
    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    scored = narrow.mapInPandas(score, "page_id long, host string, path string, score double")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("hit", rule).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
