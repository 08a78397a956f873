"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

A url is cut into host and path. The longest rule whose host is the url's or a
parent of it and whose path starts the url's path decides; where none fits, a
logistic regression over hashed character n-grams (2 to 5) of host and path
does, trained from a small labelled table of urls that is a parameter.

Defined results: a null url, or one without "://", has an empty host and path
and no rule, and is judged by the model on empty strings; rows are judged one by
one, so repeated rows and ids each have their own, and an empty table gives none;
urls of any length are read whole; of the table page_id and url are looked at, and
other columns, whatever their names, aren't returned. Hosts keep ports and user
names, as they stand between "://" and the path.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BUCKETS = 1 << 14
GRAMS = (2, 3, 4, 5)
#: The share of unwanted urls that is expected, whatever their share of the labelled table.
UNWANTED = 0.3
#: A url is blocked from this probability.
THRESHOLD = 0.5


#: Names of known sites of general use, and what their paths look like.
ORDINARY = """wikipedia.org/wiki/Main_Page github.com/apache/spark bbc.co.uk/news/world python.org/doc nytimes.com/section/science
stackoverflow.com/questions/4251 archive.org/details/texts arxiv.org/abs/1706.03762 nasa.gov/missions nih.gov/health-information
who.int/news-room/fact-sheets europa.eu/documents mit.edu/research ox.ac.uk/admissions spiegel.de/politik lemonde.fr/culture
elpais.com/deportes theguardian.com/books nature.com/articles sciencedirect.com/journal imdb.com/title/tt0111161 goodreads.com/book/show
allrecipes.com/recipe/bread khanacademy.org/math coursera.org/learn mozilla.org/firefox debian.org/releases kernel.org/doc gnu.org/licenses
wordpress.org/plugins medium.com/story reddit.com/r/askscience quora.com/topic youtube.com/watch vimeo.com/staffpicks flickr.com/photos
openstreetmap.org/map weather.gov/forecast noaa.gov/climate cdc.gov/vaccines epa.gov/water usgs.gov/earthquakes loc.gov/collections
si.edu/museums metmuseum.org/art louvre.fr/visiter rijksmuseum.nl/collectie britannica.com/topic merriam-webster.com/dictionary
city-library.net/hours garden-club.org/events open-data.net/sets school-district.org/calendar trail-maps.com/hikes book-review.net/fiction
health-clinic.org/contact music-lessons.net/piano small-town-news.com/local dictionary.com/browse etsy.com/shop ebay.com/itm amazon.com/gp/help ikea.com/catalog bahn.de/fahrplan sncf.com/horaires""".split()
#: Invented hosts of the kinds that are unwanted: gambling, adult, pills, pirated goods, fraud, malware, advertising.
UNWANTED_SITES = """best-casino-slots.com/bonus online-poker-win.net/play sportsbet-king.com/odds jackpot-spins.org/free roulette777.net/register
bingo-bonus-now.com/signup xxx-tube.net/videos free-porn-clips.com/hd sex-cams-live.com/room adult-friend-dates.net/join hot-escorts.org/city
naked-girls.net/gallery pr0n-hub.org/watch milf-videos.com/new cheap-viagra-pills.com/order buy-cialis-online.net/cart rx-meds-store.com/discount
weightloss-miracle-pills.com/buy steroids-shop.net/checkout replica-watches-sale.com/rolex fake-ids-now.net/order cracked-software-keygen.com/download
warez-torrents.net/full free-movies-pirate.org/stream serial-key-crack.com/get nulled-scripts.net/php secure-login-paypa1.com/verify
account-verify-bank.net/update appleid-unlock-alert.com/signin win-free-iphone.net/claim prize-winner-claim.com/survey lottery-payout.org/transfer
crypto-double-profit.com/invest quick-payday-loans.net/apply make-money-fast-now.com/join forex-signals-rich.net/vip miracle-credit-repair.com/start
trojan-installer.net/setup.exe flash-update-codec.com/install malware-dropper.org/payload free-ringtones-toolbar.net/download pc-speedup-cleaner.com/scan
adclick-tracker.net/go banner-adserver.com/impression popunder-ads.net/redirect pixel-tracker.org/collect clickbank-affiliate-ads.com/ref spam-blast-mailer.com/send
seo-backlinks-cheap.net/buy buy-followers-likes.com/instagram""".split()


#: Words of either kind, which stand in names of the same shapes.
UNWANTED_WORDS = "casino poker slots bets bingo jackpot porn xxx sex adult escort cams viagra cialis pills steroids replica warez crack keygen torrent phish malware trojan spam popup ads tracker loan lottery".split()
ORDINARY_WORDS = "library school garden museum music recipes travel science history weather city health sports forum books maps docs wiki news hospital kitchen cycling theater gallery physics parks council archive courses radio".split()
SHAPES = ("{}", "{}-online", "best-{}", "my{}", "{}24", "{}-club", "{}world", "free{}")


def labelled_urls() -> pd.DataFrame:
    """The small labelled table (host, path, block): sites and words, all under common first and last names, which so say nothing."""
    rows = []
    for sites, words, y in ((ORDINARY, ORDINARY_WORDS, 0), (UNWANTED_SITES, UNWANTED_WORDS, 1)):
        for url in sites:
            host, _, path = url.partition("/")
            name = host.rpartition(".")[0]
            rows += [(sub + h, "/" + path, y) for sub in ("", "www.") for h in dict.fromkeys([host, *(f"{name}.{top}" for top in ("com", "net", "org"))])]
        rows += [(f"{shape.format(w)}.{top}", "/", y) for w in words for shape in SHAPES for top in ("com", "net", "org")]
    return pd.DataFrame([*rows, ("", "", 0)], columns=["host", "path", "block"])


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each hashed n-gram; digits of a path count as one character."""
    rows, keys = [], []
    for kind, values in ((1, hosts), (2, paths)):
        raw = [np.frombuffer(f"^{v}$".encode("utf-8", "surrogatepass"), np.uint8) for v in values]
        n = np.array([len(r) for r in raw], np.int64)
        flat = np.concatenate(raw).astype(np.uint64) if raw else np.empty(0, np.uint64)
        if kind == 2:
            flat = np.where((flat >= 48) & (flat <= 57), np.uint64(48), flat)
        doc = np.repeat(np.arange(len(raw)), n)
        key = np.full(len(flat), np.uint64(kind), np.uint64)
        for size in range(1, max(GRAMS) + 1):
            if size > len(flat):
                break
            key = key[: len(flat) - size + 1] * np.uint64(0x100000001B3) + flat[size - 1 :] + np.uint64(size)
            if size in GRAMS:
                inside = doc[: len(key)] == doc[size - 1 :]
                rows.append(doc[: len(key)][inside])
                keys.append((key[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50))
    return (np.concatenate(rows), np.concatenate(keys).astype(np.int64)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class Model:
    def __init__(self, labelled: pd.DataFrame, epochs: int = 300, rate: float = 0.5, penalty: float = 1e-4):
        rows, keys = features(labelled.host.tolist(), labelled.path.tolist())
        y = labelled.block.to_numpy(float)
        n = np.bincount(rows, minlength=len(y)).astype(float)
        value = 1 / np.sqrt(n[rows])
        share = np.where(y == 1, UNWANTED / max(1, y.sum()), (1 - UNWANTED) / max(1, (1 - y).sum()))
        self.w, self.b = np.zeros(BUCKETS), 0.0
        speed, speed_b = np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(epochs):  # full-batch AdaGrad: the table is small
            g = (self.of(rows, value, keys, len(y)) - y) * share
            grad = np.bincount(keys, g[rows] * value, minlength=BUCKETS) + penalty * self.w
            speed += grad**2
            speed_b += g.sum() ** 2
            self.w -= rate * grad / np.sqrt(speed)
            self.b -= rate * g.sum() / np.sqrt(speed_b)

    def of(self, rows: np.ndarray, value: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        x = np.bincount(rows, self.w[keys] * value, minlength=n) + self.b
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def block(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that a url is unwanted."""
        rows, keys = features(hosts, paths)
        n = np.bincount(rows, minlength=len(hosts)).astype(float)
        return self.of(rows, 1 / np.sqrt(n[rows]), keys, len(hosts))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def judge(pages: DataFrame, rules=RULES, labelled: pd.DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the model's probability)."""
    model = Model(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = host_and_path(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))

    def run(batches):
        for b in batches:
            p = shared.value.block(column(b, "host").to_pylist(), column(b, "path").to_pylist())
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("page_id", "host", "path")), pa.array(p)], ["page_id", "host", "path", "p_block"])

    judged = cut.mapInArrow(run, f"page_id {cut.schema['page_id'].dataType.simpleString()}, host string, path string, p_block double")
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = None
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, verdict) if said is None else said.when(F.col("rule") == rule, verdict)
    model_says = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", (said.otherwise(model_says) if said is not None else model_says).alias("verdict"), "p_block")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with its rule and verdict."""
    return judge(table(spark, sf_dir, "pages"))
