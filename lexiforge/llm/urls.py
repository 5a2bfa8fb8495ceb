"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Everything is built-in column functions: parsing, n-grams, hashing, training and scoring.

The labelled table is small by contract (:data:`MAX_LABELLED` rows at most, checked), so training works in
the dual: the Gram matrix of the labelled URLs is one array value, gradient steps are a fold over it, and the
weights follow as the coefficient-weighted sum of the rows' n-grams. The weights are ``N_BUCKETS`` doubles
whatever the corpus, and become a literal in the scoring projection; scoring is scan and project, no shuffle.

The shipped labels are a starting point: a model knows the n-grams of its labels and says little of hosts with other
words, so a user passes labels of their own crawl.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
model's verdict for no n-grams; repeated rows are judged alike; clashing input columns are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import ascii_lower, let

N_BUCKETS = 8192
MAX_LABELLED = 1000
GRAM_SIZES = (3, 4, 5)


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"), UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"))

#: Labelled URLs (parameter of the filter), made up from the usual categories of public block lists (gambling, pharmacy,
#: adult, phishing, piracy, loans and replicas, advertising and spam) and from well-known kinds of sites. Both kinds have the
#: same top-level domains and shapes of paths, pages under a language and a number among them.
BLOCKED = """
royal-roulette.net/play  www.blackjackpalace.com/bonus  jackpot-city-slots.com/spin/3  onlinepoker777.net/table/12  mega-lottery-prize.org/claim
slotsjackpot.net/bonus-code  pokerroom-vip.com/deposit  baccarat-live.org/table  roulettebonus.net/bonus  sportswager.org/odds/today
buy-viagra-online.net/order  cialis-discount.org/cart  viagra-generic.com/buy  xanax-no-prescription.com/order  tramadol-overnight.org/checkout
discount-pharmacy-rx.com/order?id=3  steroids-shop.org/buy-now  weightloss-miracle.net/offer  viagrarx.com/order  miracle-diet-offer.com/order
porn-tube-hd.com/video/881  hotporn.org/clips  sexcam-live.net/room/7  escort-girls-vip.com/book  nude-webcams.net/live
pornvideos-hd.com/watch/12  eroticsex.org/gallery  m.sextube.com/watch  hentai-porn.net/watch  sexdating-now.com/join
secure-login-verify.com/paypal/update  account-verify-bank.net/signin.php  paypal-account-update.org/login  bank-login-secure.com/verify  wallet-restore-verify.net/seed
login-appleid-verify.org/update.php  webmail-account-verify.com/signin  secure-banking-update.net/login.php  verify-your-account.com/login  password-reset-secure.org/login
crack-keygen-download.net/serial  nulled-scripts.com/download  torrent-movies-hd.org/get/44  warez-download.net/crack  serial-keygen.com/patch
full-crack-software.org/download.exe  torrentcrack.net/setup.exe  keygen-patch.net/get  download-nulled.com/zip  moviestorrent.com/get
payday-loan-instant.org/apply  instant-loan-approval.com/apply  crypto-doubler.org/invest  bitcoin-profit-invest.com/register  forex-signals-profit.net/join
replica-watches-luxury.org/sale  luxury-replica-bags.com/buy  get-rich-profit.net/offer  make-money-fast.com/join  fake-diploma-buy.org/order
popunder-banner.com/click  clickbanner.org/redirect?u=9  banner-clicks.net/impression.gif  redirect-popunder.net/click  pixel-beacon.org/p.gif
online-casino-bonus.com/play  grand-casino-club.org/en/14  cheap-pills-shop.net/order  diet-pills-store.com/es/9  adult-dating-site.com/join
adult-videos-free.net/de/301  ads-network-track.com/click  popup-ads-server.net/en/7  spam-mailer-tool.org/lists  bulk-spam-lists.com/fr/52
mega-slots-win.com/de/18  viagra-express.net/en/220  free-sex-chat.com/fr/6  verify-login-bank.org/en/31  crack-software-full.net/es/404
instant-payday-cash.com/en/5  rolex-replica-store.net/fr/83  seo-links-cheap.org/de/62  poker-bonus-club.net/es/27  webcam-girls-online.com/en/19
backlinks-seo-buy.com/order  seo-backlinks.org/buy  bulkmailer-seo.net/lists  buy-followers-likes.com/order  likes-followers.org/instagram
""".split()
ALLOWED = """
en.wikipedia.org/wiki/River  de.wikipedia.org/wiki/Berlin  fr.wikipedia.org/wiki/Fromage  docs.python.org/3/library/json.html  spark.apache.org/docs/latest
www.nasa.gov/missions/voyager  www.bbc.co.uk/news/world-europe  www.nytimes.com/2021/05/04/arts  www.lemonde.fr/culture/article/2020  elpais.com/ciencia/2019-03-11
stackoverflow.com/questions/11227809  github.com/numpy/numpy/issues/12  arxiv.org/abs/1706.03762  www.nature.com/articles/d41586  www.gutenberg.org/ebooks/1342
www.stadt-zuerich.ch/de/leben  www.deutsche-bahn.de/fahrplan  www.bundestag.de/parlament  www.sueddeutsche.de/wissen/mond  www.spiegel.de/kultur/literatur
www.service-public.fr/particuliers  www.louvre.fr/en/explore  www.larousse.fr/dictionnaires  meteofrance.com/previsions  www.radiofrance.fr/musique
www.rae.es/diccionario  www.museodelprado.es/coleccion  www.uned.es/estudios  www.madrid.es/transporte  www.cervantes.es/cultura/12
university.edu/physics/lecture-notes  library.city.gov/catalog/search  www.museum.org/exhibits/rome  blog.gardener.net/roses/pruning  kitchenrecipes.com/soup/onion
weather.gov/forecast/boston  history-society.org/archive/1848  chess-club.net/openings/sicilian  forum.woodworking.com/thread/881  news.localpaper.com/council-meeting
school-district.org/calendar  www.hospital.org/patients/visit  engineering-handbook.net/beams  travelnotes.com/portugal/lisbon  bookreviews.net/novels/2018
opendata.city.org/tables/population  developer.mozilla.org/en-US/docs/Web  kernel.org/doc/html/latest  www.who.int/health-topics  europa.eu/legislation/2016
birdwatching.org/species/heron  maps.hiking.net/trail/17  orchestra.org/season/brahms  www.theatre.com/tickets/hamlet  geology.museum.edu/minerals/7
m.railways.net/timetable/3  www.gardencentre.co.uk/plants  teaching-resources.net/maths/fractions  poetry-archive.org/poem/29  astronomy.net/en/planets/5
www.bakery.de/brot/rezepte  www.wanderverein.de/touren/14  www.buchhandlung.de/romane  www.jardin.fr/fleurs/9  www.randonnee.fr/sentiers/22
www.cocina.es/recetas/31  www.biblioteca.es/libros/45  www.senderos.es/rutas/6  blog.photographer.net/landscape/88  m.newspaper.org/opinion/402
www.furniture-store.com/de/3312  m.cityguide.com/fr/88  shop.outdoorgear.com/en/1207  hotel-lakeside.com/es/14  www.airline.com/en/flights/22
support.printer.com/fr/manuals/9  www.carmuseum.com/de/77  blog.teacher.com/en/301  www.furnace-repair.net/contact  parents.schoolnet.net/fr/45
www.city-orchestra.org/en/19  alpine-club.net/fr/62  m.bookshop.com/de/403.html  www.old-town-museum.com/en/118  riverside-school.net/es/7
""".split()

#: The smallest multiple of 0.05 at which no wanted URL is blocked when the labels are split in five: wanted pages matter more.
THRESHOLD = 0.8


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as the rules see them."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(found, pattern, 1)), F.regexp_extract(found, pattern, 2)


def hashed_grams(host: Column, path: Column, buckets: int = N_BUCKETS) -> Column:
    """The distinct buckets of the n-grams of host and of path; the two never share an n-gram."""

    def grams(text: Column, mark: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        of_size = lambda s, n: F.when(
            F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substring(s, i, F.lit(n))))
        ).otherwise(F.array().cast("array<string>"))
        return F.when(text == "", F.array().cast("array<string>")).otherwise(let(padded, lambda s: F.concat(*[of_size(s, n) for n in GRAM_SIZES])))

    return F.array_distinct(F.transform(F.concat(grams(host, "h"), grams(path, "p")), lambda g: (F.crc32(g) % buckets).cast("int")))


def labelled_urls(spark: SparkSession, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED) -> DataFrame:
    """(url, label): label 1 is unwanted."""
    rows = [(f"http://{u}", 1) for u in blocked] + [(f"http://{u}", 0) for u in allowed]
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled URL table is small by contract: at most {MAX_LABELLED} rows")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows])))


def train(labelled: DataFrame, steps: int = 400, rate: float = 8.0, decay: float = 0.0002, buckets: int = N_BUCKETS) -> list[float]:
    """Weights of the hashed n-grams, and the bias last, by gradient descent on the logistic loss.

    Step: a ← a − rate·((σ(Ka) − y)/n + decay·a), where K is the kernel of unit-length n-gram vectors plus one.
    """
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled rows")
    host, path = parse_url(F.col("url"))
    rows = labelled.select(hashed_grams(host, path, buckets).alias("x"), F.col("label").cast("double").alias("y"), "url")
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("rows"))
    dot = lambda p, q: F.size(F.array_intersect(p["x"], q["x"])) / F.sqrt((F.size(p["x"]) * F.size(q["x"])).cast("double")) + 1
    gram = F.transform("rows", lambda p: F.transform(F.col("rows"), lambda q: dot(p, q)))

    def descend(k: Column) -> Column:  # k is bound once, not computed anew in each step
        def step(a: Column, _: Column) -> Column:
            margin = lambda row: F.aggregate(F.zip_with(row, a, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
            miss = lambda row, i: 1 / (1 + F.exp(-margin(row))) - F.get(F.col("rows"), i)["y"]
            return F.transform(k, lambda row, i: F.get(a, i) - rate * (miss(row, i) / F.size("rows") + decay * F.get(a, i)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("rows", lambda _: F.lit(0.0)), step)

    solved = one.select("rows", let(gram, descend).alias("a"))
    each = solved.select(F.posexplode("rows").alias("i", "row"), "a").select(F.col("row.x").alias("x"), F.get("a", F.col("i")).alias("a"))
    share = F.col("a") / F.sqrt(F.size("x").cast("double"))
    parts = each.select(F.explode("x").alias("b"), share.alias("w")).union(each.select(F.lit(buckets).alias("b"), F.col("a").alias("w")))
    found = {r["b"]: r["w"] for r in parts.groupBy("b").agg(F.sum("w").alias("w")).collect()}  # at most buckets + 1 rows
    return [found.get(b, 0.0) for b in range(buckets + 1)]


def block_probability(host: Column, path: Column, weights: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in weights[:-1])), ",").cast("array<double>")  # folded into one literal
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-(let(hashed_grams(host, path, len(weights) - 1), total) + F.lit(weights[-1]))))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Ties: the longer host, then block."""
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict == "allow"))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(order):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_filter(df: DataFrame, weights: list[float], url: str = "url", rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with host, path, rule, probability (of an unwanted page) and verdict."""
    new = ("host", "path", "rule", "probability", "verdict", "_rule")
    host, path = parse_url(F.col(url))
    out = df.select(*[c for c in df.columns if c not in new], host.alias("host"), path.alias("path"))
    out = out.withColumns({"_rule": longest_rule(F.col("host"), F.col("path"), rules), "probability": block_probability(F.col("host"), F.col("path"), weights)})
    judged = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), judged)}).drop("_rule")


def op2_url_filter(pages: DataFrame) -> DataFrame:
    weights = train(labelled_urls(pages.sparkSession))
    return url_filter(pages.select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict", "probability")


def reference_weights(rows: list[tuple[list[int], float]], steps: int = 400, rate: float = 8.0, decay: float = 0.0002, buckets: int = N_BUCKETS) -> list[float]:
    """The same training in plain Python over (buckets, label) rows; the tests hold :func:`train` against it."""
    n = len(rows)
    k = [[len(set(p) & set(q)) / math.sqrt(len(p) * len(q)) + 1 for q, _ in rows] for p, _ in rows]
    a = [0.0] * n
    for _ in range(steps):
        miss = [1 / (1 + math.exp(-sum(x * y for x, y in zip(row, a, strict=True)))) - rows[i][1] for i, row in enumerate(k)]
        a = [v - rate * (m / n + decay * v) for v, m in zip(a, miss, strict=True)]
    w = [0.0] * (buckets + 1)
    for (x, _), v in zip(rows, a, strict=True):
        w[-1] += v
        for b in x:
            w[b] += v / math.sqrt(len(x))
    return w
