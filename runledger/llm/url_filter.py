"""URL filters (operator 11), in DataFrame functions and Spark ML only.

Rules come first: a rule (host, path, verdict) fits its host and all subdomains where the
url's path starts with the rule's; the longest rule decides. Any other url is judged by a
logistic regression on hashed character n-grams of host and path, trained from a small
labelled URL table: host and path are hashed apart (3 to 5 characters, with marks at both
ends) and each scaled to length one, so a long path can't outvote the host.

The table is a parameter (url, label; label 1 is block). The default one is made of names
written by hand, sites of the kinds that web corpora drop and ordinary ones. It is the only data
that the model learns from, so training costs the same whatever the size of the pages, and
scoring is one narrow pass over the urls: no shuffle, nothing on the driver but the weights
(2 * 2^BITS doubles, 128 kB).

Defined cases: a null url or one without ``://`` has empty host and path, no n-gram and no
rule, and gets the verdict of the model's intercept; the host keeps a port or user name that
the url gives; very long urls cost time in proportion to their length; repeated rows are
judged alike; null page_id stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# The rules of the query, as (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# Names of sites to block and to let through, and the same of paths.
BLOCK_SITES = """
casino-royal mega-casino online-casino-bonus lucky-spin win-big-slots poker-win bingo-jackpot sports-betting-tips best-bets bets-online free-spins roulette-winner
lotto-win gambling-hub slot-machines win-casino betwin buy-pills-online cheap-meds pills-discount cheap-viagra pharmacy-no-prescription diet-pills weight-loss-miracle
cheap-watches replica-bags discount-outlet cheap-loans payday-loan-fast instant-credit quick-cash-now earn-money-fast get-rich-quick crypto-doubler free-bitcoin forex-profits
mlm-income spam-links link-farm seo-spam backlinks-cheap content-farm article-spinner keyword-stuffing doorway-pages scraper-farm spam-blog spamsite ads-server
tracking-pixel ad-track popunder-ads click-tracker banner-ads adclick-network affiliate-track tracker-ads popup-adserver xxx-videos adult-cams hot-singles porn-tube
sex-dating nude-pics escort-directory adult-xxx live-sex free-porn free-ringtones warez-crack torrent-free free-download-crack serial-keys free-gift-cards you-won-prize
survey-rewards free-iphone prize-winner miracle-cure phish-login account-verify-now fake-news-daily
""".split()
ALLOW_SITES = """
city-library history-museum river-news garden-notes science-weekly open-tools university town-council weather-report recipes math-lectures physics-notes language-school
travel-stories bird-watch mountain-hikes school-board health-institute public-radio music-archive theatre-review national-park chess-club film-journal book-reviews astronomy
programming data-handbook law-review economics open-source kernel-notes cooking-class local-history ocean-research teacher-forum the-morning-post railway-times farm-museum
winter-sports alphabet-books betty-bakery cash-register-history trackside-athletics adventure-diary thornton therapy-notes northern-shore thistle tinsmith stonehouse ethereal
threshold inland harbour whetstone tonight heather entire sherwood lantern tithe anthem thirteen roundhouse another tension ration whither southern listen stable nation
rather thermal adultery-law-history freedom-of-press freestone windmill window-makers slotted-spoons pixel-art link-road thinkers clothing-makers something-new anything
""".split()
BLOCK_PATHS = "casino/bonus buy-pills/order payday-loan/apply free-spins/claim xxx/videos cheap-viagra win-prize/now click/track?id=1".split()
ALLOW_PATHS = "news/report docs/install article/history about guide/chapter library/catalog science/physics weather/today".split()
# How a site is written. Every name has all forms, so no form tells the label.
FORMS = ["http://{}.test/en/12", "https://www.{}.example.com/de/853/", "http://m.{}.example.net/es/40.html", "https://blog.{}.example.org/fr/7?page=2", "https://{}.example/", "http://{}.example.net/en/6021", "https://{}.invalid/a/b"]
PATH_FORMS = ["http://site.test/{}", "https://www.home.example.com/en/{}", "https://blog.page.example.net/{}/7"]

GRAMS, BITS = (3, 4, 5), 13
SCHEMA = "url string, label double"


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: every name in every form, about 1,200 urls, in one
    partition so that training adds up in one order."""
    rows = [(f.format(n), label) for forms, names, label in ((FORMS, BLOCK_SITES, 1.0), (FORMS, ALLOW_SITES, 0.0), (PATH_FORMS, BLOCK_PATHS, 1.0), (PATH_FORMS, ALLOW_PATHS, 0.0)) for n in names for f in forms]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for of, begin, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begin)
        name, verdict = F.when(fits, of + begin).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """All n-grams of the text between its marks; a match takes one character and looks ahead,
    so a long text costs one pass for each n."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    found = [F.regexp_extract_all(marked, F.lit(rf"(?s)(?=(.{{{n}}})).")) for n in GRAMS]
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*found))


def _features(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = urls.withColumns({"host": host, "path": path})
    return rows.withColumns({"host_grams": grams(F.col("host")), "path_grams": grams(F.col("path"))})


def train(labelled: DataFrame) -> PipelineModel:
    """Model of labelled urls (url, label); rows with a null label are left out."""
    stages = []
    for part in ("host", "path"):
        stages.append(HashingTF(inputCol=f"{part}_grams", outputCol=f"{part}_tf", numFeatures=1 << BITS, binary=True))
        stages.append(Normalizer(inputCol=f"{part}_tf", outputCol=f"{part}_unit", p=2.0))
    stages.append(VectorAssembler(inputCols=["host_unit", "path_unit"], outputCol="features"))
    stages.append(LogisticRegression(maxIter=100, regParam=0.0003, standardization=False))
    return Pipeline(stages=stages).fit(_features(labelled.where("label is not null").select("url", "label")))


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) per row."""
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = model.transform(_features(pages.select("page_id", "url")))
    score = vector_to_array("probability")[1]
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    learned = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", score.alias("score")).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "score")


def allowed(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The rows of ``pages`` (all columns, url among them) that are let through."""
    own = pages.columns
    kept = [f"page_{i}" for i in range(len(own))]  # other names than those the model adds
    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(own, kept)], F.col("url"))
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    _, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    score = vector_to_array("probability")[1]
    rows = model.transform(_features(rows)).where(F.coalesce(verdict, F.when(score >= 0.5, "block").otherwise("allow")) == "allow")
    return rows.select(*[F.col(k).alias(c) for c, k in zip(own, kept)])
