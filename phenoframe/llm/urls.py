"""Verdicts on URLs: host and path rules first, else a ranking learnt from labelled URLs.

The learnt part is a logistic regression on hashed character n-grams of host and path. Grams,
training steps and scores are column expressions; the driver only holds the weights, of which
there are ``BUCKETS``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenoframe.scale.bounds import materialised

ORDERS = (3, 4)  # lengths of the n-grams
BUCKETS = 1 << 14
STEPS = 25
PENALTY = 1e-3
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# A small labelled table: names and paths that filters commonly block or let pass.
BLOCKED_URLS = """
http://casino-royal.example.com/bonus http://www.mega-casino.example.org/en/slots http://online-casino.example.net/play
http://casino-spins.example.com/en/14 https://win-big-casino.example.org/es/9 http://lucky-win.example.com/jackpot
https://free-spins.example.org/en/3 http://best-bets.example.com/en/55.html https://sport-bets.example.org/de/7
http://bets-online.example.net/fr/21 http://m.live-bets.example.com/es/8 https://free-poker.example.com/en/77
http://poker-win.example.org/fr/12/ http://cheap-meds.example.com/en/18 https://cheap-viagra.example.org/en/44
http://pills-online.example.com/de/5 https://diet-pills.example.net/en/31 http://www.cheap-loans.example.org/en/6
http://blog.discount-pills.example.com/fr/90 https://adult-video.example.com/en/1 http://adult-chat.example.org/es/33
https://m.adult-cams.example.com/en/48 http://xxx-adult.example.net/de/2 https://hot-xxx.example.org/en/71
http://spam-links.example.com/en/25 https://link-farm.example.org/en/80 http://seo-farm.example.com/fr/64
https://www.spam-mail.example.net/en/11 http://article-farm.example.org/es/39 https://ads-server.example.com/en/50
http://click-track.example.org/en/93 https://track-ads.example.com/de/28 http://ads-click.example.net/en/60
https://pop-ads.example.org/fr/17 http://adserver.example.com/banner/ad.js http://tracker.example.org/pixel.gif
https://free-money.example.com/en/4 http://get-rich-fast.example.org/en/15 http://warez-crack.example.com/keygen
https://serial-crack.example.org/en/29 http://free-download-crack.example.net/en/70 http://phish-login.example.com/verify
"""
ALLOWED_URLS = """
http://news.example.com/en/14 https://www.library.example.org/en/books http://school.example.net/courses
http://weather.example.com/en/55.html https://museum.example.org/es/9 http://city-council.example.com/parks
https://science.example.org/en/3 http://history.example.com/en/77 https://recipes.example.org/de/7
http://garden.example.net/fr/21 http://m.travel.example.com/es/8 https://music.example.com/en/18
http://theatre.example.org/fr/12/ http://health.example.com/en/44 https://university.example.org/en/31
http://there.example.com/de/5 https://thesis.example.net/en/6 http://www.nation.example.org/en/90
http://blog.station.example.com/fr/1 https://other.example.com/en/33 http://thread.example.org/es/48
https://m.weather.example.com/en/2 http://mother.example.net/de/71 https://thing.example.org/en/25
http://think.example.com/en/80 https://father.example.org/en/64 http://earth.example.com/fr/11
https://www.north.example.net/en/39 http://truth.example.org/es/50 https://health-care.example.com/en/93
http://blog.together.example.org/en/28 https://theory.example.com/de/60 http://action.example.net/en/17
https://blog.portion.example.org/fr/4 http://forum.example.com/topic/15 http://docs.example.org/manual/index.html
https://wiki.example.com/en/29 http://maps.example.org/en/70 http://sport.example.net/en/16 http://open-data.example.com/sets
https://open-source.example.org/en/26 http://m.radio.example.com/live http://www.author.example.com/fr/30
https://blog.throne.example.com/fr/85 http://www.thorn.example.org/fr/52/ https://m.thirst.example.com/fr/19.html
http://www.forest.example.com/es/10 https://thrush.example.org/de/41 http://blog.thunder.example.com/de/13
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, blocked)`` from the lists above."""
    rows = [(u, 1) for u in BLOCKED_URLS.split()] + [(u, 0) for u in ALLOWED_URLS.split()]
    return spark.createDataFrame(rows, "url string, blocked int")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``(rule, verdict)`` of the longest fitting rule, else null.

    Rules are ``(verdict, "host/path")``. They are looked up by the last labels of the host, so
    the work per URL depends on the labels of a rule's host, not on the number of rules.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((rule, slash + rest, verdict))
    fits = []
    for name_labels in sorted({name.count(".") + 1 for name in by_host}, reverse=True):
        names = {k: v for k, v in by_host.items() if k.count(".") + 1 == name_labels}
        table = F.create_map(
            *[
                c
                for name, entries in names.items()
                for c in (
                    F.lit(name),
                    F.array(
                        *[
                            F.struct(
                                F.lit(len(rule)).alias("size"),
                                F.lit(name_labels).alias("labels"),
                                F.lit(rule).alias("rule"),
                                F.lit(start).alias("path"),
                                F.lit(verdict).alias("verdict"),
                            )
                            for rule, start, verdict in entries
                        ]
                    ),
                )
            ]
        )
        here = F.try_element_at(table, F.substring_index(host, ".", -name_labels))
        fits.append(F.filter(F.coalesce(here, F.array()), lambda r: path.startswith(r["path"])))
    return F.array_max(F.flatten(F.array(*fits))) if fits else F.lit(None)


def buckets(kind: str, text: Column) -> Column:
    """Different buckets of the character n-grams of a text; digits count as one character."""
    plain = F.regexp_replace(text, "[0-9]", "0")
    marked = F.when(F.length(plain) > 0, F.concat(F.lit("<"), plain, F.lit(">"))).otherwise("")
    grams = [F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in ORDERS]
    hashed = F.transform(F.concat(*grams), lambda g: F.pmod(F.xxhash64(F.lit(kind), g), F.lit(BUCKETS)).cast("int"))
    return F.array_distinct(hashed)


def with_buckets(rows: DataFrame, host: Column, path: Column) -> DataFrame:
    return rows.withColumn("_h", buckets("host", host)).withColumn("_p", buckets("path", path))


def margin(weights: Column) -> Column:
    """Weights of the grams of host and path, each list scaled to length one."""

    def part(name: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda s, b: s + F.get(weights, b))
        return total / F.sqrt(F.greatest(F.size(name), F.lit(1)))

    return part("_h") + part("_p")


def weight_column(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def fit_weights(
    labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", steps: int = STEPS, penalty: float = PENALTY
) -> list[float]:
    """Weights of a logistic regression without constant, both labels weighing the same.

    Each step is an aggregation of gradients by bucket, accelerated by Nesterov's rule with the
    step that the bound of the curvature allows. Rows without URL or label are left out. With
    one label or none all weights are zero.
    """
    known = labelled.select(F.col(url_col).alias("_u"), F.col(label_col).cast("double").alias("_y")).where(
        F.col("_u").isNotNull() & F.col("_y").isin(0.0, 1.0)
    )
    rows = materialised(with_buckets(known, host_of(F.col("_u")), path_of(F.col("_u"))).drop("_u"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights, moved, pace = [0.0] * BUCKETS, [0.0] * BUCKETS, 1.0
    if len(counts) < 2:
        return weights
    share = F.when(F.col("_y") == 1, 0.5 / counts[1.0]).otherwise(0.5 / counts[0.0])
    length = 1 / (0.25 * 2 + penalty)
    for _ in range(steps):
        miss = share * (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(weight_column(moved)))) - F.col("_y"))
        each = [
            F.struct(F.col(c).alias("at"), (F.col("_r") / F.sqrt(F.greatest(F.size(c), F.lit(1)))).alias("by"))
            for c in ("_h", "_p")
        ]
        slope = (
            rows.withColumn("_r", miss)
            .select(F.explode(F.array(*each)).alias("_e"))
            .select(F.explode("_e.at").alias("bucket"), F.col("_e.by").alias("by"))
            .groupBy("bucket")
            .agg(F.sum("by").alias("by"))
            .collect()
        )
        step = [m * (1 - length * penalty) for m in moved]
        for r in slope:
            step[r["bucket"]] -= length * r["by"]
        later = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        moved = [s + (pace - 1) / later * (s - w) for s, w in zip(step, weights)]
        weights, pace = step, later
    return [round(w, 6) for w in weights]


def url_verdicts(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    at: float = 0.5,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` per row of ``pages``.

    ``rules`` are ``("allow" or "block", "host/path")``; the longest that fits gives the verdict.
    Other URLs are blocked if they score above ``at``. A null URL and one without ``://`` have
    empty host and path, which no rule fits and no gram speaks against: 0.5, allowed. Null ids
    and repeated rows stay; other columns are ignored.
    """
    weights = weight_column(fit_weights(labelled))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_u")).select(
        "page_id", host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path")
    )
    found = rule_of(F.col("host"), F.col("path"), rules)
    rows = with_buckets(rows, F.col("host"), F.col("path")).withColumn("_f", found)
    rows = rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(weights))))
    learnt = F.when(F.col("score") > at, "block").otherwise("allow")
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), learnt.alias("verdict"), "score")
    return rows.select(
        "page_id", "host", "path", F.col("_f.rule").alias("rule"), F.coalesce("_f.verdict", learnt).alias("verdict"), "score"
    )
