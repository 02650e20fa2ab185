"""URL filters: rules by host and path, and a character language-model ratio for the rest.

Rules allow or block a host with all its subdomains, from a path prefix on; the longest rule wins.
The URLs that rules allow and block train two variable-order Markov models over characters: a
character's probability after a context of n characters mixes its count there with the probability
after the context of n - 1 characters, ``(count + mass * shorter) / (context + mass)``. A URL's score is the
difference of the two log-likelihoods per character. Every fourth training URL (by hash) is kept
out of the counts and sets the threshold, at the best mean of both classes' accuracy; models of all
training URLs then judge the URLs without a rule.

Defined results: a URL without ``://``, or null, has an empty host and path and no rule; it is judged by its
whole text, an empty text scores 0; A-Z in hosts are lower-cased; repeated pages are each
judged; without URLs of both classes every score is 0 and, as the threshold is 0 too, the verdict is
allow; a URL without a rule is judged also where its text, in lower case, equals that of a ruled one; an empty
table gives no rows; other columns are ignored.

Scale: only built-in functions. Counts of character runs shrink map-side to the distinct runs; the models
are joined to distinct runs, and to pages once. Distinct URLs are scored once each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.llm.frames import picked, stored

Rule = tuple[str, str, str]
ORDER = 4
MASS = 1.0
HELD_OUT = 4
BIN = 0.01
MOST_SCORE = 10.0
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_AFTER = r"(?s)^.*?://"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` (with host, path) and the longest fitting rule and its verdict, else null.

    ``rules``: (verdict, host, path prefix). Each distinct host meets the rules of all its suffixes once.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, suffix string, prefix string")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = (
        pages.select("host").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix")
        .groupBy("host").agg(
            F.collect_list(
                F.struct(
                    F.length(F.concat("suffix", "prefix")).alias("size"), F.concat("suffix", "prefix").alias("rule"),
                    F.col("verdict"), F.col("prefix"),
                )
            ).alias("rules")
        )
    )
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    return pages.join(fitting, "host", "left").withColumn("best", best).select(
        *pages.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruling")
    )


def _runs(urls: DataFrame, carry: list[str]) -> DataFrame:
    """One row per character of ``body`` and end mark, with the ``ORDER`` characters that end there."""
    padded = F.concat(F.lit("\u0002" * (ORDER - 1)), F.col("body"), F.lit("\u0003"))
    at = F.explode(F.sequence(F.lit(1), F.length("body") + 1))
    return urls.where("body <> ''").withColumn("padded", padded).select(*carry, "padded", at.alias("at")).select(
        *carry, F.col("padded").substr(F.col("at"), F.lit(ORDER)).alias("run")
    )


def _ratios(counts: DataFrame, mass: float) -> DataFrame:
    """run, ratio: the log-ratio of the two models for the last character of each run.

    ``counts``: run, good, bad, with zeros for runs that are only to be judged.
    """
    letters = counts.select(F.substring("run", ORDER, 1)).distinct().count()
    base = F.lit(1.0 / max(1, letters))
    out = counts.select("run").withColumns({"p_good": base, "p_bad": base})
    for n in range(1, ORDER + 1):
        last = F.substring("run", ORDER - n + 1, n)
        context = F.substring("run", ORDER - n + 1, n - 1)
        own = counts.groupBy(last.alias("gram")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        around = counts.groupBy(context.alias("context")).agg(F.sum("good").alias("cg"), F.sum("bad").alias("cb"))
        out = (
            out.withColumns({"gram": last, "context": context}).join(own, "gram").join(around, "context")
            .select(
                "run",
                ((F.col("g") + mass * F.col("p_good")) / (F.col("cg") + mass)).alias("p_good"),
                ((F.col("b") + mass * F.col("p_bad")) / (F.col("cb") + mass)).alias("p_bad"),
            )
        )
    return out.select("run", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def _scores(runs: DataFrame, learning: Column, judged: Column, label: str, mass: float) -> DataFrame:
    """body, score of the judged URLs by models of the learning ones."""
    counts = stored(
        runs.groupBy("run").agg(
            *[
                F.sum(F.when(learning & (F.col("ruling") == verdict), F.lit(1)).otherwise(0)).alias(name)
                for name, verdict in (("good", "allow"), ("bad", "block"))
            ]
        ),
        f"runs-{label}",
    )
    ratios = stored(_ratios(counts, mass), f"ratios-{label}")
    return runs.where(judged).join(ratios, "run").groupBy("body").agg(
        F.any_value("ruling").alias("ruling"), F.avg("ratio").alias("score")
    )


def _threshold(scored: DataFrame) -> float:
    """The score at or above which the mean of both classes' accuracy is best, from a histogram."""
    limited = F.least(F.greatest("score", F.lit(-MOST_SCORE)), F.lit(MOST_SCORE))
    bins = scored.groupBy(F.floor(limited / BIN).alias("bin")).agg(
        F.count_if(F.col("ruling") == "allow").alias("good"), F.count_if(F.col("ruling") == "block").alias("bad")
    ).orderBy("bin").collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0.0
    best, at, below = -1.0, 0.0, bins[0]["bin"]
    lost = caught = 0
    for r in bins:
        # Between the bins on both sides of the cut.
        accuracy = (good - lost) / good + caught / bad
        if accuracy > best:
            best, at = accuracy, (below + r["bin"]) / 2 * BIN
        lost, caught, below = lost + r["good"], caught + r["bad"], r["bin"] + 1
    return at


def judge(
    pages: DataFrame, rules: Sequence[Rule], mass: float = MASS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    pages = picked(pages, page_id=page_id, url=url)
    after = F.when(F.col("url").rlike(_AFTER), F.regexp_replace("url", _AFTER, "")).otherwise(F.col("url"))
    body = F.translate(F.coalesce(after, F.lit("")), _UPPER + "\u0002\u0003", _LOWER)
    told = stored(
        ruled(
            pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "body": body}).drop("url"),
            rules,
        ),
        "ruled",
    )
    urls = stored(
        told.groupBy("body").agg(F.min("ruling").alias("ruling"), F.max(F.col("rule").isNull()).alias("free"))
        .withColumn("fold", F.pmod(F.xxhash64("body"), F.lit(HELD_OUT))),
        "urls",
    )
    classes = {r["ruling"] for r in urls.select("ruling").distinct().limit(3).collect()}
    if not {"allow", "block"} <= classes:
        verdict = F.coalesce("ruling", F.lit("allow"))
        own = F.when(F.col("rule").isNull(), F.lit(0.0))
        return told.select("page_id", "host", "path", "rule", verdict.alias("verdict"), own.alias("score"))
    runs = _runs(urls, ["body", "ruling", "free", "fold"])
    tried = _scores(runs, F.col("fold") > 0, F.col("ruling").isNotNull() & (F.col("fold") == 0), "held-out", mass)
    threshold = _threshold(tried)
    scored = _scores(runs, F.lit(True), F.col("free"), "all", mass).select("body", "score")
    done = told.where("rule is not null").select(
        "page_id", "host", "path", "rule", F.col("ruling").alias("verdict"), F.lit(None).cast("double").alias("score")
    )
    score = F.coalesce("score", F.lit(0.0))
    rest = told.where("rule is null").join(scored, "body", "left").select(
        "page_id", "host", "path", "rule",
        F.when(score >= threshold, "allow").otherwise("block").alias("verdict"), score.alias("score"),
    )
    return done.unionByName(rest)
