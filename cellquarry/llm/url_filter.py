"""URL filter: rules first, then a ratio of two character language models.

The models are variable-order Markov models of up to ``ORDER`` preceding
characters, interpolated down to a uniform distribution by Witten-Bell
smoothing: one of URLs that the rules accept, one of URLs they reject.  A URL
without a rule is judged by the difference of its two log-likelihoods over its
length, against a threshold calibrated on rule-labelled URLs that were held out.
Every distinct URL with a rule is used: a fifth, by its hash, calibrates, all others are learned from.

All of this is DataFrame work.  A context is a row with a map of the characters
that follow it; scoring explodes each distinct URL into its characters and looks
their contexts up in the model, one join for each order; orders of few entries are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import stored

ORDER = 4
#: Contexts of so many characters are broadcast, if they have no more entries than this; others are joined without a hint.
BROADCAST_ORDER = 2
BROADCAST_ENTRIES = 200_000
ALPHABET = 256
#: Distinct URLs of one scoring task; they are few bytes, but a row for each character is made of them.
URLS_PER_TASK = 8192
START, END = "\u0002", "\u0003"
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _characters(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character (and the end) of ``url`` with its contexts ``c0`` ... ``c{ORDER}``."""
    whole = F.concat(F.lit(START * ORDER), F.coalesce("url", F.lit("")), F.lit(END))
    rows = urls.select(*keep, whole.alias("w"))
    rows = rows.select(*keep, "w", F.explode(F.sequence(F.lit(ORDER + 1), F.length("w"))).alias("at"))
    contexts = [F.substring(F.col("w"), F.col("at") - k, F.lit(k)).alias(f"c{k}") for k in range(ORDER + 1)]
    return rows.select(*keep, F.substring(F.col("w"), F.col("at"), F.lit(1)).alias("char"), *contexts)


def spread(urls: DataFrame) -> DataFrame:
    """``urls`` dealt to tasks by a count of them; by their bytes, adaptive execution would put all into one."""
    return urls.repartition(max(1, math.ceil(urls.count() / URLS_PER_TASK)))


def train(urls: DataFrame) -> DataFrame:
    """The model's contexts from ``url`` and ``accepted`` (boolean)."""
    one = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    rows = _characters(spread(urls), ["accepted"])
    rows = rows.select("accepted", "char", F.explode(F.array(*[f"c{k}" for k in range(ORDER + 1)])).alias("context"))
    counts = rows.groupBy("context", "char").agg(one(F.col("accepted")).alias("a"), one(~F.col("accepted")).alias("r"))
    model = counts.groupBy("context").agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), one(F.col("a") > 0).alias("ta"), one(F.col("r") > 0).alias("tr"),
        F.map_from_entries(F.collect_list(F.struct("char", F.struct("a", "r")))).alias("next"),
    )
    return stored(model, "contexts")


def score(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``url`` and ``llr`` of distinct urls: accepted minus rejected log-likelihood per character."""
    entries = {r["k"]: r["n"] for r in model.groupBy(F.length("context").alias("k")).agg(F.sum(F.size("next")).alias("n")).collect()}
    rows = _characters(spread(urls), ["url"])
    accepted = rejected = F.lit(1.0 / ALPHABET)
    for k in reversed(range(ORDER + 1)):  # a joined map gives way to one character's counts at once
        own = model.where(F.length("context") == k).select(F.col("context").alias(f"c{k}"), "na", "nr", "ta", "tr", "next")
        rows = rows.join(F.broadcast(own) if k <= BROADCAST_ORDER and entries.get(k, 0) <= BROADCAST_ENTRIES else own, f"c{k}", "left")
        rows = rows.withColumn(f"m{k}", F.struct("na", "nr", "ta", "tr", F.col("next")[F.col("char")].alias("seen"))).drop(f"c{k}", "na", "nr", "ta", "tr", "next")
    for k in range(ORDER + 1):
        seen = F.col(f"m{k}.seen")

        def mixed(lower: Column, count: Column, n: Column, types: Column) -> Column:
            return F.when(n > 0, (F.coalesce(count, F.lit(0)) + types * lower) / (n + types)).otherwise(lower)

        accepted = mixed(accepted, seen["a"], F.col(f"m{k}.na"), F.col(f"m{k}.ta"))
        rejected = mixed(rejected, seen["r"], F.col(f"m{k}.nr"), F.col(f"m{k}.tr"))
        rows = rows.withColumns({"_a": accepted, "_r": rejected})
        accepted, rejected = F.col("_a"), F.col("_r")
        rows = rows.select("url", "char", "_a", "_r", *[f"m{i}" for i in range(k + 1, ORDER + 1)])
    return rows.groupBy("url").agg(F.avg(F.ln("_a") - F.ln("_r")).alias("llr"))


def calibrate(scored: DataFrame) -> float:
    """The threshold of best balanced accuracy over ``llr`` and ``accepted``.

    Scores are counted in bins of a hundredth; of equally good thresholds the
    middle one is taken.  Without URLs of both kinds it is 0.
    """
    bins = scored.groupBy(F.floor(F.col("llr") * 100).alias("bin")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    rows = sorted((r["bin"], r["a"], r["r"]) for r in bins.collect())
    a, r = sum(x[1] for x in rows), sum(x[2] for x in rows)
    if not a or not r:
        return 0.0
    best, kept, above, below = -1.0, [], a, 0
    edges = [(rows[0][0], rows[0][0])] + [(rows[i - 1][0] + 1, rows[i][0]) for i in range(1, len(rows))] + [(rows[-1][0] + 1, rows[-1][0] + 1)]
    for i, edge in enumerate(edges):
        quality = above / a + below / r
        if quality > best + 1e-12:
            best, kept = quality, []
        if quality > best - 1e-12:
            kept.append(edge)
        if i < len(rows):
            above, below = above - rows[i][1], below + rows[i][2]
    return (kept[0][0] + kept[-1][1]) / 200


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``llr`` of every row.

    A null url counts as an empty one: no rule fits and the models judge its end
    alone; a very long url is scored over all its characters.  Without accepted or rejected URLs to learn from, every URL without a
    rule has llr 0 and is allowed.  Repeated rows are judged alike; rows of one
    URL are scored once.  An empty table gives an empty result.  Other columns
    are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    urls = stored(ruled.groupBy("url").agg(F.first("ruled").alias("ruled")), "urls")
    fold = F.pmod(F.xxhash64("url", F.lit(31)), F.lit(5)) == 0
    labelled = urls.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"), fold.alias("held"))
    model = train(labelled.where(~F.col("held")))
    scored = stored(score(urls.select("url"), model), "scores")
    threshold = calibrate(labelled.where("held").join(scored, "url"))
    judged = ruled.alias("p").join(scored.alias("s"), F.col("p.url").eqNullSafe(F.col("s.url")), "left")
    llr = F.coalesce("llr", F.lit(0.0))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(llr >= threshold, "allow").otherwise("block")).alias("verdict"), llr.alias("llr"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
