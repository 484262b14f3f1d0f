"""URL filters by association rules.

Fixed host and path rules come first; the longest that fits decides. What they leave is decided by mined rules:
FP-growth over the labelled URLs among it (quality and toxicity labels of the pages) finds combinations of URL tokens
(host parts, path words, file suffix, query keys) that come with a label.

The support of a rule is a number of pages, the same at every size of the table, so a rare host is learned from its
own pages however large the rest is. What keeps chance out is the confidence: its lower bound (Wilson, Z) must reach
MIN_BOUND and the label's own share. A rule that a simpler one with the same label and no lower bound covers goes. Of
the rules with all tokens in the URL the one with the highest bound gives the verdict; without one the URL is allowed.

Rules stay a table, for their number grows with the hosts. Each is listed in an inverted index under its rarest
token; the tokens of a URL find the listed rules, and the other tokens are checked there. Everything is column
expressions and joins; the index is broadcast only if it was counted and is small.

Defined results: a NULL URL or one without `://` has empty host and path, fits no fixed rule and is judged by its
(no) tokens; repeated rows get equal rows; without labels nothing is mined and the rest is allowed; labels that
contradict each other count as bad.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import small
from ..session import stash
from .text import documents

# host, path, verdict
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
         ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
MIN_PAGES = 5          # least number of labelled URLs with all tokens of a rule and its label
MIN_BOUND = 0.5        # least lower bound of the confidence
Z = 1.28               # of the bound: nine of ten true confidences lie above it
DEFAULT = "allow"
LABELS = {"=block": "block", "=allow": "allow"}


def host(url: Column) -> Column:
    """What lies between the first :// and the next /, ?, # or end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, field) -> Column:
    """field(rule) of the longest fixed rule that fits, else NULL."""
    out = F.lit(None).cast("string")
    for r in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((h == r[0]) | h.endswith("." + r[0])) & p.startswith(r[1])
        out = F.when(fits, F.lit(field(r))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; path words of digits only are left out, they name single pages."""
    h, p = host(url), path(url)
    parts = F.filter(F.split(h, r"\."), lambda x: x != "")
    words = F.filter(F.split(p, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key "), x))
    suffix = F.regexp_extract(p, r"\.([A-Za-z]+)$", 1)
    return F.array_distinct(F.concat(
        F.transform(parts, lambda x: F.concat(F.lit("host "), x)),
        F.transform(F.flatten(F.transform(parts, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>")))),
                    lambda x: F.concat(F.lit("part "), x)),
        F.transform(words, lambda x: F.concat(F.lit("path "), x)), keys,
        F.when(suffix != "", F.array(F.concat(F.lit("file "), F.lower(suffix)))).otherwise(F.array().cast("array<string>"))))


def _bound(k: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of k in n."""
    p = k / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _subsets(items: Column) -> Column:
    """All proper subsets of a sorted array but the empty one, sorted."""
    every = F.aggregate(items, F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))
    return F.filter(every, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(items)))


def mine(labelled: DataFrame, pages: int = MIN_PAGES) -> DataFrame:
    """(tokens, label, k, n, bound, anchor) of the rules from labelled(items): token arrays with a label item."""
    labels = F.array(*map(F.lit, LABELS))
    counts = labelled.groupBy(F.get(F.array_intersect("items", labels), F.lit(0)).alias("label")).agg(F.count(F.lit(1)).alias("of")).collect()   # two rows
    total = sum(r["of"] for r in counts)
    schema = "tokens array<string>, label string, k bigint, n bigint, bound double, anchor string"
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    # half a page less, so that the share never rounds above the wanted number
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (pages - 0.5) / total)).setMinConfidence(1.0).fit(labelled)
    found = stash(model.freqItemsets.select(F.sort_array(F.array_except("items", labels)).alias("tokens"),
                                            F.get(F.array_intersect("items", labels), F.lit(0)).alias("label"), F.col("freq")), "itemsets")
    plain = found.where(F.col("label").isNull())
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("label") == r["label"], r["of"] / total).otherwise(share)
    rules = stash(found.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).withColumnRenamed("freq", "k")
                  .join(plain.select("tokens", F.col("freq").alias("n")), "tokens").withColumn("bound", _bound(F.col("k"), F.col("n")))
                  .where((F.col("bound") >= MIN_BOUND) & (F.col("bound") > share)), "rules")
    simpler = rules.select(F.col("tokens").alias("_t"), "label", F.col("bound").alias("_b"))
    covered = (rules.select("tokens", "label", "bound", F.explode(_subsets(F.col("tokens"))).alias("_t")).join(simpler, ["_t", "label"])
               .where("_b >= bound").select("tokens", "label").distinct())
    kept = rules.join(covered, ["tokens", "label"], "left_anti")
    single = plain.where(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("_one"), F.col("freq").alias("_f"))
    anchors = (kept.select("tokens", "label", F.explode("tokens").alias("_one")).join(single, "_one")
               .groupBy("tokens", "label").agg(F.min(F.struct("_f", "_one")).alias("_a")))
    return stash(kept.join(anchors, ["tokens", "label"]).select("tokens", "label", "k", "n", "bound", F.col("_a._one").alias("anchor")), "kept")


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, verdict) of the rows of urls(row, url) that a rule covers: the best rule with all its tokens in the URL."""
    index = small(rules.select("anchor", F.col("tokens").alias("needed"), "label", "bound", "n"))
    held = urls.select("row", tokens(F.col("url")).alias("held"))
    hits = (held.select("row", "held", F.explode("held").alias("anchor")).join(index, "anchor")
            .where(F.forall("needed", lambda x: F.array_contains("held", x))))
    best = hits.groupBy("row").agg(F.min(F.struct((-F.col("bound")).alias("b"), (-F.col("n")).alias("n"), F.size("needed").alias("s"),
                                                  F.col("needed"), F.col("label"))).alias("best"))
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return best.select("row", names[F.col("best.label")].alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and whether a mined rule decided."""
    url = F.col("url")
    rows = stash(documents(pages, "page_id", "url").withColumn("row", F.monotonically_increasing_id())
                 .withColumn("host", host(url)).withColumn("path", path(url)), "urls")
    fixed = {name: rule(F.col("host"), F.col("path"), field) for name, field in (("rule", lambda r: r[0] + r[1]), ("fixed", lambda r: r[2]))}
    left = rows.where(fixed["fixed"].isNull())
    bad = (documents(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
           .groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).cast("int")).alias("_bad")))
    items = F.concat(tokens(url), F.array(F.when(F.col("_bad") == 1, "=block").otherwise("=allow")))
    labelled = stash(left.join(bad, F.col("page_id") == F.col("_id")).select(items.alias("items")), "labelled")
    mined = verdicts(left.select("row", "url"), mine(labelled)).withColumnRenamed("verdict", "_mined")
    return (rows.join(mined, "row", "left")
            .select("page_id", "host", "path", fixed["rule"].alias("rule"), F.coalesce(fixed["fixed"], F.col("_mined"), F.lit(DEFAULT)).alias("verdict"),
                    (fixed["fixed"].isNull() & F.col("_mined").isNotNull()).alias("mined")))
