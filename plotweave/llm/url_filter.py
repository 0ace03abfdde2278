"""URL filters: rules on host and path, and where none fits, gradient-boosted trees on lexical features of the URL.

The trees learn from the URLs that rules label. DataFrame functions and MLlib only, no Python on executors.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch, ready, table

#: (verdict, host and path). A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The trees are fitted on at most so many different URLs of each verdict, those that come first by hash.
SAMPLE_URLS = 8000
TREES, DEPTH = 20, 4
#: A suffix has statistics of its own if more than 1/SUFFIXES of all URLs have it, so fewer than SUFFIXES of each kind are broadcast.
SUFFIXES = 2000
#: Labelled URLs, half of them blocked, that are added to those of a suffix; parts of the sample that don't see their own labels.
_PRIOR, _FOLDS = 20, 5


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; '' for null and without ://."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits; of equally long ones the first in code point order. Rules are a list of bounded
    size, part of the plan."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character. Characters are sorted and their runs summed, so that a long text costs n log n."""
    term = lambda n: F.when(n > 0, n * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1).otherwise(1.0).alias("n"), F.when(same, a["s"]).otherwise(a["s"] + term(a["n"])).alias("s"))

    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    return F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - F.aggregate(chars, start, step, lambda a: (a["s"] + term(a["n"])) / F.greatest(n, F.lit(1.0)))).otherwise(0.0)


def _lexical() -> dict[str, Column]:
    """What a URL has by itself, from columns u (the URL, '' for null), h (host), p (path), s1 (the host's last label)."""
    return {
        "length": F.log1p(F.length("u")), "host_length": F.log1p(F.length("h")), "path_length": F.log1p(F.length("p")),
        "labels": F.regexp_count("h", F.lit(r"\.")) + F.when(F.length("h") > 0, 1).otherwise(0), "depth": F.regexp_count("p", F.lit("/[^/]")),
        "digits": _share(F.col("u"), "[0-9]"), "host_digits": _share(F.col("h"), "[0-9]"), "hyphens": F.regexp_count("h", F.lit("-")),
        "vowels": _share(F.col("h"), "[aeiou]"), "capitals": _share(F.col("u"), "[A-Z]"), "longest_label": F.array_max(F.transform(F.split("h", r"\."), lambda x: F.length(x))),
        "host_entropy": _entropy(F.col("h")), "entropy": _entropy(F.col("u")),
        "parameters": F.regexp_count(F.regexp_extract("u", r"\?([^#]*)", 1), F.lit("[^&]+")), "fragment": F.instr("u", F.lit("#")) > 0, "ends_in_slash": F.endswith("p", F.lit("/")),
        "extension": F.length(F.regexp_extract("p", r"\.([A-Za-z0-9]{1,5})$", 1)), "top_length": F.length("s1"),
    }


#: Suffixes of a host, its last label and its last two, and in the same way the path's first part, which rules look at, too.
_SUFFIX = {"s1": ("h", r"[^.]*$"), "s2": ("h", r"[^.]*(\.[^.]*)?$"), "p1": ("p", "^/?[^/]*/?")}


def _parts(urls: DataFrame) -> DataFrame:
    """u, h, p, s1, s2, p1 of url, beside it and the other columns."""
    out = urls.withColumn("u", F.coalesce("url", F.lit(""))).withColumns({"h": host_of(F.col("u")), "p": path_of(F.col("u"))})
    return out.withColumns({s: F.regexp_extract(c, r, 0) for s, (c, r) in _SUFFIX.items()})


@dataclass
class Model:
    """trees: None if all labelled URLs have one verdict, then that one for all; suffixes by kind: (suffix, share, blocked)."""

    trees: GBTClassificationModel | None
    only: str
    suffixes: dict[str, DataFrame]


def _with_suffixes(rows: DataFrame, suffixes: dict[str, DataFrame]) -> DataFrame:
    for s, known in suffixes.items():  # fewer than SUFFIXES rows
        known = known.select(F.col("suffix").alias(s), F.col("share").alias(f"{s}_share"), F.col("blocked").alias(f"{s}_blocked"))
        rows = rows.join(F.broadcast(known), s, "left").withColumn(f"{s}_share", F.coalesce(f"{s}_share", F.lit(0.0)))
        rows = rows.withColumn(f"{s}_blocked", F.coalesce(f"{s}_blocked", F.lit(0.5)))
    return rows


def _vectors(rows: DataFrame) -> DataFrame:
    own = {c: x.cast("double") for c, x in _lexical().items()}
    names = [*own, *(f"{s}_{x}" for s in _SUFFIX for x in ("share", "blocked"))]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(rows.withColumns(own))


def train(urls: DataFrame, rules: Sequence[tuple[str, str]] = RULES, sample_urls: int = SAMPLE_URLS, seed: int = 7) -> Model:
    """From the URLs (url) that rules label; repeated URLs count once, and both verdicts weigh the same. A suffix has the share of
    all URLs that have it, and the weighted share of blocked ones among the sample's, drawn to a half, which also is that of
    rare suffixes; in training those of the other folds."""
    scratch = Scratch(urls.sparkSession, "urls")
    rows = _parts(urls.select("url"))
    labelled = rows.withColumn("verdict", rule_of(F.col("h"), F.col("p"), rules)[1]).where(F.col("verdict").isNotNull())
    distinct = labelled.groupBy("url").agg(F.max((F.col("verdict") == "block").cast("double")).alias("label"))
    drawn = [distinct.where(F.col("label") == y).orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(sample_urls) for y in (0.0, 1.0)]
    sample = scratch.write(_parts(drawn[0].unionByName(drawn[1])).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(_FOLDS)).cast("int")), "sample")
    counts = {y: n for y, n in sample.groupBy("label").count().collect()}  # two rows
    weigh = F.when(F.col("label") == 1, 1 / (counts.get(1.0) or 1)).otherwise(1 / (counts.get(0.0) or 1)) * (sum(counts.values()) / 2)
    sample = sample.withColumn("weight", weigh)
    suffixes, seen = {}, {}
    for s in _SUFFIX:
        every = rows.groupBy(F.col(s).alias("suffix")).count()
        total = every.agg(F.coalesce(F.sum("count"), F.lit(1))).first()[0]
        shares = every.where(F.col("count") > total // SUFFIXES).select("suffix", (F.col("count") / F.lit(total)).alias("share"))
        by_fold = sample.groupBy(F.col(s).alias("suffix"), "fold").agg(F.sum(F.col("label") * F.col("weight")).alias("y"), F.sum("weight").alias("n"))
        rate = lambda y, n: (y + _PRIOR / 2) / (n + _PRIOR)
        known = shares.join(by_fold.groupBy("suffix").agg(F.sum("y").alias("y"), F.sum("n").alias("n")), "suffix", "left").fillna(0, ["y", "n"])
        suffixes[s] = scratch.write(known.select("suffix", "share", rate(F.col("y"), F.col("n")).alias("blocked")).coalesce(1), s)
        whole = W.partitionBy("suffix")
        seen[s] = by_fold.select(F.col("suffix").alias(s), "fold", rate(F.sum("y").over(whole) - F.col("y"), F.sum("n").over(whole) - F.col("n")).alias("_others"))
    if len(counts) < 2:
        return Model(None, "block" if counts.get(1.0) else "allow", suffixes)
    for s, others in seen.items():  # a row for each suffix and fold of the sample
        frequent = F.broadcast(suffixes[s].select(F.col("suffix").alias(s), "share"))
        sample = sample.join(frequent, s, "left").join(F.broadcast(others), [s, "fold"], "left")
        sample = sample.withColumns({f"{s}_share": F.coalesce("share", F.lit(0.0)), f"{s}_blocked": F.when(F.col("share").isNull(), 0.5).otherwise(F.col("_others"))}).drop("share", "_others")
    rows = scratch.write(_vectors(sample).select("label", "weight", "features", "url").orderBy("url").coalesce(1), "vectors")  # the sample, in one order
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed).fit(rows)
    return Model(trees, "", suffixes)


def judge_urls(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score; one row for each row of pages (page_id, url).

    verdict: that of the longest rule that fits, else the trees'. score: the trees' probability that a rule blocks such a URL,
    null without trees. A null URL counts as an empty one: host and path are empty, and the trees judge it. Very long URLs are
    read whole. Repeated rows: each has its row. No rows: no rows. Other columns are ignored.
    """
    ready(pages.sparkSession)
    rows = _parts(pages.select("page_id", "url"))
    rule, verdict = rule_of(F.col("h"), F.col("p"), rules)
    if model.trees is None:
        score, own = F.lit(None).cast("double"), F.lit(model.only)
    else:
        rows = model.trees.transform(_vectors(_with_suffixes(rows, model.suffixes)))
        score, own = vector_to_array("probability")[1], F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return rows.select("page_id", "url", F.col("h").alias("host"), F.col("p").alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))


def op11(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, train(pages)).drop("url")
