"""URL verdicts: explicit rules first, then a path-template tree with labelled purity.

Per host, the tree's levels are the path's segments. A segment that is a number, a hex id,
a date or the like becomes a class wildcard at once; a node whose remaining children are
many and mostly seen once gets ``*`` for all of them.

At every level, a node's labelled children are merged where their block rates are alike: the
children are ordered by rate (in ``STEPS`` steps, so that any number of them is a bounded
row of cells), and a cell joins the one before it unless a two-proportion test parts them.
A merged branch has the labels of all its children; a child without labels is judged by its
parent. The block rate of a branch is smoothed towards its parent's, that of the host's root
towards the rate of all labels.

A URL without a rule goes to the deepest node of its template whose branch has ``least``
labels, and is blocked where the smoothed rate there is ``reject`` or more. A host without
that many labels blocks nothing: labels of other hosts only smooth.

Labels are the verdicts of the rules on the URLs that they fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits the host (or a domain above it) and begins the path, as a struct."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    made = reduce(lambda c, r: c.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))), ordered, F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict"))))
    return made


#: Class wildcards of variable segments, most specific first (the part before a file extension).
CLASSES = (
    ("<date>", r"^\d{4}-\d{1,2}(-\d{1,2})?$"),
    ("<num>", r"^\d+$"),
    ("<uuid>", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("<hex>", r"^(?=.*\d)[0-9a-fA-F]{8,}$"),
    ("<slug>", r"^[^-_]+([-_][^-_]+){2,}$"),
)
#: Steps of the block rate in which siblings are ordered.
STEPS = 64


def _general(segment: Column) -> Column:
    stem, ending = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", 1), F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})?$", 0)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CLASSES):
        out = F.when(stem.rlike(pattern), F.lit(name)).otherwise(out)
    return F.coalesce(F.concat(out, ending), segment)


def _templates(seen: DataFrame, depth: int, many: int, rare: float) -> DataFrame:
    """seen: host, path, n, good, bad for distinct paths of class wildcards. Adds ``tpl``, the
    template of each level down to the whole path's: children that are many and mostly rare
    become ``*``. A longer path's rest is one ``**``."""
    now = seen.withColumn("seg", F.split(F.regexp_replace("path", "^/+", ""), "/")).withColumn("tpl", F.array(F.lit("")))
    for k in range(depth):
        at, above = F.get("seg", F.lit(k)), F.element_at("tpl", -1)
        child = now.where(F.size("seg") > k).groupBy("host", above.alias("above"), at.alias("child")).agg(F.sum("n").alias("cn"))
        wide = child.groupBy("host", "above").agg(F.count("*").alias("kids"), F.sum("cn").alias("urls")).where((F.col("kids") >= many) & (F.col("kids") >= rare * F.col("urls"))).select("host", "above", F.lit(True).alias("wide"))
        now = now.withColumn("above", above).join(wide, ["host", "above"], "left")
        step = F.concat("above", F.lit("/"), F.when(F.col("wide"), F.lit("*")).otherwise(at))
        now = now.withColumn("tpl", F.when(F.size("seg") > k, F.concat("tpl", F.array(step))).otherwise(F.col("tpl"))).drop("wide", "above")
    rest = F.array(F.concat(F.element_at("tpl", -1), F.lit("/**")))
    return now.withColumn("tpl", F.when(F.size("seg") > depth, F.concat("tpl", rest)).otherwise(F.col("tpl"))).drop("seg")


def _branches(nodes: DataFrame, same: float) -> DataFrame:
    """host, level, node, g, b: the labels of each labelled node's merged branch."""
    told = F.col("good") + F.col("bad")
    labelled = nodes.where(told > 0).withColumn("cell", F.floor(F.col("bad") * STEPS / told).cast("int"))
    place = ["host", "level", "above"]
    cells = labelled.groupBy(*place, "cell").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    by_rate = Window.partitionBy(*place).orderBy("cell")  # at most STEPS + 1 rows a node
    n, m = F.col("g") + F.col("b"), F.lag("g").over(by_rate) + F.lag("b").over(by_rate)
    before = F.lag("b").over(by_rate)
    pooled = (F.col("b") + before) / (n + m)
    apart = F.abs(F.col("b") / n - before / m) > same * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    parted = cells.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0)))
    numbered = parted.withColumn("branch", F.sum("new").over(by_rate.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*place, "branch")
    merged = numbered.select(*place, "cell", F.sum("g").over(whole).alias("g"), F.sum("b").over(whole).alias("b"))
    return labelled.select(*place, "node", "cell").join(merged, [*place, "cell"]).select("host", "level", "node", "g", "b")


def judge(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", depth: int = 6, many: int = 20, rare: float = 0.5, weight: float = 2.0, same: float = 1.96, reject: float = 0.7, least: int = 3) -> DataFrame:
    """id, host, path, rule, verdict, template, block_rate, labels for each row.

    ``block_rate`` and ``labels`` are those of the node that a URL is judged by, also where a
    rule tells; they are null on a host with fewer than ``least`` labels. A null url, or one
    without ``://``, has an empty host and path and no rule. Ids may be null and rows may
    repeat. Ties between rules of one length fall to the first in order of name. ``depth``
    levels of the path are kept apart; a longer path's rest is one wildcard.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "r.rule", F.col("r.verdict").alias("told"))
    rows = stored(rows.withColumn("general", F.array_join(F.transform(F.split("path", "/"), _general), "/")), "urls")
    good, bad = (F.coalesce(F.sum((F.col("told") == v).cast("long")), F.lit(0)).alias(n) for v, n in (("allow", "good"), ("block", "bad")))
    seen = rows.groupBy("host", F.col("general").alias("path")).agg(F.count("*").alias("n"), good, bad)
    tree = stored(_templates(seen, depth, many, rare), "templates")
    chains = tree.groupBy("host", "tpl").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    steps = chains.select("host", "tpl", "good", "bad", F.posexplode("tpl").alias("level", "node"))
    above = F.when(F.col("level") > 0, F.get("tpl", F.col("level") - 1)).otherwise("")
    nodes = steps.groupBy("host", "level", above.alias("above"), "node").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    branches = _branches(nodes, same)
    all_good, all_bad = (x or 0 for x in chains.agg(F.sum("good"), F.sum("bad")).first())

    def down(a: Column, s: Column) -> Column:
        """The rate of the next node, and what the deepest node with enough labels tells."""
        n = s["g"] + s["b"]
        rate = (s["b"] + weight * a["rate"]) / (n + weight)
        enough = n >= least
        return F.struct(rate.alias("rate"), F.when(enough, rate).otherwise(a["told"]).alias("told"), F.when(enough, n).otherwise(a["labels"]).alias("labels"))

    start = F.struct(F.lit((all_bad + 1) / (all_bad + all_good + 2)).alias("rate"), F.lit(None).cast("double").alias("told"), F.lit(None).cast("long").alias("labels"))
    met = steps.select("host", "tpl", "level", "node").join(branches, ["host", "level", "node"])
    per_chain = met.groupBy("host", "tpl").agg(F.sort_array(F.collect_list(F.struct("level", "g", "b"))).alias("s"))  # a row for each level
    rated = per_chain.select("host", "tpl", F.aggregate("s", start, down).alias("r")).select("host", "tpl", F.col("r.told").alias("block_rate"), F.col("r.labels").alias("labels"))
    by_path = tree.select("host", F.col("path").alias("general"), "tpl").join(rated, ["host", "tpl"], "left").select("host", "general", F.element_at("tpl", -1).alias("template"), "block_rate", "labels")
    out = rows.join(by_path, ["host", "general"], "left")
    verdict = F.coalesce("told", F.when(F.col("block_rate") >= reject, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "block_rate", "labels")
