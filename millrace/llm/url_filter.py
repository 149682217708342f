"""URL filters: rules for hosts and paths, and a path-template tree for urls that no rule fits.

The tree has a node for each host and template of a path. It is made from the top down, a segment at a time, from counts: children
of a node that are numbers, or are rare and hardly ever repeat, are one wildcard ``*``. Of the others, however many, those with enough labelled urls whose share of blocked ones does not differ
significantly from their siblings' are merged into one branch ``~``, and those without labelled urls whose next segments are distributed like those of their unlabelled siblings into one branch ``^``; the rest
keep their segment. It is as deep as the paths: levels are added until no row has a further segment. A node of fewer than ``FEW`` urls, or whose urls all end alike, can have neither wildcards by count nor branches, so the rest of its paths is added at once.

Urls that a rule fits are the labelled ones. A node's purity is the share of blocked urls among its labelled ones, drawn towards what its parent hands down with the weight of ``PRIOR`` urls; a host's is drawn
towards ``NEUTRAL``. A node hands down its purity as far as its urls are labelled: of a branch whose urls are all labelled all of it, of one without labels ``NEUTRAL``. A template is rejected if its purity reaches
``REJECT``. So one without labelled urls is rejected only where nearly all that surrounds it is labelled and blocked, never for what other hosts hold.

All of it is DataFrame operations. Counts are summed before they are dealt out, so a hot host costs a row a task and segment, and joins back to the rows are
sort-merge joins, whose hot keys Spark splits. A child's name is a row by host, template and segment, so a node can have any number of children.

Of rules of the same length that fit, the last in the order of their text wins. An empty table has no rows. Paths are read whole, however long. Null urls and those without ``://`` have an empty host and path, and are a host of their own. Null and repeated page_ids are kept. Other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import source, stored

#: A child with so many urls keeps its segment. A node's other children, if they have so many urls together and are more than half as many as these, are a wildcard.
FEW = 8
#: Labelled urls that a branch and its siblings each need before they can be merged, and the z value below which they are alike.
LABELLED, ALIKE = 5, 1.96
#: The least overlap of the distributions of next segments of unlabelled branches that are merged.
OVERLAP = 0.8
#: The purity that a host without labelled urls has, the weight in urls of what a parent hands down, and the purity from which a template is rejected.
NEUTRAL, PRIOR, REJECT = 0.5, 2.0, 0.9
#: Segments that are numbers or hexadecimal ids, maybe with a suffix.
VARIABLE = r"^[0-9a-f-]*[0-9][0-9a-f-]*(\.[a-z]{2,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it has none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(rows: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Adds rule and judged: the text and verdict of the longest rule that fits host and path, or null. Rules are a parameter of the job, not data."""
    rule, judged = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tried first, as it is added last
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        rule, judged = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(judged)
    return rows.withColumns({"rule": rule, "judged": judged})


def _purity(lab: Column, blk: Column, prior: Column) -> Column:
    return (blk + PRIOR * prior) / (lab + PRIOR)


def _handed(n: Column, lab: Column, blk: Column, prior: Column) -> Column:
    """What a node hands down to its children."""
    return NEUTRAL + (_purity(lab, blk, prior) - NEUTRAL) * lab / n


def _labels() -> list[Column]:
    return [F.count("*").alias("n"), F.count("judged").alias("lab"), F.count_if(F.col("judged") == "block").alias("blk")]


def _overlaps(rows: DataFrame, level: int, plain: DataFrame) -> DataFrame:
    """host, tpl, seg, overlap: of the distribution of next segments under an unlabelled child with that under its unlabelled siblings together. ``plain``: those children, with n and all_n (of all of them under the node)."""
    node = ["host", "tpl"]
    after = F.coalesce(F.get("segs", F.lit(level + 1)), F.lit("")).alias("after")
    below = rows.join(plain, [*node, "seg"]).groupBy(*node, "seg", after).agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("all_n").alias("all_n"))
    below = stored(below, f"below{level}")
    every = below.groupBy(*node, "after").agg(F.sum("m").alias("all_m"))
    both = F.least(F.col("m") / F.col("n"), F.try_divide(F.col("all_m") - F.col("m"), F.col("all_n") - F.col("n")))
    return below.join(every, [*node, "after"]).groupBy(*node, "seg").agg(F.sum(F.when(F.col("all_n") > F.col("n"), both)).alias("overlap"))


def _grown(rows: DataFrame, level: int) -> DataFrame:
    """Rows that have a segment of this level, with ``tpl`` longer by it, or by all further ones (``done``) where no level below can rename any; ``prior`` is what the template's parent hands down."""
    node = ["host", "tpl"]
    rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
    ends = F.xxhash64(F.slice("segs", level + 1, F.size("segs")))
    children = rows.groupBy(*node, "seg").agg(*_labels(), F.min(ends).alias("lo"), F.max(ends).alias("hi"), F.first("prior").alias("prior"))
    children = stored(children, f"children{level}")
    rare = F.col("n") < FEW
    nodes = children.groupBy(*node).agg(
        F.count_if(rare).alias("rare_kids"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rare_rows"), F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"),
        F.sum(F.when(~rare & (F.col("lab") == 0), F.col("n")).otherwise(0)).alias("all_n"), ((F.sum("n") < FEW) | (F.min("lo") == F.max("hi"))).alias("done"),
    )
    children = children.join(nodes, node)
    open_ = ~rare & (F.col("lab") == 0)
    plain = children.filter(open_ & ~F.col("done") & (F.col("all_n") > F.col("n"))).select(*node, "seg", "n", "all_n")
    children = children.join(_overlaps(rows, level, plain), [*node, "seg"], "left")
    wild = rare & (F.col("rare_rows") >= FEW) & (2 * F.col("rare_kids") > F.col("rare_rows"))
    rest_lab, rest_blk = F.col("all_lab") - F.col("lab"), F.col("all_blk") - F.col("blk")
    over = F.try_divide
    pooled = over(F.col("all_blk"), F.col("all_lab"))
    spread = F.sqrt(pooled * (1 - pooled) * (over(F.lit(1), F.col("lab")) + over(F.lit(1), rest_lab)))
    apart = F.abs(over(F.col("blk"), F.col("lab")) - over(rest_blk, rest_lab))
    alike = F.coalesce((F.col("lab") >= LABELLED) & (rest_lab >= LABELLED) & (apart <= ALIKE * spread), F.lit(False))
    name = F.when(wild, F.lit("*")).when(alike, F.lit("~")).when(F.col("overlap") >= OVERLAP, F.lit("^")).otherwise(F.col("seg"))
    named = stored(children.withColumn("name", name).select(*node, "seg", "name", "done", "n", "lab", "blk", "prior"), f"named{level}")
    handed = _handed(F.sum("n"), F.sum("lab"), F.sum("blk"), F.first("prior"))
    names = named.select(*node, "seg", "name", "done").join(named.groupBy(*node, "name").agg(handed.alias("handed")), [*node, "name"])
    more = F.when(F.col("done"), F.array_join(F.slice("segs", level + 1, F.size("segs")), "/")).otherwise(F.col("name"))
    last = F.col("done") | (F.size("segs") == level + 1)
    grown = rows.join(stored(names, f"names{level}"), [*node, "seg"]).withColumns({"tpl": F.concat("tpl", F.lit("/"), more), "prior": F.when(last, F.col("prior")).otherwise(F.col("handed")), "done": last})
    return stored(grown.drop("seg", "name", "handed"), f"templates{level}")


def templates(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, judged, tpl, prior: each url with its template and what the template's parent hands down."""
    host, path = parts(F.col(url_col).cast("string"))
    rows = ruled(pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")), rules)
    segs = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    rows = stored(rows.withColumns({"segs": segs, "tpl": F.lit(""), "done": F.size(segs) == 0}), "paths")
    hosts = rows.groupBy("host").agg(*_labels()).select("host", _handed(F.col("n"), F.col("lab"), F.col("blk"), F.lit(NEUTRAL)).alias("prior"))
    rows = rows.join(stored(hosts, "hosts"), "host")
    level, made = 0, rows.filter("done")
    while not (left := rows.filter("not done")).isEmpty():
        rows = _grown(left.drop("done"), level)
        level, made = level + 1, made.unionByName(rows.filter("done"))
    return stored(made.select("page_id", "host", "path", "rule", "judged", "tpl", "prior"), "templates")


def judge(made: DataFrame, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity. The rule's verdict, or block for rejected templates, else allow."""
    nodes = made.groupBy("host", "tpl").agg(*_labels(), F.first("prior").alias("p")).select("host", "tpl", _purity(F.col("lab"), F.col("blk"), F.col("p")).alias("purity"))
    verdict = F.coalesce("judged", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return made.join(stored(nodes, "purity"), ["host", "tpl"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("tpl").alias("template"), "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(templates(source(spark, sf_dir, "pages", "page_id", "url")))
