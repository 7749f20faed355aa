"""URL filter: fixed rules, then a path-template tree per host that learns which templates to reject.

The tree grows level by level over pre-aggregated paths, as deep as a node still has ``LEAST_PAGES`` pages.  Segments are
first brought to a shape (numbers, hexadecimal ids).  Where a node's values are many or mostly single, only those with a
fair part of its pages stay and the rest become a wildcard.  Then children whose labelled shares don't differ
significantly, and children without labels, are merged into one branch each, so that what lies below them is pooled.  A template is rejected when its
smoothed share of bad labels passes a threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spherion.llm.shared import ascii_lower, written

#: Fixed values of the contract, and words in a host that label its pages bad.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BAD_WORDS = ("adult", "casino", "porn", "xxx", "viagra", "betting", "gambling", "escort")
#: Pages of a node from which it grows, and levels at most; what lies deeper is one wildcard.
LEAST_PAGES, DEPTH = 4, 32
#: A node with more values than FANOUT, or with at least SINGLES values of which most occur once, has a wildcard; beside
#: it stays what has one page in KEPT of the node's, and LEAST_PAGES.
FANOUT, SINGLES, KEPT = 32, 8, 64
#: Parts in which the paths of one node meet its children, so that a host with most of the pages is not one task.
SALTS = 16
#: Smoothing towards PRIOR with the weight of PSEUDO labels; the share beyond which a template goes; significance.
PRIOR, PSEUDO, PURITY, Z = 0.1, 2.0, 0.6, 1.96


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.  ``rules`` are few: one expression holds them all."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(segment: Column) -> Column:
    """Digits as ``<n>``, hexadecimal ids as ``<x>``; the rest stays."""
    return F.regexp_replace(F.regexp_replace(segment, r"(?<![0-9A-Za-z])(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F]{8}[0-9a-fA-F-]*(?![0-9A-Za-z])", "<x>"), r"[0-9]+", "<n>")


def smoothed(bad: Column, labelled: Column) -> Column:
    return (bad + PRIOR * PSEUDO) / (labelled + PSEUDO)


def _salt(paths: DataFrame) -> DataFrame:
    return paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))


def _spread(few: DataFrame) -> DataFrame:
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def node_children(tree: DataFrame, part: Column) -> DataFrame:
    """(host, node, names): for each node that grows, the branch of each value that stays; what isn't there is ``*``.

    A node keeps at most KEPT values or FANOUT, so a row and the windows below are bounded whatever a node holds.
    """
    values = tree.where(part.isNotNull()).groupBy("host", "node", part.alias("part")).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    nodes = values.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.count("*").alias("fan"), F.sum((F.col("n") == 1).cast("long")).alias("single")).where(F.col("pages") >= LEAST_PAGES)
    wild = (F.col("fan") > FANOUT) | ((F.col("fan") >= SINGLES) & (2 * F.col("single") > F.col("fan")))
    h = nodes.select(F.col("host").alias("h"), F.col("node").alias("o"), "pages", wild.alias("wild"))
    held = values.join(_spread(h), (values["host"] == F.col("h")) & (values["node"] == F.col("o")) & (F.pmod(F.xxhash64("part"), F.lit(SALTS)) == F.col("salt")))
    held = held.where(~F.col("wild") | ((F.col("n") * KEPT >= F.col("pages")) & (F.col("n") >= LEAST_PAGES)))
    known = F.col("labelled") > 0
    order, share = Window.partitionBy("host", "node").orderBy(known, "share", "part"), F.col("share")
    before, weight = F.lag("share").over(order), F.col("labelled") + PSEUDO
    spread = F.sqrt(share * (1 - share) / weight + before * (1 - before) / F.lag(weight).over(order))
    apart = F.coalesce((known != F.lag(known).over(order)) | (share - before > Z * spread), F.lit(True)).cast("int")
    held = held.select("host", "node", "part", "labelled", smoothed(F.col("bad"), F.col("labelled")).alias("share")).withColumn("apart", apart).withColumn("branch", F.sum("apart").over(order))
    merged = held.groupBy("host", "node", "branch").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    name = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("parts", "|"), F.lit("}")))
    entries = F.transform("parts", lambda x: F.struct(x.alias("k"), F.col("name").alias("v")))
    named = merged.withColumn("name", name).groupBy("host", "node").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("names"))
    empty = F.expr("cast(map() as map<string,string>)")
    return nodes.select("host", "node").join(named, ["host", "node"], "left").select(F.col("host").alias("h"), F.col("node").alias("o"), F.coalesce("names", empty).alias("names"))


def path_templates(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(host, path, labelled, bad, template) for each (host, path, n, labelled, bad) of ``paths``."""
    columns = ["host", "path", "n", "labelled", "bad", "parts", "node"]
    pieces = F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), shape_of)
    live = written(spark, paths.withColumn("parts", pieces).withColumn("node", F.lit("")).select(columns), "paths")
    done = []
    for level in range(DEPTH + 1):
        part = F.get("parts", F.lit(level))
        known = written(spark, node_children(live, part), "nodes") if level < DEPTH else None
        if known is None or known.isEmpty():
            tail = F.when(part.isNotNull(), F.lit("/**")).otherwise(F.lit(""))
            done.append(live.select("host", "path", "labelled", "bad", F.concat("node", tail).alias("template")))
            break
        salted = _salt(live)
        many = _spread(known).withColumnRenamed("salt", "s")
        found = salted.join(many, (salted["host"] == many["h"]) & (salted["node"] == many["o"]) & (salted["salt"] == many["s"]), "left")
        ends = part.isNull() | F.col("names").isNull()
        node = F.when(part.isNull(), F.col("node")).when(F.col("names").isNull(), F.concat("node", F.lit("/**"))).otherwise(F.concat("node", F.lit("/"), F.coalesce(F.try_element_at("names", part), F.lit("*"))))
        grown = written(spark, found.select("host", "path", "n", "labelled", "bad", "parts", node.alias("node"), ends.alias("ends")), "paths")
        done.append(grown.where("ends").select("host", "path", "labelled", "bad", F.col("node").alias("template")))
        live = grown.where("not ends").select(columns)
    return reduce(DataFrame.unionByName, done)


def template_verdicts(templates: DataFrame) -> DataFrame:
    """(host, template, share, verdict): a row per template; its share of bad labels is smoothed."""
    one = templates.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share = smoothed(F.col("bad"), F.col("labelled"))
    return one.select("host", "template", share.alias("share"), F.when(share > PURITY, "block").otherwise("allow").alias("verdict"))


def filter_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template): a row per row of ``pages`` (page_id, url).

    A page is labelled by ``labels`` (page_id, bad; of repeated ids the worst counts), else by the verdict of the rule that
    fits it (block: bad, allow: not), else as bad by a bad word in its host.  Null urls and those without ``://`` have empty
    host and path, and the template tree judges them like any other.  Repeated rows and null ids pass through; other
    columns are not read; an empty table gives an empty table.
    """
    given = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"))
    given = given.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seeded = reduce(lambda a, b: a | b, [F.col("host").contains(w) for w in BAD_WORDS])
    y = F.when(F.col("r.verdict").isNotNull(), (F.col("r.verdict") == "block").cast("int")).when(seeded, F.lit(1))
    labelled = given.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("y", y)
    if labels is not None:
        known = labels.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("__id")).agg(F.max(F.col("bad").cast("int")).alias("__bad"))
        labelled = labelled.join(known, labelled["page_id"] == known["__id"], "left").withColumn("y", F.coalesce("__bad", "y"))
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad"))
    templates = path_templates(spark, paths)
    verdicts = _spread(template_verdicts(templates).select("host", "template", F.col("verdict").alias("learnt")))
    judged = _salt(templates.select("host", "template", "path")).join(verdicts, ["host", "template", "salt"]).select(F.col("host").alias("h"), "template", F.col("path").alias("p"), "learnt")
    out = given.join(judged, (given["host"] == judged["h"]) & (given["path"] == judged["p"]), "left").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "learnt").alias("verdict"), "template")
