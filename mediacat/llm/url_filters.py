"""URL filters: allow and block rules, and a path-template tree that judges the urls no rule fits.

Built-in functions only.  Urls that a rule decides are the labelled ones.  Per host the path segments, to any depth, form a tree over
its lexical templates (paths whose segments with a digit are ``#``).  Level by level, the children of a node whose labelled share
differs from the node's by a binomial test keep a branch of their own, and all others, similar to the node and so to each other, merge into
the wildcard branch ``*``; among many children (more than FANOUT) chance sets some apart, so the test is stricter there.  A branch is
followed as long as it holds both labels.  A template is blocked when its purity, smoothed towards its parent's, reaches PURITY.

Everything is summed per lexical template before it is shuffled, and the levels work on these sums: a host with a third of all rows is
as many rows as it has templates.  Each level is kept in the shared folder.

Null urls and urls without ``://`` have an empty host and path, which no rule fits; of rules the longest wins, and of equally
long ones the last in order of their text; very long urls are deep trees, one level at a time; repeated rows are judged one by one;
other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, rule): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Children from which the stricter test holds, weight of the parent's purity, purity from which a template is blocked, and the
#: deviations that set a child apart among few and among many.
FANOUT, PRIOR, PURITY, Z, Z_MANY = 8, 4.0, 0.9, 1.96, 4.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    after = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones, the longer, win
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def template_tree(templates: DataFrame, pi: float) -> DataFrame:
    """templates: host, lex (segments joined by /), l (labelled urls), b (blocked ones).  (host, lex, template, purity) of each of them."""
    zero = lambda c: F.when(F.col("l") > 0, F.col(c) / F.col("l")).otherwise(F.lit(0.0))
    hosts = templates.groupBy("host").agg(((F.sum("b") + PRIOR * pi) / (F.sum("l") + PRIOR)).alias("above"))
    active = stored(templates.join(hosts, "host").withColumn("node", F.lit("")))
    done, depth = None, 0
    while done is None or not active.isEmpty():
        segment = F.coalesce(F.get(F.split("lex", "/"), F.lit(depth)), F.lit(""))
        rows = active.withColumn("s", segment)
        children = rows.groupBy("host", "node", "s").agg(F.sum("l").alias("cl"), F.sum("b").alias("cb"))
        nodes = children.groupBy("host", "node").agg(F.sum("cl").alias("l"), F.sum("cb").alias("b"), F.count(F.lit(1)).alias("fan"))
        nodes = nodes.select("host", "node", zero("b").alias("p"), F.when(F.col("fan") > FANOUT, Z_MANY).otherwise(Z).alias("z"))
        apart = F.abs(F.col("cb") - F.col("cl") * F.col("p")) > F.col("z") * F.sqrt(F.col("cl") * F.col("p") * (1.0 - F.col("p"))) + 0.5
        named = children.join(nodes, ["host", "node"]).select("host", "node", "s", F.concat("node", F.lit("/"), F.when(apart, F.col("s")).otherwise("*")).alias("branch"))
        moved = rows.join(named, ["host", "node", "s"])
        sums = moved.groupBy("host", "branch").agg(F.sum("l").alias("bl"), F.sum("b").alias("bb"), F.max("above").alias("parent"))
        sums = sums.select("host", "branch", ((F.col("bb") + PRIOR * F.col("parent")) / (F.col("bl") + PRIOR)).alias("purity"), ((F.col("bb") > 0) & (F.col("bb") < F.col("bl"))).alias("mixed"))
        depth += 1
        level = stored(moved.join(sums, ["host", "branch"]).select("host", "lex", "l", "b", F.col("branch").alias("node"), F.col("purity").alias("above"), (F.col("mixed") & (F.size(F.split("lex", "/")) > depth)).alias("on")))
        ended = level.where("NOT on").select("host", "lex", F.col("node").alias("template"), F.col("above").alias("purity"))
        done = ended if done is None else done.unionByName(ended)
        active = level.where("on").drop("on")
    return done


def url_filters(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template, purity."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parts(F.col("url"))
    rule, verdict = rule_columns(rules)
    lex = F.array_join(F.transform(F.array_remove(F.split("path", "/"), ""), lambda x: F.when(F.regexp_like(x, F.lit("[0-9]")), "#").otherwise(x)), "/")
    judged = source.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("ruled"), lex.alias("lex"))
    blocked = F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0))
    templates = stored(judged.groupBy("host", "lex").agg(F.count("ruled").alias("l"), blocked.alias("b")))  # read by all levels
    labelled = templates.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    tree = template_tree(templates, ((labelled["b"] or 0) + 1) / ((labelled["l"] or 0) + 2))
    verdicts = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return judged.join(tree, ["host", "lex"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", verdicts).alias("verdict"), "template", "purity")
