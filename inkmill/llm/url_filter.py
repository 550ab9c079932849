"""URL verdicts from rules, and from path templates where no rule fits. DataFrame functions only.

A host's paths form a tree, made from its root down. Digits in a segment are variable and
become `#`; a segment whose parent has many different children becomes `*` unless it is
frequent itself, and what is below all that became one `*` is below one node, so that the
next level is generalised over all of them. Sibling templates whose share of blocked urls doesn't differ from their common share by more than
chance (a test of proportions) are merged into one branch `~`. Urls that a rule judges are
the labelled ones. A branch's purity is its share of blocked labelled urls, smoothed
towards that of the same branch on all hosts, which is smoothed towards the share of all;
branches with a purity of at least BLOCK are rejected.

The tree is worked out on one row for each host and masked path with its counts, so a host
that has a third of all urls is as many rows as it has masked paths; the children of one
parent are counted by partial sums, not gathered. Each level is a step, written before the
next, with the paths that go on below a node of CHILDREN paths or more: a single url of very many
segments is done in one step, and there is no limit on depth.

Null urls and urls without `://` have empty host and path and are judged as such. Repeated
rows get equal verdicts; ties between equally long rules go to the first. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import materialise

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A parent with so many different children is variable; a child with this share of its rows isn't.
CHILDREN, FREQUENT = 12, 0.05
#: Standard deviations within which branches are alike, weight of the smoothing, and purity from which a branch is rejected.
ALIKE, WEIGHT, BLOCK = 1.96, 4.0, 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return pages.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOWER),
        "path": F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1),
    }).drop("rest")


def _rule_column(rules: tuple, value) -> Column:
    """value(rule) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def templates(counts: DataFrame) -> DataFrame:
    """counts (host, parts, n, ...), a row a path, with nodes, the segments of the template of each path.

    A node above fewer than CHILDREN paths has no variable child, nor has any below it, so that the rest of
    these paths stays as it is and goes no further down. The steps end with the last node that has more.
    """
    live = materialise(counts.withColumn("nodes", F.array().cast("array<string>")).withColumn("done", F.size("parts") == 0), "level")
    out, level = live.where("done"), 0
    while not live.where("not done").isEmpty():
        live = live.where("not done").withColumn("part", F.element_at("parts", level + 1))
        children = live.groupBy("host", "nodes", "part").agg(F.sum("n").alias("rows"), F.count("*").alias("paths"))
        families = children.groupBy("host", "nodes").agg(F.count("*").alias("kinds"), F.sum("rows").alias("all"), F.sum("paths").alias("below"))
        wild = (F.col("kinds") >= CHILDREN) & (F.col("rows") < FREQUENT * F.col("all"))
        turns = children.join(families, ["host", "nodes"]).select("host", "nodes", "part", F.when(wild, F.lit("*")).otherwise(F.col("part")).alias("node"), (F.col("below") < CHILDREN).alias("few"))
        grown = live.drop("done").join(turns, ["host", "nodes", "part"])
        rest = F.slice("parts", level + 1, F.size("parts"))
        grown = grown.withColumn("nodes", F.when(F.col("few"), F.concat("nodes", rest)).otherwise(F.array_append("nodes", F.col("node")))).withColumn("done", F.col("few") | (F.size("parts") == level + 1))
        live, level = materialise(grown.drop("part", "node", "few"), "level"), level + 1
        out = out.unionByName(live.where("done"))
    return out


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages (page_id, url)."""
    rows = parsed(pages.select("page_id", "url")).withColumns({
        "rule": _rule_column(rules, lambda r: r[1] + r[2]), "label": _rule_column(rules, lambda r: r[0]), "masked": F.regexp_replace("path", "[0-9]+", "#"),
    })
    counts = rows.groupBy("host", "masked").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum((F.col("label") == "block").cast("long")).alias("blocked")
    ).withColumn("blocked", F.coalesce("blocked", F.lit(0))).withColumn("parts", _segments(F.col("masked")))
    nodes = templates(counts).withColumns({"above": F.expr("array_join(slice(nodes, 1, greatest(size(nodes) - 1, 0)), '/')"), "template": F.array_join("nodes", "/")})
    branch = nodes.groupBy("host", "above", "template").agg(F.sum("labelled").alias("k"), F.sum("blocked").alias("b"))
    siblings = branch.groupBy("host", "above").agg(F.sum("k").alias("sk"), F.sum("b").alias("sb"), F.count("*").alias("kin"))
    share = F.col("sb") / F.greatest(F.col("sk"), F.lit(1))
    merged = branch.join(siblings, ["host", "above"]).withColumn(
        "branch", F.when((F.col("kin") > 1) & (F.abs(F.col("b") - F.col("k") * share) <= ALIKE * F.sqrt(F.col("k") * share * (1 - share)) + 0.5), F.concat("above", F.lit("/~"))).otherwise(F.col("template"))
    )
    own = merged.groupBy("host", "branch").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
    every = own.groupBy("branch").agg(F.sum("k").alias("ek"), F.sum("b").alias("eb"))
    total = own.agg((F.coalesce(F.sum("b"), F.lit(0)) / F.greatest(F.coalesce(F.sum("k"), F.lit(0)), F.lit(1))).alias("prior"))
    pure = own.join(every, "branch").crossJoin(F.broadcast(total)).select("host", "branch", F.round(
        (F.col("b") + WEIGHT * (F.col("eb") + WEIGHT * F.col("prior")) / (F.col("ek") + WEIGHT)) / (F.col("k") + WEIGHT), 6
    ).alias("purity"))  # total is one row
    of = nodes.select("host", "masked", "template").join(merged.select("host", "template", "branch"), ["host", "template"]).join(pure, ["host", "branch"])
    return rows.join(of.select("host", "masked", F.col("branch").alias("template"), "purity"), ["host", "masked"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("purity") >= BLOCK, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of pages."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rule_sql(value) -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in rules) + " END"


ORACLE = rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_rule_sql(lambda r: r[1] + r[2])} AS rule, {_rule_sql(lambda r: r[0])} AS label, regexp_replace(path, '[0-9]+', '#', 'g') AS masked FROM p),
c AS (SELECT host, masked, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked, list_filter(string_split(masked, '/'), lambda x: x <> '') AS parts FROM r GROUP BY host, masked),
tr AS (SELECT host, masked, n, labelled, blocked, parts, []::VARCHAR[] AS nodes, 0 AS level FROM c
  UNION ALL SELECT host, masked, n, labelled, blocked, parts, list_append(nodes, CASE WHEN kinds >= {CHILDREN} AND rws < {FREQUENT}::DOUBLE * every THEN '*' ELSE part END), level + 1 FROM (
    SELECT *, sum(n) OVER (PARTITION BY host, nodes, part) AS rws, sum(n) OVER (PARTITION BY host, nodes) AS every, count(DISTINCT part) OVER (PARTITION BY host, nodes) AS kinds
    FROM (SELECT *, parts[level + 1] AS part FROM tr WHERE len(parts) > level))),
no AS (SELECT host, masked, labelled, blocked, array_to_string(nodes[1:greatest(len(nodes) - 1, 0)], '/') AS above, array_to_string(nodes, '/') AS template FROM tr WHERE level = len(parts)),
br AS (SELECT host, above, template, sum(labelled) AS k, sum(blocked) AS b FROM no GROUP BY ALL),
sb AS (SELECT *, count(*) OVER s AS kin, sum(b) OVER s / greatest(sum(k) OVER s, 1)::DOUBLE AS share FROM br WINDOW s AS (PARTITION BY host, above)),
me AS (SELECT host, template, k, b, CASE WHEN kin > 1 AND abs(b - k * share) <= {ALIKE}::DOUBLE * sqrt(k * share * (1 - share)) + 0.5 THEN above || '/~' ELSE template END AS branch FROM sb),
ow AS (SELECT host, branch, sum(k) AS k, sum(b) AS b FROM me GROUP BY ALL),
ev AS (SELECT branch, sum(k) AS ek, sum(b) AS eb FROM ow GROUP BY ALL),
pr AS (SELECT coalesce(sum(b), 0)::DOUBLE / greatest(coalesce(sum(k), 0), 1)::DOUBLE AS prior FROM ow),
pu AS (SELECT host, branch, round((b + {WEIGHT}::DOUBLE * (eb + {WEIGHT}::DOUBLE * prior) / (ek + {WEIGHT}::DOUBLE)) / (k + {WEIGHT}::DOUBLE), 6) AS purity FROM ow JOIN ev USING (branch), pr)
SELECT page_id, r.host, path, rule, coalesce(label, CASE WHEN purity >= {BLOCK} THEN 'block' ELSE 'allow' END) AS verdict, pu.branch AS template, purity
FROM r JOIN no ON r.host = no.host AND r.masked = no.masked JOIN me ON me.host = no.host AND me.template = no.template JOIN pu ON pu.host = me.host AND pu.branch = me.branch
"""
