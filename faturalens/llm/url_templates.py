"""URL filters by path-template trees.

Per host, paths form a tree of segments. Going down level by level, a segment is generalised to
a wildcard of its kind (number, number with an ending, hexadecimal, long mixed) where the branch
shows many different ones for its size; other segments stay themselves. Sibling branches whose share
of blocked urls can't be told from that of their parent's other urls are merged into one branch; the end
of a path is a branch of its own. The leaves are templates. Each has a purity: the share of blocked urls
among its labelled ones, smoothed by that of its parent branch, which is smoothed by its own, up to the
host and all hosts. Templates whose purity exceeds `MOST_BLOCKED` are rejected.

The labels come from rules (host, path, verdict): the longest rule that fits a url decides it and
labels it; the method decides all others. Urls are first folded to distinct paths. Each level is a few
group-bys over (host, branch) keys and joins with what they give, written before the next
level begins, so that the plan of a level doesn't hold those above it, and no host is ever gathered
in one task. A path, or template, that is alone in its branch meets no other any more and
is finished at once. So there are as many levels as different paths share, however long paths are.

A null url, or one without `://`, has an empty host and path and is judged by the tree as a host of
its own. Paths of any length are read whole; with `depth` given, segments beyond it are one wildcard
tail. Repeated rows count and are judged alike. An empty table gives an empty one. Only page_id
and url are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common

# The rules that are given, as host/path and verdict.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
# A kind becomes a wildcard in a branch with at least so many different segments of the kind,
LEAST_KINDS = 4
# or with so few urls to each.
MOST_PER_SEGMENT = 3.0
SMOOTHING = 4.0
MERGE_Z = 2.58
MOST_BLOCKED = 0.5
TAIL = "**"
MERGED = "~"
END = ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    raw_host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(raw_host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def with_rule(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """pages (host, path, ...) with rule and rule_verdict of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From short to long, so that the longest that fits is asked first.
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def segments(path: Column, depth: int | None = None) -> Column:
    """The path's segments behind its first slash; with `depth`, those beyond it are one tail."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    if depth is None:
        return parts
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit(TAIL)))).otherwise(parts)


def kind(segment: Column) -> Column:
    """The wildcard that a segment may become; null for a plain word."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{x}")
        .when(segment.rlike(r"^(?=.*[0-9]).{12,}$"), "{s}")
    )


def folded(labelled: DataFrame) -> DataFrame:
    """Distinct (host, parts) with counts of urls, labelled ones and blocked ones."""
    return labelled.groupBy("host", "parts").agg(
        F.count("*").alias("n"), F.count("rule_verdict").alias("labelled"), F.count_if(F.col("rule_verdict") == "block").alias("blocked")
    )


def below(branch: Column, step: Column) -> Column:
    """The key of the branch that a step leads to."""
    return F.md5(F.concat_ws("\n", branch, F.md5(step)))


def behind(steps: Column) -> Column:
    """All but the first."""
    return F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))


def generalised(urls: DataFrame) -> DataFrame:
    """(host, parts, template, n, labelled, blocked): each segment, or the wildcard of its kind where its branch has many."""
    kept = ["host", "parts", "template", "n", "labelled", "blocked"]
    # Each level takes the first of what is left of a path, so that all levels are the same compiled code.
    current = urls.withColumns({"template": F.array().cast("array<string>"), "branch": F.lit(""), "rest": F.col("parts")})
    done = []
    while True:
        ended = F.size("rest") == 0
        done.append(current.where(ended).select(*kept))
        here = F.get("rest", F.lit(0))
        current = current.where(~ended).withColumn("segment", here).withColumn("kind", kind(here))
        # Group-bys one after the other: different segments of a kind are counted without gathering them.
        each = current.groupBy("host", "branch", "kind", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        kinds = each.groupBy("host", "branch", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("urls"), F.sum("paths").alias("paths"))
        many = F.col("kind").isNotNull() & ((F.col("different") >= LEAST_KINDS) | (F.col("urls") <= MOST_PER_SEGMENT * F.col("different")))
        # Written, so that the join knows its size, and a hot branch's rows can be split.
        branches = common.written(
            kinds.groupBy("host", "branch").agg(F.collect_set(F.when(many, F.col("kind"))).alias("wild"), (F.sum("paths") == 1).alias("alone"))
        )
        shown = F.when(F.array_contains("wild", F.col("kind")), F.col("kind")).otherwise(F.col("segment"))
        grown = common.written(
            current.join(branches, ["host", "branch"]).select(
                *[name for name in kept if name != "template"],
                F.concat("template", F.array(shown)).alias("template"),
                below(F.col("branch"), shown).alias("branch"),
                behind(F.col("rest")).alias("rest"),
                "alone",
            )
        )
        # Alone in its branch, a segment is the only one of its kind, at this level and at each behind it.
        last = F.transform(
            "rest", lambda segment: F.when((F.col("n") <= MOST_PER_SEGMENT) & kind(segment).isNotNull(), kind(segment)).otherwise(segment)
        )
        done.append(grown.where("alone").withColumn("template", F.concat("template", last)).select(*kept))
        current = grown.where(~F.col("alone")).drop("alone")
        if current.isEmpty():
            return reduce(DataFrame.union, done)


def purity(counts: DataFrame, above: Column) -> Column:
    return smoothed(F.col("blocked"), F.col("labelled"), above)


def smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + SMOOTHING * above) / (labelled + SMOOTHING)


def rated(urls: DataFrame) -> DataFrame:
    """(host, template, purity) of every template, siblings being merged level by level."""
    sums = [F.sum(name).alias(name) for name in ("labelled", "blocked")]
    templates = common.written(urls.groupBy("host", "template").agg(*sums))
    overall = templates.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    base = ((overall["b"] or 0) + 0.5) / ((overall["l"] or 0) + 1)
    hosts = templates.groupBy("host").agg(*sums)
    hosts = hosts.select(
        "host", purity(hosts, F.lit(base)).alias("purity"), F.col("labelled").alias("up_labelled"), F.col("blocked").alias("up_blocked")
    )
    current = common.written(templates.join(hosts, "host").withColumns({"branch": F.lit(""), "rest": F.col("template")}))
    kept = ["host", "template", "purity"]
    done = []
    while True:
        # A step begins with a slash, but for the end of a path.
        step = F.when(F.size("rest") > 0, F.concat(F.lit("/"), F.get("rest", F.lit(0)))).otherwise(END)
        current = current.withColumn("step", step)
        key = ["host", "branch", "step"]
        nodes = current.groupBy(*key).agg(
            F.sum("labelled").alias("own_labelled"),
            F.sum("blocked").alias("own_blocked"),
            F.count("*").alias("members"),
            F.first("purity").alias("up"),
            F.first("up_labelled").alias("up_labelled"),
            F.first("up_blocked").alias("up_blocked"),
        )
        # A branch against the rest of its parent: without a clear difference in shares it is merged.
        rest = F.col("up_labelled") - F.col("own_labelled")
        pooled = (F.col("up_blocked") + 0.5) / (F.col("up_labelled") + 1)
        share = F.col("own_blocked") / F.nullif(F.col("own_labelled"), F.lit(0))
        rest_share = (F.col("up_blocked") - F.col("own_blocked")) / F.nullif(rest, F.lit(0))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("own_labelled"), F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
        stands = F.coalesce(F.abs(share - rest_share) / spread >= MERGE_Z, F.lit(False))
        nodes = nodes.withColumn("to", F.when(stands, F.col("step")).otherwise(MERGED))
        merged = nodes.groupBy("host", "branch", "to").agg(
            F.sum("own_labelled").alias("labelled"), F.sum("own_blocked").alias("blocked"), F.sum("members").alias("members"), F.first("up").alias("up")
        )
        merged = merged.select(
            "host", "branch", "to", "members", purity(merged, F.col("up")).alias("purity"),
            F.col("labelled").alias("up_labelled"), F.col("blocked").alias("up_blocked"),
        )
        # Dealt by other keys than the next join's, so that its sides are plain shuffles, which a hot branch's rows can be split in.
        chosen = nodes.select(*key, "to").join(merged, ["host", "branch", "to"])
        moved = current.drop("purity", "up_labelled", "up_blocked").join(chosen, key)
        grown = common.written(moved.withColumns({"branch": below(F.col("branch"), F.col("to")), "rest": behind(F.col("rest"))}))
        # Alone in its branch, a template is merged with nothing at each level that it has left, its end included.
        left = F.sequence(F.lit(0), F.size("rest"))
        last = F.aggregate(left, F.col("purity"), lambda p, _: smoothed(F.col("blocked"), F.col("labelled"), p))
        done.append(grown.where(F.col("step") == END).select(*kept))
        done.append(grown.where((F.col("step") != END) & (F.col("members") == 1)).withColumn("purity", last).select(*kept))
        current = grown.where((F.col("step") != END) & (F.col("members") > 1)).drop("step", "to", "members")
        if current.isEmpty():
            return reduce(DataFrame.union, done)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, depth: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every url."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    split = with_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    labelled = split.withColumn("parts", segments(F.col("path"), depth))
    templates = common.written(generalised(common.written(folded(labelled))))
    rates = common.written(rated(templates))
    known = common.written(templates.select("host", "parts", "template").join(rates, ["host", "template"]))
    found = labelled.join(known, ["host", "parts"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity") > MOST_BLOCKED, "block").otherwise("allow"))
    shown = F.concat(F.lit("/"), F.array_join("template", "/"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), shown.alias("template"), "purity")
