"""URL verdicts by domain rules, and beyond them by a tree of path templates with labelled purity."""
from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import pin


@dataclass(frozen=True)
class TreeSettings:
    """Settings of the template tree."""
    depth: int = 4            # segments kept apart; what lies deeper is one segment, **
    max_children: int = 64    # a branch with more children has a variable segment there
    min_labelled: int = 5     # labelled urls that a branch needs to be compared with its siblings
    z: float = 1.96           # branches whose shares differ by less than this many standard errors are alike
    prior: float = 0.1        # share of bad urls expected before any label is seen
    strength: float = 1.0     # labelled urls that the prior counts for
    reject: float = 0.5       # smoothed share of bad urls from which a template is rejected


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or a url without ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://", "")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. A rule is (host/path, allow or block)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones are longer and win
        at, under = rule.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + under))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _segments(path: Column, depth: int) -> list[Column]:
    """The path's first segments with every run of digits as *, null where there is none; then ** for what lies deeper."""
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), lambda s: s != "")
    first = [F.get(parts, F.lit(i)) for i in range(depth)]
    return [*first, F.when(F.size(parts) > depth, F.lit("**"))]


def template_purity(urls: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Template and smoothed share of bad urls for each distinct (host, generalised path): `host, s0 .., template, purity`.

    `urls` has host, path and bad (1, 0, or null: not labelled). Urls are folded to distinct generalised paths with counts before
    anything else, so the tree is built on counts. Level by level, from the root: a child whose labelled share does not differ
    from that of its siblings by `z` standard errors is merged into the wildcard branch *, and so are thinly labelled children of
    a parent with more than `max_children`, whose segment is variable. Then each leaf's labels are counted and smoothed.
    """
    levels = [f"s{i}" for i in range(settings.depth)]
    keys = ["host", *levels, "deep"]
    parts = _segments(F.col("path"), settings.depth)
    tree = (urls.select("host", *[c.alias(k) for c, k in zip(parts, [*levels, "deep"])], "bad")
            .groupBy(*keys).agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")))
    tree = pin(tree.select(*keys, "labelled", "bad", *[F.col(k).alias(f"t_{k}") for k in levels]))
    for i, level in enumerate(levels):
        above = ["host", *[f"t_{k}" for k in levels[:i]]]
        child = tree.where(F.col(level).isNotNull()).groupBy(*above, level).agg(F.sum("labelled").alias("c_n"), F.sum("bad").alias("c_bad"))
        parent = child.groupBy(*above).agg(F.sum("c_n").alias("p_n"), F.sum("c_bad").alias("p_bad"), F.count(F.lit(1)).alias("children"))
        both = _same(child, parent, above)
        rest_n, rest_bad = F.col("p_n") - F.col("c_n"), F.col("p_bad") - F.col("c_bad")
        share = F.col("p_bad") / F.col("p_n")
        error = F.sqrt(share * (1 - share) * (1 / F.col("c_n") + 1 / rest_n))
        enough = (F.col("c_n") >= settings.min_labelled) & (rest_n >= settings.min_labelled)
        alike = F.abs(F.col("c_bad") / F.col("c_n") - rest_bad / rest_n) < settings.z * error + 1e-12
        merged = F.when(enough, alike).otherwise((F.col("children") > settings.max_children) & (F.col("c_n") < settings.min_labelled))
        moved = both.where(merged).select(*above, F.col(level))
        # written per level: the next level reads it three times
        tree = pin(_same(tree.drop(f"t_{level}"), moved.withColumn("moved", F.lit(True)), [*above, level], how="left").withColumn(
            f"t_{level}", F.when(F.col("moved"), F.lit("*")).otherwise(F.col(level))).drop("moved"))
    template = F.concat(F.col("host"), F.lit("/"), F.concat_ws("/", *[f"t_{k}" for k in levels], "deep"))
    tree = tree.withColumn("template", template)
    leaf = tree.groupBy("template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("n_bad"))
    purity = (F.col("n_bad") + settings.prior * settings.strength) / (F.col("n") + settings.strength)
    return tree.select(*keys, "template").join(leaf.select("template", purity.alias("purity")), "template")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    right = right.select(*[F.col(k).alias(f"r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    out = on[0]
    for x in on[1:]:
        out = out & x
    return left.join(right, out, how).drop(*[f"r_{k}" for k in keys])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], bad_words: list[str], url_col: str = "url",
               settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Adds `host, path, rule, verdict` to every row; existing columns of these names are replaced.

    A rule's verdict holds where one fits. Labels for the tree are the rules' verdicts (block: bad, allow: good) and hosts that
    hold one of `bad_words` between dots and hyphens (bad). Elsewhere a url is blocked when its template's smoothed share of bad
    urls reaches `reject`, and allowed otherwise; a template without labels has the prior share. A null url, or one without ://,
    has empty host and path, meets no rule and is judged by the template of empty paths. Only narrow rows are shuffled.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("__says", says)
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in bad_words])) if bad_words else F.lit(False)
    bad = F.when(seeded, 1).when(F.col("__says") == "block", 1).when(F.col("__says") == "allow", 0)
    purity = template_purity(rows.select("host", "path", bad.alias("bad")), settings)
    levels = [f"s{i}" for i in range(settings.depth)]
    keyed = rows.select("*", *[c.alias(f"__{k}") for c, k in zip(_segments(F.col("path"), settings.depth), [*levels, "deep"])])
    tree = purity.select(F.col("host").alias("__host"), *[F.col(k).alias(f"__t{k}") for k in [*levels, "deep"]], F.col("purity").alias("__purity"))
    on = F.col("host") == F.col("__host")
    for k in [*levels, "deep"]:
        on = on & F.col(f"__{k}").eqNullSafe(F.col(f"__t{k}"))
    verdict = F.coalesce(F.col("__says"), F.when(F.col("__purity") >= settings.reject, F.lit("block")).otherwise(F.lit("allow")))
    out = keyed.join(tree, on, "left").withColumn("verdict", verdict)
    return out.drop("__says", "__host", "__purity", *[f"__{k}" for k in [*levels, "deep"]], *[f"__t{k}" for k in [*levels, "deep"]])
