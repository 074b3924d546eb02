"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Segments that are variable by their form, and what stands for them.
FORMS = ((r"^[0-9]+", "{n}"), (r"^[0-9a-f]{8,}", "{x}"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the (verdict, rule) pairs that fits, and its verdict; null if none does.

    A rule is a host and a path beginning, like example.org/es/; it fits the host and its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        own, slash, rest = r.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    """Leading digits, or a long leading hex run, become their wildcard; a file name's ending stays."""
    out = segment
    for pattern, mark in reversed(FORMS):
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, mark)).otherwise(out)
    return out


def segments_of(path: Column, max_depth: int | None) -> Column:
    """The path's segments by form; what lies deeper than max_depth is one segment **, and nothing is cut if that is None."""
    parts = F.transform(F.split(F.ltrim(path, F.lit("/")), "/"), _form)
    if max_depth is None:
        return parts
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))).otherwise(parts)


def _generalised(forms: DataFrame, variable_children: int, variable_repeats: float) -> DataFrame:
    """forms (host, form, n, segments) -> a row for each: host, form and path, its segments with those below variable nodes as *.

    Node by node from the root: a node's children are counted over all forms whose generalised path leads to it, so that
    what lies below a variable node is one node. A form leaves as soon as fewer than variable_children forms share its
    node, since no node below can then be variable; what all forms of a node have in common is passed in one step, so
    the rounds are as many as nodes with a choice on one path, not as its segments."""
    node = ["host", "path"]
    active, done = forms.select("host", "form", "n", F.expr("slice(segments, 1, 0)").alias("path"), F.col("segments").alias("rest")), []
    while True:
        sizes = active.filter(F.size("rest") > 0).groupBy(*node).agg(F.count("*").alias("forms"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        sizes = sizes.filter(F.col("forms") >= variable_children)
        differs = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True)
        shared = F.when(differs == 0, F.size("low")).otherwise(differs - 1) if variable_children > 1 else F.lit(0)
        at = written(active.join(sizes.select(*node, shared.cast("int").alias("shared")), node, "left"), "nodes")
        done.append(at.filter(F.col("shared").isNull() | (F.size("rest") == 0)).select("host", "form", F.concat("path", "rest").alias("path")))
        at = at.filter(F.col("shared").isNotNull() & (F.size("rest") > 0))
        if at.isEmpty():
            break
        at = at.select("host", "form", "n", F.expr("concat(path, slice(rest, 1, shared))").alias("path"), F.expr("slice(rest, shared + 1, size(rest))").alias("rest"))
        child = F.get("rest", F.lit(0))
        children = at.filter(F.size("rest") > 0).groupBy(*node, child.alias("segment")).agg(F.sum("n").alias("n"))
        nodes = children.groupBy(*node).agg(F.count("*").alias("kids"), F.sum("n").alias("n"))
        variable = nodes.filter((F.col("kids") >= variable_children) & (F.col("n") < variable_repeats * F.col("kids"))).select(*node, F.lit("*").alias("any"))
        step = F.when(F.size("rest") > 0, F.array(F.coalesce("any", child))).otherwise(F.expr("slice(rest, 1, 0)"))
        active = at.join(variable, node, "left").select("host", "form", "n", F.concat("path", step).alias("path"), F.expr("slice(rest, 2, size(rest))").alias("rest"))
    return reduce(DataFrame.unionByName, done)


def _merged(children: DataFrame, similar_z: float) -> DataFrame:
    """children (node, child, known, bad) -> node, child, merged, known and bad: siblings that are statistically similar
    are one branch, with the labels of all of them.

    A labelled child is similar if its share of bad labels is within similar_z standard errors of the share of all of
    its siblings' labels together. Children without a label are merged with nobody."""
    pools = children.filter("known > 0").groupBy("node").agg((F.sum("bad") / F.sum("known")).alias("common"))
    near = F.abs(F.col("bad") / F.col("known") - F.col("common")) <= similar_z * F.sqrt(F.col("common") * (1 - F.col("common")) / F.col("known"))
    known = F.col("known") > 0
    marked = children.join(pools, "node", "left").withColumn("merged", known & F.coalesce(F.when(known, near), F.lit(False)))
    sums = marked.filter("merged").groupBy("node").agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
    out = marked.join(sums, "node", "left")
    return out.select("node", "child", "merged", *[F.when(F.col("merged"), F.col(f"all_{c}")).otherwise(F.col(c)).alias(c) for c in ("known", "bad")])


def _branches(templates: DataFrame, similar_z: float) -> DataFrame:
    """templates (host, template, path, known, bad) -> host, template, evidence (its own labels) and levels, the known and
    bad labels of every node on its path.

    Node by node from the host: similar children become one node, below which their subtrees lie over one another, so
    that equal segments are one child there, and are compared with their siblings in turn. What all templates of a node
    have in common is passed in one step, so the rounds are as many as nodes with a choice on one path, and a template
    that has a node to itself is done. A node is named by its segments, null for those that were merged."""
    none = F.array().cast("array<struct<known: bigint, bad: bigint>>")
    active, done = templates.select("host", "template", "known", "bad", F.array("host").alias("node"), F.col("path").alias("rest"), none.alias("levels")), []
    labels = lambda known, bad: F.struct(F.col(known).cast("bigint").alias("known"), F.col(bad).cast("bigint").alias("bad"))
    while True:
        more = active.filter(F.size("rest") > 0)
        alike = more.groupBy("node").agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        differs = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True)
        shared = F.when(differs == 0, F.size("low")).otherwise(differs - 1).cast("int")
        at = active.join(alike.select("node", shared.alias("shared"), "all_known", "all_bad"), "node", "left")
        own = (F.size("rest") > 0) & F.col("shared").isNotNull()
        at = at.withColumn("levels", F.when(own, F.concat("levels", F.array_repeat(labels("all_known", "all_bad"), F.col("shared")))).otherwise(F.col("levels")))
        at = written(at.withColumn("rest", F.when(own, F.expr("slice(rest, shared + 1, size(rest))")).otherwise(F.col("rest"))).drop("shared", "all_known", "all_bad"), "branches")
        done.append(at.filter(F.size("rest") == 0).select("host", "template", F.col("known").alias("evidence"), "levels"))
        at = at.filter(F.size("rest") > 0)
        if at.isEmpty():
            return reduce(DataFrame.unionByName, done)
        at = at.withColumn("child", F.get("rest", F.lit(0)))
        children = written(at.groupBy("node", "child").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")), "children")
        merged = _merged(children, similar_z).select("node", "child", "merged", labels("known", "bad").alias("level"))
        segment = F.when(~F.col("merged"), F.col("child"))
        active = at.join(merged, ["node", "child"]).select(
            "host", "template", "known", "bad", F.concat("node", F.array(segment)).alias("node"), F.expr("slice(rest, 2, size(rest))").alias("rest"), F.concat("levels", F.array("level")).alias("levels")
        )


def _purity(start: Column, levels: Column, m: float) -> Column:
    """Shares smoothed from the root to a leaf: every level's labels with m labels of the share above it."""
    return F.aggregate(levels, start.cast("double"), lambda p, x: (x["bad"] + F.lit(m) * p) / (x["known"] + F.lit(m)))


def judge_templates(
    labelled: DataFrame,
    *,
    variable_children: int = 10,
    variable_repeats: float = 3.0,
    similar_z: float = 2.0,
    prior_weight: float = 5.0,
) -> DataFrame:
    """labelled (host, segments, label: 1 bad, 0 good, null unknown) -> a row for each host and segments: template, evidence
    (the labels of its own template) and purity, the smoothed share of bad ones.

    1. The tree: rows are counted by host and path form, so that everything after works on distinct forms. A node with
       at least variable_children children that occur fewer than variable_repeats times on average is variable: its
       children become *, and are one node whose own children are counted together.
    2. Branches: siblings of one node that are statistically similar are merged (see _merged), and their subtrees with
       them (see _branches), level by level; others, and those without a label, stay apart.
    3. Purity: from the whole table's share over the host's domains (com, example.com, ...) and the path's nodes down to
       the template, every level's labels are smoothed with prior_weight labels of the level above. So a template
       without labels has the purity of the nearest node above it that has some, at whatever depth."""
    forms = (
        labelled.groupBy("host", "segments")
        .agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("bad"))
        .withColumn("form", F.concat_ws("/", "segments"))
    )
    forms = written(forms, "forms")
    general = _generalised(forms, variable_children, variable_repeats).select("host", "form", "path", F.concat_ws("/", "path").alias("template"))
    forms = written(forms.join(general, ["host", "form"]).select("host", "segments", "path", "template", "known", "bad"), "templates")
    templates = written(forms.groupBy("host", "template").agg(F.first("path").alias("path"), F.sum("known").alias("known"), F.sum("bad").alias("bad")), "counts")

    levels = _branches(templates, similar_z)

    # The host's domains, the shortest first.
    hosts = written(templates.groupBy("host").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")), "hosts")
    parts = F.split("host", r"\.")
    domains = hosts.select("host", "known", "bad", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.concat_ws(".", F.slice(parts, -d, d)).alias("domain")))).alias("s"))
    domains = domains.select("host", "known", "bad", "s.*")
    sums = written(domains.groupBy("domain").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")), "domains")
    whole = hosts.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("known")), F.lit(0.0)).alias("share")).first()["share"]  # one number
    above = domains.select("host", "domain", "depth").join(sums, "domain").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("depth", "known", "bad"))).alias("levels"))
    above = written(above.select("host", _purity(F.lit(whole), F.col("levels"), prior_weight).alias("share")), "shares")

    purity = levels.join(above, "host").select("host", "template", "evidence", _purity(F.col("share"), F.col("levels"), prior_weight).alias("purity"))
    return forms.select("host", "segments", "template").join(written(purity, "purity"), ["host", "template"])


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
    max_depth: int | None = None,
    block_purity: float = 0.8,
    **tree,
) -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict, template, evidence and purity.

    A rule's verdict stands where one fits. The other urls are judged by their path template (see judge_templates): it
    is blocked if its smoothed share of bad labels is at least block_purity. Labels come from label_col (1 bad, 0 good,
    null unknown) or else from the rules' own verdicts, which cover a part of the urls.

    Cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged as the template of that
    host; repeated rows and urls are judged alike (and count as often as they occur); whole paths count, unless max_depth cuts deeper ones, which then end in **; an empty
    table gives an empty result; other columns are ignored, whatever their names.

    Scale: only id and url are read. Rows are counted by host and form first, with partial sums in each task, so a host
    with a third of all urls is a few rows from there on; verdicts come back by a join that Spark splits where a form is hot."""
    url = F.col(f"`{url_col}`")
    known = (F.col(f"`{label_col}`") if label_col else F.lit(None)).cast("int")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), known.alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("segments", segments_of(F.col("path"), max_depth))
    if not label_col:
        rows = rows.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")))
    judged = written(judge_templates(rows, **tree), "judged")
    out = rows.join(judged, ["host", "segments"])
    own = F.when(F.col("purity") >= block_purity, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "evidence", "purity")
