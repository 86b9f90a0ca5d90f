"""URL filter by path-template trees, in DataFrame operations only.

Each host has a tree of path segments. Level by level, a segment stays a literal if enough of its parent's urls have
it; the others are generalised into the wildcard `*`. Literal siblings whose labelled rates do not differ
significantly from the rest of their parent are merged into the wildcard too. A path's template is then its
segments so generalised. A template is rejected by its smoothed labelled purity: its rate of bad labels, drawn
towards the host's rate and that towards the rate of all.

Labels come from the caller; the query takes the verdicts of the url rules for them. All statistics cover all rows.
They are held by (host, prefix, segment) and summed with partial aggregation, so one host with a third of all urls is
spread over as many tasks as it has segments, or summed before it is shuffled. Tables of urls, segments and templates
grow with the input and are joined by sorting, never broadcast; rows of one very common url are what Spark splits as a
skewed side of such a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm.common import ascii_lower, materialise

#: (verdict, rule). A rule is host/path; it fits the host and its subdomains, and paths that start with its path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, after), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longer ones are put above
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + own_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def templates(urls: DataFrame, min_share: float, min_count: int, z: float) -> DataFrame:
    """urls (host, path, n, labelled, bad; distinct host and path) with the path's template.

    All paths are walked to their end. A step takes the segments that all paths of a group have in common, and then the one where they part.
    A group with fewer than min_count urls has wildcards from there on, and leaves the walk; so the steps are as many as the
    forks of common paths, however long a path is.
    """
    names = ["host", "path", "n", "labelled", "bad"]
    sums = ("n", "labelled", "bad")
    now = materialise(urls.select(*names, F.split(F.regexp_replace("path", "^/", ""), "/").alias("rest"), F.lit("").alias("template")))
    found: list[DataFrame] = []
    while now.take(1):
        groups = now.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in sums), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        # What the least and the greatest of a group have in common, all have.
        parting = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))
        groups = groups.withColumn("same", F.when(parting == 0, F.size("lo")).otherwise(parting - 1).cast("int")).drop("lo", "hi")
        rows = now.join(groups.hint("merge"), ["host", "template"])  # both grow with the urls, so neither is broadcast
        rare = F.col("all_n") < min_count
        wild = F.concat("template", F.repeat(F.lit("/*"), F.size("rest")))
        literal = F.concat("template", F.array_join(F.transform(F.slice("rest", 1, F.col("same")), lambda x: F.concat(F.lit("/"), x)), ""))
        rows = rows.withColumns({"template": F.when(rare, wild).otherwise(literal), "rest": F.when(rare, F.array().cast("array<string>")).otherwise(F.slice("rest", F.col("same") + 1, F.size("rest")))})
        rows = materialise(rows.drop("same"))
        found.append(rows.where(F.size("rest") == 0).select(*names, "template"))
        going = rows.where(F.size("rest") > 0).withColumn("at", F.get("rest", F.lit(0)))
        children = going.groupBy("host", "template", "at").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(f"all_{c}").alias(f"all_{c}") for c in sums))
        # A child differs if its labelled rate is further than z standard errors from that of its siblings.
        others = F.col("all_labelled") - F.col("labelled")
        pooled = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("labelled") + F.lit(1.0) / others))
        gap = F.abs(F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / others)
        differs = (F.col("labelled") > 0) & (others > 0) & (gap > z * error)
        common = (F.col("n") >= min_count) & (F.col("n") >= min_share * F.col("all_n"))
        kept = children.where(common & (differs | (F.col("labelled") == 0) | (others == 0))).select("host", "template", "at", F.lit(True).alias("literal"))
        going = going.join(kept.hint("merge"), ["host", "template", "at"], "left")
        part = F.when(F.col("literal"), F.concat(F.lit("/"), "at")).otherwise("/*")
        now = materialise(going.select(*names, F.slice("rest", 2, F.size("rest")).alias("rest"), F.concat("template", part).alias("template")))
    out = now.select(*names, "template")
    for part in found:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, threshold: float = 0.5, smoothing: float = 4.0, min_share: float = 0.02, min_count: int = 5, z: float = 2.0) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, template, purity.

    labels (url, bad 0 or 1) are the judgements to learn from; without them, the rules' verdicts are. A url that is null
    or without :// has an empty host and path, and so the template of that host. Repeated rows count as often as they occur and get the same verdict; a null
    page_id stays null; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    if labels is None:
        learn = rows.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    else:
        given = labels.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("label"))
        learn = rows.join(given, "url", "left")
    urls = learn.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad"))
    found = materialise(templates(materialise(urls), min_share, min_count, z))
    whole = found.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    hosts = found.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    trees = found.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
    trees = trees.join(hosts.hint("merge"), "host")
    base = ((whole["b"] or 0) + 1.0) / ((whole["l"] or 0) + 2.0)
    of_host = (F.col("hb") + smoothing * base) / (F.col("hl") + smoothing)
    trees = trees.select("host", "template", ((F.col("tb") + smoothing * of_host) / (F.col("tl") + smoothing)).alias("purity"))
    verdicts = found.select("host", "path", "template").join(trees.hint("merge"), ["host", "template"])
    own = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return rows.join(verdicts.hint("merge"), ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")
