"""Which URLs the robots files of their hosts let an agent fetch: rules as rows, and a join on path prefixes.

A robots file becomes rows of its lines; windows over a host's lines find the groups, the group that speaks to
the agent, and its rules in order. A URL is cut only to the lengths that its host's rules have, those prefixes
meet the rules in one equi-join, and the first rule in the file decides. Rows grow with the URLs and the few
lengths of a host's rules, not with URLs times rules.

The verdicts are those of the original standard: groups in order, the first whose agent is part of the
agent's name (without its version), else the first group of *; the first rule that begins the path; paths
compared with their escapes decoded and encoded anew; no group, or no rule that fits: allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import urls

#: Fields of a group besides its agents; any of them ends the list of agents.
RULES = ("allow", "disallow", "crawl-delay", "request-rate")
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def host_key(url: Column) -> Column:
    """scheme://authority of a URL, as the robots file's place is written."""
    return F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1)


def _decoded(c: Column) -> Column:
    return urls._unquoted(F.replace(c, F.lit("+"), F.lit("%2B")))


def _path(c: Column) -> Column:
    """A decoded path, with what marks empty parts dropped, encoded anew."""
    for pattern, kept in ((r"^([^?#]*)\?(#|$)", "$1$2"), ("^([^#]*)#$", "$1"), ("^([^?#]*/[^/;?#]*|[^/;?#]*);([?#]|$)", "$1$2")):
        c = F.regexp_replace(c, pattern, kept)
    return F.replace(F.replace(urls._quoted(c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def url_path(url: Column) -> Column:
    """What the rules are compared with: the URL behind its authority."""
    rest = F.regexp_extract(_decoded(url), "(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    return F.when(_path(rest) == "", "/").otherwise(_path(rest))


def rules(files: DataFrame, agent: str) -> DataFrame:
    """Rows (host, at, prefix, allow) of the rules that speak to the agent, in the order `at` of each host's file (host, body)."""
    name = agent.split("/")[0].lower()
    lines = files.select("host", F.posexplode(F.split("body", _BREAK)).alias("at", "raw"))
    text = F.regexp_replace(F.substring_index("raw", "#", 1), _STRIP, "")
    field = F.lower(F.regexp_replace(F.substring_index("text", ":", 1), _STRIP, ""))
    value = F.regexp_replace(F.regexp_extract("text", "(?s)^[^:]*:(.*)$", 1), _STRIP, "")
    lines = lines.withColumn("text", text).withColumn("field", F.when(F.col("raw") == "", "").when(F.col("text").contains(":"), field)).withColumn("value", value)
    kind = F.when(F.col("field") == "", "blank").when(F.col("field") == "user-agent", "agent").when(F.col("field").isin(*RULES), "rule")
    lines = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    order = Window.partitionBy("host").orderBy("at")
    lines = lines.withColumn("before", F.lag("kind").over(order))
    starts = (F.col("kind") == "agent") & ~F.coalesce(F.col("before") == "agent", F.lit(False))
    open_ = F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(order) == "agent"
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(order)).withColumn("open", open_).where("open AND kind <> 'blank'")
    named = F.lower(_decoded(F.col("value")))
    whole = Window.partitionBy("host", "group")
    lines = lines.withColumn("ruled", F.max(F.col("kind") == "rule").over(whole)).withColumn("any", F.max((F.col("kind") == "agent") & (named == "*")).over(whole))
    mine = F.max((F.col("kind") == "agent") & F.lit(name).contains(named)).over(whole)
    lines = lines.withColumn("rank", F.when(F.col("ruled") & ~F.col("any") & mine, F.col("group")).when(F.col("ruled") & F.col("any"), F.lit(1 << 30) + F.col("group")))
    spoken = lines.withColumn("first", F.min("rank").over(Window.partitionBy("host"))).where("rank = first AND field IN ('allow', 'disallow')")
    return spoken.select("host", "at", _path(_decoded(F.col("value"))).alias("prefix"), ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"))


def verdicts(fetches: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """fetches (url, ..) with (observed, allowed, notes), for robots responses (host, status, body), one a host at most.

    404: observed, all is allowed; no response or another status: allowed, not observed. A null URL, and one of a host without a
    response, counts as not fetched.
    """
    taken = {c.lower() for c in fetches.columns}
    ours = [n for n in ("host", "status", "lengths", "path", "id", "prefix", "at", "allow") if n in taken]
    if ours:
        raise ValueError(f"columns of fetches to be renamed first: {', '.join(ours)}")
    first = rules(files.where("status = 200").select("host", F.coalesce("body", F.lit("")).alias("body")), agent).groupBy("host", "prefix").agg(F.min(F.struct("at", "allow")).alias("rule"))
    lengths = first.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    known = files.select("host", "status").join(lengths, "host", "left")
    # equal URLs have one verdict
    seen = fetches.select("url").where("url IS NOT NULL").distinct().withColumn("host", host_key(F.col("url"))).join(known, "host", "left")
    cut = seen.where("lengths IS NOT NULL").withColumn("path", url_path(F.col("url"))).select("url", "host", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    decided = cut.select("url", "host", F.expr("left(path, n)").alias("prefix")).join(first, ["host", "prefix"]).groupBy("url").agg(F.min("rule").alias("rule"))
    allowed = F.coalesce(F.col("rule.allow"), F.lit(True))
    out = seen.select("url", "status").join(decided, "url", "left").select("url", F.coalesce(F.col("status").isin(200, 404), F.lit(False)).alias("observed"), allowed.alias("allowed"), urls.robots_note(F.col("status"), ~allowed, F.lit(False)).alias("notes"))
    out = fetches.join(out, "url", "left")
    return out.select(*fetches.columns, F.coalesce("observed", F.lit(False)).alias("observed"), F.coalesce("allowed", F.lit(True)).alias("allowed"), F.coalesce("notes", F.lit("robots_fetch_failed")).alias("notes"))
