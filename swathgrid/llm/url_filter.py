"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule is a host and the beginning of a path; it fits its host and all subdomains. Hosts are compared as canonical
keys, their labels reversed and each ended by a dot (`www.example.org` is `org.example.www.`), so that a host's
subdomains are the strings that begin with its key: an interval. Paths that begin with a rule's path are an interval,
too. Two intervals of prefixes are nested or apart, never crossed.

So both questions are a sorted sweep. Interval ends and points are laid in one order; the running sum of +1 for an
opening and -1 for a closing is the height of the stack of active rules, and the rule at a level of the stack is the
last one opened at that level. Hosts are swept first (distinct ones only): the whole stack tells all rule hosts above
a host. Then the distinct URLs are swept under each of these, and the top of the stack is the longest path that fits.

A group of the sweep with more than PER_SWEEP points is dealt into slices by hash, each with a copy of the group's rules.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Points of one group in one slice of a sweep.
PER_SWEEP = 500_000
#: What is said of a URL that no rule fits.
DEFAULT = "allow"


def lower(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://` up to `/`, `?` or `#` (A-Z lower-cased), and from there up to `?` or `#`. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) from rules like ("example.org/es/", "block"): the path begins with the first slash."""
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for rule, verdict in rules))
    whole = spark.range(1).select(F.inline(rows)) if rules else spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    host = F.substring_index("rule", "/", 1)
    return whole.select(host.alias("host"), F.col("rule").substr(F.length(host) + 1, F.length("rule")).alias("path"), "verdict")


def _reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bytes(text: Column) -> Column:
    """Ordered like the text; never holds the byte FF, which closes an interval behind all strings with its prefix."""
    return F.make_valid_utf8(text).cast("binary")


def sweep(points: DataFrame, intervals: DataFrame, levels: bool, per_sweep: int = PER_SWEEP) -> DataFrame:
    """Points with the prefixes that they begin with, by a sorted sweep with a stack of the active intervals.

    points: _by, _key and `point` (any struct); intervals: _by, _key (the prefix, distinct in its group) and `rule`. Only
    pairs of the same _by meet. Returns (_by, point, rule): with levels a row for each active interval of a point, else one
    for the innermost. Points without any are left out.
    """
    # at most (number of points / per_sweep) groups are larger than per_sweep: a list that may be broadcast
    large = points.groupBy("_by").count().where(F.col("count") > per_sweep)
    large = F.broadcast(cut(large.select(F.col("_by").alias("_large"), F.ceil(F.col("count") / per_sweep).cast("int").alias("_slices"))))
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    dealt = points.join(large, F.col("_by") == F.col("_large"), "left").withColumn("_slice", F.pmod(F.xxhash64("_key", "point"), slices).cast("int"))
    copied = intervals.join(large, F.col("_by") == F.col("_large"), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    key, point, rule = _bytes(F.col("_key")).alias("_k"), points.schema["point"].dataType, intervals.schema["rule"].dataType
    none, nothing = F.lit(None).cast(point).alias("point"), F.lit(None).cast(rule).alias("rule")
    opened = copied.select("_by", "_slice", key, F.lit(0).alias("_kind"), F.lit(1).alias("_step"), none, "rule")
    met = dealt.select("_by", "_slice", key, F.lit(1).alias("_kind"), F.lit(0).alias("_step"), "point", nothing)
    closed = copied.select("_by", "_slice", F.concat(_bytes(F.col("_key")), F.lit(b"\xff")).alias("_k"), F.lit(2).alias("_kind"), F.lit(-1).alias("_step"), none, nothing)
    so_far = Window.partitionBy("_by", "_slice").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = opened.union(met).union(closed).withColumn("_height", F.sum("_step").over(so_far)).where("_kind < 2 and _height > 0")
    if levels:
        lowest = F.when(F.col("_kind") == 1, F.lit(1).cast("long")).otherwise(F.col("_height"))
        stack = stack.withColumn("_height", F.explode(F.sequence(lowest, "_height")))
    same_level = Window.partitionBy("_by", "_slice", "_height").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return stack.withColumn("rule", F.last("rule", ignorenulls=True).over(same_level)).where("_kind = 1").select("_by", "point", "rule")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, per_sweep: int = PER_SWEEP) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    rules: (host, path, verdict); a null host or path counts as empty, a null verdict drops the rule. An empty host fits every
    URL. Of the rules that fit a URL the longest (host and path together) decides, among equally long ones that with the longer host;
    of the same rule given twice the greater verdict (block before allow). Where none fits, rule is null and the verdict is `default`.

    A null url, or one without `://`, has an empty host and path. Ports and user names are part of the host. Null and
    repeated ids and repeated rows stay as they are, one row each. Empty tables give what they must: no pages no rows, no
    rules the default. Other columns are not read, so their names can't clash.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    clean = rules.where("verdict is not null").select(lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = cut(clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    distinct = cut(urls.select("_host", "_path").distinct())

    # which rule hosts are above a host: hosts fall into groups by their last label, which a rule host shares
    hosts, last = distinct.select("_host").distinct(), lambda c: F.substring_index(c, ".", -1)
    owners = clean.select("host").distinct()
    named = owners.where("host != ''").select(last("host").alias("_by"), _reversed_host(F.col("host")).alias("_key"), F.struct("host").alias("rule"))
    above = sweep(hosts.select(last("_host").alias("_by"), _reversed_host(F.col("_host")).alias("_key"), F.struct("_host").alias("point")), named, True, per_sweep)
    above = above.select(F.col("point._host").alias("_own"), F.col("rule.host").alias("_by"))
    everywhere = hosts.select(F.col("_host").alias("_own"), F.lit("").alias("_by")).join(owners.where("host = ''"), F.col("_by") == F.col("host"), "left_semi")

    # the longest path under each of them
    under = distinct.join(cut(above.union(everywhere)), F.col("_host") == F.col("_own")).select("_by", F.col("_path").alias("_key"), F.struct("_host", "_path").alias("point"))
    held = clean.select(F.col("host").alias("_by"), F.col("path").alias("_key"), F.struct("host", "path", "verdict").alias("rule"))
    size = F.length("rule.host") + F.length("rule.path")
    best = F.max_by("rule", F.struct(size, F.length("rule.host"))).alias("_rule")
    fits = sweep(under, held, False, per_sweep).groupBy(F.col("point._host").alias("_h"), F.col("point._path").alias("_p")).agg(best)
    judged = urls.join(fits, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
    return judged.select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.concat("_rule.host", "_rule.path").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"),
    )


def oracle(rules: list[tuple[str, str]], default: str = DEFAULT) -> str:
    """The same by DuckDB over pages: each URL beside each rule."""
    values = ", ".join(f"('{rule.split('/')[0]}', '/{rule.split('/', 1)[1]}', '{verdict}')" for rule, verdict in rules)
    return f"""
WITH r(rh, rp, verdict) AS (VALUES {values}),
c AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, k, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM c),
v AS (SELECT page_id, k, translate(h, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT k, max_by({{'rule': rh || rp, 'verdict': verdict}}, length(rh || rp)) AS best FROM v JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{default}') AS verdict FROM v LEFT JOIN f USING (k)"""
