"""URL rules by a sort-merge range join.

A host's labels in reverse, each with a dot behind it, and then the path make the canonical key of a rule or
url: ``www.example.com/en/1`` is ``com.example.www./en/1``. In the order of these keys everything that begins with a
rule's key lies side by side, so a rule is an interval, and intervals are nested or apart.

1. The rules are swept in order, in chunks of bounded size, with a stack of the rules that are still open; each rule
   keeps the stack at its place (``nested``). What is open at a chunk's first key comes from the stacks that earlier
   chunks ended with: the same problem over far fewer keys.
2. Urls and rules are merged in one order. The last rule before a url has the stack there; of its rules those are
   open whose key the url's begins with, and the innermost is the longest. A rule also fits subdomains, between its
   host and its path, so a url is looked up under each parent host, down to the rules' longest.

Keys are dealt out by range, so one host or path may hold any share of the rows: what reaches over the edge of a
part comes from one row a part. Only DataFrame functions; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rules whose stacks are swept together.
CHUNK = 512
_RULE = "struct<key: string, rule: string, verdict: string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``key, rule, verdict, depth`` of rules ``host, path, verdict``; of equal rules ``block`` counts. Rules without host or verdict, or of a form that no url has, are left out; no path: any."""
    r = rules.where("host is not null and verdict is not null and not contains(host, '/') and (coalesce(path, '') = '' or startswith(path, '/'))").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return r.select(F.concat(F.array_join(_labels(F.col("host")), "."), F.lit("."), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(_labels(F.col("host"))).alias("depth"))


def _pushed(stack: str, rule: str) -> str:
    """The stack behind ``rule``'s place: what the key doesn't begin with is closed."""
    return f"concat(filter({stack}, o -> startswith({rule}.key, o.key)), array({rule}))"


def nested(rules: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``key, stack`` for rules ``key, rule, verdict`` of different keys: the rules open at each one's place, outermost first, itself last."""
    each = rules.select(F.struct("key", "rule", "verdict").alias("r"))
    n, longest = each.agg(F.count("*"), F.max(F.length("r.key"))).first()
    chunk = max(chunk, 4 * ((longest or 0) + 1))  # a key of so many characters lies in no more rules, so each level has at most half the rules
    if n <= chunk:
        chunks = each.groupBy().agg(F.sort_array(F.collect_list("r")).alias("rs")).withColumn("before", F.expr(f"cast(array() as array<{_RULE}>)"))
    else:
        dealt = materialize(each.repartitionByRange(-(-n // (8 * chunk)), "r").withColumn("part", F.spark_partition_id()), "rules")
        dealt = dealt.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("part").orderBy("r")) - 1) / chunk))
        chunks = materialize(dealt.groupBy("part", "chunk").agg(F.sort_array(F.collect_list("r")).alias("rs")), "chunks")
        left_open = chunks.select(F.explode(F.expr(f"aggregate(rs, cast(array() as array<{_RULE}>), (s, r) -> {_pushed('s', 'r')})")).alias("r")).select("r.*")
        before = swept(chunks.select(F.expr("rs[0].key").alias("key"), "part", "chunk"), nested(left_open, chunk))
        before = before.select("part", "chunk", F.expr("filter(stack, o -> o.key != key)").alias("before"))
        chunks = chunks.join(before, ["part", "chunk"])
    state = f"struct<open: array<{_RULE}>, done: array<struct<key: string, stack: array<{_RULE}>>>>"
    sweep = f"aggregate(rs, cast(named_struct('open', before, 'done', array()) as {state}), (s, r) -> named_struct('open', {_pushed('s.open', 'r')}, 'done', concat(s.done, array(named_struct('key', r.key, 'stack', {_pushed('s.open', 'r')})))), s -> s.done)"
    return materialize(chunks.select(F.explode(F.expr(sweep)).alias("d")).select("d.*"), "stacks")


def swept(points: DataFrame, stacks: DataFrame) -> DataFrame:
    """The rows of ``points`` (a column ``key``) with ``stack``: the rules that are open at their key, outermost first."""
    session = points.sparkSession
    parts = 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    events = points.withColumn("_kind", F.lit(2)).unionByName(stacks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    # all columns of the order, so that one key may fill several parts
    others = [c for c in points.columns if c != "key"]
    dealt = materialize(events.repartitionByRange(parts, "key", "_kind", *others).withColumn("_part", F.spark_partition_id()), "swept")
    ends = dealt.groupBy("_part").agg(F.max_by("stack", F.when(F.col("_kind") == 1, F.col("key"))).alias("last"))
    ends = ends.select("_part", F.last("last", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("stack")).where("stack is not null")
    both = dealt.unionByName(ends.select("_part", "stack", F.lit("").alias("key"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    both = both.withColumn("stack", F.last("stack", True).over(Window.partitionBy("_part").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)))
    open_now = F.expr(f"coalesce(filter(stack, o -> startswith(key, o.key)), cast(array() as array<{_RULE}>))")
    return both.where("_kind = 2").select(*points.columns, open_now.alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", chunk: int = CHUNK) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict`` under rules ``host, path, verdict``.

    A rule fits its host and all subdomains if the url's path begins with its path; the longest wins (of two as long
    ones the one with the longer host), and ``default`` counts where none fits (``rule`` is null). Null urls and urls
    without ``://`` have empty host and path. Repeated rows and null ids are judged like others, other columns play no
    part; without rules all get ``default``.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = materialize(rule_keys(rules), "rule-keys")
    deepest = keyed.agg(F.max("depth")).first()[0]
    if deepest is None:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parents = urls.select("host", "path").distinct().withColumn("labels", _labels(F.col("host")))
    parents = parents.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
    points = parents.select("host", "path", "depth", F.concat(F.array_join(F.slice("labels", 1, F.col("depth")), "."), F.lit("."), "path").alias("key"))
    found = swept(points, nested(keyed.drop("depth"), chunk)).where("size(stack) > 0").withColumn("r", F.element_at("stack", -1))
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("r.key").alias("n"), "depth", "r.rule", "r.verdict")).alias("b"))
    best = best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("fits"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("fits", F.lit(default)).alias("verdict"))
