"""URL filters as a sort-merge range join, with column expressions only.

A rule ``host/path`` fits its host, all subdomains, and paths that start with its own. The
canonical key of a rule is its host with the labels reversed, followed by its path; the keys of all
urls it fits then form the interval ``[key, key + 0xFF)`` (0xFF never occurs in UTF-8). A url asks
once for each of its host's suffixes that some rule has. Questions and interval bounds are sorted
by key and swept: each bound carries what lies on top of the stack of active rules after it (the
rule itself at its start, the rule around it at its end), so the last bound before a question
answers it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, stored
from vidspark.plans.scale import small

# Questions one sweep holds for one host; hosts with more are split by salt. A host with many rules
# has twice as many questions as bounds in each, so the bounds of all salts are fewer than the questions.
SWEEP_ROWS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the registered query: host, path, verdict.
PAGE_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case (A-Z), and the path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    tail = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def key(host: Column, path: Column) -> Column:
    """Canonical key: reversed host, a zero byte, path. Byte order keeps prefixes together."""
    return F.concat(reversed_host(host).cast("binary"), F.lit(b"\x00"), path.cast("binary"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def bounds(rules: DataFrame) -> DataFrame:
    """Interval bounds ``rule_host, at, ord, top`` of the rules, ``top`` as it is after the bound.

    The rule around another has the same host and the longest proper prefix of its path, found by
    joining prefixes. Of equal rules the one with the smaller verdict (allow) counts.
    """
    r = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rule = F.struct(F.length("host").alias("h"), F.length("path").alias("p"), "host", "path", "verdict")
    r = r.select("host", "path", rule.alias("rule"))
    longer = r.select("host", F.col("path").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("path"))
    longer = longer.filter(F.col("path") != F.col("of")).join(r, ["host", "path"])
    around = longer.groupBy("host", F.col("of").alias("path")).agg(F.max_by("rule", F.length("path")).alias("around"))
    r = r.join(around, ["host", "path"], "left")
    at = key(F.col("host"), F.col("path"))
    ends = F.array(
        F.struct(at.alias("at"), F.col("rule").alias("top")),
        F.struct(F.concat(at, F.lit(b"\xff")).alias("at"), F.col("around").alias("top")),
    )
    return r.select(F.col("host").alias("rule_host"), F.explode(ends).alias("e")).select("rule_host", "e.*")


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` plus ``host, path, rule, verdict``; the longest rule that fits, else ``default``.

    Longest is host and path together, then the host. Null urls and urls without ``://`` have empty
    host and path. Rows may be repeated, and keys may be null. Without rules all get ``default``.
    The rules are a table of any size; hosts have at most 127 labels, and a url asks for no more
    suffixes than the longest rule host has labels.
    """
    host, path = host_and_path(F.col(url))
    names = urls.columns
    row = F.struct(*[urls[f"`{c}`"] for c in names]).alias("_row")
    # Only what sorting and the answer need travels; the rows come along as they are.
    pages = urls.select(row, host.alias("_host"), path.alias("_path"), F.monotonically_increasing_id().alias("_id"))
    labels = F.size(F.split(F.col("host"), r"\.", -1))
    deepest = rules.agg(F.max(labels)).first()[0] or 0
    parts = F.split("_host", r"\.", -1)
    last = F.least(F.size(parts), F.lit(deepest))
    suffixes = F.transform(F.sequence(F.lit(0), last), lambda n: F.when(n > 0, F.array_join(F.slice(parts, -n, n), ".")))
    # Entry 0 is null: it keeps the row where no rule host fits.
    asked = pages.select("*", F.explode(suffixes if deepest else F.array(F.lit(None).cast("string"))).alias("_suffix"))
    edges = bounds(rules)
    hosts = edges.groupBy(F.col("rule_host").alias("_suffix")).agg(F.count("*").alias("_bounds"))
    asked_of = asked.filter(F.col("_suffix").isNotNull())
    rows = F.greatest(F.lit(SWEEP_ROWS), 2 * F.col("_bounds"))
    # One row per rule host that some url has.
    counts = stored(
        asked_of.groupBy("_suffix").agg(F.count("*").alias("_n"))
        .join(hosts, "_suffix").select("_suffix", "_n", F.ceil(F.col("_n") / rows).cast("int").alias("_salts")), "hosts"
    )
    # A host with a third of all urls must not meet its count in one task.
    open_ = asked_of.join(F.broadcast(counts), "_suffix") if small(counts) else join_groups(asked_of, counts, "_suffix", "_n")
    salt = F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int")
    questions = open_.select(
        "_id", "_row", "_host", "_path", F.col("_suffix").alias("_rh"), salt.alias("_salt"),
        key(F.col("_suffix"), F.col("_path")).alias("_at"), F.lit(1).alias("_ord"),
    )
    b = edges.join(counts, F.col("rule_host") == F.col("_suffix"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    marks = b.select(
        F.lit(None).cast("long").alias("_id"), F.lit(None).cast(questions.schema["_row"].dataType).alias("_row"),
        F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"),
        F.col("rule_host").alias("_rh"), F.col("_salt").cast("int").alias("_salt"), F.col("at").alias("_at"), F.lit(0).alias("_ord"), F.struct(F.lit(True).alias("set"), "top").alias("_top"),
    )
    questions = questions.withColumn("_top", F.lit(None).cast(marks.schema["_top"].dataType))
    sweep = Window.partitionBy("_rh", "_salt").orderBy("_at", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = questions.unionByName(marks).withColumn("_top", F.last("_top", ignorenulls=True).over(sweep))
    answers = swept.filter("_ord = 1").select("_id", "_row", "_host", "_path", F.col("_top.top").alias("_rule"))
    kept = asked.filter(F.col("_suffix").isNull()).select("_id", "_row", "_host", "_path", F.lit(None).cast(answers.schema["_rule"].dataType).alias("_rule"))
    length = F.struct((F.col("_rule.h") + F.col("_rule.p")).alias("n"), F.col("_rule.h").alias("h"))
    best = (
        answers.filter(F.col("_rule").isNotNull()).unionByName(kept)
        .groupBy("_id")
        .agg(
            F.first("_row").alias("_row"), F.first("_host").alias("host"), F.first("_path").alias("path"),
            F.max_by("_rule", F.when(F.col("_rule").isNotNull(), length)).alias("_rule"),
        )
    )
    rule = F.concat(F.col("_rule.host"), F.col("_rule.path"))
    return best.select(
        *[F.col("_row").getField(c).alias(c) for c in names if c not in ("host", "path", "rule", "verdict")],
        "host", "path", rule.alias("rule"), F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
    )
