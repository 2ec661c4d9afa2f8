"""Secret scans over an incremental blob ledger, with column expressions only.

The ledger is a folder of four appended Parquet tables:

* ``paths``: the columns that name a version of a file, and the ``blob`` (SHA-256) it held;
* ``scanned``: ``blob, rule`` pairs that need no further scan, ``rule`` being ``kind@version``;
* ``findings``: ``blob, kind, ord, start, stop``, code points, end exclusive.

A scan adds the paths, reads each blob once, and only for rules it has not met in that version;
findings are then joined back to every path. A blob's copies, be they a third of all rows, are
folded before the text moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidspark.llm.common import join_groups, text_of
from vidspark.plans.scale import fresh_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlap; ``group`` (0: all) needs ``least`` letters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three kinds that every scan reports, as specified.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more are the matches of the open pattern that are long enough.
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
# A private key: its first marker, headers, runs of base64, its last marker. Runs are parted by blanks, quoting and
# line prefixes; up to four short ones (prefixes, escapes, the checksum) may stand between long ones, so prose ends
# the span. A body holds no five dashes in a row, and groups that repeat without bound are possessive: both engines
# find the same spans, without recursion and in linear time.
_MARK = r"[A-Z0-9\x20]{0,40}PRIVATE KEY(?:\x20BLOCK)?-----"
_GAP = r"[\x20\x09-\x0D\\\"'>,;|*#]"
_BASE64 = r"[A-Za-z0-9+/=]"
_PREFIX = rf"(?:-{{1,4}}{_GAP}+){{0,8}}-{{0,4}}"
_SHORT = rf"{_GAP}+{_PREFIX}{_BASE64}{{1,15}}"
_HEADER = (
    rf"{_GAP}*{_PREFIX}(?:(?:Proc-Type:\x20?4,ENCRYPTED|DEK-Info:\x20?[A-Z0-9-]+,[0-9A-Fa-f]+){_GAP}+"
    rf"|[A-Za-z][A-Za-z0-9-]*:[^\r\n\\-]*(?:-{{1,4}}[^\r\n\\-]+)*+[\r\n\\]{_GAP}*)"
)
_LONG = rf"(?:{_SHORT}){{0,4}}{_GAP}*{_PREFIX}{_BASE64}{{16,}}"
_LAST = rf"(?:{_SHORT}){{0,4}}{_GAP}*(?:-{{1,4}}{_GAP}+){{0,8}}-{{0,3}}-----END\x20{_MARK}"
PEM = rf"-----BEGIN\x20{_MARK}(?:(?:{_HEADER})*+(?:(?:{_LONG})++(?:{_LAST}|(?:{_SHORT})?{_GAP}*)|{_LAST}))?"
# Kinds added by this method: published formats of keys and tokens.
EXTRA = (
    Rule("pem", PEM, version=3),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + EXTRA

FINDINGS = "blob binary, kind string, ord int, start long, stop long"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class BlobLedger:
    """What has been scanned and found so far, in ``path`` (a new folder by default)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "ledger")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(name))

    def scanned(self) -> DataFrame:
        return self.read("scanned", "blob binary, rule string")

    def findings(self) -> DataFrame:
        return self.read("findings", FINDINGS).dropDuplicates(["blob", "kind", "start"])

    def unseen(self, blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """``blob, text, todo``: one row per distinct blob with a rule version it has not met."""
        every = F.array(*[F.lit(r.key) for r in rules])
        if not self._has("scanned"):
            return blobs.dropDuplicates(["blob"]).withColumn("todo", every)
        met = self.scanned().groupBy("blob").agg(F.collect_set("rule").alias("_met"))
        left = blobs.join(met, "blob", "left")
        todo = F.array_except(every, F.coalesce("_met", F.array().cast("array<string>")))
        return left.withColumn("todo", todo).drop("_met").filter(F.size("todo") > 0).dropDuplicates(["blob"])

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, names: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Scan what is new in ``docs``; the stored ``names, blob`` rows of this call.

        A call that fails half-way leaves no pair marked as scanned, so it can be repeated; findings
        that are written twice that way are folded when read. Null texts are the empty blob.
        """
        text = text_of(docs)
        call = f"{self._at('paths')}/call={fresh_path(self.spark, 'c').rsplit('-', 1)[1]}"
        docs.select(*names, blob_of(text).alias("blob")).write.parquet(call)
        todo = self.unseen(docs.select(blob_of(text).alias("blob"), text.alias("text")), rules)
        pairs = todo.select("blob", F.explode("todo").alias("rule"))
        pairs_at = f"{self.path}/pending-{call.rsplit('=', 1)[1]}"
        pairs.write.parquet(pairs_at)
        spans(todo, rules, F.col("todo")).write.mode("append").parquet(self._at("findings"))
        self.spark.read.parquet(pairs_at).write.mode("append").parquet(self._at("scanned"))
        return self.spark.read.parquet(call)


def spans(rows: DataFrame, rules: tuple[Rule, ...], todo: Column | None = None) -> DataFrame:
    """``blob, kind, ord, start, stop`` of all matches in ``rows(blob, text)``.

    A match begins after the pieces between matches and the matches before it, so the positions are
    running sums of lengths; only texts with a match take part in the window.
    """
    hits = []
    for n, r in enumerate(rules):
        hit = F.col("text").rlike(r.pattern)
        if todo is not None:
            hit = F.array_contains(todo, r.key) & hit
        pat = F.lit(r.pattern)
        parts = F.arrays_zip(
            F.transform(F.split("text", r.pattern, -1), F.length).alias("gap"),
            F.transform(F.regexp_extract_all("text", pat, F.lit(0)), F.length).alias("len"),
            F.transform(F.regexp_extract_all("text", pat, F.lit(r.group)), F.length).alias("part"),
        )
        hits.append(F.when(hit, F.transform(parts, _cell(n))))
    some = [F.coalesce(h, F.array().cast("array<struct<ord:int,i:int,gap:int,len:int,part:int>>")) for h in hits]
    cells = rows.select("blob", F.explode(F.concat(*some)).alias("m")).select("blob", "m.*")
    w = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap").cast("long") + F.coalesce("len", F.lit(0))).over(w)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("ord") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("ord") + 1)
    return (
        cells.withColumn("stop", stop)
        .filter(F.col("part") >= least)
        .select("blob", kind.alias("kind"), "ord", (F.col("stop") - F.col("len")).alias("start"), "stop")
    )


def _cell(n: int):
    return lambda p, i: F.struct(F.lit(n).alias("ord"), i.alias("i"), p["gap"].alias("gap"), p["len"].alias("len"), p["part"].alias("part"))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each blob joined back to all its paths; paths without any stay, with zeros.

    Only blobs with findings take part in the join: the others are told by their absence.
    """
    order = {r.kind: n for n, r in enumerate(rules)}
    base = [r.kind for r in BASE]
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("kind"))
    found = findings.withColumn("s", F.struct("start", place.alias("ord"), "stop", "kind"))
    per = found.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in base],
        F.collect_list(F.when(F.col("kind").isin(base), F.col("s"))).alias("_base"),
        F.collect_list("s").alias("_all"),
    )
    per = per.select("blob", *[f"n_{k}" for k in base], joined(F.col("_base")).alias("_text"), joined(F.col("_all")).alias("spans"))
    size = paths.groupBy("blob").agg(F.count("*").alias("_n"))
    per = per.join(size, "blob")
    names = [c for c in paths.columns if c != "blob"]
    zero = [F.lit(0).cast("long").alias(f"n_{k}") for k in base]
    clean = paths.join(per.select("blob"), "blob", "left_anti").select(*names, *zero, F.lit("").alias("_text"), F.lit("").alias("spans"))
    hit = join_groups(paths, per, "blob", "_n").select(*names, *[f"n_{k}" for k in base], "_text", "spans")
    return hit.unionByName(clean).select(
        *names, *[f"n_{k}" for k in base], F.sha2(F.col("_text").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """One row per row of ``docs``: counts, digest and spans of the secrets in its whole text.

    Null texts have none. Repeated rows, null ids and further columns are allowed; each row is a path.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = ledger.scan(docs)
    return report(paths, ledger.findings())


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans become one.

    A text that matches no pattern passes where it is. Only the others, which are few, meet the
    findings of their blob. ``n_chars`` follows the text where the column exists. Null and empty
    texts stay as they are, repeated rows and null ids stay rows of their own, an empty table stays
    empty, and further columns, whatever their names, pass untouched.
    """
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    by = Window.partitionBy("blob")
    before = F.max("stop").over(by.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    # A new island starts where no earlier span reaches.
    rows = ledger.findings().withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(by.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    islands = rows.groupBy("blob", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    islands = islands.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    text = text_of(docs)
    some = text.rlike(RULES[0].pattern)
    for r in RULES[1:]:
        some = some | text.rlike(r.pattern)
    # Rows travel as one struct, so that columns may have any name.
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    maybe = docs.filter(some).select(own.alias("row"), text.alias("whole"), blob_of(text).alias("blob"))
    maybe = maybe.join(islands, "blob", "left")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length("whole").cast("long")))
    gaps = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda g: F.col("whole").substr((g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    rest = F.when(F.col("cuts").isNotNull(), F.array_join(gaps, mark)).otherwise(F.col("row").getField("text"))
    new = {"text": rest, **({"n_chars": F.length(rest).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    out = maybe.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    return docs.filter(~some).unionByName(out)
