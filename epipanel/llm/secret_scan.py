"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import stage, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Raising ``version`` makes every blob unseen for it.

    ``found`` matches a span. With ``group``, spans whose group is shorter
    than ``least`` characters are dropped after matching.
    """

    kind: str
    found: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = False


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(
    [*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"]
)
# A run of hex digits, or of key characters after AKIA, is as long as the text
# allows, so a least length inside the pattern finds the same spans as a
# filter afterwards. In an assignment it does not: a value that is too short
# still uses up its text.
RULES = (
    Rule("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, base=True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
)
SPAN = "array<struct<start:bigint,place:int,kind:string,end:bigint>>"
LEDGER = {"blob": "string", "kind": "string", "version": "int", "spans": SPAN}


def spans_of(text: Column, place: int, rule: Rule) -> Column:
    """All leftmost, non-overlapping spans of a rule, in code points.

    The texts between the matches and the matches themselves add up to the
    whole text, so running totals of their lengths give the positions.
    """
    pattern = F.lit(rule.found)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    valued = (
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
        if rule.group
        else F.transform(size, lambda _: F.lit(True))
    )
    gap = F.transform(F.split(text, rule.found, -1), lambda g: F.length(g).cast("long"))
    steps = F.zip_with(F.slice(gap, F.lit(1), F.size(size)), F.arrays_zip(size.alias("n"), valued.alias("ok")),
                       lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def add(state: Column, step: Column) -> Column:
        first = state["at"] + step["gap"]
        span = F.struct(
            first.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"),
            (first + step["n"]).alias("end"),
        )
        return F.struct(
            (first + step["n"]).alias("at"),
            F.when(step["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    found = F.aggregate(steps, start, add, lambda s: s["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in LEDGER.items()]
    return spark.range(0).select(*nothing)


def scan_blobs(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: spans of the unseen (blob, rule version) pairs.

    ``paths`` holds (blob, text). A blob is scanned once, whatever the number
    of paths and versions that hold it, and only by the rules that have not
    seen it. Copies inside a task are merged before the shuffle.
    """
    known = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    blobs = paths.groupBy("blob", "text").agg(F.count("*").alias("copies"))
    todo = blobs.join(known, "blob", "left")

    def unseen(rule: Rule) -> Column:
        pair = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
        return F.col("seen").isNull() | ~F.array_contains("seen", pair)

    findings = [
        F.when(
            unseen(r),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), i, r).alias("spans")),
        )
        for i, r in enumerate(rules)
    ]
    return (
        todo.select("blob", F.explode(F.filter(F.array(*findings), lambda f: f.isNotNull())).alias("f"))
        .select("blob", "f.kind", "f.version", "f.spans")
    )


def secret_scan(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Findings for every path, and the ledger to start the next scan from.

    1. Every whole text is addressed by its SHA-256.
    2. Pairs of blob and rule version that the ledger lacks are scanned, and
       these new rows are written to the shared folder. The ledger returned is
       the older rows and them; ``Ledger`` keeps it in one folder.
    3. The spans of the current rule versions are joined back to all paths.

    The findings have (id, blob, spans), spans in order of start, then rule;
    the base rules give exactly the base spans, and further rules add theirs.
    Null and empty texts are one blob without findings. Every input row gets a
    row, repeated ones too. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    paths = docs.select(F.col(id_col).alias("path"), text_of(text_col).alias("text")).withColumn(
        "blob", F.sha2("text", 256)
    )
    old = empty_ledger(spark) if ledger is None else ledger.select(*LEDGER)
    new = stage(scan_blobs(paths.select("blob", "text"), old, rules))
    merged = new.unionByName(old)
    return findings_of(paths, merged, id_col, rules), merged


def findings_of(paths: DataFrame, ledger: DataFrame, id_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, blob, spans) of every path, from the ledger's rows of the current rule versions."""
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    found = (
        ledger.where(current & (F.size("spans") > 0))
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    empty = F.expr(f"cast(array() as {SPAN})")
    return paths.select("path", "blob").join(found, "blob", "left").select(
        F.col("path").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans")
    )


class Ledger:
    """A ledger kept in a folder, to which every scan adds the pairs it was the first to see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        schema = ", ".join(f"{name} {kind}" for name, kind in LEDGER.items())
        self.spark.createDataFrame([], schema).write.mode("append").parquet(self.path)      # so that the folder exists
        return self.spark.read.schema(schema).parquet(self.path)

    def scan(
        self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
    ) -> DataFrame:
        """Findings for every row of ``versions``, as ``secret_scan`` gives them.

        Each row is a version of a path; a path may have any number of them.
        Only blobs that no earlier scan met, or that met other rule versions,
        are looked at. A pair that is stored twice, as by a scan that was
        repeated, tells the same spans once.
        """
        paths = versions.select(F.col(id_col).alias("path"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
        new = stage(scan_blobs(paths.select("blob", "text"), self.read(), rules))
        new.write.mode("append").parquet(self.path)
        return findings_of(paths, self.read(), id_col, rules)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each path."""
    def of_kind(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    kinds = [r.kind for r in rules if r.base]
    counts = {f"n_{k}": F.size(of_kind(k)).cast("long") for k in kinds}
    return found.withColumns(
        {**counts, "base_sha256": F.sha2(joined(of_kind(*kinds)), 256), "all": joined(F.col("spans"))}
    ).drop("spans", "blob").withColumnRenamed("all", "spans")
