r"""Secret scans over an incremental ledger of blobs. DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds, for each blob, which versions
of which rules have scanned it and what they found. A scan takes one path of each blob that some rule version has not
seen, applies just the missing rules to it, appends the outcome to the ledger and joins findings back to all paths.

Only hashes and path ids are grouped, so thousands of copies of one text cost one scan and small rows. A first scan moves
each text once, to meet the list of blobs to scan; that list is the build side of a hash join, so texts are never sorted.
A later scan writes the list of unseen blobs first: if it is empty no text is read for it, and while it is short (FEW) it
is broadcast and no text moves. Findings are written before they are joined back, so that their size is known: they are
broadcast below Spark's own threshold, and only beyond it do texts that are carried along move again.

Defined results: a null text counts as empty; repeated rows each get the findings of their blob; an empty table gives no
rows; other columns are carried along untouched (but for `_blob` and `_spans`, which are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import let, match_spans, save, scratch_path, tagged


@dataclass(frozen=True)
class Rule:
    """A pattern with its version; a match counts if its group is of `least` characters or more. hint: a cheap test."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column, order: int) -> Column:
        long_enough = lambda m: F.length(F.regexp_extract(m, self.pattern, self.group) if self.group else m) >= self.least
        found = tagged(match_spans(text, self.pattern, long_enough), self.kind, order)
        return F.when(F.contains(text, F.lit(self.hint)), found) if self.hint else found


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The fixed rules. Runs that are too short never match, which leaves the same spans as matching and dropping them.
BASE_RULES = (
    Rule("assign", ASSIGN, group=1, least=8),
    Rule("access", "AKIA[A-Z0-9]{12,}", hint="AKIA"),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{32,}"),
)
#: Forms of credentials beyond them.
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}+", hint="gh"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}+", hint="xox"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="-----BEGIN "),
)
RULES = BASE_RULES + MORE_RULES

# To the END line of the same label, if no other dashed line comes first; or over what looks like lines of base64.
_SEALED = r"(?:\s*+(?:Proc-Type|DEK-Info):\s*+\S++)*+"
_LINES = r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{24,}+={0,2})++"
_LAST = r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,23}+={1,2}|\r?\n[\x20\t]*+[A-Za-z0-9+/]{1,23}+(?=[\x20\t]*+(?:[\r\n]|\z)))?+"
PEM = rf"-----BEGIN ([A-Z ]{{0,40}}PRIVATE KEY)-----(?:(?:[^-]++|-(?!----))*+-----END \1-----|{_SEALED}{_LINES}{_LAST})?+"
#: For redaction: a private key with its body. The SQL of scans knows the BEGIN line alone.
WHOLE_RULES = tuple(Rule("pem", PEM, hint="-----BEGIN ", version=2) if r.kind == "pem" else r for r in RULES)

#: Unseen blobs whose list is still broadcast: some 250 bytes each.
FEW = 10_000

_FOUND = "array<struct<s:bigint,k:int,e:bigint,kind:string,m:string>>"
_LEDGER = f"_blob string, scanned array<string>, found {_FOUND}"


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with `_blob` and `_spans`, tagged spans of all rules. ledger: its folder, kept between scans."""
    spark = versions.sparkSession
    versions = versions.drop("_blob", "_spans")
    ledger = ledger or scratch_path(spark, "ledger")
    content = F.coalesce(F.col(text), F.lit(""))
    addressed = versions.withColumn("_blob", F.sha2(content, 256))
    blobs = addressed.groupBy("_blob").agg(F.min(F.struct(F.col(path).alias("p")))["p"].alias("_path"))
    keys = [r.key for r in rules]
    seen = _ledger(versions, ledger)
    if seen is None:
        todo = blobs.withColumn("_todo", F.array(*map(F.lit, keys)))
    else:
        done = seen.groupBy("_blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("_done"))
        unseen = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("_done", F.array().cast("array<string>")))
        todo = save(blobs.join(done, "_blob", "left").select("_blob", "_path", unseen.alias("_todo")).filter(F.size("_todo") > 0), "unseen")
    many = FEW + 1 if seen is None else todo.limit(FEW + 1).count()
    if many:
        todo = todo.withColumnRenamed("_blob", "_want")
        _scan_blobs(addressed, path, content, F.broadcast(todo) if many <= FEW else todo.hint("shuffle_hash"), rules, ledger)
    # A rule that has changed leaves findings of its old version in the ledger: only rows of current versions count.
    now = spark.read.schema(_LEDGER).parquet(ledger).select("_blob", F.filter("found", _current(rules, F.col("scanned"))).alias("found")).filter(F.size("found") > 0)
    # Distinct: a scan that was run again, or one beside this one, may have written a blob's findings twice.
    found = save(now.groupBy("_blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("_spans")), "findings")
    return addressed.join(found, "_blob", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(_FOUND)))


def _scan_blobs(addressed: DataFrame, path: str, content: Column, todo: DataFrame, rules: tuple[Rule, ...], ledger: str) -> None:
    """One path of each blob in todo, its missing rules applied, the outcome appended to the ledger."""
    one = addressed.select("_blob", F.col(path).alias("_p"), content.alias("_text"))
    fresh = one.join(todo, (one["_p"].eqNullSafe(todo["_path"])) & (one["_blob"] == todo["_want"]))
    none = F.array().cast(_FOUND)
    parts = [F.when(F.array_contains("_todo", r.key), F.coalesce(r.spans(F.col("_text"), k), none)).otherwise(none) for k, r in enumerate(rules)]
    scanned = fresh.select("_blob", F.col("_todo").alias("scanned"), F.concat(*parts).cast(_FOUND).alias("found"))
    scanned.dropDuplicates(["_blob"]).write.mode("append").parquet(ledger)


def _current(rules: tuple[Rule, ...], scanned: Column):
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)])
    return lambda x: F.array_contains(scanned, F.element_at(version, x["kind"]))


def _ledger(df: DataFrame, path: str) -> DataFrame | None:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(_LEDGER).parquet(path)


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows with every found span of the text replaced by mark; overlapping spans are replaced once."""

    def covered(spans: Column) -> Column:
        start = F.array().cast("array<struct<s:bigint,e:bigint>>")

        def add(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            own = F.struct(x["s"].alias("s"), x["e"].alias("e"))
            wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
            return F.when(F.size(acc) == 0, F.array(own)).otherwise(
                F.when(last["e"] > x["s"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(own)))
            )

        return F.aggregate(F.array_sort(spans), start, add)

    def cut(spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda x: x["e"]))
        ends = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text).cast("bigint")))
        return F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(F.col(text), (b + 1).cast("int"), (e - b).cast("int"))), mark)

    return scanned.withColumn(text, F.when(F.size("_spans") == 0, F.col(text)).otherwise(let(covered(F.col("_spans")), cut)))
