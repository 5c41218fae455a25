"""Secret scans over a ledger of blobs.

Every version of every file is a blob, named by the SHA-256 of its content. The ledger, a folder
of Parquet files that only grows, says which rules in which version have seen a blob and what
they found. A scan names the blobs of the paths it is given, scans each blob once with the rules
that have not seen it, appends the result, and joins findings back to all paths. Copies of any
number are one blob; a second scan of known blobs reads no text beyond naming them.

Only DataFrame functions run. Spark has no function for the places of all matches, so they come
from the lengths of the matches and of the pieces between them.

Defined results: a null text is the empty blob; null paths are kept; repeated rows give repeated
results; blobs are cut whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What to look for: ``pattern``; ``group`` of a match must hold ``least`` characters.

    ``hint`` is a cheap condition without which a text cannot match.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The base kinds.
BASE = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20, hint="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", least=24),
)

# Kinds added to the base.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,100}@", hint="://"),
)

FINDING = "struct<kind:string,start:bigint,end:bigint>"
LEDGER = f"blob binary, rules array<string>, findings array<{FINDING}>"


# Matches of a pattern in text t: each begins after the gaps and matches before it.
SPANS = """
if({hint} and t rlike {pattern}, transform(array(regexp_extract_all(t, {pattern}, 0)), m -> aggregate(
  slice(
    arrays_zip(
      transform(split(t, {pattern}, -1), x -> length(x)),
      transform(m, x -> length(x)),
      transform(regexp_extract_all(t, {pattern}, {group}), x -> length(x))
    ),
    1, size(m)
  ),
  named_struct('at', 0L, 'found', cast(array() as array<{finding}>)),
  (s, p) -> named_struct(
    'at', s.at + p.`0` + p.`1`,
    'found', if(
      p.`2` >= {least},
      concat(s.found, array(named_struct('kind', '{name}', 'start', s.at + p.`0`, 'end', s.at + p.`0` + p.`1`))),
      s.found
    )
  ),
  s -> s.found
))[0], cast(array() as array<{finding}>))"""


def spans(rule: Rule) -> str:
    """Matches of ``rule`` in a text ``t``, as SQL for an array of `FINDING`, in characters, end
    exclusive."""
    return SPANS.format(
        hint=f"contains(t, '{rule.hint}')" if rule.hint else "true",
        pattern="r'" + rule.pattern.replace("'", r"\x27") + "'",
        group=rule.group, least=rule.least, name=rule.name, finding=FINDING,
    )


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries so far: ``blob, rules, findings``; none where nothing has been scanned."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def _named(files: DataFrame, path: str, text: str) -> DataFrame:
    """``path, blob, text`` of every row, the text never null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return files.select(
        F.col(path).alias("path"), F.unhex(F.sha2(whole, 256)).alias("blob"), whole.alias("text")
    )


def update(
    files: DataFrame, ledger_path: str, rules: tuple[Rule, ...], path: str, text: str
) -> None:
    """Scan every blob of ``files`` with the rules that have not seen it; append to the ledger."""
    spark = files.sparkSession
    seen = ledger(spark, ledger_path).groupBy("blob").agg(
        F.flatten(F.collect_set("rules")).alias("seen")  # a set for each scan that had new rules
    )
    keys = F.array(*(F.lit(rule.key) for rule in rules))
    # one text of each blob: copies meet in the partial aggregate of their task first
    blobs = _named(files, path, text).groupBy("blob").agg(F.any_value("text").alias("text"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("rules"))
    unseen = unseen.filter(F.size("rules") > 0)
    each = ", ".join(
        f"if(array_contains(rules, '{rule.key}'), {spans(rule)}, cast(array() as array<{FINDING}>))"
        for rule in rules
    )
    found = F.expr(f"flatten(transform(array(text), t -> concat({each})))")
    unseen.select("blob", "rules", found.alias("findings")).write.mode("append").parquet(ledger_path)


def findings(
    files: DataFrame,
    ledger_path: str,
    rules: tuple[Rule, ...] = BASE + ADDED,
    path: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``path, blob, findings`` for every row of ``files``, after the ledger has been brought up to it.

    Only findings of the given rules are returned, ordered by start, then as the rules are listed.
    """
    update(files, ledger_path, rules, path, text)
    names = F.array(*(F.lit(rule.name) for rule in rules))
    keys = F.array(*(F.lit(rule.key) for rule in rules))
    # of each entry, what the given versions found
    current = F.transform(F.array_intersect("rules", keys), lambda k: F.substring_index(k, "@", 1))
    kept = F.filter("findings", lambda f: F.array_contains(current, f["kind"]))
    place = F.transform(
        kept,
        lambda f: F.struct(
            f["start"].alias("start"), F.array_position(names, f["kind"]).alias("n"),
            f["kind"].alias("kind"), f["end"].alias("end"),
        ),
    )
    entries = ledger(files.sparkSession, ledger_path).filter(F.size("findings") > 0)
    by_blob = entries.groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(place)))).alias("findings")
    )
    paths = _named(files, path, text).drop("text")
    ordered = F.coalesce("findings", F.array().cast("array<struct<start:bigint,n:bigint,kind:string,end:bigint>>"))
    return paths.join(by_blob, "blob", "left").select("path", "blob", ordered.alias("findings"))
