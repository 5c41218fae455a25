"""Lines that recur across documents, found with a tree of log templates, and dropped.

Every line is led down a tree of fixed depth: first its number of tokens, then its leading `DEPTH`
tokens, where a token that holds a digit is a variable field. Lines that end in one leaf and come
from enough documents are generalised: a token at a place of the leaf is constant if `LEAST_DOCS`
lines of the leaf have it there, anything else is a variable field. A second template of the line takes
as constant only what one in `SHARE` lines of the leaf has too, and the line with its digits masked is a
third, whatever else its leaf holds; one of them that recurs is enough. What
is constant in a line is its template, if that is at least `CONSTANT` of its tokens. A template recurs if texts of
`LEAST_DOCS` families hold it; a family is the near copies of one text, found by their shingles at the
similarity at which near-duplicates are removed (`families`), so a text and its near copies count once and are
left to near-duplicate removal, however many they are, and veto no line that other texts hold too.

A line of `LONG` tokens or more does not repeat by chance: word for word it recurs from `LONG_DOCS` families
on, whose texts are not even half alike (`HALF`), so that versions of one text keep what they share.
Lines of recurring templates are dropped from all documents; lines held by fewer families stay.

Only DataFrame functions run. Leaves and templates are counted by aggregates that combine in each
task first, never gathered; texts are named by their content, so copies of a text are one; lines go
through one shuffle. Families are formed among the texts that hold a line repeated in texts enough, so only their
words are read for them. Texts go through one shuffle more, when the lines to drop are joined to them.

Defined results: null texts stay null, empty ones empty; blank lines are kept and belong to no
template; line ends are ``\\n``; a text all of whose lines recur becomes empty; repeated rows and
null ids are treated by their text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidsearch.llm import families as fm
from braidsearch.llm import words as wd
from braidsearch.session import materialize

DEPTH = 4
LEAST_DOCS = 8
SHARE = 16
# Least part of a line that is constant in its template.
CONSTANT = 0.7
# Tokens of a long line, and the families from which on it recurs.
LONG = 50
LONG_DOCS = 2
# Shingle similarity from which two texts are of one family, as in `neardup`, and for long lines.
SIMILAR = 0.8
HALF = 0.5

# A token that holds a digit is a variable field.
FIELD = "<*>"
# tried at the start of each token only, without going back
MASKED = r"regexp_replace({}, r'(?<![^ ])[^ 0-9]*+[0-9][^ ]*+', '" + FIELD + "')"


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """``key, text`` of every document that has a text; the key names the content."""
    return docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).select(
        F.unhex(F.md5("text")).alias("key"), "text"
    )


def leaves(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """``key, id, line, at, size, leaf, long`` for every line that is not blank, texts named by content.

    ``long`` names the line itself, null for short ones.
    """
    lines = _texts(docs, text).select("key", F.xxhash64("key").alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    each = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    # every blank ends a token, so the number of tokens needs no list of them
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    leading = F.substring_index("line", " ", depth)
    masked = F.when(leading.rlike("[0-9]"), F.expr(MASKED.format(f"substring_index(line, ' ', {depth})")))
    leaf = F.xxhash64(size, F.coalesce(masked, leading))
    long = F.when(size >= LONG, F.xxhash64(F.lit("long"), "line"))
    return each.select("key", "id", "line", "at", size.alias("size"), leaf.alias("leaf"), long.alias("long"))


def families(docs: DataFrame, text: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, family`` of the texts among ``held`` (id) that have near copies there: near ones, and half alike."""
    texts = _texts(docs, text).select(F.xxhash64("key").alias("id"), "text").join(held, "id", "left_semi")
    edges = fm.edges(texts, HALF)
    return fm.connected(edges.filter(F.col("similar") >= SIMILAR), "family"), fm.connected(edges, "family")


def _once_a_text(rows: DataFrame, key: str) -> DataFrame:
    """``key, id, least``; rows of one text meet in this aggregate, so a hot key is spread by text."""
    return rows.groupBy(key, "id").agg(F.first("least").alias("least"))


def _repeated(texts: DataFrame, key: str) -> DataFrame:
    """``key, least`` of the keys that at least ``least`` of ``texts`` hold."""
    many = texts.groupBy(key).agg(F.count("*").alias("n"), F.first("least").alias("least"))
    return many.filter(F.col("n") >= F.col("least")).select(key, "least")


def _recurring(docs: DataFrame, text: str, templates: DataFrame) -> DataFrame:
    """The templates held by texts of enough families."""
    # fewer texts are fewer families
    texts = _once_a_text(templates, "template")
    held = materialize(texts.join(_repeated(texts, "template").select("template"), "template"), "line-held")
    near, half = families(docs, text, held.select("id").distinct())
    parts = []
    for long, family in ((False, near), (True, half)):
        mine = held.filter(F.col("least").eqNullSafe(LONG_DOCS) == F.lit(long))
        named = mine.join(family, "id", "left").select("template", "least", F.coalesce("family", "id").alias("family"))
        # texts of one family meet in the first aggregate
        found = named.groupBy("template", "family").agg(F.first("least").alias("least"))
        found = found.groupBy("template").agg(F.count("*").alias("families"), F.first("least").alias("least"))
        parts.append(found.filter(F.col("families") >= F.col("least")).select("template"))
    return parts[0].unionByName(parts[1]).distinct()


def recurring_lines(
    docs: DataFrame, text: str = "text", depth: int = DEPTH, least: int = LEAST_DOCS
) -> DataFrame:
    """``key, at, line, template``: the lines of recurring templates, for each distinct text."""
    every = leaves(docs, text, depth)
    # written first, so that the join stands alone and Spark may split a hot leaf in it
    keys = F.array(
        F.struct(F.col("leaf").alias("leaf"), F.lit(least).alias("least"), F.lit(False).alias("whole")),
        F.struct(F.col("long").alias("leaf"), F.lit(LONG_DOCS).alias("least"), F.lit(True).alias("whole")),
    )
    counted = every.select("id", F.inline(keys)).filter("leaf is not null")
    common = materialize(_repeated(_once_a_text(counted, "leaf"), "leaf"), "line-common")
    # short and long keys together, so that the texts are cut into lines once more and not twice
    keyed = every.select("key", "id", "at", "line", "size", F.inline(keys)).filter("leaf is not null")
    masked = F.when(~F.col("whole"), F.expr(MASKED.format("line")))
    kept = keyed.join(common, ["leaf", "least"]).withColumn("masked", masked).drop("least")
    kept = materialize(kept, "line-leaves")
    rows = kept.filter(~F.col("whole")).drop("whole")
    long = kept.filter("whole").select("key", "id", "at", "line", F.col("leaf").alias("template"))

    split = "split(masked, ' ')"
    tokens = rows.select("key", "at", "leaf", F.posexplode(F.expr(split)).alias("place", "token"))
    counted = tokens.filter(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("lines"))
    often = materialize(counted.filter(F.col("n") >= least).join(sizes, "leaf"), "line-constants")

    # constants of one in SHARE lines: at most SHARE at each place
    constants = often.filter(F.col("n") * SHARE >= F.col("lines")).groupBy("leaf").agg(
        F.collect_list(F.concat_ws(":", "place", "token")).alias("constants")
    )
    placed = F.expr(f"transform({split}, (t, i) -> concat(i, ':', t))")
    held = rows.join(constants, "leaf").select(
        "key", "id", "at", "line", "leaf", "size",
        F.array_intersect(placed, "constants").alias("constant"),
    )

    # in fuller leaves also constants of any share, joined token by token as they have no bound
    rarer = often.filter(F.col("lines") > SHARE * least).select("leaf", "place", "token")
    found = tokens.join(rarer, ["leaf", "place", "token"])
    # repeated rows have one key and are one line
    found = found.groupBy("key", "at").agg(F.array_sort(F.collect_set(F.struct("place", "token"))).alias("found"))
    in_full = rows.join(found, ["key", "at"]).select(
        "key", "id", "at", "line", "leaf", "size",
        F.transform("found", lambda f: F.concat_ws(":", f["place"], f["token"])).alias("constant"),
    )

    constant = held.unionByName(in_full).filter(F.size("constant") >= F.lit(CONSTANT) * F.col("size"))
    template = F.xxhash64("leaf", "constant").alias("template")
    whole = rows.select("key", "id", "at", "line", F.xxhash64("leaf", "masked").alias("template"))
    of_leaves = constant.select("key", "id", "at", "line", template).unionByName(whole)
    templates = of_leaves.withColumn("least", F.lit(least)).unionByName(long.withColumn("least", F.lit(LONG_DOCS)))
    templates = materialize(templates, "line-templates")
    again = _recurring(docs, text, templates.select("template", "id", "least"))
    lines = templates.join(again, "template").groupBy("key", "at")
    return lines.agg(F.first("line").alias("line"), F.min("template").alias("template"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the lines of recurring templates dropped from ``text``."""
    found = recurring_lines(docs, text, **options)
    gone = materialize(
        found.groupBy(F.col("key").alias("gone_key")).agg(F.collect_set("at").alias("gone")), "line-gone"
    )
    key = wd.free_name(docs, "key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text))))
    mark, gone_key = wd.free_name(docs, "gone_at"), wd.free_name(docs, "gone_of")
    gone = gone.select(F.col("gone_key").alias(gone_key), F.col("gone").alias(mark))
    joined = keyed.join(gone, F.col(key) == F.col(gone_key), "left")
    kept = F.expr(
        f"array_join(filter(split(`{text}`, '\\n'), (l, i) -> not array_contains(`{mark}`, i)), '\\n')"
    )
    cleaned = F.when(F.col(mark).isNull(), F.col(text)).otherwise(kept)
    return joined.withColumn(text, cleaned).select(*(F.col(f"`{name}`") for name in docs.columns))
