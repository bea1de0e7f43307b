"""Secret scan: credential patterns, and how many owners hold each candidate.

Base patterns mark assignments of a password-like word, access key ids and long hexadecimal runs. A fourth pattern takes
bare tokens that look random (long, of lower case, upper case and digits). The values of all of them are counted over the
whole corpus by distinct repositories and distinct owners: a value that at most `max_owners` owners hold, in at most
`max_repositories` repositories, looks like a live credential; one that is held by more, or copied widely by one owner, is an example. A bare token becomes a span of its own (kind `bare`) only if it looks
live and touches no base span; base spans always stay, and are told apart by the counts n_live and n_example.

All of it is column expressions. Positions are running sums over the gaps and lengths of a text's matches, as a window over
the matches of one text. Values are counted per (value, owner, repository) with map-side combination; the table of counts is
written, and the join back to the matches is a plain shuffle on both sides that Spark can split at a much copied value.

Defined cases: a null text is empty; texts without candidates have zero counts and empty spans; a null owner or repository
is one of its own; repeated rows are scanned each; an empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolens.llm import common

KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The runs of at least the asked length: a shorter run can hold no match of the open pattern, a longer one is one match.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_=-]{20,}"


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """The matches of a pattern with the gap before each; text pieces and matches are made once and zipped."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def one(z: Column, i: Column) -> Column:
        value = F.regexp_extract(z["match"], pattern, value_group) if value_group else z["match"]
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["match"]).alias("len"), value.alias("value"))

    return F.transform(F.filter(zipped, lambda z: z["match"].isNotNull()), one)


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id), (matches: row, kind, start, end, value, repository, owner), ends exclusive, in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(_matches(text, ASSIGN, 0, 2), _matches(text, ACCESS, 1), _matches(text, HEX, 2), _matches(text, BARE, 3))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        docs[repository].cast("string").alias("repository"),
        docs[owner].cast("string").alias("owner"),
        found.alias("found"),
    )
    rows = common.stored(rows, "found")
    each = rows.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("m")).select("row", "repository", "owner", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    random_looking = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    keep = F.when(F.col("kind") == 0, F.length("value") >= 6).when(F.col("kind") == 3, random_looking).otherwise(F.lit(True))
    each = each.where(keep).select("row", "repository", "owner", "kind", "start", "end", "value")
    return rows.select("row", "doc_id"), each


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = 5) -> DataFrame:
    """Every row with doc_id, counts per kind, and `found`: spans (start, end, kind, value, owners, repositories, live) in order."""
    rows, each = candidates(docs, repository, owner)
    each = each.withColumn("digest", F.sha2("value", 256))
    each = common.stored(each, "candidates")
    held = each.select("digest", "owner", "repository").distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    held = common.stored(held, "ownership")
    spans = each.join(held, "digest").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    spans = spans.where((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "value", "owners", "repositories", "live")
    per = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
    per = per.withColumn("base", F.filter("all", lambda s: s["kind"] < 3))
    apart = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    per = per.withColumn("found", F.filter("all", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: apart(s, b))))
    out = rows.join(per.drop("all"), "row", "left")
    none = F.array().cast(per.schema["found"].dataType)
    out = out.withColumns({"found": F.coalesce("found", none), "base": F.coalesce("base", none)})
    kinds = F.transform("base", lambda s: s["kind"])
    return out.select(
        "doc_id",
        *[(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
        "base",
        "found",
    )


def listed(spans: Column) -> Column:
    """kind:start:end of spans in order, joined with commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
