"""Secrets in texts, and how widely each is owned over the whole corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, spans

KINDS = ("assign", "access", "hex")
KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
# A run too short for its kind is no match wherever in the run one starts, so access and hex state their least lengths at once.
# An assignment's value is measured after the match, as a failing match uses up its text.
PATTERNS = {"assign": KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", "access": "AKIA[A-Z0-9]{16,}", "hex": "(?<![0-9a-f])[0-9a-f]{24,}+"}
VALUE = "^" + KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
LEAST_VALUE = 6
#: Up to so many owners and repositories a value counts as its owner's own.
MAX_OWNERS, MAX_REPOSITORIES = 1, 3


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """One row per row of docs with its tagged base spans, sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"), text.alias("_text"))
    may = {"assign": F.col("_text").rlike(KEYWORD + r"""["']?\x20*[:=]"""), "access": F.contains("_text", F.lit("AKIA")), "hex": F.col("_text").rlike("[0-9a-f]{24}")}
    parts = {}
    for kind in KINDS:
        parts[f"_{kind}"], parts[f"_{kind}_around"] = spans.find(F.col("_text"), PATTERNS[kind], may[kind])
    rows = rows.select("doc_id", "owner", "repository", *[c.alias(n) for n, c in parts.items()])
    rows = rows.select("doc_id", "owner", "repository", *[spans.at(f"_{k}", f"_{k}_around").alias(k) for k in KINDS])
    value = lambda s: F.regexp_extract(s["value"], VALUE, 1)
    # Of an assignment, the value alone is the secret.
    rows = rows.withColumn("assign", F.filter(F.transform("assign", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), value(s).alias("value"))), lambda s: F.length(s["value"]) >= LEAST_VALUE))
    every = F.array_sort(F.concat(*[spans.tagged(F.col(k), k, i) for i, k in enumerate(KINDS)]))
    return rows.select("doc_id", "owner", "repository", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], every.alias("base"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, copies) over the corpus. Copies within a repository are summed before owners are counted."""
    each = found.select("owner", "repository", F.explode("base").alias("s")).select("owner", "repository", F.sha2("s.value", 256).alias("value_hash"))
    by_repository = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("copies"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "lang", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base (spans), live (spans), examples (values held widely).

    Base spans are assignments (the whole assignment), access keys and long lower-case hexadecimal runs.
    live has the values, without their keyword, that look drawn at random (a letter and a digit, and at
    least 8 characters) and that at most max_owners owners with max_repositories repositories hold;
    examples counts base spans whose value more of them hold: documentation and test keys. A value in
    several kinds of spans is live once a place. A repository is an owner's repository_col. Null texts are
    empty, a null owner or repository is a name of its own; rows that share a doc_id are apart;
    an empty table gives no rows. Other columns aren't read.

    Regular expressions run once, and their spans are stored in the shared folder. A hash that a third of the rows
    hold is summed by repository in every task before it is shuffled, and documents meet the verdicts by their list of
    secrets: documents with the same list share one row, and the rest is an equi-join whose large partitions Spark splits.
    """
    found = shared.materialise(candidates(docs, id_col, text_col, owner_col, repository_col))
    values = F.array_join(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"), s["value"])), ",")
    found = found.withColumn("_list", F.when(F.size("base") > 0, F.sha2(values, 256)))
    lists = found.where("_list is not null").groupBy("_list").agg(F.first("base").alias("base"))
    each = lists.select("_list", F.explode("base").alias("s")).select("_list", "s", F.sha2("s.value", 256).alias("value_hash"))
    owned = ownership(found)
    alone = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    random = F.col("s.value").rlike("[0-9]") & F.col("s.value").rlike("[A-Za-z]") & (F.length("s.value") >= 8)
    value = F.struct((F.col("s.stop") - F.length("s.value")).alias("start"), F.lit(len(KINDS)).alias("k"), F.col("s.stop").alias("stop"), F.lit("live").alias("kind"), F.col("s.value").alias("value"))
    judged = each.join(owned, "value_hash").groupBy("_list").agg(F.sort_array(F.collect_set(F.when(alone & random, value))).alias("_live"), F.sum((~alone).cast("long")).alias("_examples"))
    judged = judged.withColumnRenamed("_list", "_key")
    kind = "array<struct<start:int,k:int,stop:int,kind:string,value:string>>"
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base"]
    some = found.join(judged, F.col("_list") == F.col("_key")).select(*names, F.col("_live").cast(kind).alias("live"), F.col("_examples").alias("examples"))
    # Most rows have no secret: they don't take part in the join, where they would be one key.
    none = found.where("_list is null").select(*names, F.array().cast(kind).alias("live"), F.lit(0).cast("long").alias("examples"))
    return some.unionByName(none)
