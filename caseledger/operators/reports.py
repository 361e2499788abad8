"""The analytics the tool's validators and inventory produced.

All reports are aggregations with map-side partial aggregation or joins
between tables that are unique on the join key; none collects a group into
one row or emits all pairs of a key. Definitions marked (*) are our choice
where the tool's prose leaves them open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.files import file_extension, file_url
from ..schema import COMPARE_KEY
from .group import folder_entries
from .parse import parse_cases, parse_clients, severity

# Comparison statuses, case types and parser comparison buckets.
ADDED, REMOVED, CHANGED, IDENTICAL = "Added", "Removed", "Changed", "Identical"
CASE_TYPES = ["Standard", "Pending / No TM No", "NTN / Administrative", "Dispute / Rectification"]
DISPUTE_WORDS = r"(?i)\b(OPPO|RECTIFICATION|DISPUTE)\b"
NTN_WORD = r"(?i)\bNTN\b"
BUCKETS = ["regression", "ambiguous", "case_no_recovered", "case_name_fixed", "identical", "other"]
FIELDS = ["case_no", "case_name", "tm_no", "class_code"]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- D1, D2 --

def compare_exports(a: DataFrame, b: DataFrame, key=COMPARE_KEY,
                    exclude=("date_added", "updated_on", "DATE ADDED", "UPDATED ON")) -> DataFrame:
    """Added / Removed / Changed / Identical per composite key (and root,
    where both sides have one).

    Every row of a repeated key counts: a key is Identical when both sides
    hold the same rows, however often and in whatever order, and a column
    changed when its values did. Each side is reduced to counts and sums of
    64-bit hashes per key, which combine before the shuffle, so the full outer
    join moves a few numbers per key and never multiplies rows.
    """
    key = list(key)
    if "root" in a.columns and "root" in b.columns and "root" not in key:
        key = ["root", *key]
    cols = [c for c in a.columns if c in b.columns and c not in key and c not in exclude]

    def prints(df, tag):
        def total(*cs):
            # both halves of a 64-bit hash, as sums of plain longs
            h = F.xxhash64(*cs)
            return F.struct(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
                            F.sum(F.shiftrightunsigned(h, 32)).alias("high"))
        return df.groupBy(*key).agg(
            F.count("*").alias(f"n_{tag}"), total(F.lit(1), *[_q(c) for c in cols]).alias(f"row_{tag}"),
            *[total(_q(c)).alias(f"{tag}{i}") for i, c in enumerate(cols)])

    j = prints(a, "a").join(prints(b, "b"), key, "full")
    diffs = [F.when(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(c)) for i, c in enumerate(cols)]
    changed = F.array_join(F.array_compact(F.array(*diffs)), ", ") if diffs else F.lit("")
    gone = F.col("n_a").isNull() | F.col("n_b").isNull()
    status = (F.when(F.col("n_a").isNull(), F.lit(ADDED))
              .when(F.col("n_b").isNull(), F.lit(REMOVED))
              .when((F.col("n_a") != F.col("n_b")) | (F.col("row_a") != F.col("row_b")), F.lit(CHANGED))
              .otherwise(F.lit(IDENTICAL)))
    return j.select(*key, status.alias("status"), F.when(gone, F.lit("")).otherwise(changed).alias("changed_columns"),
                    F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def compare_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("records"))


def duplicate_keys(df: DataFrame, key=COMPARE_KEY) -> DataFrame:
    """Composite keys occurring more than once, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


# ------------------------------------------------------- folder diagnosis --

def folder_diagnosis(case_files: DataFrame) -> DataFrame:
    """One row per case folder: token parse of client and case, severity,
    kept file count and tokens (input of D3, D4, D5, D10)."""
    folders = folder_entries(case_files, "token").drop("files_text", "ext_text")
    parsed = parse_cases(parse_clients(folders, "token"), "token", tokens="tokens")
    return parsed.select("*", *severity())


def validation_summary(diag: DataFrame) -> DataFrame:
    """D3: cases, ok, failures, warnings, duplicates, empty, missing TM /
    class / case no. and their share of cases (one row).

    *duplicates = case folders whose (client no., case no., TM, class) key
    was already seen. Two aggregation levels (per key, then total) replace
    a join of two results.
    """
    per_key = diag.groupBy(*COMPARE_KEY).agg(
        F.count("*").alias("n"),
        F.count_if("is_ok").alias("ok"), F.count_if("is_failure").alias("failures"),
        F.count_if("is_warning").alias("warnings"),
        F.count_if(F.col("n_files") == 0).alias("empty"),
        F.count_if(F.col("tm_no") == "").alias("missing_tm"),
        F.count_if(F.col("class_code") == "").alias("missing_class"),
        F.count_if(F.col("case_no") == "").alias("missing_case_no"))
    counts = ["ok", "failures", "warnings", "empty", "missing_tm", "missing_class",
              "missing_case_no"]
    tot = per_key.agg(F.sum("n").alias("cases"), F.sum(F.col("n") - 1).alias("duplicates"),
                      *[F.sum(c).alias(c) for c in counts])
    pct = lambda c: F.round(F.lit(100.0) * F.col(c) / F.col("cases"), 1).alias(f"{c}_pct")
    return tot.select("cases", *counts, "duplicates",
                      *[pct(c) for c in ["ok", "failures", "warnings", "missing_tm",
                                         "missing_class", "missing_case_no"]])


def naming_signatures(diag: DataFrame, k: int = 10) -> DataFrame:
    """Top-k structural signatures among unrecognised (*failure) folders,
    e.g. ``[CASE_NO] [UPPER] [TM_NO] [CLASS]``; ties by signature."""
    fails = diag.where("is_failure").select(
        N.signature(F.col("tokens")).alias("signature"), "case_folder")
    counted = fails.groupBy("signature").agg(F.count("*").alias("folders"),
                                             F.min("case_folder").alias("example"))
    return counted.orderBy(F.desc("folders"), "signature").limit(k)


def warnings_table(diag: DataFrame) -> DataFrame:
    """One row per warning of warning-severity folders."""
    return diag.where("is_warning").select(
        "root", "client_folder", F.col("case_folder").alias("folder_name"), *FIELDS,
        F.explode_outer("warnings").alias("message"))


def failures_table(diag: DataFrame) -> DataFrame:
    """One row per issue of failed folders."""
    return diag.where("is_failure").select(
        "root", "client_folder", F.col("case_folder").alias("folder_name"), *FIELDS,
        F.explode_outer("issues").alias("message"))


# ----------------------------------------------------------------- D5 -----

def parser_differences(case_files: DataFrame) -> DataFrame:
    """D5 detail: both parsers side by side per case folder, with a bucket.

    Buckets are tested in the order regression (legacy set, token blank in
    any field), ambiguous (two or more TM tokens), case no. recovered, case
    name fixed, identical; anything else is ``other`` (*).
    """
    folders = case_files.where(F.col("case_folder").isNotNull()) \
        .select("root", "client_folder", "case_folder").distinct()
    leg = parse_cases(folders, "legacy")
    both = parse_cases(leg.select(*folders.columns, *[F.col(f).alias(f"legacy_{f}") for f in FIELDS]),
                       "token", tokens="_tok")
    n_tm = F.size(F.filter("_tok", lambda t: t["type"] == "TM_NO"))
    regression = reduce(lambda x, y: x | y,
                        [(F.col(f"legacy_{f}") != "") & (F.col(f) == "") for f in FIELDS])
    same = reduce(lambda x, y: x & y, [F.col(f"legacy_{f}") == F.col(f) for f in FIELDS])
    bucket = (F.when(regression, F.lit("regression"))
              .when(n_tm >= 2, F.lit("ambiguous"))
              .when((F.col("legacy_case_no") == "") & (F.col("case_no") != ""), F.lit("case_no_recovered"))
              .when(F.col("legacy_case_name") != F.col("case_name"), F.lit("case_name_fixed"))
              .when(same, F.lit("identical"))
              .otherwise(F.lit("other")))
    return both.withColumn("bucket", bucket).drop("_tok")


def compare_parsers(case_files: DataFrame) -> DataFrame:
    """Folders per bucket."""
    return parser_differences(case_files).groupBy("bucket").agg(F.count("*").alias("folders"))


# ------------------------------------------------------------ D6-D9 -------

def case_type(case_folder: Column, tokens: Column) -> Column:
    """D7 (*order): dispute words or >= 2 TM tokens; the word NTN; no TM;
    else Standard."""
    n_tm = F.size(F.filter(tokens, lambda t: t["type"] == "TM_NO"))
    return (F.when(case_folder.rlike(DISPUTE_WORDS) | (n_tm >= 2), F.lit(CASE_TYPES[3]))
            .when(case_folder.rlike(NTN_WORD), F.lit(CASE_TYPES[2]))
            .when(n_tm == 0, F.lit(CASE_TYPES[1]))
            .otherwise(F.lit(CASE_TYPES[0])))


def inventory(listing: DataFrame, root_ids: DataFrame | None = None):
    """(clients, cases, files) tables of a listing, token parser.

    Built with semi joins on ids (no de-duplication of a wide joined tree):
    clients = folders under a root, cases = folders under a client,
    files = files under a case.
    """
    folders = listing.where(F.col("is_folder"))
    if root_ids is None:
        client_rows = folders.where(F.col("parent_id") == F.col("root"))
    else:
        client_rows = folders.join(root_ids, (folders["root"] == root_ids["root"])
                                   & (folders["parent_id"] == root_ids["root_id"]), "left_semi")
    clients = parse_clients(client_rows.select(
        "root", F.col("id").alias("client_id"), F.col("name").alias("client_folder"),
        "parent_id", "created_time", "modified_time"), "token")
    # ids are unique within a root
    case_rows = folders.join(clients.select("root", F.col("client_id").alias("parent_id")),
                             ["root", "parent_id"], "left_semi")
    cases = parse_cases(case_rows.select(
        "root", F.col("id").alias("case_id"), F.col("parent_id").alias("client_id"),
        F.col("name").alias("case_folder"), "created_time", "modified_time"), "token", tokens="_tok")
    cases = cases.withColumn("case_type", case_type(F.col("case_folder"), F.col("_tok"))).drop("_tok")
    # cases by id alone, not parsed
    file_rows = listing.where(~F.col("is_folder")).join(
        case_rows.select("root", F.col("id").alias("parent_id")), ["root", "parent_id"], "left_semi")
    files = file_rows.select(
        "root", F.col("id").alias("file_id"), F.col("parent_id").alias("case_id"),
        F.col("name").alias("file_name"), file_extension(F.col("name")).alias("extension"),
        "mime_type", "size", file_url(F.col("id"), F.col("source")).alias("url"),
        "created_time", "modified_time")
    return clients, cases, files


def inventory_report(clients: DataFrame, cases: DataFrame, files: DataFrame) -> DataFrame:
    """Totals, case types, missing TM / class (with %), empty folders,
    largest case and mean files per case as (metric, value, detail) rows.

    Two independent aggregations are stacked with UNION ALL (no join of
    single-row results); the files of all cases are all files.
    """
    per_case = files.groupBy("root", "case_id").agg(F.count("*").alias("n_files"))
    c = cases.join(per_case, ["root", "case_id"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    n = F.count("*")
    case_stats = c.agg(
        n.alias("total_cases"),
        F.sum("n_files").alias("total_files_in_cases"),
        F.count_if(F.col("tm_no") == "").alias("missing_tm"),
        F.count_if(F.col("class_code") == "").alias("missing_class"),
        F.count_if(F.col("n_files") == 0).alias("empty_cases"),
        F.max(F.struct("n_files", "case_folder")).alias("largest"),
        *[F.count_if(F.col("case_type") == t).alias(f"type:{t}") for t in CASE_TYPES])
    def m(metric, value, detail=F.lit("")):
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                        detail.alias("detail"))

    pct = lambda c: F.round(100.0 * F.col(c) / F.col("total_cases"), 1)
    rows = case_stats.select(F.explode(F.array(
        m("total_cases", F.col("total_cases")),
        m("missing_tm", F.col("missing_tm")),
        m("missing_tm_pct", pct("missing_tm")),
        m("missing_class", F.col("missing_class")),
        m("missing_class_pct", pct("missing_class")),
        m("empty_cases", F.col("empty_cases")),
        m("largest_case_files", F.col("largest.n_files"), F.col("largest.case_folder")),
        m("total_files", F.coalesce("total_files_in_cases", F.lit(0))),
        m("avg_files_per_case", F.round(F.col("total_files_in_cases") / F.col("total_cases"), 2)),
        *[m(f"case_type:{t}", F.col(f"`type:{t}`")) for t in CASE_TYPES],
    )).alias("r")).select("r.*")
    totals = clients.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("total_clients").alias("metric"), "value", F.lit("").alias("detail"))
    return rows.unionByName(totals)


def duplicate_tm(cases: DataFrame) -> DataFrame:
    """TM numbers found in more than one case folder, one row per
    (TM, folder) with the folder count; blank TM excluded.

    Long form instead of a collected list: a TM shared by millions of
    folders stays spread over tasks.
    """
    with_tm = cases.where(F.col("tm_no") != "")
    dup = with_tm.groupBy("tm_no").agg(F.count("*").alias("folders")).where(F.col("folders") > 1)
    return with_tm.join(dup, "tm_no")
