"""

Every query reads the driver tables of ``sf_dir`` (customer, orders,
lineitem) and derives the folder tree from them in Spark
(``caseledger.sources.fixture``); nothing runs on made-up input.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql_defs as O
from caseledger.functions import names as N
from caseledger.operators import classify as C
from caseledger.operators import parse as P
from caseledger.operators import export as X
from caseledger.operators import reports as R
from caseledger.operators import upsert as U
from caseledger.operators.incremental import group_changed, group_first
from caseledger.operators.partial_upsert import create_target, read_target, upsert_target
from caseledger.operators.rowdiff import diff_rows
from caseledger.operators.group import group_cases, record_counts
from caseledger.operators.positions import row_positions
from caseledger.plans.scans import (classified_scan, export_run, listing_run, scan_pair, token_scan,
                                    upsert_run)
from caseledger.schema import KEY
from caseledger.session import materialize, shared_dir
from caseledger.functions import files as FF
from caseledger.sources import fixture
from caseledger.sources import hierarchy as H
from caseledger.sources import listing as L
from caseledger.sources.paths import paths_from_parents
from caseledger.sources.rules import default_rules, load_rules, shipped_rules

SMOKE_DIR = "/root/testdata/sf0.001"
LIMIT_N = 100
FIRST_CLIENTS_N = 50
TOP_K = 10
RUN_ORDER = ["client_number", "case_no", "client_name", "case_name", "tm_no", "class_code", "root"]
CF_COLS = ["root", "client_folder", "case_folder", "file_name", "file_path", "entry_is_folder"]
ORDER = ["root", "client_number", "case_no", "client_name", "case_name", "tm_no", "class_code"]


def _cf(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.case_files(spark, sf)


def _names(spark, sf, col):
    return _cf(spark, sf).where(F.col(col).isNotNull()).select(col).distinct()


def _rule_cols():
    return [F.col(f"`{c}`") for c in O.RULE_NAMES]


# ---------------------------------------------------------------- queries --

def q_parse_clients_legacy(spark, sf):
    return P.parse_clients(_names(spark, sf, "client_folder"), "legacy")


def q_parse_clients_token(spark, sf):
    return P.parse_clients(_names(spark, sf, "client_folder"), "token")


def q_parse_cases_legacy(spark, sf):
    return P.parse_cases(_names(spark, sf, "case_folder"), "legacy")


def q_parse_cases_token(spark, sf):
    return P.parse_cases(_names(spark, sf, "case_folder"), "token")


def q_tokens(spark, sf):
    return P.token_rows(_names(spark, sf, "case_folder"), "case_folder")


def q_diagnose_clients(spark, sf):
    d = P.diagnose_clients(_names(spark, sf, "client_folder"))
    return d.withColumn("issues", F.array_join("issues", "; "))


def q_diagnose_cases(spark, sf):
    d = P.diagnose_cases(_names(spark, sf, "case_folder"))
    return d.withColumn("issues", F.array_join("issues", "; ")) \
        .withColumn("warnings", F.array_join("warnings", "; "))


def _group(mode):
    def run(spark, sf):
        r = group_cases(_cf(spark, sf), mode=mode)
        return r.select("root", *KEY, "files", "ext", "n_folders", "n_files")
    return run


def q_group_strict_split(spark, sf):
    """A1/A2 with the hot-group split (range-partitioned ordered concat)."""
    r = group_cases(_cf(spark, sf), mode="strict", split_hot=True)
    return r.select("root", *KEY, "files", "ext", "n_folders", "n_files")


#: A folder with more files is hot in the queries of the piled tree.
PILE_HOT = 1000


def _group_pile(mode):
    """A1-A3 where one folder holds a third of all files."""
    def run(spark, sf):
        r = group_cases(fixture.piled(spark, sf), mode=mode, hot_files=PILE_HOT, hot_folders=PILE_HOT)
        return r.select("root", *KEY, "files", "ext", "n_folders", "n_files")
    return run


def _limit_groups(mode):
    def run(spark, sf):
        r = group_cases(_cf(spark, sf), mode=mode, limit=LIMIT_N)
        return r.select("root", *KEY, "files", "n_files")
    return run


def q_classified_scan_split(spark, sf):
    """L1 with folders and keys spread over tasks."""
    return classified_scan(_cf(spark, sf), split_hot=True).select(
        "root", *KEY, "files", "ext", *_rule_cols(), "date_added", "updated_on")


def q_default_rules_scan(spark, sf):
    """L1 with the built-in rules, written as a rule file and loaded."""
    path = f"{shared_dir(spark).rstrip('/')}/rules/{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(json.dumps(default_rules())).alias("value")).coalesce(1).write.text(path)
    rules = load_rules(spark, path)
    return classified_scan(_cf(spark, sf), rules).select(
        "root", *KEY, "files", *[F.col(f"`{n}`") for n in O.active(default_rules())])


#: Plain text, a bad pattern beside a good one, none that can run, loops.
CUSTOM_RULES = [C.make_rule("papers", ["scan", "legal", "demand note"], plain_text=True),
                C.make_rule("broken", ["(", r"TM-\d+"]),
                C.make_rule("hopeless", ["[", "x(a+)+y"]),
                C.make_rule("looped", [r"(\w|-)*NOTICE", "(ACK|LEGAL)+$"])]


def q_custom_rules_scan(spark, sf):
    """L1 with rules as a user types them."""
    recs = C.classify(group_cases(_cf(spark, sf), mode="strict"), CUSTOM_RULES, data_sheet_override=False)
    return recs.select("root", *KEY, "files", *[r["name"] for r in CUSTOM_RULES])


def q_record_counts(spark, sf):
    return record_counts(group_cases(_cf(spark, sf), mode="strict"))


def q_classified_scan(spark, sf):
    """L1 flagship: strict scan, legacy parser, shipped rules."""
    return classified_scan(_cf(spark, sf)).select(
        "root", *KEY, "files", "ext", *_rule_cols(), "date_added", "updated_on")


def q_token_scan(spark, sf):
    return token_scan(_cf(spark, sf)).select(
        "root", *KEY, "files", "ext", *_rule_cols(), "date_added")


def q_rule_hits(spark, sf):
    recs = classified_scan(_cf(spark, sf))
    return C.rule_hit_counts(recs, O.RULE_NAMES)


def q_rule_hits_long(spark, sf):
    recs = classified_scan(_cf(spark, sf))
    return C.rule_hits_long(recs, O.RULE_NAMES, ["root", *KEY])


# -------------------------------------------------- listing-based queries --

def _listing(spark, sf, stored=False, cols=("*",)):
    """Non-trashed listing; ``stored`` writes it once as a table first, as a
    listing export would be, for plans that scan it several times. ``cols`` are
    those that a plan reads."""
    lst = fixture.listing(spark, sf).select(*cols)
    return L.not_trashed(materialize(lst, "zstd") if stored else lst)


def q_not_trashed(spark, sf):
    return _listing(spark, sf).drop("source")


def q_file_parts(spark, sf):
    f = L.files_only(_listing(spark, sf))
    name = F.col("name")
    return f.select("id", "name", FF.file_stem(name).alias("stem"), FF.file_ext(name).alias("ext"),
                    FF.file_extension(name).alias("extension"),
                    FF.file_url(F.col("id"), F.col("source")).alias("url"),
                    FF.is_noise_file(name).alias("is_noise"), "size", "created_time",
                    "modified_time")


def q_scan_roots(spark, sf):
    lst = fixture.listing(spark, sf)
    parts = [(r, lst.where(F.col("root") == r).drop("root")) for r in ("clients", "consultants")]
    both, _ = L.scan_roots(parts + [("missing", None)])
    return both.select("root", "id", "name", "parent_id", "path", "is_folder", "size")


def _hier(mode):
    def run(spark, sf):
        return H.hierarchy_by_path(_listing(spark, sf, mode != "deep"), mode).select(*CF_COLS)
    return run


def q_hierarchy_parent(spark, sf):
    return H.hierarchy_by_parent(_listing(spark, sf, True)).select(*CF_COLS)


def _listing_scan(mode):
    def run(spark, sf):
        cf = H.hierarchy_by_path(_listing(spark, sf, mode != "deep"), mode)
        return group_cases(cf, mode=mode).select("root", *KEY, "files", "ext", "n_folders", "n_files")
    return run


def q_first_clients(spark, sf):
    return L.first_clients(_cf(spark, sf), FIRST_CLIENTS_N)


def _read_back(spark, sf):
    """The listing of both roots, stored and read as an export would be."""
    path = f"{shared_dir(spark).rstrip('/')}/listings/{uuid.uuid4().hex}"
    fixture.listing(spark, sf).write.parquet(path)
    return L.read_listing(spark, path)


def q_listing_run(spark, sf):
    """L1 end to end: read, drop trash, tree, group, classify, sort."""
    return listing_run(_read_back(spark, sf)).select("root", *KEY, "files", "ext", *_rule_cols())


def q_paths_from_parents(spark, sf):
    """The listing's paths, from parent ids alone."""
    lst = _listing(spark, sf).select("root", "id", "name", "parent_id", "is_folder")
    return paths_from_parents(lst).select("root", "id", "is_folder", "path", "path_state")


def q_paths_of_chains(spark, sf):
    """The same where folders lie deep in each other, in rings or nowhere."""
    return paths_from_parents(fixture.chains(spark, sf)).select("root", "id", "is_folder", "path", "path_state")


def q_parent_listing_run(spark, sf):
    """L1 end to end from a listing without paths."""
    cols = ["root", "id", "name", "parent_id", "is_folder", "trashed"]
    return listing_run(_listing(spark, sf, True, cols)).select("root", *KEY, "files", "ext", *_rule_cols())


def q_first_listed_clients(spark, sf):
    lst = L.first_listed_clients(L.not_trashed(_read_back(spark, sf)), FIRST_CLIENTS_N)
    return lst.select("root", "id", "path", "is_folder")


# --------------------------------------------------------------- reports --

def _diag(spark, sf):
    return R.folder_diagnosis(_cf(spark, sf))


def _scan_cols(df, dated=("date_added", "updated_on")):
    return df.select("root", *KEY, "files", "ext", *_rule_cols(), *[d for d in dated if d in df.columns])


def q_compare_exports(spark, sf):
    a, b = scan_pair(_cf(spark, sf))
    return R.compare_exports(_scan_cols(a), _scan_cols(b))


def q_duplicate_keys(spark, sf):
    return R.duplicate_keys(classified_scan(_cf(spark, sf)))


def q_validation_summary(spark, sf):
    return R.validation_summary(_diag(spark, sf))


def q_naming_signatures(spark, sf):
    return R.naming_signatures(_diag(spark, sf), TOP_K)


def q_compare_parsers(spark, sf):
    return R.compare_parsers(_cf(spark, sf))


def q_warnings_table(spark, sf):
    return R.warnings_table(_diag(spark, sf))


def q_failures_table(spark, sf):
    return R.failures_table(_diag(spark, sf))


def _inventory(i):
    def run(spark, sf):
        return R.inventory(_listing(spark, sf, True))[i]
    return run


def q_inventory_report(spark, sf):
    return R.inventory_report(*R.inventory(_listing(spark, sf, True)))


def q_duplicate_tm(spark, sf):
    folders = materialize(L.folders_only(_listing(spark, sf)))  # files play no part
    cases = R.inventory(folders)[1]
    return R.duplicate_tm(cases).select("tm_no", "folders", "root", "client_id", "case_folder")


# ---------------------------------------------------------- export, sinks --

def q_export_projection(spark, sf):
    return X.project_export(classified_scan(_cf(spark, sf)), shipped_rules())


def q_quick_export(spark, sf):
    return X.quick_export(classified_scan(_cf(spark, sf)))


def q_csv_round_trip(spark, sf):
    """The export written as CSV into the shared folder and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    X.write_csv(X.python_booleans(_scan_cols(classified_scan(_cf(spark, sf)))), path)
    return X.read_csv(spark, path)


def q_csv_lines_round_trip(spark, sf):
    """W3 with a line a row, so that files split among tasks."""
    path = f"{shared_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    X.write_csv(X.python_booleans(_scan_cols(classified_scan(_cf(spark, sf)))), path, lines=True)
    return X.read_csv(spark, path, lines=True)


def q_classify_entries(spark, sf):
    """A remote-API shaped listing (size as text, absent fields null)."""
    lst = fixture.listing(spark, sf)
    raw = lst.select(
        "root", "id", "name", "parent_id", "path",
        F.col("mime_type").alias("mimeType"),
        F.when(F.col("size") % 7000 == 0, F.lit("n/a"))
        .otherwise(F.col("size").cast("string")).alias("size"),
        F.when(F.col("created_time") != "", F.col("created_time")).alias("createdTime"),
        F.when(F.col("modified_time") != "", F.col("modified_time")).alias("modifiedTime"),
        "trashed", F.lit(None).cast("string").alias("source"))
    return L.classify_entries(raw)


def q_sort_records(spark, sf):
    return X.sort_records(_scan_cols(classified_scan(_cf(spark, sf))))


#: Row 1 of a sheet is its header.
FIRST_ROW = 2


def q_row_positions(spark, sf):
    """The number each record has in the sorted sheet."""
    recs = classified_scan(_cf(spark, sf)).select("root", *KEY, "files")
    return row_positions(recs, RUN_ORDER, "row", FIRST_ROW)


def q_upsert_cases(spark, sf):
    e, i = scan_pair(_cf(spark, sf))
    return U.upsert_cases(materialize(_scan_cols(e)), _scan_cols(i), key="case_no",
                          order_by=ORDER, keep_position=False)


def q_upsert_partial(spark, sf):
    """W1 in place: the touched parts of a partitioned target are rewritten."""
    path = f"{shared_dir(spark).rstrip('/')}/targets/{uuid.uuid4().hex}"
    e, i = scan_pair(_cf(spark, sf))
    create_target(_scan_cols(e), path, parts=64)
    upsert_target(_scan_cols(i), path, order_by=ORDER, keep_position=False)
    return read_target(spark, path)


def q_incremental_run(spark, sf):
    """A1 on what changed: the tree's records, then the tree after a third of all
    files moved to one folder."""
    cols = ["root", "client_folder", "case_folder", "file_name", "file_path"]
    first = group_first(_cf(spark, sf).select(*cols))
    r = group_changed(fixture.piled(spark, sf).select(*cols), first).records
    return r.select("root", *KEY, "files", "ext", "n_folders", "n_files")


#: Columns that the row-level comparison looks at.
DIFF_COLS = ["client_name", "case_name", "files", "ext"]


def q_row_diff(spark, sf):
    """D1 by row: strict and token records of each key, row against row."""
    a, b = scan_pair(_cf(spark, sf))
    return diff_rows(_scan_cols(a), _scan_cols(b), cols=DIFF_COLS)


def q_upsert_run(spark, sf):
    """W1 as a run: a strict scan written as a table, then a token scan into it."""
    base = f"{shared_dir(spark).rstrip('/')}/upserts/{uuid.uuid4().hex}"
    cf = _cf(spark, sf)
    first = upsert_run(cf, None, f"{base}/v0")
    second = upsert_run(cf, first, f"{base}/v1", mode="token", parser="token")
    return second.select("root", *KEY, "files", "ext", *_rule_cols(), "date_added", "updated_on", "upsert_status")


def q_export_run(spark, sf):
    """The sorted export under a new name, read back."""
    base = f"{shared_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
    return X.read_csv(spark, export_run(_cf(spark, sf), base))


def q_upsert_counts(spark, sf):
    e, i = scan_pair(_cf(spark, sf))
    return U.upsert_counts(e, i, key="case_no")


def q_evolve_schema(spark, sf):
    """A table written with the first 10 rules meets a batch with all 15."""
    rules = shipped_rules()
    base = ["root", *KEY, "files", "ext"]
    old = classified_scan(_cf(spark, sf), rules=rules[:10]).select(
        *base, *[F.col(f"`{r['name']}`") for r in rules[:10]])
    # of the batch only the columns count: one lazy plan
    new = classified_scan(_cf(spark, sf), rules=rules, split_hot=False).select(*base, *_rule_cols())
    return U.evolve_schema(old, new)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_clients_legacy": q_parse_clients_legacy,
    "parse_clients_token": q_parse_clients_token,
    "parse_cases_legacy": q_parse_cases_legacy,
    "parse_cases_token": q_parse_cases_token,
    "tokens": q_tokens,
    "diagnose_clients": q_diagnose_clients,
    "diagnose_cases": q_diagnose_cases,
    "group_strict": _group("strict"),
    "group_deep": _group("deep"),
    "group_token": _group("token"),
    "group_strict_split": q_group_strict_split,
    "group_pile_strict": _group_pile("strict"),
    "group_pile_deep": _group_pile("deep"),
    "group_pile_token": _group_pile("token"),
    "limit_groups": _limit_groups("strict"),
    "limit_groups_deep": _limit_groups("deep"),
    "limit_groups_token": _limit_groups("token"),
    "record_counts": q_record_counts,
    "classified_scan": q_classified_scan,
    "classified_scan_split": q_classified_scan_split,
    "default_rules_scan": q_default_rules_scan,
    "custom_rules_scan": q_custom_rules_scan,
    "token_scan": q_token_scan,
    "rule_hits": q_rule_hits,
    "rule_hits_long": q_rule_hits_long,
    "not_trashed": q_not_trashed,
    "file_parts": q_file_parts,
    "scan_roots": q_scan_roots,
    "hierarchy_deep": _hier("deep"),
    "hierarchy_strict": _hier("strict"),
    "hierarchy_token": _hier("token"),
    "hierarchy_parent": q_hierarchy_parent,
    "listing_scan_strict": _listing_scan("strict"),
    "listing_scan_deep": _listing_scan("deep"),
    "listing_scan_token": _listing_scan("token"),
    "first_clients": q_first_clients,
    "listing_run": q_listing_run,
    "paths_from_parents": q_paths_from_parents,
    "paths_of_chains": q_paths_of_chains,
    "parent_listing_run": q_parent_listing_run,
    "first_listed_clients": q_first_listed_clients,
    "compare_exports": q_compare_exports,
    "duplicate_keys": q_duplicate_keys,
    "validation_summary": q_validation_summary,
    "naming_signatures": q_naming_signatures,
    "compare_parsers": q_compare_parsers,
    "warnings_table": q_warnings_table,
    "failures_table": q_failures_table,
    "inventory_clients": _inventory(0),
    "inventory_cases": _inventory(1),
    "inventory_files": _inventory(2),
    "inventory_report": q_inventory_report,
    "duplicate_tm": q_duplicate_tm,
    "export_projection": q_export_projection,
    "quick_export": q_quick_export,
    "sort_records": q_sort_records,
    "row_positions": q_row_positions,
    "csv_round_trip": q_csv_round_trip,
    "csv_lines_round_trip": q_csv_lines_round_trip,
    "classify_entries": q_classify_entries,
    "upsert_cases": q_upsert_cases,
    "upsert_partial": q_upsert_partial,
    "incremental_run": q_incremental_run,
    "row_diff": q_row_diff,
    "upsert_run": q_upsert_run,
    "export_run": q_export_run,
    "upsert_counts": q_upsert_counts,
    "evolve_schema": q_evolve_schema,
}


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators and their pipeline; none
    where that subpackage isn't installed."""
    try:
        import caseledger.llm  # noqa: F401
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name not in ("caseledger.llm", "corpus_pipeline"):
            raise
        return {}, {}
    from caseledger.llm.queries import ORACLE_SQL, QUERIES
    sql = dict(ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, sql


def entry(spark: SparkSession) -> DataFrame:
    """Flagship L1 scan (strict, legacy parser, shipped rules) on sf0.001."""
    return q_classified_scan(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_training_data()[0]}


# ----------------------------------------------------------------- oracle --

def _names_sql(col):
    return f"select distinct {col} from cf where {col} is not null"


def _oracle() -> dict[str, str]:
    w = O.with_cf
    key = O.KEY
    scan = f"""select root, {key}, files, ext, {O.flag_columns()}, {O.AS_OF_DAY} as date_added,
  {O.AS_OF_DAY} as updated_on
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('strict', 'legacy')}) r0) r1"""
    token = f"""select root, {key}, files, ext, {O.flag_columns()}, {O.AS_OF_TS} as date_added
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('token', 'token')}) r0) r1"""
    long_hits = " union all ".join(
        f"""select root, {key}, '{n}' as rule from scan where "{n}" """ for n in O.RULE_NAMES)
    counts = " union all ".join(
        f"""select '{n}' as rule, count(*) filter (where "{n}") as hits from scan""" for n in O.RULE_NAMES)
    return {
        "parse_clients_legacy": w(O.legacy_client(_names_sql("client_folder"))),
        "parse_clients_token": w(O.token_client(_names_sql("client_folder"))),
        "parse_cases_legacy": w(O.legacy_case(_names_sql("case_folder"))),
        "parse_cases_token": w(O.token_case(_names_sql("case_folder"))),
        "tokens": w(f"""select case_folder, cast(i - 1 as integer) as position, _ty[i] as type, _t[i] as raw
from ({O.typed(_names_sql('case_folder'), 'case_folder')}) tt, range(1, len(_t) + 1) r(i)"""),
        "diagnose_clients": w(f"""select client_folder as folder_name, client_number, client_name,
  client_number <> '' as recognized,
  case when client_number <> '' then '' else '{N.CLIENT_ISSUE}' end as issues
from ({O.token_client(_names_sql('client_folder'))}) d"""),
        "diagnose_cases": w(f"""select case_folder as folder_name, case_no, case_name, tm_no, class_code,
  case when case_no = '' then '{N.CASE_ISSUE}' else '' end as issues,
  concat_ws('; ', case when tm_no = '' then '{N.TM_WARNING}' end,
                  case when class_code = '' then '{N.CLASS_WARNING}' end) as warnings,
  case_no = '' as is_failure,
  case_no <> '' and (tm_no = '' or class_code = '') as is_warning,
  case_no <> '' and tm_no <> '' and class_code <> '' as is_ok
from ({O.token_case(_names_sql('case_folder'))}) d"""),
        "group_strict": w(O.records("strict", "legacy")),
        "group_deep": w(O.records("deep", "legacy")),
        "group_token": w(O.records("token", "token")),
        "group_strict_split": w(O.records("strict", "legacy")),
        **{f"group_pile_{mode}": f"with pcf as materialized ({fixture.PILED_SQL}),\npkf as ({O.kept_files('pcf')})\n"
           + O.records(mode, parser, "pcf", "pkf")
           for mode, parser in (("strict", "legacy"), ("deep", "legacy"), ("token", "token"))},
        "limit_groups": w(f"""select root, {key}, files, n_files from (
  select r.*, row_number() over (partition by root order by first_path) as rn
  from ({O.records('strict', 'legacy')}) r
  join (select root, {key}, min(client_folder || '/' || case_folder || '/') as first_path
        from ({O.parse_both("select distinct root, client_folder, case_folder from cf where case_folder is not null", "legacy")}) pf
        group by all) fp using (root, {key})
) x where rn <= {LIMIT_N}"""),
        "limit_groups_deep": w(f"""select root, {key}, files, n_files from (
  select r.*, row_number() over (partition by root order by first_path) as rn
  from ({O.records('deep', 'legacy')}) r
  join (select root, {key}, min(client_folder || '/' || case_folder || '/') as first_path
        from ({O.parse_both("select distinct root, client_folder, case_folder from kf", "legacy")}) pf
        group by all) fp using (root, {key})
) x where rn <= {LIMIT_N}"""),
        "limit_groups_token": f"""with cf0 as ({fixture.CASE_FILES_SQL}),
cf as (select cf0.* from cf0 join (select root, client_folder, case_folder from (
  select *, row_number() over (partition by root order by client_folder || '/' || case_folder || '/') as rn
  from (select distinct root, client_folder, case_folder from cf0 where case_folder is not null) d) n
  where rn <= {LIMIT_N}) k using (root, client_folder, case_folder)),
kf as ({O.KEPT_FILES})
select root, {key}, files, n_files from ({O.records('token', 'token')}) r""",
        "record_counts": w(f"select root, count(*) as records from ({O.records('strict', 'legacy')}) r group by root"),
        "classified_scan": w(scan),
        "classified_scan_split": w(scan),
        "default_rules_scan": w(f"""select root, {key}, files, {O.flag_columns(rules=default_rules())}
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('strict', 'legacy')}) r0) r1"""),
        "custom_rules_scan": w(f"""select root, {key}, files,
  regexp_matches(_txt, '\\b(scan|legal|demand note)\\b', 'i') as "PAPERS", regexp_matches(_txt, 'TM-\\d+', 'i') as "BROKEN",
  false as "HOPELESS", regexp_matches(_txt, 'NOTICE|(ACK|LEGAL)$', 'i') as "LOOPED"
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('strict', 'legacy')}) r0) r1"""),
        "token_scan": w(token),
        "rule_hits": _with_scan(scan, counts),
        "rule_hits_long": _with_scan(scan, long_hits),
    }


def _with_scan(scan: str, body: str) -> str:
    from caseledger.sources.fixture import CASE_FILES_SQL
    return (f"with cf as ({CASE_FILES_SQL}),\nkf as ({O.KEPT_FILES}),\n"
            f"scan as ({scan})\n{body}")


def _oracle_more() -> dict[str, str]:
    key = O.KEY
    flags = ", ".join(f'"{n}"' for n in O.RULE_NAMES)
    scan_a = f"""select root, {key}, files, ext, {O.flag_columns()}, {O.AS_OF_DAY} as date_added,
  {O.AS_OF_DAY} as updated_on
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('strict', 'legacy')}) r0) r1"""
    scan_b = f"""select root, {key}, files, ext, {O.flag_columns()}, {O.AS_OF_TS} as date_added
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('token', 'token')}) r0) r1"""
    cf_ctes = f"with cf as ({fixture.CASE_FILES_SQL}),\nkf as ({O.KEPT_FILES}),\n"
    two = cf_ctes + f"sa as ({scan_a}),\nsb as ({scan_b})\n"
    listing = f"with lst as materialized ({fixture.LISTING_SQL}),\nnt as materialized (select *, string_split(path, '/') as parts from lst where not trashed)"

    def lscan(mode, parser):
        return (f"{listing},\nhcf as ({O.hierarchy(mode)}),\nhkf as ({O.kept_files('hcf')})\n"
                f"select root, {key}, files, ext, n_folders, n_files from ({O.records(mode, parser, 'hcf', 'hkf')}) r")

    # The sorted rows, and the sorted values of each column, of a key.
    cmp_cols = ["client_name", "case_name", "files", "ext"] + O.RULE_NAMES
    st = ", ".join(f"'{c}': \"{c}\"" for c in cmp_cols)
    lists = ", ".join(f'list_sort(list("{c}")) as "_{i}"' for i, c in enumerate(cmp_cols))
    diffs = ", ".join(f"case when a._{i} is distinct from b._{i} then '{c}' end" for i, c in enumerate(cmp_cols))
    ck = "client_number, case_no, tm_no, class_code"
    on = " and ".join(f"a.{c} = b.{c}" for c in ["root", *ck.split(", ")])
    both = ", ".join(f"coalesce(a.{c}, b.{c}) as {c}" for c in ["root", *ck.split(", ")])
    compare = two + f""", a as (select root, {ck}, count(*) as n, list_sort(list({{{st}}})) as r, {lists} from sa group by all),
b as (select root, {ck}, count(*) as n, list_sort(list({{{st}}})) as r, {lists} from sb group by all)
select {both},
  case when a.n is null then 'Added' when b.n is null then 'Removed'
       when a.r is distinct from b.r then 'Changed' else 'Identical' end as status,
  case when a.n is null or b.n is null then '' else concat_ws(', ', {diffs}) end as changed_columns,
  coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b
from a full join b on {on}"""

    # folder diagnosis (token parser) shared by D3, D4, D10
    fd = """select root, client_folder, case_folder,
  count(file_name) filter (where lower(file_name) <> 'desktop.ini') as n_files
from cf where case_folder is not null group by all"""
    dg = O.token_case(O.token_client(fd))
    diag = cf_ctes.replace(",\n", ",\n", 1) + f"dg as ({dg})\n"
    summary = diag + """, pk as (select client_number, case_no, tm_no, class_code, count(*) as n,
  count(*) filter (where case_no <> '' and tm_no <> '' and class_code <> '') as ok,
  count(*) filter (where case_no = '') as failures,
  count(*) filter (where case_no <> '' and (tm_no = '' or class_code = '')) as warnings,
  count(*) filter (where n_files = 0) as empty,
  count(*) filter (where tm_no = '') as missing_tm,
  count(*) filter (where class_code = '') as missing_class,
  count(*) filter (where case_no = '') as missing_case_no
  from dg group by all),
t as (select cast(sum(n) as bigint) as cases, cast(sum(ok) as bigint) as ok,
  cast(sum(failures) as bigint) as failures, cast(sum(warnings) as bigint) as warnings,
  cast(sum(empty) as bigint) as empty, cast(sum(missing_tm) as bigint) as missing_tm,
  cast(sum(missing_class) as bigint) as missing_class,
  cast(sum(missing_case_no) as bigint) as missing_case_no,
  cast(sum(n - 1) as bigint) as duplicates from pk)
select *, round(100.0 * ok / cases, 1) as ok_pct, round(100.0 * failures / cases, 1) as failures_pct,
  round(100.0 * warnings / cases, 1) as warnings_pct, round(100.0 * missing_tm / cases, 1) as missing_tm_pct,
  round(100.0 * missing_class / cases, 1) as missing_class_pct,
  round(100.0 * missing_case_no / cases, 1) as missing_case_no_pct
from t"""
    sig = f"""select array_to_string(list_transform(range(1, len(_t) + 1), lambda i:
    '[' || case when _ty[i] = 'WORD' and _t[i] = upper(_t[i]) then 'UPPER' else _ty[i] end || ']'), ' ') as signature,
  case_folder
from ({O.typed("select * from dg where case_no = ''", 'case_folder')}) s"""
    signatures = diag + f"""select signature, count(*) as folders, min(case_folder) as example
from ({sig}) x group by signature order by folders desc, signature limit {TOP_K}"""
    cols10 = "root, client_folder, case_folder as folder_name, case_no, case_name, tm_no, class_code"
    warn = diag + f"""select {cols10}, unnest(list_filter([case when tm_no = '' then '{N.TM_WARNING}' end,
  case when class_code = '' then '{N.CLASS_WARNING}' end], lambda m: m is not null)) as message
from dg where case_no <> '' and (tm_no = '' or class_code = '')"""
    fail = diag + f"select {cols10}, '{N.CASE_ISSUE}' as message from dg where case_no = ''"

    # D5
    folders = "select distinct root, client_folder, case_folder from cf where case_folder is not null"
    lg = f"""select root, client_folder, case_folder, case_no as legacy_case_no, case_name as legacy_case_name,
  tm_no as legacy_tm_no, class_code as legacy_class_code from ({O.legacy_case(folders)}) l"""
    ntm = "len(list_filter(" + O.tokens("case_folder") + ", lambda x: regexp_full_match(x, '\\d{6}')))"
    fields = ["case_no", "case_name", "tm_no", "class_code"]
    regression = " or ".join(f"(legacy_{f} <> '' and {f} = '')" for f in fields)
    same = " and ".join(f"legacy_{f} = {f}" for f in fields)
    parsers = cf_ctes.rstrip(",\n") + f"""
select bucket, count(*) as folders from (
  select case when {regression} then 'regression' when {ntm} >= 2 then 'ambiguous'
    when legacy_case_no = '' and case_no <> '' then 'case_no_recovered'
    when legacy_case_name <> case_name then 'case_name_fixed'
    when {same} then 'identical' else 'other' end as bucket
  from ({O.token_case(lg)}) t) b group by bucket"""

    # D6-D9 (inventory over the listing)
    tree = O.with_tree
    inv_clients = tree(O.token_client(
        "select root, client_id, client_folder, parent_id, created_time, modified_time from cl"))
    case_src = """select root, case_id, client_id, case_folder, case_created_time as created_time,
  case_modified_time as modified_time from ca"""
    ctype = f"""case when regexp_matches(case_folder, '(?i)\\b(OPPO|RECTIFICATION|DISPUTE)\\b') or {ntm} >= 2
    then '{R.CASE_TYPES[3]}' when regexp_matches(case_folder, '(?i)\\bNTN\\b') then '{R.CASE_TYPES[2]}'
    when {ntm} = 0 then '{R.CASE_TYPES[1]}' else '{R.CASE_TYPES[0]}' end"""
    cases_sql = f"select *, {ctype} as case_type from ({O.token_case(case_src)}) c"
    files_sql = f"""select f.root, f.id as file_id, f.parent_id as case_id, f.name as file_name,
  case when contains(f.name, '.') then lower(string_split(f.name, '.')[-1]) else '' end as extension,
  f.mime_type, f.size,
  case when f.source = 'drive' and f.id <> '' then '{O.URL_PREFIX}' || f.id || '/view' else '' end as url,
  f.created_time, f.modified_time
from fi f join ca on f.root = ca.root and f.parent_id = ca.case_id"""
    metrics = [("total_cases", "cast(total_cases as double)", "''"),
               ("missing_tm", "cast(mt as double)", "''"),
               ("missing_tm_pct", "round(100.0 * mt / total_cases, 1)", "''"),
               ("missing_class", "cast(mc as double)", "''"),
               ("missing_class_pct", "round(100.0 * mc / total_cases, 1)", "''"),
               ("empty_cases", "cast(ec as double)", "''"),
               ("largest_case_files", "cast(lg['n_files'] as double)", "lg['case_folder']"),
               ("avg_files_per_case", "round(tf / total_cases, 2)", "''")]
    metrics += [(f"case_type:{t}", f"cast(t{i} as double)", "''") for i, t in enumerate(R.CASE_TYPES)]
    rows = "\nunion all ".join(f"select '{m}' as metric, {v} as value, {d} as detail from agg"
                               for m, v, d in metrics)
    report = tree(f""", cs as ({cases_sql}), fs as ({files_sql}),
pc as (select root, case_id, count(*) as n_files from fs group by all),
c as (select cs.*, coalesce(pc.n_files, 0) as n_files from cs left join pc using (root, case_id)),
agg as (select count(*) as total_cases, sum(n_files) as tf,
  count(*) filter (where tm_no = '') as mt, count(*) filter (where class_code = '') as mc,
  count(*) filter (where n_files = 0) as ec,
  max({{'n_files': n_files, 'case_folder': case_folder}}) as lg,
  {", ".join(f"count(*) filter (where case_type = '{t}') as t{i}" for i, t in enumerate(R.CASE_TYPES))}
  from c)
{rows}
union all select 'total_clients', cast(count(*) as double), '' from cl
union all select 'total_files', cast(count(*) as double), '' from fs""")
    dup_tm = tree(f""", cs as ({cases_sql})
select cs.tm_no, d.folders, cs.root, cs.client_id, cs.case_folder from cs
join (select tm_no, count(*) as folders from cs where tm_no <> '' group by tm_no having count(*) > 1) d
  using (tm_no)""")

    # export, upsert
    hdr = {"client_number": "CLIENT NUMBER", "client_name": "CLIENT NAME", "case_no": "CASE #",
           "case_name": "CASE NAME", "tm_no": "TM NO", "class_code": "CLASS", "files": "FILES",
           "ext": "EXT"}
    base_hdr = ", ".join(f'{k} as "{v}"' for k, v in hdr.items())
    export = two + f'select {base_hdr}, {flags}, date_added as "DATE ADDED" from sa'
    quick = two + f'select {base_hdr}, date_added as "DATE ADDED" from sa'
    order_desc = ", ".join(f"{c} desc" for c in ORDER)
    i_cols = ["root", *KEY, "files", "ext", *O.RULE_NAMES]
    icl = ", ".join(f'i."{c}"' for c in i_cols)
    ecl = ", ".join(f'"{c}"' for c in i_cols)
    upsert = two + f""", e as (select *, trim(case_no) as _k, case when trim(case_no) <> '' then
    row_number() over (partition by trim(case_no) order by {order_desc}) end as _rn from sa),
i0 as (select *, trim(case_no) as _k from sb),
el as (select * from e where _k <> '' and _rn = 1),
im as (select * from i0 where _k in (select _k from el)),
il as (select * from (select *, row_number() over (partition by _k order by {order_desc}) as _rn from im) x
       where _rn = 1)
select {ecl}, date_added, updated_on, 'untouched' as upsert_status from e
where not (coalesce(_rn, 0) = 1 and _k in (select _k from il))
union all
select {icl}, el.date_added, el.updated_on, 'updated' from il i join el using (_k)
union all
select {ecl}, date_added, cast(null as varchar), 'appended' from i0 where _k not in (select _k from el)"""
    run_desc = ", ".join(f"{c} desc" for c in ["client_number", "case_no", "client_name", "case_name", "tm_no",
                                               "class_code", "root"])
    counts = two + """select count(*) filter (where _k in (select trim(case_no) from sa where trim(case_no) <> '')) as updated,
  count(*) filter (where _k not in (select trim(case_no) from sa where trim(case_no) <> '')) as appended
from (select trim(case_no) as _k from sb) i"""
    csv_trip = two + "select root, " + key + ", files, ext, " + ", ".join(
        f'case when "{n}" then \'True\' else \'False\' end as "{n}"' for n in O.RULE_NAMES) \
        + ", date_added, updated_on from sa"
    whole_run = f"""{listing},
hcf as ({O.hierarchy('strict')}),
hkf as ({O.kept_files('hcf')})
select root, {key}, files, ext, {O.flag_columns()}
from (select *, replace(files, chr(10), ' ') as _txt from ({O.records('strict', 'legacy', 'hcf', 'hkf')}) r0) r1"""
    first10 = O.RULE_NAMES[:10]
    rest = O.RULE_NAMES[10:]
    evolve = two + (f"select root, {key}, files, ext, " + ", ".join(f'"{c}"' for c in first10) + ", "
                    + ", ".join(f'cast(null as boolean) as "{c}"' for c in rest) + " from sa")
    return {
        "not_trashed": f"{listing}\nselect root, id, name, parent_id, path, is_folder, mime_type, size, created_time, modified_time, trashed from nt",
        "file_parts": f"""{listing}
select id, name, {O.stem('name')} as stem, {O.ext('name')} as ext,
  case when contains(name, '.') then lower(string_split(name, '.')[-1]) else '' end as extension,
  case when source = 'drive' and id <> '' then '{O.URL_PREFIX}' || id || '/view' else '' end as url,
  lower(name) = 'desktop.ini' as is_noise, size, created_time, modified_time
from nt where not is_folder""",
        "scan_roots": f"{listing}\nselect root, id, name, parent_id, path, is_folder, size from lst",
        "hierarchy_deep": f"{listing}\n{O.hierarchy('deep')}",
        "hierarchy_strict": f"{listing}\n{O.hierarchy('strict')}",
        "hierarchy_token": f"{listing}\n{O.hierarchy('token')}",
        "hierarchy_parent": O.with_tree(O.PARENT_TREE),
        "listing_scan_strict": lscan("strict", "legacy"),
        "listing_scan_deep": lscan("deep", "legacy"),
        "listing_scan_token": lscan("token", "token"),
        "first_clients": cf_ctes.rstrip(",\n") + f"""
select cf.* from cf join (select root, client_folder from (
  select root, client_folder, row_number() over (partition by root order by client_folder) as rn
  from (select distinct root, client_folder from cf where client_folder is not null) d) r
  where rn <= {FIRST_CLIENTS_N}) k using (root, client_folder)""",
        "compare_exports": compare,
        "duplicate_keys": two + f"select {ck}, count(*) as occurrences from sa group by all having count(*) > 1",
        "validation_summary": summary,
        "naming_signatures": signatures,
        "compare_parsers": parsers,
        "warnings_table": warn,
        "failures_table": fail,
        "inventory_clients": inv_clients,
        "inventory_cases": tree(cases_sql),
        "inventory_files": tree(files_sql),
        "inventory_report": report,
        "duplicate_tm": dup_tm,
        "export_projection": export,
        "quick_export": quick,
        "sort_records": two + "select * from sa",
        "row_positions": two + f"""select root, {key}, files,
  row_number() over (order by {', '.join(RUN_ORDER)}) + {FIRST_ROW - 1} as row from sa""",
        "csv_round_trip": csv_trip,
        "csv_lines_round_trip": csv_trip,
        "classify_entries": f"""{listing}
select root, id, name, parent_id, path, is_folder, mime_type,
  case when is_folder or size % 7000 = 0 then null else size end as size,
  created_time, modified_time, trashed, 'drive' as source from lst""",
        "upsert_cases": upsert,
        "upsert_partial": f"select * exclude (upsert_status) from ({upsert}) u",
        "incremental_run": f"with pcf as materialized ({fixture.PILED_SQL}),\npkf as ({O.kept_files('pcf')})\n"
        + O.records("strict", "legacy", "pcf", "pkf"),
        "row_diff": two + O.row_diff("sa", "sb", ["root", *ck.split(", ")], DIFF_COLS),
        "upsert_run": upsert.replace(order_desc, run_desc),
        "export_run": two + f"select {base_hdr}, " + ", ".join(
            f'case when "{n}" then \'True\' else \'False\' end as "{n}"' for n in O.RULE_NAMES)
        + ', date_added as "DATE ADDED" from sa',
        "listing_run": whole_run,
        "parent_listing_run": whole_run,
        "paths_from_parents": O.paths(f"select root, id, name, parent_id, is_folder from ({fixture.LISTING_SQL}) where not trashed"),
        "paths_of_chains": O.paths(fixture.CHAINS_SQL),
        "first_listed_clients": f"""{listing}
select root, id, path, is_folder from nt join (select root, path as client from (
  select root, path, row_number() over (partition by root order by path) as rn
  from nt where is_folder and len(parts) = 1) c where rn <= {FIRST_CLIENTS_N}) k using (root)
where parts[1] = client""",
        "upsert_counts": counts,
        "evolve_schema": evolve,
    }


def oracle_sql() -> dict[str, str]:
    out = _oracle()
    out.update(_oracle_more())
    out.update(_training_data()[1])
    return out
