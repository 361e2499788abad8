"""A1-A5: group the entries of case folders into one record per case key.

Plan (two aggregations, both with map-side partial aggregation):

1. ``folder_entries``: one row per raw folder ``(root, client_folder,
   case_folder)`` with the joined text of its kept files in path order.
   Parsing then runs once per folder, not once per file.
2. ``group_cases``: one row per ``(root, 6-column key)``. Folder texts are
   concatenated in folder-path order, which equals file-path order because
   every path of a folder starts with ``folder path + "/"``. This stage moves
   one short text per folder, so a key that merges a very large number of
   folders (unparsable names, root files) carries no per-file overhead; its
   record text is the only per-group state, and it is the output value.

Hot folders and keys are found while the rows are stored: a mergeable sketch of the
most frequent folders and clients is taken in that same scan (``measured``). Folders
beyond HOT_FILES rows, and keys beyond HOT_FOLDERS folders, go through
``ordered_concat``, which spreads each over tasks; all others through one hash
aggregation. The choice only moves work: records are the same either way, and a task
that runs again finds the same keys in its plan.

Modes: ``strict`` (every case folder is a record, empty ones too; any child
name counts as a file), ``deep`` (only folders with at least one kept file;
files at root or client level get placeholder keys) and ``token`` (as strict
but only real files, token parser).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import files as FF
from ..functions import names as N
from ..schema import KEY
from ..session import materialize
from .parse import parse_cases, parse_clients

MODES = ("strict", "deep", "token")


FOLDER = ["root", "client_folder", "case_folder"]
#: Rows of a folder, and folders of a key, beyond which it is spread over tasks.
HOT_FILES, HOT_FOLDERS = 250_000, 100_000
#: Frequent keys a sketch reports, and items it tracks: a key is missed only if it
#: holds fewer than about one in 7500 of all rows.
TOP_KEYS, TRACKED = 1000, 10_000
#: Rows of a run of a spread key: what one task joins at most (about).
RUN_ROWS = 100_000
#: Codec of stored rows that hold names or texts: they are most of what is written.
DENSE = "zstd"


def _folder_path() -> Column:
    return F.concat(F.coalesce("client_folder", F.lit("")), F.lit("/"),
                    F.coalesce("case_folder", F.lit("")), F.lit("/")).alias("folder_path")


def _joined(arr: Column, field: str) -> Column:
    # no lambdas, which are interpreted; array_join passes over nulls
    return F.array_join(F.array_remove(arr.getField(field), ""), "\n")


def _led(keys: list[str]) -> list[Column | str]:
    """Grouping columns of ``keys``, led by their hash. Spark sorts rows whose lists it
    collects by these columns, and one number settles nearly every comparison; the names
    alone agree in long beginnings. 32 bits are enough, and less is shuffled."""
    return [F.hash(*keys).alias("_lead_hash"), *keys]


def ordered_runs(df: DataFrame, keys: list[str], order_col: str, texts: list[str],
                 sums: list[str] = (), parts: int | None = None) -> DataFrame:
    """The runs that ``ordered_concat`` joins: keys, ``_run`` (ascending in row order),
    ``_n`` rows, ``_first``, the joined texts, and ``_s_*`` sums."""
    # stored: dealing rows to ranges reads them twice
    rows = materialize(df.select(*keys, order_col, *texts, *sums), DENSE)
    if parts is None:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RUN_ROWS))
    rows = rows.withColumn("_place", F.col("_metadata.row_index"))
    ranged = rows.repartitionByRange(parts, *keys, order_col, *texts, "_place")
    runs = ranged.groupBy(*_led(keys), F.spark_partition_id().alias("_run")).agg(
        F.sort_array(F.collect_list(F.struct(order_col, *texts))).alias("_items"), F.count("*").alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in sums])
    return runs.select(*keys, "_run", "_n", F.array_min(F.col("_items").getField(order_col)).alias("_first"),
                       *[f"_s_{c}" for c in sums], *[_joined(F.col("_items"), t).alias(t) for t in texts])


def ordered_concat(df: DataFrame, keys: list[str], order_col: str, texts: list[str],
                   sums: list[str] = (), parts: int | None = None) -> DataFrame:
    """Per key: ``\n``-join of each non-empty text column in ``order_col``
    order, plus ``n_rows``, ``first`` (smallest ``order_col``) and sums.

    Splits hot keys without losing order: rows are range-partitioned on
    (keys, order_col, texts), so a key holding a large share of all rows spans
    several partitions; each partition joins its run of rows, and the runs
    are joined in partition order, which is the row order. Equal rows are told
    apart by their place in the stored file, so that every row has a place of its
    own, which a task that runs again finds again. No task holds more than one partition's rows of a
    key until the final join of run texts, which is the output value itself.
    """
    runs = ordered_runs(df, keys, order_col, texts, sums, parts)
    out = runs.groupBy(*_led(keys)).agg(
        F.sort_array(F.collect_list(F.struct("_run", *texts))).alias("_runs"),
        F.sum("_n").alias("n_rows"), F.min("_first").alias("first"),
        *[F.sum(f"_s_{c}").alias(c) for c in sums])
    return out.select(*keys, *[_joined(F.col("_runs"), t).alias(t) for t in texts],
                      "n_rows", "first", *sums)


# ------------------------------------------------------------ hot keys --

def _key_text(keys: list[str]) -> Column:
    """One text a key, nulls apart from all texts."""
    return F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")) for k in keys])


def _key_hash(keys: list[str]) -> Column:
    """64-bit hash of a key, nulls apart from empty texts: sketches count these, since
    texts of every row cost far more."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())])


def measured(df: DataFrame, keys: list[str], hot: int, **more: list[str]) -> tuple[DataFrame, list[str], dict[str, int]]:
    """``df`` stored, the key texts with more than about ``hot`` rows, and for each
    key list of ``more`` the most rows any of its keys has: read off sketches that
    each task fills while it writes its rows."""
    seen = Observation()
    texts = {"_key": keys, **more}
    wide = df.select("*", *[_key_hash(k).alias(f"_text_{n}") for n, k in texts.items()])
    wide = wide.observe(seen, *[F.expr(f"approx_top_k(`_text_{n}`, {TOP_KEYS}, {TRACKED})").alias(n) for n in texts])
    stored = materialize(wide.select(*df.columns), DENSE)
    got = {n: [(r["item"], r["count"]) for r in seen.get[n] or []] for n in texts}
    hashes = [item for item, many in got["_key"] if many > hot]
    # at most TOP_KEYS texts (two keys of one hash are both spread, and stay two keys)
    heavy = sorted(r[0] for r in stored.where(_key_hash(keys).isin(hashes)).select(_key_text(keys)).distinct().collect()) \
        if hashes else []
    return stored, heavy, {n: max((many for _, many in got[n]), default=0) for n in more}


def _crowded(counts: DataFrame, hot_folders: int) -> bool:
    """Whether a client has more than ``hot_folders`` folders."""
    clients = counts.groupBy("root", "client_folder").agg(F.count("*").alias("folders"))
    return not clients.where(F.col("folders") > hot_folders).isEmpty()


def _in_folders(left: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows of ``left`` whose folder is in ``folders``, nulls equal: joined by one
    number, the names are compared where it agrees. It is the number that leads groups
    of entries, so joined rows lie as their grouping needs them."""
    right = folders.select(F.hash(*FOLDER).alias("_same"), *[F.col(c).alias(f"_of_{c}") for c in FOLDER])
    equal = sum((F.col(c).eqNullSafe(F.col(f"_of_{c}")).cast("int") for c in FOLDER), F.lit(0)) == len(FOLDER)
    return left.join(right, (F.hash(*FOLDER) == F.col("_same")) & equal, "left_semi")


def _counted_folders(case_files: DataFrame, counts: DataFrame, hot: int, mode: str, only: bool) -> DataFrame:
    """``_folders`` of one walk where ``counts`` tells the heavy folders; entries aren't
    stored. With ``only``, other folders than those of ``counts`` are left out: heavy
    ones, found by name, take no part in that join, so that none gathers in a task."""
    heavy = sorted(r[0] for r in counts.where(F.col("n") > hot).select(_key_text(FOLDER)).collect())
    many, few = _split(case_files, FOLDER, heavy)
    few = few if heavy else case_files
    folders = _hash_folders(entry_rows(_in_folders(few, counts) if only else few, mode), _ONE_WALK)
    if not heavy:
        return folders
    return folders.withColumns(_one_run()).unionByName(_folder_runs(entry_rows(many, mode), _ONE_WALK))


def _split(df: DataFrame, keys: list[str], heavy: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of heavy keys, all other rows)."""
    is_heavy = _key_text(keys).isin(heavy)
    return df.where(is_heavy), df.where(~is_heavy)


# ------------------------------------------------------------- stage 1 --

def entry_rows(case_files: DataFrame, mode: str = "strict") -> DataFrame:
    """What stage 1 needs of each entry: folder, path inside the folder, stem,
    extension, and 1 or 0 for whether the walk keeps it (``kept``) and whether it is
    a kept file (``kept_file``). Inside a folder the path behind the folder's own
    sorts as the whole one does, so only that travels."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    cf, name, path = case_files, F.col("file_name"), F.col("file_path")
    is_dir = F.coalesce(F.col("entry_is_folder"), F.lit(False)) if "entry_is_folder" in cf.columns else F.lit(False)
    kept = name.isNotNull() & ~FF.is_noise_file(name)
    if mode == "deep":
        # Missing levels may be null or "": both mean "no client / no case"
        kept = kept & ~is_dir
        cf = cf.where(kept)
    else:
        cf = cf.where(F.col("case_folder").isNotNull())
        kept = kept & ~is_dir if mode == "token" else kept
    level = [F.when(F.col(c) != "", F.concat(F.col(c), F.lit("/"))) for c in ("client_folder", "case_folder")]
    # columns of their own, so that each is computed once for all that read it
    cf = cf.withColumns({"_kept": F.coalesce(kept, F.lit(False)), "_raw_ext": FF.raw_ext(name),
                         "_above": F.concat(*[F.coalesce(x, F.lit("")) for x in level])})
    kept, raw, above = F.col("_kept"), F.col("_raw_ext"), F.col("_above")
    inside = F.when(path.startswith(above), F.substring(path, F.length(above) + 1, F.lit(1 << 30))).otherwise(path)
    return cf.select(*FOLDER, F.when(kept, inside).alias("path"), F.when(kept, FF.stem_before(name, raw)).alias("stem"),
                     F.when(kept, FF.ext_of(raw)).alias("ext"), kept.cast("long").alias("kept"),
                     (kept & ~is_dir).cast("long").alias("kept_file"))


def _hash_folders(rows: DataFrame, walks: dict[str, str]) -> DataFrame:
    """One aggregation by folder. ``walks``: suffix of the output columns and the
    column that says which entries the walk keeps."""
    entry = F.struct("path", "stem", "ext", *(["kept_file"] if set(walks.values()) != {"kept"} else []))
    grouped = rows.groupBy(*_led(FOLDER)).agg(
        F.sort_array(F.collect_list(F.when(F.col("kept") > 0, entry))).alias("_files"),
        *[F.sum(flag).alias(f"n_files{suffix}") for suffix, flag in walks.items()])
    out = []
    for suffix, flag in walks.items():
        files = F.col("_files") if flag == "kept" else F.filter("_files", lambda e: e["kept_file"] > 0)
        out += [_joined(files, "stem").alias(f"files_text{suffix}"), _joined(files, "ext").alias(f"ext_text{suffix}"),
                f"n_files{suffix}"]
    return grouped.select(*FOLDER, _folder_path(), *out)


def _folder_runs(rows: DataFrame, walks: dict[str, str]) -> DataFrame:
    """The same with each folder spread over tasks: a row a run of its files, ``_run``
    in path order, ``_lead`` 1 for one run of each folder. No row holds a whole
    folder's text."""
    texts, sums = [], []
    for suffix, flag in walks.items():
        for name in ("stem", "ext"):
            rows = rows.withColumn(f"{name}{suffix}_", F.when(F.col(flag) > 0, F.col(name)))
            texts.append(f"{name}{suffix}_")
        rows = rows.withColumn(f"n_files{suffix}", F.col(flag))
        sums.append(f"n_files{suffix}")
    runs = materialize(ordered_runs(rows, FOLDER, "path", texts, sums).drop("_n", "_first"), DENSE)
    # ranges hold folders in order: what goes on in a range is its first folder, if that
    # is the last one of the range before. One row a range is collected
    ends = runs.groupBy("_run").agg(F.min(F.struct(*FOLDER)).alias("_low"), F.max(F.struct(*FOLDER)).alias("_high"))
    ends = sorted(tuple(r) for r in ends.select("_run", *[_key_text([f"{x}.{c}" for c in FOLDER]) for x in ("_low", "_high")]).collect())
    later = [f"{run}\x00{low}" for (_, _, high), (run, low, _) in zip(ends, ends[1:]) if low == high]
    lead = ~F.concat_ws("\x00", F.col("_run").cast("string"), _key_text(FOLDER)).isin(later)
    return runs.select(*FOLDER, _folder_path(), *[x for suffix in walks for x in (
        F.col(f"stem{suffix}_").alias(f"files_text{suffix}"), F.col(f"ext{suffix}_").alias(f"ext_text{suffix}"),
        F.col(f"_s_n_files{suffix}").alias(f"n_files{suffix}"))],
        "_run", lead.cast("long").alias("_lead"))


def _ordered_folders(rows: DataFrame, walks: dict[str, str]) -> DataFrame:
    """``_folder_runs`` joined to one row a folder."""
    runs = _folder_runs(rows, walks)
    texts = [c for c in runs.columns if c.startswith(("files_text", "ext_text"))]
    sums = [c for c in runs.columns if c.startswith("n_files")]
    out = runs.groupBy(*_led([*FOLDER, "folder_path"])).agg(
        F.sort_array(F.collect_list(F.struct("_run", *texts))).alias("_runs"), *[F.sum(c).alias(c) for c in sums])
    return out.select(*FOLDER, "folder_path", *[_joined(F.col("_runs"), c).alias(c) if c in texts else F.col(c)
                                                for c in runs.columns if c in texts or c in sums])


def _folders(rows: DataFrame, walks: dict[str, str], heavy: list[str], runs: bool = False) -> DataFrame:
    """Heavy folders spread, the others by one aggregation. ``runs``: the heavy ones
    stay in runs, for ``group_folders`` to join."""
    if not heavy:
        return _hash_folders(rows, walks)
    hot, cold = _split(rows, FOLDER, heavy)
    if not runs:
        return _hash_folders(cold, walks).unionByName(_ordered_folders(hot, walks))
    return _hash_folders(cold, walks).withColumns(_one_run()).unionByName(_folder_runs(hot, walks))


def _one_run() -> dict[str, Column]:
    """Columns of a folder that is not spread."""
    return {"_run": F.lit(0), "_lead": F.lit(1).cast("long")}


_ONE_WALK = {"": "kept"}
_BOTH_WALKS = {"_strict": "kept", "_token": "kept_file"}


def folder_entries(case_files: DataFrame, mode: str = "strict", split_hot: bool | None = False) -> DataFrame:
    """Stage 1: one row per raw case folder.

    Columns: root, client_folder, case_folder, folder_path, files_text and
    ext_text (non-empty stems / extensions of the kept files in path order,
    ``\n``-joined), n_files (kept files). The per-file structs live only
    inside this aggregation; stage 2 moves one short text per folder.
    ``split_hot``: True spreads every folder over tasks, None those that are
    found heavy while the entries are stored, False none.
    """
    rows = entry_rows(case_files, mode)
    if split_hot:
        return _ordered_folders(rows, _ONE_WALK)
    heavy = []
    if split_hot is None:
        rows, heavy, _ = measured(rows, FOLDER, HOT_FILES)
    return _folders(rows, _ONE_WALK, heavy)


def folder_entries_both(case_files: DataFrame, hot_files: int | None = None, runs: bool = False) -> DataFrame:
    """Stage 1 once for the strict and the token walk (same folder set; the
    token walk only drops sub-folder entries). Columns as ``folder_entries``
    with ``_strict`` and ``_token`` variants of files_text, ext_text, n_files.
    Entries are stored first if ``hot_files`` is given, and folders with more
    of them are spread, and left in runs for ``group_folders`` to join if ``runs``.
    """
    rows, heavy = entry_rows(case_files, "strict"), []
    if hot_files is not None:
        rows, heavy, _ = measured(rows, FOLDER, hot_files)
    return _folders(rows, _BOTH_WALKS, heavy, runs)


def pick_walk(folders: DataFrame, walk: str) -> DataFrame:
    """The ``strict`` or ``token`` columns of ``folder_entries_both`` under
    the names ``folder_entries`` uses."""
    return folders.select("root", "client_folder", "case_folder", "folder_path",
                          F.col(f"files_text_{walk}").alias("files_text"),
                          F.col(f"ext_text_{walk}").alias("ext_text"),
                          F.col(f"n_files_{walk}").alias("n_files"),
                          *[c for c in ("_run", "_lead") if c in folders.columns])


def parse_folders(folders: DataFrame, parser: str = "legacy", mode: str = "strict") -> DataFrame:
    """Add the 6 key columns to folder rows (deep mode placeholders included)."""
    out = parse_cases(parse_clients(folders, parser), parser)
    if mode == "deep":
        no_client = F.coalesce(F.col("client_folder"), F.lit("")) == ""
        no_case = F.coalesce(F.col("case_folder"), F.lit("")) == ""
        out = out.select(
            *[c for c in out.columns if c not in KEY],
            F.when(no_client, F.lit("")).otherwise(F.col("client_number")).alias("client_number"),
            F.when(no_client, F.lit(N.ROOT_CLIENT_NAME)).otherwise(F.col("client_name")).alias("client_name"),
            F.when(no_case, F.lit("")).otherwise(F.col("case_no")).alias("case_no"),
            F.when(no_case, F.lit(N.NO_CASE_NAME)).otherwise(F.col("case_name")).alias("case_name"),
            F.when(no_case, F.lit("")).otherwise(F.col("tm_no")).alias("tm_no"),
            F.when(no_case, F.lit("")).otherwise(F.col("class_code")).alias("class_code"),
        )
    return out


def _limit_per_root(df: DataFrame, order: str, n: int) -> DataFrame:
    """First n rows per root by ``order``; row_number <= n is planned as a
    per-partition group limit before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy("root").orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def limit_groups(case_files: DataFrame, n: int, mode: str = "strict",
                 parser: str | None = None) -> DataFrame:
    """A4: keep only the entries of the first ``n`` groups per root, in path
    order (token mode: the first ``n`` folders, as its walker counts
    folders). Chosen from folder names alone, before any file is
    aggregated: distinct folders -> parse -> first path per key -> top n per
    root -> left-semi joins down to the kept folders' entries."""
    parser = parser or ("token" if mode == "token" else "legacy")
    folder_key = ["root", "client_folder", "case_folder"]
    if mode == "deep":
        kept = F.col("file_name").isNotNull() & ~FF.is_noise_file(F.col("file_name"))
        if "entry_is_folder" in case_files.columns:
            kept = kept & ~F.coalesce(F.col("entry_is_folder"), F.lit(False))
        folders = case_files.where(kept).select(*folder_key).distinct()
    else:
        folders = case_files.where(F.col("case_folder").isNotNull()).select(*folder_key).distinct()
    folders = folders.select(*folder_key, _folder_path())
    if mode == "token":
        keep = _limit_per_root(folders, "folder_path", n)
    else:
        keys = parse_folders(folders, parser, mode)
        firsts = keys.groupBy("root", *KEY).agg(F.min("folder_path").alias("first_path"))
        top = _limit_per_root(firsts, "first_path", n)
        keep = keys.join(top.select("root", *KEY), ["root", *KEY], "left_semi")
    return case_files.join(keep.select(*folder_key), folder_key, "left_semi")


def group_cases(case_files: DataFrame, mode: str = "strict", parser: str | None = None,
                limit: int | None = None, keep_raw_folder: bool = False,
                split_hot: bool | None = None, hot_files: int = HOT_FILES,
                hot_folders: int = HOT_FOLDERS, counts: DataFrame | None = None,
                only_counted: bool = False) -> DataFrame:
    """A1/A2 (+A3, A4): one record per (root, client_number, client_name,
    case_no, case_name, tm_no, class_code).

    Output columns: root, the 6 key columns, files, ext (``\\n``-joined
    non-empty stems / extensions in path order), n_folders, n_files,
    first_path. ``limit`` keeps the first n groups per root in path order
    (token mode: the first n folders, as its walker counts folders).
    ``keep_raw_folder`` adds the raw folder path to the key, so unparsable
    folders of one client stay separate records (the documented intent)
    instead of merging (the actual behaviour, default). ``split_hot``: by default
    (None) folders and keys that hold very many rows are found while the entries
    are stored, and only they are spread over tasks; True spreads all, False none
    (one lazy plan). ``counts``, a row a folder with the number of its entries ``n``,
    tells the heavy ones where it is known: the entries aren't stored then. With
    ``only_counted`` other folders are left out.
    """
    parser = parser or ("token" if mode == "token" else "legacy")
    if counts is not None and (limit or split_hot is not None):
        case_files, counts = _in_folders(case_files, counts) if only_counted else case_files, None
    if limit:
        case_files = limit_groups(case_files, limit, mode, parser)
    # a key lies within one client: without a client of many entries, or folders, there
    # is no key of many folders to look for
    if counts is not None:
        folders = _counted_folders(case_files, counts, hot_files, mode, only_counted)
        return group_folders(folders, mode, parser, keep_raw_folder, None if _crowded(counts, hot_folders) else False,
                             hot_folders)
    rows = entry_rows(case_files, mode)
    if split_hot is not None:
        folders = _folder_runs(rows, _ONE_WALK) if split_hot else _hash_folders(rows, _ONE_WALK)
        return group_folders(folders, mode, parser, keep_raw_folder, split_hot)
    rows, heavy, most = measured(rows, FOLDER, hot_files, client=["root", "client_folder"])
    crowded = most["client"] > hot_folders
    return group_folders(_folders(rows, _ONE_WALK, heavy, runs=True), mode, parser, keep_raw_folder,
                         None if crowded else False, hot_folders)


def group_folders(folders: DataFrame, mode: str = "strict", parser: str | None = None,
                  keep_raw_folder: bool = False, split_hot: bool | None = False,
                  hot_folders: int = HOT_FOLDERS) -> DataFrame:
    """Stage 2 of ``group_cases`` on folder rows (``folder_entries`` or
    ``pick_walk(folder_entries_both(..))``), or on runs of them: the texts of a folder
    in runs meet in its record only."""
    parser = parser or ("token" if mode == "token" else "legacy")
    key = ["root", *KEY, *(["folder_path"] if keep_raw_folder else [])]
    if "_run" not in folders.columns:
        folders = folders.withColumns(_one_run())
    parsed = parse_folders(folders, parser, mode).select(
        "root", *KEY, "folder_path", "_run", "files_text", "ext_text", "n_files", "_lead")
    if split_hot:
        return _ordered_records(parsed, key)
    if split_hot is None:
        parsed, heavy, _ = measured(parsed, key, hot_folders)
        if heavy:
            hot, cold = _split(parsed, key, heavy)
            return _hash_records(cold, key).unionByName(_ordered_records(hot, key))
    return _hash_records(parsed, key)


def _ordered_records(parsed: DataFrame, key: list[str]) -> DataFrame:
    # a key's folders can't be told apart by a column of the key
    parsed = parsed.withColumn("_order", F.struct("folder_path", "_run"))
    out = ordered_concat(parsed, key, "_order", ["files_text", "ext_text"], ["n_files", "_lead"])
    return out.select("root", *KEY, F.col("files_text").alias("files"), F.col("ext_text").alias("ext"),
                      F.col("_lead").alias("n_folders"), "n_files", F.col("first.folder_path").alias("first_path"))


def _hash_records(parsed: DataFrame, key: list[str]) -> DataFrame:
    grouped = parsed.groupBy(*_led(key)).agg(
        F.sort_array(F.collect_list(F.struct("folder_path", "_run", "files_text", "ext_text"))).alias("_parts"),
        F.sum("_lead").alias("n_folders"),
        F.sum("n_files").alias("n_files"))
    # Folder texts in folder-path order = file-path order (every path of a
    # folder starts with its folder path + "/").
    return grouped.select(
        "root", *KEY,
        _joined(F.col("_parts"), "files_text").alias("files"),
        _joined(F.col("_parts"), "ext_text").alias("ext"),
        "n_folders", "n_files", F.get("_parts", 0)["folder_path"].alias("first_path"))


def record_counts(records: DataFrame) -> DataFrame:
    """A5: number of records per root."""
    return records.groupBy("root").agg(F.count("*").alias("records"))
