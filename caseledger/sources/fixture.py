"""Folder tree derived from the driver tables (customer -> client folder,
order -> case folder, lineitem -> file).

The three name expressions are plain SQL that Spark and DuckDB both run
unchanged, so ``queries()`` and ``oracle_sql()`` start from the same rows.
The tree has two roots: even customer keys under ``clients``, odd ones under
``consultants``. Every line item is a file. Empty folders are planted beside
them: a case folder without files where the smallest order key of a case folder
is 3 mod 10, and a client folder without cases where the customer key is 7 mod 40.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FOLDER_MIME

CLIENT_FOLDER_SQL = """case when c_custkey % 11 = 0 then c_name
       else concat(chr(cast(65 + c_custkey % 26 as int)), '-', lpad(cast(c_custkey as string), 3, '0'), ' ', c_name)
  end"""

CASE_FOLDER_SQL = """concat(
    case when o_orderkey % 13 = 0 then 'MISC'
         when o_orderkey % 5 = 0 then concat(chr(cast(65 + o_custkey % 26 as int)), lpad(cast(o_custkey % 100 as string), 2, '0'), '-', lpad(cast(o_orderkey % 1000 as string), 3, '0'))
         else concat(chr(cast(65 + o_custkey % 26 as int)), lpad(cast(o_custkey % 1000 as string), 3, '0'), '-', lpad(cast(o_orderkey % 1000 as string), 3, '0'))
    end,
    ' ', split_part('Golden,star,ALPHA,Blue,Nova,M,SMITH,2nd,Co.,Foods', ',', cast(o_orderkey % 10 + 1 as int)),
    ' ', split_part('Golden,star,ALPHA,Blue,Nova,M,SMITH,2nd,Co.,Foods', ',', cast(o_custkey % 10 + 1 as int)),
    case when o_orderkey % 4 = 0 then '' else concat(' ', lpad(cast(((o_orderkey - case when o_orderkey % 50 = 2 then 1 else 0 end) * 7919) % 1000000 as string), 6, '0')) end,
    case when o_orderkey % 97 = 0 then concat(' ', lpad(cast((o_orderkey * 104729) % 1000000 as string), 6, '0')) else '' end,
    case when o_orderkey % 7 = 0 then ''
         when o_orderkey % 9 = 0 then concat(' c', cast(o_orderkey % 9 + 1 as string))
         else concat(' C', lpad(cast(o_orderkey % 45 + 1 as string), 2, '0'))
    end)"""

FILE_NAME_SQL = """case when l_orderkey is null then null
       when l_partkey % 50 = 0 then 'desktop.ini'
       else concat(split_part('TM-1;UPDATED [TM-48];EXAMINATION REPLY;ACK;Journal_12;CNIC FRONT;DATA SHEET PVT;scan;LEGAL;NOTICE;DEMAND NOTE;CERTIFICATE;DATA SHEET;page', ';', cast((l_partkey + l_linenumber) % 14 + 1 as int)),
                   case when l_partkey % 3 = 0 then '.pdf' when l_partkey % 3 = 1 then '.DOCX' else '' end)
  end"""

ROOT_SQL = "case when c_custkey % 2 = 0 then 'clients' else 'consultants' end"

# Name of the empty case folder planted beside the folder whose smallest order
# key it has: a case number of its own, so it is a record of its own.
VOID_SQL = """concat('Z', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '-999 Void ', cast(o_orderkey as string))"""

# The case_files view (F1.2) in SQL, used by every oracle query.
CASE_FILES_SQL = f"""
select root, client_folder, case_folder, file_name,
       case when file_name is null then null
            else concat(client_folder, '/', case_folder, '/', file_name) end as file_path
from (
  select {ROOT_SQL} as root,
         {CLIENT_FOLDER_SQL} as client_folder,
         {CASE_FOLDER_SQL} as case_folder,
         {FILE_NAME_SQL} as file_name
  from customer
  join orders on c_custkey = o_custkey
  left join lineitem on l_orderkey = o_orderkey
) t
union all
select root, client_folder, {VOID_SQL}, null, null from (
  select root, client_folder, min(o_orderkey) as o_orderkey from (
    select {ROOT_SQL} as root, {CLIENT_FOLDER_SQL} as client_folder, {CASE_FOLDER_SQL} as case_folder, o_orderkey
    from customer join orders on c_custkey = o_custkey) v
  group by root, client_folder, case_folder) g
where o_orderkey % 10 = 3
union all
select {ROOT_SQL}, {CLIENT_FOLDER_SQL} || ' NEW', null, null, null from customer where c_custkey % 40 = 7"""


def _tables(spark: SparkSession, sf_dir: str):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    return customer, orders, lineitem


def _case_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its root, client folder and case folder name.

    Names are built once per order (not per line item).
    """
    customer, orders, _ = _tables(spark, sf_dir)
    co = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return co.select(
        F.expr(ROOT_SQL).alias("root"),
        F.expr(CLIENT_FOLDER_SQL).alias("client_folder"),
        F.expr(CASE_FOLDER_SQL).alias("case_folder"),
        "c_custkey", "o_orderkey", "o_orderdate",
    )


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case folder name with its smallest order key."""
    return (_case_folders(spark, sf_dir).groupBy("root", "client_folder", "case_folder")
            .agg(F.min("o_orderkey").alias("o_orderkey")))


def _is_void() -> "F.Column":
    return F.col("o_orderkey") % 10 == 3


def _new_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, client_folder) of the planted clients without cases."""
    customer, _, _ = _tables(spark, sf_dir)
    return customer.where(F.col("c_custkey") % 40 == 7).select(
        F.expr(ROOT_SQL).alias("root"), F.concat(F.expr(CLIENT_FOLDER_SQL), F.lit(" NEW")).alias("client_folder"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, lineitem = _tables(spark, sf_dir)
    co = _case_folders(spark, sf_dir)
    joined = co.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select(
        "root", "client_folder", "case_folder",
        F.expr(FILE_NAME_SQL).alias("file_name"),
        "c_custkey", "o_orderkey", "o_orderdate", "l_linenumber", "l_partkey",
        "l_quantity", "l_shipdate",
    )


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1.2 rows: root, client_folder, case_folder, file_name, file_path."""
    b = _base(spark, sf_dir)
    files = b.select(
        "root", "client_folder", "case_folder", "file_name",
        F.when(F.col("file_name").isNull(), F.lit(None).cast("string"))
        .otherwise(F.concat_ws("/", "client_folder", "case_folder", "file_name")).alias("file_path"),
    )
    none = F.lit(None).cast("string")
    void = _folders(spark, sf_dir).where(_is_void()).select(
        "root", "client_folder", F.expr(VOID_SQL).alias("case_folder"),
        none.alias("file_name"), none.alias("file_path"))
    new = _new_clients(spark, sf_dir).select("root", "client_folder", none.alias("case_folder"),
                                             none.alias("file_name"), none.alias("file_path"))
    return files.unionByName(void).unionByName(new)


#: Every third part's files lie in one folder.
PILE = ("clients", "P-900 Pile", "P900-900 Pile 900900 C01")
_PILE_NAME_SQL = f"concat(lpad(cast(l_orderkey as string), 9, '0'), '.', cast(l_linenumber as string), ' ', {FILE_NAME_SQL})"

#: DuckDB form of ``piled``.
PILED_SQL = f"""
select case when p then '{PILE[0]}' else root end as root, case when p then '{PILE[1]}' else client_folder end as client_folder,
  case when p then '{PILE[2]}' else case_folder end as case_folder, file_name,
  case when file_name is null then null when p then '{PILE[1]}/{PILE[2]}/' || file_name
       else client_folder || '/' || case_folder || '/' || file_name end as file_path
from (select {ROOT_SQL} as root, {CLIENT_FOLDER_SQL} as client_folder, {CASE_FOLDER_SQL} as case_folder,
        coalesce(l_partkey % 3 = 0, false) as p, case when l_partkey % 3 = 0 then {_PILE_NAME_SQL} else {FILE_NAME_SQL} end as file_name
      from customer join orders on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey)"""


def piled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_files`` with a third of all files in one folder."""
    _, _, lineitem = _tables(spark, sf_dir)
    rows = _case_folders(spark, sf_dir).join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    pile = F.coalesce(F.col("l_partkey") % 3 == 0, F.lit(False))
    name = F.when(pile, F.expr(_PILE_NAME_SQL)).otherwise(F.expr(FILE_NAME_SQL))
    rows = rows.select(*[F.when(pile, F.lit(v)).otherwise(F.col(c)).alias(c)
                         for c, v in zip(("root", "client_folder", "case_folder"), PILE)], name.alias("file_name"))
    return rows.withColumn("file_path", F.when(F.col("file_name").isNotNull(),
                                               F.concat_ws("/", "client_folder", "case_folder", "file_name")))


def listing(spark: SparkSession, sf_dir: str, with_trash: bool = True) -> DataFrame:
    """F1.1 listing of the same tree: one row per folder or file.

    ids are the root plus the path (file ids add the line number, because
    names may repeat inside one folder). A trashed draft is planted in every
    case folder whose smallest order key is 1 mod 13; ``not_trashed`` removes
    exactly those rows.
    """
    from ..functions.files import iso_utc

    customer, orders, _ = _tables(spark, sf_dir)
    b = _base(spark, sf_dir)
    client_id = F.concat_ws("/", "root", "client_folder")
    case_id = F.concat_ws("/", "root", "client_folder", "case_folder")

    def row(id_, name, parent, path, is_folder, mime, size, created, modified, trashed):
        return F.struct(
            id_.alias("id"), name.alias("name"), parent.alias("parent_id"), path.alias("path"),
            F.lit(is_folder).alias("is_folder"), mime.alias("mime_type"),
            size.cast("long").alias("size"), created.alias("created_time"),
            modified.alias("modified_time"), trashed.alias("trashed"))

    with_orders = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    clients = with_orders.select(
        F.expr(ROOT_SQL).alias("root"), F.expr(CLIENT_FOLDER_SQL).alias("client_folder"))
    clients = clients.unionByName(_new_clients(spark, sf_dir))
    clients = clients.select("root", row(
        client_id, F.col("client_folder"), F.col("root"), F.col("client_folder"), True,
        F.lit(FOLDER_MIME), F.lit(None), F.lit(""), F.lit(""), F.lit(False)).alias("e"))

    case_rows = _folders(spark, sf_dir)
    folder_epoch = F.lit(1_600_000_000) + F.col("o_orderkey") * 3600
    # One pass over the case folders emits each folder plus what is planted
    # in it: a trashed draft in every folder whose smallest order key is
    # 1 mod 13, and a sub-folder "old" with one file where it is 5 mod 17
    # (strict scans list "old" as a file, the token walker and the
    # parent-id tree ignore it, deep scans roll its file up).
    sub_id = F.concat(case_id, F.lit("/old"))
    has_sub = F.col("o_orderkey") % 17 == 5
    per_folder = [
        row(case_id, F.col("case_folder"), client_id,
            F.concat_ws("/", "client_folder", "case_folder"), True, F.lit(FOLDER_MIME),
            F.lit(None), iso_utc(folder_epoch), iso_utc(folder_epoch + 60), F.lit(False)),
        F.when(has_sub, row(
            sub_id, F.lit("old"), case_id,
            F.concat_ws("/", "client_folder", "case_folder", F.lit("old")), True,
            F.lit(FOLDER_MIME), F.lit(None), F.lit(""), F.lit(""), F.lit(False))),
        F.when(has_sub, row(
            F.concat(sub_id, F.lit("/scan old.pdf")), F.lit("scan old.pdf"), sub_id,
            F.concat_ws("/", "client_folder", "case_folder", F.lit("old"), F.lit("scan old.pdf")),
            False, F.lit("application/pdf"), F.lit(2048), F.lit(""), F.lit(""), F.lit(False))),
    ]
    void = F.expr(VOID_SQL)
    per_folder.append(F.when(_is_void(), row(
        F.concat_ws("/", "root", "client_folder", void), void, client_id,
        F.concat_ws("/", "client_folder", void), True, F.lit(FOLDER_MIME),
        F.lit(None), F.lit(""), F.lit(""), F.lit(False))))
    if with_trash:
        per_folder.append(F.when(F.col("o_orderkey") % 13 == 1, row(
            F.concat(case_id, F.lit("/~draft")), F.lit("~draft.tmp"), case_id,
            F.concat_ws("/", "client_folder", "case_folder", F.lit("~draft.tmp")), False,
            F.lit("application/octet-stream"), F.lit(1), F.lit(""), F.lit(""), F.lit(True))))
    folders = case_rows.select(
        "root", F.explode(F.filter(F.array(*per_folder), lambda e: e.isNotNull())).alias("e"))

    mime = (F.when(F.col("file_name").endswith(".pdf"), F.lit("application/pdf"))
            .when(F.col("file_name").endswith(".DOCX"), F.lit(
                "application/vnd.openxmlformats-officedocument.wordprocessingml.document"))
            .otherwise(F.lit("application/octet-stream")))
    file_epoch = (F.lit(1_600_000_000) + F.col("o_orderkey") * 3600
                  + F.col("l_linenumber") * 60 + F.col("l_partkey") % 60)
    files = b.where(F.col("file_name").isNotNull()).select("root", row(
        F.concat(case_id, F.lit("/"), F.col("file_name"), F.lit("#"), F.col("o_orderkey"),
                 F.lit("."), F.col("l_linenumber")),
        F.col("file_name"), case_id,
        F.concat_ws("/", "client_folder", "case_folder", "file_name"), False, mime,
        F.when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("l_quantity") * 1000),
        iso_utc(file_epoch), iso_utc(file_epoch + F.lit(0.25)), F.lit(False)).alias("e"))
    out = clients.unionByName(folders).unionByName(files)
    return out.select("root", "e.*").withColumn("source", F.lit("drive"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing without paths, as deep as customers have orders: each order is a
    folder inside that of the customer's previous order, with its line items as
    files. The first order lies in the customer's folder; of customers with a key
    1 mod 25 it lies in their last order's (a ring), 2 mod 25 in a folder that is
    not listed."""
    customer, orders, lineitem = _tables(spark, sf_dir)
    order = F.col("o_orderkey").cast("string")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.max("o_orderkey").over(Window.partitionBy("o_custkey")).cast("string")
    kind = F.col("o_custkey") % 25
    first = F.when(kind == 1, last).when(kind == 2, F.lit("gone")).otherwise(F.concat(F.lit("c"), F.col("o_custkey")))
    root = F.expr(ROOT_SQL.replace("c_custkey", "o_custkey"))
    client = customer.select(F.expr(ROOT_SQL).alias("root"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"),
                             F.col("c_name").alias("name"), F.expr(ROOT_SQL).alias("parent_id"),
                             F.lit(True).alias("is_folder"))
    folder = orders.select(root.alias("root"), order.alias("id"), F.concat(F.lit("o"), order).alias("name"),
                           F.coalesce(F.lag("o_orderkey").over(w).cast("string"), first).alias("parent_id"),
                           F.lit(True).alias("is_folder"))
    item = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        root.alias("root"), F.concat_ws(".", order, "l_linenumber").alias("id"),
        F.concat_ws(".", F.lit("f"), "l_linenumber").alias("name"), order.alias("parent_id"),
        F.lit(False).alias("is_folder"))
    return client.unionByName(folder).unionByName(item)


#: DuckDB form of ``chains``.
CHAINS_SQL = f"""
select {ROOT_SQL} as root, 'c' || c_custkey as id, c_name as name, {ROOT_SQL} as parent_id, true as is_folder from customer
union all
select {ROOT_SQL.replace("c_custkey", "o_custkey")}, o_orderkey::varchar, 'o' || o_orderkey,
  coalesce(lag(o_orderkey) over (partition by o_custkey order by o_orderkey)::varchar,
    case when o_custkey % 25 = 1 then (max(o_orderkey) over (partition by o_custkey))::varchar
         when o_custkey % 25 = 2 then 'gone' else 'c' || o_custkey end), true
from orders
union all
select {ROOT_SQL.replace("c_custkey", "o_custkey")}, o_orderkey || '.' || l_linenumber, 'f.' || l_linenumber,
  o_orderkey::varchar, false
from lineitem join orders on l_orderkey = o_orderkey"""


def _iso_sql(e: str, frac: bool = False) -> str:
    if frac:
        return (f"strftime(make_timestamp(cast(({e}) * 1000000 as bigint)), "
                f"'%Y-%m-%dT%H:%M:%S.%f+00:00')")
    return f"strftime(make_timestamp(cast({e} as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


_FOLDER_EPOCH = "(1600000000 + cast(o_orderkey as bigint) * 3600)"
_FILE_EPOCH = f"({_FOLDER_EPOCH} + l_linenumber * 60 + l_partkey % 60)"

# DuckDB form of ``listing`` (oracle side only: it formats times with strftime).
LISTING_SQL = f"""
with co as (
  select {ROOT_SQL} as root, {CLIENT_FOLDER_SQL} as client_folder,
         {CASE_FOLDER_SQL} as case_folder, o_orderkey
  from customer join orders on c_custkey = o_custkey),
cases as materialized (select root, client_folder, case_folder, min(o_orderkey) as o_orderkey
          from co group by root, client_folder, case_folder),
clients as (select distinct root, client_folder from co
            union all select {ROOT_SQL}, {CLIENT_FOLDER_SQL} || ' NEW' from customer where c_custkey % 40 = 7),
fl as (
  select {ROOT_SQL} as root, {CLIENT_FOLDER_SQL} as client_folder,
         {CASE_FOLDER_SQL} as case_folder, {FILE_NAME_SQL} as file_name,
         o_orderkey, l_linenumber, l_partkey, l_quantity
  from customer join orders on c_custkey = o_custkey
  join lineitem on l_orderkey = o_orderkey)
select root, root || '/' || client_folder as id, client_folder as name, root as parent_id,
       client_folder as path, true as is_folder, '{FOLDER_MIME}' as mime_type,
       cast(null as bigint) as size, '' as created_time, '' as modified_time,
       false as trashed, 'drive' as source
from clients
union all
select root, root || '/' || client_folder || '/' || case_folder, case_folder,
       root || '/' || client_folder, client_folder || '/' || case_folder, true, '{FOLDER_MIME}',
       cast(null as bigint), {_iso_sql(_FOLDER_EPOCH)}, {_iso_sql(_FOLDER_EPOCH + ' + 60')},
       false, 'drive'
from cases
union all
select root, root || '/' || client_folder || '/' || case_folder || '/' || file_name || '#'
             || cast(o_orderkey as varchar) || '.' || cast(l_linenumber as varchar),
       file_name, root || '/' || client_folder || '/' || case_folder,
       client_folder || '/' || case_folder || '/' || file_name, false,
       case when file_name like '%.pdf' then 'application/pdf'
            when file_name like '%.DOCX' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            else 'application/octet-stream' end,
       case when l_linenumber = 4 then cast(null as bigint) else cast(l_quantity * 1000 as bigint) end,
       {_iso_sql(_FILE_EPOCH)}, {_iso_sql(_FILE_EPOCH + ' + 0.25', True)}, false, 'drive'
from fl
union all
select root, root || '/' || client_folder || '/' || case_folder || '/~draft', '~draft.tmp',
       root || '/' || client_folder || '/' || case_folder,
       client_folder || '/' || case_folder || '/~draft.tmp', false, 'application/octet-stream',
       cast(1 as bigint), '', '', true, 'drive'
from cases where o_orderkey % 13 = 1
union all
select root, root || '/' || client_folder || '/' || case_folder || '/old', 'old',
       root || '/' || client_folder || '/' || case_folder,
       client_folder || '/' || case_folder || '/old', true, '{FOLDER_MIME}',
       cast(null as bigint), '', '', false, 'drive'
from cases where o_orderkey % 17 = 5
union all
select root, root || '/' || client_folder || '/' || case_folder || '/old/scan old.pdf', 'scan old.pdf',
       root || '/' || client_folder || '/' || case_folder || '/old',
       client_folder || '/' || case_folder || '/old/scan old.pdf', false, 'application/pdf',
       cast(2048 as bigint), '', '', false, 'drive'
from cases where o_orderkey % 17 = 5
union all
select root, root || '/' || client_folder || '/' || {VOID_SQL}, {VOID_SQL},
       root || '/' || client_folder, client_folder || '/' || {VOID_SQL}, true, '{FOLDER_MIME}',
       cast(null as bigint), '', '', false, 'drive'
from cases where o_orderkey % 10 = 3
"""
