"""DuckDB SQL for the oracle check of ``__spark_entry__.queries()``.

Written independently of the Spark code: list lambdas and RE2 regexes over
the pre-registered driver tables. Every query starts from the folder tree
SQL shared with the Spark fixture (``caseledger.sources.fixture``).
"""

from __future__ import annotations

from caseledger.operators.classify import COMPANY_KEYWORDS, DATA_SHEET, IDENTITY_PATTERNS
from caseledger.sources.fixture import CASE_FILES_SQL, LISTING_SQL
from caseledger.sources.rules import shipped_rules

AS_OF_DAY = "strftime(timestamp '2026-01-15 09:30:00', '%d-%b-%y')"
AS_OF_TS = "strftime(timestamp '2026-01-15 09:30:00', '%Y-%m-%d %H:%M:%S')"

KEY = "client_number, client_name, case_no, case_name, tm_no, class_code"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def q(s: str) -> str:
    return s.replace("'", "''")


# ------------------------------------------------------------------ names --

def legacy_client(src: str, c: str = "client_folder") -> str:
    p = r"^([A-Z]-\d+)\s+(.+)$"
    return f"""select *,
  case when regexp_matches({c}, '{p}') then regexp_extract({c}, '{p}', 1) else '' end as client_number,
  case when regexp_matches({c}, '{p}') then regexp_extract({c}, '{p}', 2) else {c} end as client_name
from ({src}) lc"""


def token_client(src: str, c: str = "client_folder") -> str:
    return f"""select * exclude (_ct),
  case when len(_ct) > 0 and regexp_full_match(_ct[1], '[A-Z]-\\d+') then _ct[1] else '' end as client_number,
  case when len(_ct) > 0 and regexp_full_match(_ct[1], '[A-Z]-\\d+') then array_to_string(_ct[2:], ' ') else {c} end as client_name
from (select *, {tokens(c)} as _ct from ({src}) tc0) tc"""


def legacy_case(src: str, c: str = "case_folder") -> str:
    C, NM, TM, K = r"[A-Z]\d{3}-\d{3}", r"[A-Z][a-zA-Z]+", r"\d{6}", r"C\d+"
    return f"""select * exclude (_t, _cpos, _aft, _short, _stop, _full),
  case when _full <> '' then _full else _short end as case_name
from (
 select *, case when tm_no = '' then '' else array_to_string(list_filter(_aft, lambda x, i:
        (_stop = 0 or i < _stop) and not regexp_full_match(x, '{C}') and not regexp_full_match(x, '{K}')), ' ') end as _full
 from (
  select *, coalesce(list_filter(_aft, lambda x: regexp_full_match(x, '{NM}'))[1], '') as _short,
         coalesce(list_position(_aft, tm_no), 0) as _stop
  from (
   select *, list_filter(_t, lambda x, i: _cpos > 0 and i > _cpos) as _aft
   from (
    select *,
      coalesce(list_filter(_t, lambda x: regexp_full_match(x, '{C}'))[-1], '') as case_no,
      coalesce(list_filter(_t, lambda x: regexp_full_match(x, '{TM}'))[-1], '') as tm_no,
      coalesce(list_filter(_t, lambda x: regexp_full_match(x, '{K}'))[-1], '') as class_code,
      coalesce(list_position(list_transform(_t, lambda x: regexp_full_match(x, '{C}')), true), 0) as _cpos
    from (select *, {tokens(c)} as _t from ({src}) l0) l1) l2) l3) l4) l5"""


TYPE_CASE = """case when regexp_full_match(x, '[A-Z]-\\d+') then 'CLIENT_NO'
  when regexp_full_match(x, '[A-Z]\\d{2,3}-\\d{3}') then 'CASE_NO'
  when regexp_full_match(x, '\\d{6}') then 'TM_NO'
  when regexp_full_match(x, '[Cc]\\d{1,2}') then 'CLASS'
  when regexp_full_match(x, '\\d{2}-\\d{2}-\\d{4}') then 'DATE'
  when regexp_full_match(x, '\\d+') then 'NUM'
  when regexp_full_match(x, '[A-Za-z][A-Za-z&.''-]*') then 'WORD'
  else 'OTHER' end"""


def typed(src: str, c: str) -> str:
    return f"""select *, list_transform(_t, lambda x: {TYPE_CASE}) as _ty
from (select *, {tokens(c)} as _t from ({src}) y0) y1"""


def token_case(src: str, c: str = "case_folder") -> str:
    return f"""select * exclude (_t, _ty, _cpos, _stop, _full, _fb),
  case when _full <> '' then _full else _fb end as case_name
from (
 select *,
   array_to_string(list_filter(_t, lambda x, i: _cpos > 0 and i > _cpos and (_stop is null or i < _stop)
       and _ty[i] <> 'CASE_NO' and _ty[i] <> 'CLASS'), ' ') as _full,
   coalesce(list_filter(_t, lambda x, i: _cpos > 0 and i > _cpos and _ty[i] = 'WORD')[1], '') as _fb
 from (
  select *,
    case when _cpos > 0 then _t[_cpos] else '' end as case_no,
    coalesce(_t[list_position(_ty, 'TM_NO')], '') as tm_no,
    coalesce(_t[list_position(_ty, 'CLASS')], '') as class_code,
    list_filter(list_transform(_ty, lambda x, i: case when x = 'TM_NO' and i > _cpos then i end),
                lambda v: v is not null)[1] as _stop
  from (select *, coalesce(list_position(_ty, 'CASE_NO'), 0) as _cpos from ({typed(src, c)}) t2) t3) t4) t5"""


def parse_both(src: str, parser: str) -> str:
    if parser == "legacy":
        return legacy_case(legacy_client(src))
    return token_case(token_client(src))


# ------------------------------------------------------------------ files --

SPLITEXT = r"^(\.*[^.].*)(\.[^.]*)$"


def stem(c: str = "file_name") -> str:
    return f"case when regexp_matches({c}, '{SPLITEXT}') then regexp_extract({c}, '{SPLITEXT}', 1) else {c} end"


def ext(c: str = "file_name") -> str:
    raw = f"regexp_extract({c}, '{SPLITEXT}', 2)"
    return f"case when lower({raw}) = '.ini' then '' else ltrim({raw}, '.') end"


def kept_files(cf: str = "cf") -> str:
    return f"""select root, client_folder, case_folder, file_path, {stem()} as stem, {ext()} as ext
from {cf} where file_name is not null and lower(file_name) <> 'desktop.ini'"""


KEPT_FILES = kept_files("cf")


def with_cf(body: str) -> str:
    return f"with cf as ({CASE_FILES_SQL}),\nkf as ({KEPT_FILES})\n{body}"


def records(mode: str = "strict", parser: str = "legacy", cf: str = "cf", kf: str = "kf") -> str:
    """Records per (root, key) with files / ext text and counts."""
    if mode == "deep":
        folders = f"select distinct root, client_folder, case_folder from {kf}"
    else:
        folders = f"select distinct root, client_folder, case_folder from {cf} where case_folder is not null"
    parsed = parse_both(folders, parser)
    return f"""select p.root, {', '.join('p.' + k for k in KEY.split(', '))},
  coalesce(string_agg(f.stem, chr(10) order by f.file_path) filter (where f.stem <> ''), '') as files,
  coalesce(string_agg(f.ext, chr(10) order by f.file_path, f.ext) filter (where f.ext <> ''), '') as ext,
  count(distinct p.client_folder || '/' || p.case_folder) as n_folders,
  count(f.file_path) as n_files
from ({parsed}) p
left join {kf} f on f.root = p.root and f.client_folder = p.client_folder and f.case_folder = p.case_folder
group by p.root, {', '.join('p.' + k for k in KEY.split(', '))}"""


# ------------------------------------------------------------------ rules --

def any_match(text: str, pats) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, '{q(p)}', 'i')" for p in pats) + ")"


def active(rules):
    out = {}
    for r in rules:
        n = (r.get("name") or "").strip()
        if n and r.get("patterns"):
            out.setdefault(n, []).extend(r["patterns"])
    return out


def flag_columns(text: str = "_txt", rules=None) -> str:
    rules = active(rules or shipped_rules())
    fire = f"({any_match(text, [DATA_SHEET])} and {any_match(text, COMPANY_KEYWORDS)})"
    ident = any_match(text, IDENTITY_PATTERNS)
    cols = []
    for name, pats in rules.items():
        e = any_match(text, pats)
        if name == "COMPANY":
            e = f"case when {fire} then true else {e} end"
        if name == "NTN":
            e = f"case when {fire} and not {ident} then false else {e} end"
        cols.append(f'{e} as "{name}"')
    if "COMPANY" not in rules:
        cols.append(f'case when {fire} then true end as "COMPANY"')
    if "NTN" not in rules:
        cols.append(f'case when {fire} and not {ident} then false end as "NTN"')
    return ",\n  ".join(cols)


RULE_NAMES = list(active(shipped_rules()).keys())


# ---------------------------------------------------------------- listing --

def hierarchy(mode: str) -> str:
    """Case files rebuilt from path components of the non-trashed listing."""
    if mode == "deep":
        return """select root, case when len(parts) >= 2 then parts[1] else '' end as client_folder,
  case when len(parts) >= 3 then parts[2] else '' end as case_folder,
  name as file_name, path as file_path, false as entry_is_folder
from nt where not is_folder"""
    only_files = "and not is_folder" if mode == "token" else ""
    return f"""select * from (
  select root, parts[1] as client_folder, parts[2] as case_folder, name as file_name,
         path as file_path, is_folder as entry_is_folder
  from nt where len(parts) = 3 {only_files}) ent
union all
select root, parts[1], parts[2], null, null, null from nt c
where is_folder and len(parts) = 2 and not exists (
  select 1 from nt e where len(e.parts) = 3 {only_files.replace('is_folder', 'e.is_folder')}
    and e.root = c.root and e.parts[1] = c.parts[1] and e.parts[2] = c.parts[2])"""


PARENT_TREE = """select ca.root, client_folder, case_folder, f.name as file_name,
  client_folder || '/' || case_folder || '/' || f.name as file_path, false as entry_is_folder
from fi f join ca on f.root = ca.root and f.parent_id = ca.case_id
union all
select ca.root, client_folder, case_folder, null, null, null from ca
left join (select distinct root, parent_id from fi) f on f.root = ca.root and f.parent_id = ca.case_id
where f.root is null
union all
select cl.root, client_folder, null, null, null, null from cl
left join (select distinct root, client_id from ca) c on c.root = cl.root and c.client_id = cl.client_id
where c.root is null"""

# ids are unique within a root only
TREE_CTES = """fi as materialized (select root, id, name, parent_id, mime_type, size, created_time, modified_time, source
       from nt where not is_folder),
cl as materialized (select root, id as client_id, name as client_folder, parent_id, created_time, modified_time
       from nt where is_folder and parent_id = root),
ca as materialized (select f.id as case_id, f.name as case_folder, f.created_time as case_created_time,
              f.modified_time as case_modified_time, cl.root, cl.client_id, cl.client_folder
       from nt f join cl on f.root = cl.root and f.parent_id = cl.client_id where f.is_folder)"""


def with_tree(body: str) -> str:
    return (f"with lst as materialized ({LISTING_SQL}),\n"
            f"nt as materialized (select *, string_split(path, '/') as parts from lst where not trashed),\n"
            f"{TREE_CTES}\n{body}")


def paths(source: str) -> str:
    """Paths of a listing (root, id, name, parent_id, is_folder), walked down from
    the roots; what can't be reached hangs on a missing folder, or on a ring."""
    return f"""with recursive b as materialized ({source}),
d as materialized (select root, id, name, parent_id from b where is_folder),
t as (select root, id, name as path from d where parent_id = root
  union all select d.root, d.id, t.path || '/' || d.name from d join t on d.root = t.root and d.parent_id = t.id),
lost as (select root, parent_id as id from d where parent_id <> root
    and (root, parent_id) not in (select (root, id) from d)
  union select d.root, d.id from d join lost l on d.root = l.root and d.parent_id = l.id)
select b.root, b.id, b.is_folder,
  case when b.parent_id = b.root then b.name else t.path || '/' || b.name end as path,
  case when b.parent_id = b.root or t.path is not null then 'ok'
       when l.id is not null or d.id is null then 'orphan' else 'cycle' end as path_state
from b left join t on t.root = b.root and t.id = b.parent_id
left join lost l on l.root = b.root and l.id = b.parent_id
left join d on d.root = b.root and d.id = b.parent_id"""


URL_PREFIX = "https://drive.google.com/file/d/"


def row_diff(a: str, b: str, key: list[str], cols: list[str]) -> str:
    """CTEs (after others) and select of the row-level comparison of two tables."""
    names, parts, pairs = ", ".join([*key, *cols]), [], []
    for side, one, other in (("a", a, b), ("b", b, a)):
        parts.append(f"r{side}0 as materialized (select {names} from {one} except all select {names} from {other})")
    for i, c in enumerate([*cols, None]):
        agree = [x for x in cols if x != c] if c else []
        order = ", ".join(f"{x} nulls first" for x in cols if x not in agree)
        same = " and ".join([f"a.{x} is not distinct from b.{x}" for x in [*key, *agree]] + ["a.rn = b.rn"])
        for side in "ab":
            parts.append(f"x{side}{i} as materialized (select *, row_number() over (partition by "
                         f"{', '.join([*key, *agree])} order by {order}) as rn from r{side}{i})")
        old_new = ", ".join(f"{s}.{x} as {n}_{x}" for n, s in (("old", "a"), ("new", "b")) for x in cols)
        pairs.append(f"select {', '.join(f'a.{x}' for x in key)}, {old_new} from xa{i} a join xb{i} b on {same}")
        for side, other in ("ab", "ba"):
            parts.append(f"r{side}{i + 1} as materialized (select {names} from x{side}{i} {side} anti join x{other}{i} {other} on {same})")
    k, n = ", ".join(key), len(cols) + 1
    changed = ", ".join(f"case when old_{x} is distinct from new_{x} then '{x}' end" for x in cols)
    values = ", ".join(f"{s}_{x}" for s in ("old", "new") for x in cols)
    olds, news = (", ".join(f"{x} as {s}_{x}" for x in cols) for s in ("old", "new"))
    no_olds, no_news = (", ".join(f"null as {s}_{x}" for x in cols) for s in ("old", "new"))
    return (", " + ",\n".join(parts) + f"""
select {k}, 'Changed' as change, concat_ws(', ', {changed}) as changed_columns, {values} from ({' union all '.join(pairs)}) p
union all select {k}, 'Removed', '', {olds}, {no_news} from ra{n}
union all select {k}, 'Added', '', {no_olds}, {news} from rb{n}""")
