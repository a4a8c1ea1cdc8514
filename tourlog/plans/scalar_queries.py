"""Scalar rules applied to whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.plans.fixtures import AS_OF, CONTRACTOR
from tourlog.plans.registry import query, shared_view

# numbers, dates and clock times in the spellings that reports contain
shared_view(
    "spellings",
    """
select o_orderkey as rk,
  case o_orderkey % 8 when 0 then '1,234.50' when 1 then cast(o_custkey as string) when 2 then concat(cast(o_custkey as string), ' ft')
    when 3 then concat('about ', cast(o_custkey as string), ' psi') when 4 then 'none' when 5 then ''
    when 6 then concat(cast(o_custkey as string), '.500') else concat('-', cast(o_custkey as string), ' (USD)') end as number_text,
  case o_orderkey % 8 when 0 then substring(cast(o_orderdate as string), 1, 10)
    when 1 then concat(substring(cast(o_orderdate as string), 6, 2), '/', substring(cast(o_orderdate as string), 9, 2), '/',
      substring(cast(o_orderdate as string), 1, 4))
    when 2 then concat(substring(cast(o_orderdate as string), 9, 2), '-', substring(cast(o_orderdate as string), 6, 2), '-',
      substring(cast(o_orderdate as string), 1, 4))
    when 3 then concat('31/', cast(1 + o_custkey % 12 as string), '/1999') when 4 then '2001/2/30' when 5 then 'soon'
    when 6 then '' else concat('12-', cast(13 + o_custkey % 19 as string), '-2003') end as date_text,
  case o_orderkey % 6 when 0 then '7:05' when 1 then concat(cast(o_custkey % 30 as string), '：30') when 2 then '24:00' when 3 then '24:01'
    when 4 then '' else concat(cast(o_custkey % 24 as string), ':', cast(10 + o_custkey % 60 as string)) end as time_text,
  case o_orderkey % 9 when 0 then '00  ACME 248' when 1 then 'acme-248' when 2 then 'ACME248' when 3 then ' ACME   248 '
    when 4 then 'OTHER 9' when 5 then 'RIG PLACEHOLDER' when 6 then 'n/a' when 7 then '' else 'ACME - 248' end as rig_text,
  case o_orderkey % 6 when 0 then 'Yes' when 1 then ' ON ' when 2 then '1' when 3 then 'no' when 4 then '' else 'TRUE' end as flag_text,
  case o_orderkey % 9 when 0 then ' ZH ' when 1 then 'zh_CN' when 2 then 'EN' when 3 then 'eng' when 4 then 'Spanish' when 5 then 'es-MX'
    when 6 then '' when 7 then 'fr' else '中文' end as lang_text,
  case o_orderkey % 9 when 0 then 'drilli ng' when 1 then 'CIRCULA TING' when 2 then 'Rig up' when 3 then 'CODE BHA' when 4 then 'BHA in'
    when 5 then 'well head' when 6 then 'Wellcontrol x' when 7 then 'perforat' else 'misc code' end as code_text,
  case o_orderkey % 6 when 0 then 'n p t' when 1 then 'p' when 2 then 'Type P' when 3 then ' sc' when 4 then 'xNPTx' else '' end as type_text,
  case o_orderkey % 5 when 0 then '' when 1 then 'drilling' when 2 then ' Move ' when 3 then 'WORKOVER' else 'other' end as kind_text,
  o_orderpriority, o_orderstatus, o_custkey
from orders
""",
    "orders",
)


@query(
    "safe_float",
    """
select rk, case when regexp_full_match(replace(number_text, ',', ''), '[-+]?[0-9]+([.][0-9]+)?')
  then cast(replace(number_text, ',', '') as double) else 0.0 end as value from spellings
""",
    uses=("spellings",),
)
def safe_float(i):
    return i.v("spellings").select("rk", S.safe_float(F.col("number_text")).alias("value"))


@query(
    "normalize_number",
    """
select rk, case rk % 8 when 0 then '1234.5' when 1 then o_custkey::varchar when 2 then o_custkey::varchar when 3 then o_custkey::varchar
    when 4 then 'none' when 5 then '' when 6 then o_custkey || '.5' else '-' || o_custkey end as value,
  case rk % 8 when 3 then 'depth number corrected' when 4 then 'depth number invalid' else '' end as warning
from spellings
""",
    uses=("spellings",),
)
def normalize_number(i):
    out = S.normalize_number(F.col("number_text"), F.lit("depth"))
    return i.v("spellings").select("rk", out.alias("r")).select("rk", "r.value", "r.warning")


@query(
    "normalize_date",
    f"""
select rk, case when date_text = '' then '' when d is null then date_text else strftime(d, '%Y-%m-%d') end as value,
  case when date_text = '' then '' when d is null then 'day date invalid' when d > date '{AS_OF}' then 'day is in the future' else '' end as warning
from (select *, coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%d/%m/%Y'),
  try_strptime(date_text, '%Y/%m/%d'), try_strptime(date_text, '%d-%m-%Y'), try_strptime(date_text, '%m-%d-%Y')) as d from spellings)
""",
    uses=("spellings",),
)
def normalize_date(i):
    out = S.normalize_date(F.col("date_text"), F.lit("day"), AS_OF)
    return i.v("spellings").select("rk", out.alias("r")).select("rk", "r.value", "r.warning")


_HM = """
select rk, time_text, try_cast(split_part(replace(time_text, '：', ':'), ':', 1) as int) as hh,
  try_cast(split_part(replace(time_text, '：', ':'), ':', 2) as int) as mm from spellings
"""


@query(
    "normalize_time",
    f"""
select rk, case when time_text = '' then '' when hh < 24 and mm < 60 or (hh = 24 and mm = 0)
    then printf('%02d:%02d', hh, mm) else time_text end as value,
  case when time_text = '' or (hh < 24 and mm < 60) or (hh = 24 and mm = 0) then '' else 'start time invalid' end as warning
from ({_HM})
""",
    uses=("spellings",),
)
def normalize_time(i):
    out = S.normalize_time(F.col("time_text"), F.lit("start"))
    return i.v("spellings").select("rk", out.alias("r")).select("rk", "r.value", "r.warning")


@query(
    "clock_minutes",
    f"select rk, hh * 60 + mm as minutes from ({_HM}) where (hh < 24 and mm < 60) or (hh = 24 and mm = 0)",
    uses=("spellings",),
)
def clock_minutes(i):
    minutes = S.clock_minutes(F.col("time_text")).alias("minutes")
    return i.v("spellings").select("rk", minutes).filter("minutes is not null")


@query(
    "normalize_rig",
    """
select rk, case when rk % 9 in (0, 1, 2, 3, 8) then 'ACME 248' else trim(rig_text) end as rig, rk % 9 in (0, 1, 2, 3, 4, 8) as valid
from spellings
""",
    uses=("spellings",),
)
def normalize_rig(i):
    rig = S.canonical_rig(F.col("rig_text"), CONTRACTOR)
    return i.v("spellings").select("rk", rig.alias("rig")).select("rk", "rig", S.valid_rig(F.col("rig")).alias("valid"))


@query(
    "truthy",
    "select rk, lower(trim(flag_text)) in ('1', 'true', 'yes', 'y', 'on') as flag from spellings",
    uses=("spellings",),
)
def truthy(i):
    return i.v("spellings").select("rk", S.truthy(F.col("flag_text")).alias("flag"))


@query(
    "normalize_language",
    """
select rk, case rk % 9 when 0 then 'zh-CN' when 1 then 'zh-CN' when 2 then 'en' when 3 then 'en' when 4 then 'es' when 5 then 'es'
  when 6 then 'zh-CN' when 7 then 'fr' else 'zh-CN' end as language,
  case rk % 9 when 2 then 'English' when 3 then 'English' when 4 then 'Spanish' when 5 then 'Spanish' when 7 then 'fr'
    else 'Simplified Chinese' end as label
from spellings
""",
    uses=("spellings",),
)
def normalize_language(i):
    rows = i.v("spellings").select("rk", S.normalize_language(F.col("lang_text")).alias("language"))
    return rows.withColumn("label", S.labelled(F.col("language"), dims.LANGUAGE_LABELS))


@query(
    "normalize_op_code",
    """
select rk, case rk % 9 when 0 then 'DRILLING' when 1 then 'CIRCULATING' when 2 then 'RIG MAINTENANCE' when 3 then 'BHA' when 4 then 'BHA'
    when 5 then 'WELLHEAD' when 6 then 'WELLHEAD' when 7 then 'perforat' else 'misc' end as drilling,
  case rk % 9 when 7 then 'PERFORATING' else code_text end as completion,
  case rk % 9 when 5 then 'WELLHEAD' when 6 then 'WELL CONTROL' else code_text end as workover, code_text as move
from spellings
""",
    uses=("spellings",),
)
def normalize_op_code(i):
    return i.v("spellings").select(
        "rk", *[S.normalize_op_code(F.col("code_text"), t).alias(t) for t in dims.REPORT_TYPES]
    )


@query(
    "normalize_op_type",
    """
select rk, case rk % 6 when 0 then 'NPT' when 1 then 'P' when 2 then 'P' when 3 then '' when 4 then 'NPT' else '' end as drilling,
  case rk % 6 when 0 then 'NPT' when 1 then 'P' when 2 then '' when 3 then 'SC' when 4 then 'NPT' else '' end as completion
from spellings
""",
    uses=("spellings",),
)
def normalize_op_type(i):
    return i.v("spellings").select(
        "rk", *[S.normalize_op_type(F.col("type_text"), t).alias(t) for t in ("drilling", "completion")]
    )


@query(
    "normalize_report_type",
    "select rk, lower(trim(kind_text)) as report_type from spellings where lower(trim(kind_text)) in ('drilling', 'completion', 'workover', 'move')",
    uses=("spellings",),
)
def normalize_report_type(i):
    kind = S.normalize_report_type(F.col("kind_text")).alias("report_type")
    return i.v("spellings").select("rk", kind).filter("report_type is not null")


@query(
    "natural_record_id",
    """
select rk, case when trim(kind_text) = '' or trim(rig_text) = '' then '' else regexp_replace(trim(kind_text), '[^A-Za-z0-9_.-]+', '-', 'g')
  || ':' || regexp_replace(trim(rig_text), '[^A-Za-z0-9_.-]+', '-', 'g') || ':' || trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '-', 'g'), '-')
  end as record_id from spellings
""",
    uses=("spellings",),
)
def natural_record_id(i):
    key = S.natural_record_id(F.col("kind_text"), F.col("rig_text"), F.col("o_orderpriority"))
    return i.v("spellings").select("rk", key.alias("record_id"))


@query(
    "field_splitting",
    """
select rk, regexp_extract(replace(number_text, ',', ''), '[-+]?[0-9]+([.][0-9]+)?') as number,
  trim(split_part(o_orderpriority, '-', 1)) as left_part, trim(regexp_replace(o_orderpriority, '^[^-]*-?', '')) as right_part,
  trim(split_part(number_text || '/b', '/', 2)) as second, trim(number_text) || ' / ' || o_orderstatus as joined,
  case when rk % 8 = 1 then date_text[7:] || '-' || date_text[:2] || '-' || date_text[4:5]
    when rk % 8 = 3 then '1999-' || lpad(split_part(date_text, '/', 2), 2, '0') || '-31' else '' end as slash_date
from spellings
""",
    uses=("spellings",),
)
def field_splitting(i):
    number, priority = F.col("number_text"), F.col("o_orderpriority")
    cut = S.split_at(priority, "-")
    # month-first for one layout of report, day-first for the other
    date = F.when(
        F.col("date_text").startswith("31/"), S.date_from_slashes(F.col("date_text"), day_first=True)
    ).otherwise(S.date_from_slashes(F.col("date_text"), day_first=False))
    only_mdy = F.when(F.col("rk") % 8 == 4, F.lit("")).otherwise(date)
    return i.v("spellings").select(
        "rk", S.first_number(number).alias("number"), cut["left"].alias("left_part"), cut["right"].alias("right_part"),
        S.split_slash(F.concat(number, F.lit("/b")), 2)[1].alias("second"),
        S.join_slash(number, F.col("o_orderstatus")).alias("joined"), only_mdy.alias("slash_date"),
    )


@query(
    "labels_and_ranges",
    """
select record_id, row_no, reason, from_time || ' - ' || to_time as time_range, eff_type, sys_type from operations
""",
    uses=("operations",),
)
def labels_and_ranges(i):
    return i.v("numbered_operations").select(
        "record_id", "row_no", "reason", S.time_range(F.col("from_time"), F.col("to_time")).alias("time_range"),
        "eff_type", "sys_type",
    )


@query(
    "contract_label",
    """
select distinct project_id, case when project_title = '' then project_contract else project_contract || ' / ' || project_title end as label,
  project_contract as same, coalesce(nullif(project_title, ''), '-') as alone from project_rigs
""",
    uses=("project_rigs",),
)
def contract_label(i):
    contract, title = F.col("project_contract"), F.col("project_title")
    return i.v("project_rigs").select(
        "project_id", S.contract_label(contract, title).alias("label"), S.contract_label(contract, contract).alias("same"),
        S.contract_label(F.lit(""), title).alias("alone"),
    ).distinct()


@query(
    "row_revision_groups",
    """
select min(l_partkey) as first_part, count(*) as n from operations
group by hours, op_code, op_sub, op_type, system_op_type, confirmed_op_type, draft_op_type, from_time, to_time, operation_details
""",
    uses=("operations",),
)
def row_revision_groups(i):
    """Rows with the same content share one revision token."""
    from tourlog.operators.npt import revision

    rows = i.v("operations").select("l_partkey", revision().alias("token"))
    return rows.groupBy("token").agg(F.min("l_partkey").alias("first_part"), F.count(F.lit(1)).alias("n")).drop("token")


@query(
    "json_get",
    """
select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, coalesce(json_extract_string(props, '$.none'), '') as none
from events
""",
)
def json_get(i):
    fields = S.json_or_empty(F.col("props"))
    return i.t("events").select("event_id", fields.alias("f")).select(
        "event_id",
        F.coalesce(F.try_element_at("f", F.lit("k")).try_cast("bigint"), F.lit(-1)).alias("k"),
        F.coalesce(F.try_element_at("f", F.lit("none")), F.lit("")).alias("none"),
    )
