"""Report tables derived from the given star-schema tables.

Each base view is one SQL text that both Spark and the check engine accept;
views that apply library code have a separate, independent text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.operators import ordering
from tourlog.plans.registry import cte, shared_view, view

CONTRACTOR = "ACME"
AS_OF = "2001-06-30"

shared_view(
    "report_base",
    """
select o_orderkey as rk,
  concat('R', cast(o_orderkey as string)) as record_id,
  case o_orderkey % 4 when 0 then 'drilling' when 1 then 'completion' when 2 then 'workover' else 'move' end
    as report_type,
  substring(cast(o_orderdate as string), 1, 10) as report_date,
  cast(o_orderkey % 1000 as string) as report_no,
  case when o_orderkey % 97 = 0 then ''
    else concat('W-', lpad(cast(o_custkey % 40 as string), 3, '0')) end as wellbore,
  case when o_orderkey % 53 = 0 then 'UNKNOWN' when o_orderkey % 59 = 0 then ''
    else concat(case o_custkey % 3 when 0 then '00 ACME ' when 1 then 'ACME-' else 'ACME ' end,
      cast(100 + o_custkey % 8 as string)) end as rig_raw,
  case substring(o_orderpriority, 1, 1) when '1' then 'Rig Move' when '2' then 'DEV DRILLING'
    when '3' then 'Completion' when '4' then 'WORKOVER' else 'MOVE' end as event,
  case when o_orderstatus = 'P' then 'warning' else 'ok' end as validation_status,
  case when o_orderkey % 10 = 0 then 'yes' else '' end as locked,
  case o_orderkey % 10 when 0 then 'confirmed' when 1 then 'draft' else '' end as confirmation_status,
  case when o_orderkey % 6 = 0 then concat('note ', cast(o_custkey as string)) else '' end as confirmation_note,
  case when o_orderkey % 7 = 0 then '' else concat('AFE-', lpad(cast(o_custkey % 25 as string), 3, '0')) end
    as afe_number,
  concat(substring(cast(o_orderdate as string), 1, 10), 'T', lpad(cast(o_orderkey % 24 as string), 2, '0'), ':00:00')
    as updated_at,
  case o_orderkey % 8 when 0 then 'QUEUED' when 1 then 'IN_PROGRESS' when 2 then 'NOT_REQUIRED' when 3 then 'STOPPED'
    when 4 then 'FAILED' when 5 then '' else 'COMPLETED' end as translation_status,
  case o_custkey % 3 when 0 then 'v1' when 1 then 'v2' else '' end as translation_version,
  case o_custkey % 8 when 0 then 'QUEUED' when 1 then 'IN_PROGRESS' when 2 then 'NOT_REQUIRED' when 3 then 'STOPPED'
    when 4 then 'STALE' when 5 then '' else 'COMPLETED' end as extraction_status,
  case o_orderkey % 3 when 0 then 'v1' when 1 then 'v2' else '' end as extraction_version,
  o_totalprice, o_custkey
from orders
""",
    "orders",
)

# header fields of the report body, all text as in the stored reports
shared_view(
    "field_base",
    """
select concat('R', cast(o_orderkey as string)) as record_id,
  cast(cast(floor(o_totalprice / 100) as bigint) as string) as today_md,
  case when o_orderkey % 23 = 0 then ''
    else cast(cast(floor(o_totalprice / 100) as bigint) - o_custkey % 300 + case when o_orderkey % 19 = 0 then 900 else 0 end
      as string) end as prev_md,
  case when o_orderkey % 31 = 0 then '' else cast(o_custkey % 300 + case when o_orderkey % 5 = 0 then 7 else 0 end as string)
    end as progress,
  case when o_orderkey % 11 = 0 then ' ' else 'WBM' end as mud_type,
  case when o_orderkey % 13 = 0 then '' else concat(cast(4 + o_custkey % 19 as string), '.5') end as mud_density,
  cast(o_custkey % 13 as string) as sand,
  case when o_orderkey % 29 = 0 then '-5' else '1,200.50' end as afe_cost,
  case when o_custkey % 37 = 0 then '-1' else '' end as total_personnel,
  concat(substring(cast(o_orderdate as string), 1, 8), '15') as operation_start_date,
  case when o_custkey % 41 = 0 then '' else concat('perfora hasta ', cast(o_orderkey as string), ' ft') end as current_ops,
  case when o_custkey % 43 = 0 then '' else concat('Pumped ', cast(o_custkey as string), ' bbl') end as summary24h,
  case when o_orderkey % 47 = 0 then '' else concat('Plan: ', o_orderpriority) end as forecast24h
from orders
""",
    "orders",
)

OPERATION_SQL = """
select l_orderkey as rk, concat('R', cast(l_orderkey as string)) as record_id,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  case when l_partkey % 89 = 0 then 'n/a' else cast(l_quantity / 4 as string) end as hours,
  case when l_partkey % 13 = 0 then '' else case l_returnflag when 'R' then 'NPT' when 'A' then 'P' else 'SC' end end
    as op_type,
  case when l_partkey % 3 = 0 or l_partkey % 13 = 0
    then case l_returnflag when 'R' then 'npt' when 'A' then 'P' else 'SC' end else '' end as system_op_type,
  case when l_partkey % 17 = 0 then 'npt ' else '' end as confirmed_op_type,
  case when l_suppkey % 19 = 0 then 'SC' else '' end as draft_op_type,
  concat('OP', cast(l_suppkey % 6 as string)) as op_code,
  case when l_partkey % 3 = 0 then '' else concat('SUB', cast(l_partkey % 4 as string)) end as op_sub,
  case when l_partkey % 101 = 0 then '7h30' else
    concat(lpad(cast(cast(floor(((l_partkey * 15) % 1440) / 60) as bigint) as string), 2, '0'), ':',
      lpad(cast((l_partkey * 15) % 60 as string), 2, '0')) end as from_time,
  concat(lpad(cast(cast(floor(((l_partkey * 15 + cast(l_quantity as bigint) * 15
      + case when l_suppkey % 9 = 0 then 30 else 0 end) % 1440) / 60) as bigint) as string), 2, '0'), ':',
    lpad(cast((l_partkey * 15 + cast(l_quantity as bigint) * 15 + case when l_suppkey % 9 = 0 then 30 else 0 end) % 60
      as string), 2, '0')) as to_time,
  concat('OP', cast(l_suppkey % 6 as string), ' lot ', cast(l_partkey as string),
    case l_suppkey % 7 when 0 then ' falla de bomba SPERRY' when 1 then ' NPT A CARGO DE VENDOR ONE; espera'
      when 2 then ' washout loss SLB' when 3 then ' Responsible party: DRILLCO during trip' else '' end) as operation_details
from lineitem
"""
shared_view("operation_base", OPERATION_SQL, "lineitem")

shared_view(
    "project_rigs",
    """
select concat('P', cast(r_regionkey as string)) as project_id,
  concat('C-', cast(r_regionkey as string)) as project_contract,
  case when r_regionkey = 2 then '' else r_name end as project_title,
  case when r_regionkey = 4 then 'closed' when r_regionkey = 3 then '' else 'active' end as project_status,
  concat(cast(1995 + r_regionkey as string), '-01-01') as project_start,
  concat(cast(1998 + r_regionkey as string), '-12-31') as project_end,
  n_nationkey as rig_ord,
  case when n_nationkey % 5 = 4 then concat('OLD RIG ', cast(n_nationkey % 8 as string))
    else concat('ACME ', cast(100 + n_nationkey % 8 as string)) end as rig,
  '' as rig_start,
  case when n_nationkey % 9 = 8 then '1999-06-30' else '' end as rig_end,
  case when n_nationkey % 2 = 0 then '' else concat('W-', lpad(cast(n_nationkey as string), 3, '0')) end as well
from nation join region on n_regionkey = r_regionkey
""",
    "nation",
    "region",
)

# a team has a name and one alias row each; team order decides between them
shared_view(
    "team_names",
    """
select n_nationkey % 8 as team_ord, concat('ACME ', cast(100 + n_nationkey % 8 as string)) as team_name,
  concat('OLD RIG ', cast(n_nationkey % 8 as string)) as alias
from nation
""",
    "nation",
)


@view("records")
def records(inputs) -> DataFrame:
    base = inputs.v("report_base")
    return base.withColumn("rig", S.canonical_rig(F.col("rig_raw"), CONTRACTOR))


cte(
    "records",
    """
select *, case when rig_raw in ('UNKNOWN', '') then rig_raw else 'ACME ' || right(rig_raw, 3) end as rig,
  case when rig_raw in ('UNKNOWN', '') then false else true end as rig_ok
from report_base
""",
    "report_base",
)


def _enriched(base: DataFrame) -> DataFrame:
    return base.select(
        "*",
        S.effective_op_type(F.col("confirmed_op_type"), F.col("op_type"), F.col("system_op_type")).alias("eff_type"),
        S.system_op_type(F.col("system_op_type"), F.col("op_type")).alias("sys_type"),
        S.safe_float(F.col("hours")).alias("h"),
        S.op_category(F.col("op_code"), F.col("op_sub")).alias("reason"),
    )


@view("operations")
def operations(inputs) -> DataFrame:
    return _enriched(inputs.v("operation_base"))


OPERATION_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@view("numbered_operations")
def numbered_operations(inputs) -> DataFrame:
    """Operations with the dense row number they have inside their report.

    The raw numeric rows are numbered first; the texts are derived after that
    shuffle, so they neither travel nor get built before the rows are spread.
    """
    raw = inputs.t("lineitem").select("l_orderkey", "l_returnflag", *OPERATION_ORDER)
    sliced = raw.withColumn("slice", F.floor(F.col("l_partkey") / 512))
    numbered = ordering.number_rows(
        sliced, keys=["l_orderkey"], slices=["l_linenumber", "slice"], order=list(OPERATION_ORDER), name="row_no"
    ).drop("slice")
    text = OPERATION_SQL.replace("select l_orderkey as rk", "select row_no, l_orderkey as rk").replace("from lineitem", "from {rows}")
    return _enriched(inputs.spark.sql(text, rows=numbered))


cte(
    "operations",
    """
select *, upper(trim(case when confirmed_op_type <> '' then confirmed_op_type when op_type <> '' then op_type
    else system_op_type end)) as eff_type,
  upper(case when system_op_type <> '' then system_op_type else op_type end) as sys_type,
  coalesce(try_cast(hours as double), 0.0) as h,
  case when op_sub = '' then op_code else op_code || ' / ' || op_sub end as reason,
  row_number() over (partition by rk order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax) as row_no
from operation_base
""",
    "operation_base",
)
