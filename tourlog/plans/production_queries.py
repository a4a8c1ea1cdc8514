"""Production questions over the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.operators import assignment as A
from tourlog.operators import production as P
from tourlog.plans.fixtures import CONTRACTOR
from tourlog.plans.registry import query


@query(
    "npt_by_rig",
    """
select case when rig = '' then '未识别井队' else rig end as label, coalesce(sum(npt_h), 0.0) as hours
from facts group by rig having rig <> '' or sum(n_npt) > 0
""",
    uses=("facts",),
)
def npt_by_rig(i):
    return P.npt_by_rig(i.v("facts"))


@query(
    "record_hours",
    """
select r.record_id, coalesce(p_h, 0.0) as p_hours, coalesce(sc_h, 0.0) as sc_hours, coalesce(npt_h, 0.0) as npt_hours
from records r left join record_hours h on r.record_id = h.record_id
""",
    uses=("records", "record_hours"),
)
def record_hours(i):
    return P.record_hours(i.v("records"), i.v("record_hours"))


_PIVOT = ", ".join(
    f"sum(case when report_type = '{t}' then total_h else 0.0 end) as {t}" for t in dims.REPORT_TYPES
)


@query(
    "hours_by_rig",
    f"select case when rig = '' then '未识别井队' else rig end as rig, {_PIVOT} from facts where n_ops > 0 group by 1",
    uses=("facts",),
)
def hours_by_rig(i):
    return P.hours_pivot(i.v("facts"), S.pick(F.col("rig"), F.lit(dims.UNKNOWN_RIG)), "rig").orderBy("rig")


@query(
    "hours_by_month",
    f"select left(report_date, 7) as month, {_PIVOT} from facts where n_ops > 0 group by 1",
    uses=("facts",),
)
def hours_by_month(i):
    month = S.pick(F.substring("report_date", 1, 7), F.lit(dims.UNKNOWN_LABEL))
    return P.hours_pivot(i.v("facts"), month, "month").orderBy("month")


@query(
    "hours_by_type",
    """
select t.report_type, t.label, coalesce(sum(f.total_h), 0.0) as hours
from (values ('drilling', '钻井'), ('completion', '完井'), ('workover', '修井'), ('move', '搬迁/推井架')) t(report_type, label)
left join facts f on f.report_type = t.report_type group by 1, 2
""",
    uses=("facts",),
)
def hours_by_type(i):
    return P.hours_by_type(i.v("facts"))


_COVER = """
count(distinct nullif(report_date, '')) as days,
count(distinct case when validation_status = 'warning' then nullif(report_date, '') end) as warning_days,
(date_diff('day', min(report_date)::date, max(report_date)::date) + 1 - count(distinct report_date))::bigint as missing_days
"""
_PERCENT = "greatest(0.0, (days - warning_days * 0.35::double) / (days + missing_days) * 100) as percent"


@query(
    "production_kpis",
    f"""
select *, {_PERCENT} from (
  select count(distinct nullif(rig, '')) as rig_count, count(distinct nullif(wellbore, '')) as well_count,
    sum(total_h) as total_hours, sum(npt_h) as npt_hours, {_COVER} from facts)
""",
    uses=("facts",),
)
def production_kpis(i):
    return P.production_kpis(i.v("facts"))


@query(
    "completeness",
    f"select *, {_PERCENT} from (select rig, {_COVER} from records group by rig)",
    uses=("records",),
)
def completeness(i):
    return P.completeness(i.v("records"), "rig")


@query(
    "missing_dates",
    """
with recursive_days as (select rig, unnest(generate_series(min(report_date)::date, max(report_date)::date, interval 1 day))::date as d
  from records group by rig)
select c.rig, strftime(c.d, '%Y-%m-%d') as missing_date from recursive_days c
left join (select distinct rig, report_date from records) r on r.rig = c.rig and r.report_date = strftime(c.d, '%Y-%m-%d')
where r.rig is null
""".replace("with recursive_days as", ", recursive_days as"),
    uses=("records",),
)
def missing_dates(i):
    return P.missing_dates(i.v("records"), "rig")


@query(
    "production_details",
    """
select g.project_id, g.project_name, case when g.rig = '' then '未识别井队' else g.rig end as rig, g.wellbore, g.report_type,
  g.start_date, g.end_date,
  case when g.report_type = 'drilling' then g.hours else 0.0 end as drilling_hours,
  case when g.report_type = 'completion' then g.hours else 0.0 end as completion_hours,
  case when g.report_type = 'workover' then g.hours else 0.0 end as workover_hours,
  case when g.report_type = 'move' then g.hours else 0.0 end as move_hours,
  g.npt_hours, f.record_id,
  case when g.rig <> '' and o.validation_status = 'warning' then '有告警' else '正常' end as status
from (select project_id, max(project_name) as project_name, rig, wellbore, report_type, min(report_date) as start_date,
    max(report_date) as end_date, sum(total_h) as hours, sum(npt_h) as npt_hours
  from facts where n_ops > 0 group by project_id, rig, wellbore, report_type) g
join (select *, row_number() over (partition by project_id, rig, wellbore, report_type
    order by report_date desc, updated_at desc, rk desc) as k from facts where n_ops > 0) f
  on f.k = 1 and f.project_id = g.project_id and f.rig = g.rig and f.wellbore = g.wellbore and f.report_type = g.report_type
join (select *, row_number() over (partition by project_id, rig, wellbore, report_type
    order by report_date, updated_at, rk) as k from facts) o
  on o.k = 1 and o.project_id = g.project_id and o.rig = g.rig and o.wellbore = g.wellbore and o.report_type = g.report_type
""",
    uses=("facts",),
)
def production_details(i):
    return P.production_details(i.v("facts"))


_STAGES = """
coalesce(min(case when report_type = 'drilling' and lower(event) like '%rig move%' then report_date end), '') as move_date,
coalesce(min(case when report_type = 'drilling' and lower(event) like '%drilling%' then report_date end), '') as drilling_start_date,
coalesce(max(case when report_type = 'completion' then report_date end), '') as completion_date,
coalesce(min(case when report_type = 'workover' and lower(event) like '%workover%' then report_date end), '') as workover_date
"""
_NEWEST = "struct_pack(a := report_date, b := updated_at, c := rk)"


def _remarks(i):
    """Saved remarks keyed by project, rig and well, from the contract table."""
    return i.v("project_rigs").filter("well <> ''").select(
        F.concat_ws("|", "project_id", "rig", "well").alias("remark_key"),
        F.concat(F.lit("see "), F.col("project_contract")).alias("remarks"),
    ).distinct()


_PROJECT_REPORT = f"""
select g.*, case when project_contract <> '' and project_name <> '' and project_contract <> project_name
    then project_contract || ' / ' || project_name when project_contract <> '' then project_contract
    when project_name <> '' then project_name else '-' end as contract_project,
  coalesce(m.remarks, '') as remarks
from (
  select project_id, case when rig = '' then '未识别井队' else rig end as rig, wellbore,
    max(project_name) as project_name, max(project_contract) as project_contract,
    max_by(record_id, {_NEWEST}) as record_id, max_by(report_type, {_NEWEST}) as report_type, {_STAGES},
    coalesce(max(case when report_type = 'drilling' and lower(event) like '%drilling%' then report_date end), '')
      as drilling_finish_date,
    coalesce(sum(case when report_type = 'move' then total_h end), 0.0) as move_hours,
    coalesce(sum(case when report_type = 'drilling' then total_h end), 0.0) as drilling_hours,
    coalesce(sum(case when report_type = 'completion' then total_h end), 0.0) as completion_hours,
    coalesce(sum(case when report_type = 'workover' then total_h end), 0.0) as workover_hours,
    coalesce(sum(npt_h), 0.0) as npt_hours,
    case when bool_or(validation_status = 'warning') then '有告警' else '正常' end as status,
    project_id || '|' || case when rig = '' then '未识别井队' else rig end || '|' || wellbore as remark_key
  from project_facts group by project_id, rig, wellbore) g
left join (select distinct project_id || '|' || rig || '|' || well as remark_key, 'see ' || project_contract as remarks
  from project_rigs where well <> '') m on m.remark_key = g.remark_key
"""


@query("project_report", _PROJECT_REPORT, uses=("project_facts",))
def project_report(i):
    return P.project_report(i.v("project_facts"), _remarks(i), CONTRACTOR)


_DASH = ", ".join(
    f"case when {c} = '' then '-' else {c} end as {c}"
    for c in (
        "wellbore", "rig", "contract_project", "move_date", "drilling_start_date", "drilling_finish_date",
        "completion_date", "workover_date",
    )
)


@query(
    "dump_production_report",
    f"""
select {_DASH}, move_hours, drilling_hours, completion_hours, workover_hours, npt_hours,
  case when remarks = '' then '-' else remarks end as remarks from ({_PROJECT_REPORT})
""",
    uses=("project_facts",),
)
def dump_production_report(i):
    from tourlog.sources.sinks import production_export

    return production_export(project_report(i), show_rig=True)


@query(
    "well_stats",
    f"""
select report_type, wellbore, count(distinct nullif(report_date, '')) as days, coalesce(sum(total_h), 0.0) as total_hours,
  coalesce(sum(npt_h), 0.0) as npt_hours, coalesce(sum(p_h), 0.0) as p_hours, coalesce(sum(sc_h), 0.0) as sc_hours,
  coalesce(max_by(rig, {_NEWEST}) filter (rig <> ''), '') as rig,
  coalesce(max_by(afe_number, {_NEWEST}) filter (afe_number <> ''), '') as afe_number, {_STAGES}
from records r left join record_hours h on h.record_id = r.record_id group by report_type, wellbore
""",
    uses=("records", "record_hours"),
)
def well_stats(i):
    facts = i.v("records").join(i.v("record_hours"), "record_id", "left")
    return P.well_stats(facts, "report_type", "wellbore")


@query(
    "sort_export",
    f"select wellbore, move_date, npt_hours, remark_key from ({_PROJECT_REPORT})",
    uses=("project_facts",),
)
def sort_export(i):
    rows = project_report(i).select("wellbore", "move_date", "npt_hours", "remark_key")
    return P.sort_export(rows, "move_date", "desc", ("npt_hours",))


@query(
    "filter_options",
    """
select distinct kind, value from (
  select 'rig' as kind, rig as value from records where rig_ok
  union all select 'rig', rig from project_rigs where project_status in ('active', '')
  union all select 'well', wellbore from records where wellbore <> ''
  union all select 'project', project_id from project_rigs where project_status in ('active', ''))
""",
    uses=("records", "project_rigs"),
)
def filter_options(i):
    return P.filter_options(i.v("records"), i.v("bindings"), CONTRACTOR)


@query(
    "records_by_type",
    """
select case when report_type = '' then 'unknown' else report_type end as report_type, count(*) as n from records group by 1
union all select 'total', count(*) from records
""",
    uses=("records",),
)
def records_by_type(i):
    return P.records_by_type(i.v("records"))


@query(
    "filter_facts",
    """
select report_type, wellbore, count(*) as n, sum(coalesce(npt_h, 0.0)) as npt_hours
from records r left join record_hours h on h.record_id = r.record_id
where report_date >= '1997-01-01' and report_date <= '1999-12-31' and rig in ('ACME 101', 'ACME 104', 'ACME 106')
  and report_type = 'drilling' and lower(wellbore) like '%w-0%'
group by report_type, wellbore
""",
    uses=("records", "record_hours"),
)
def filter_facts(i):
    kept = P.filter_facts(
        i.v("records"), "1997-01-01", "1999-12-31", ("00 ACME 101, ACME-104", "acme106"), "drilling", "w-0", CONTRACTOR
    )
    hours = i.v("record_hours")
    return (
        kept.join(hours, "record_id", "left")
        .groupBy("report_type", "wellbore")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("npt_h", F.lit(0.0))).alias("npt_hours"))
    )


@query(
    "project_assignment",
    "select record_id, project_id, project_name, project_contract from assigned",
    uses=("assigned",),
)
def project_assignment(i):
    rows = A.assign_projects(i.v("records"), i.v("project_windows"))
    return rows.select("record_id", "project_id", "project_name", "project_contract")


@query(
    "rig_alias_match",
    """
select distinct p.rig as configured, case when x.k = 0 then p.rig when p.rig like 'OLD%' then replace(p.rig, 'OLD RIG ', 'ACME 10')
  else replace(p.rig, 'ACME 10', 'OLD RIG ') end as reported
from project_rigs p, (values (0), (1)) x(k)
""",
    uses=("project_rigs",),
)
def rig_alias_match(i):
    rows = A.reachable_bindings(i.v("bindings"), i.v("team_list"))
    return rows.select(F.col("rig").alias("configured"), "reported").distinct()


@query(
    "unassigned_fill",
    """
select project_id, project_name, count(*) as n_records, sum(coalesce(total_h, 0.0)) as hours
from project_facts group by project_id, project_name
""",
    uses=("project_facts",),
)
def unassigned_fill(i):
    return (
        i.v("project_facts")
        .groupBy("project_id", "project_name")
        .agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.coalesce("total_h", F.lit(0.0))).alias("hours"))
    )


@query(
    "pending_wells",
    """
select rig, wellbore, report_type, record_id from (
  select *, row_number() over (partition by rig, wellbore order by report_date desc, updated_at desc, rk desc) as k
  from records r where report_type in ('drilling', 'completion', 'workover') and rig_ok and wellbore <> ''
    and not exists (select 1 from assigned a where a.record_id = r.record_id)) where k = 1
""",
    uses=("assigned",),
)
def pending_wells(i):
    return A.pending_wells(i.v("records"), i.v("project_windows")).orderBy("rig", "wellbore")
