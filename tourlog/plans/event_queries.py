"""Event logs, job states, streaming runs, and source and sink round trips."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.operators import logs as LG
from tourlog.operators import ordering
from tourlog.operators import terms as TM
from tourlog.plans import quality_queries as QQ
from tourlog.plans.fixtures import CONTRACTOR
from tourlog.plans.registry import cte, query, view
from tourlog.session import materialise, shared_dir
from tourlog.sources import events as EV
from tourlog.sources import payloads as PL
from tourlog.sources import structured as SR
from tourlog.streaming import intake as IN
from tourlog.streaming import jobs as ST
from tourlog.streaming import timed as TD
from tourlog.streaming.changelog import ChangeLog


@view("job_events")
def job_events(i):
    """Events with the generation of their job and the value in whole cents."""
    k = F.try_element_at(S.json_or_empty(F.col("props")), F.lit("k")).try_cast("int")
    return i.t("events").select(
        "event_id", "ts", "user_id", "event_type", F.coalesce(k, F.lit(0)).alias("generation"),
        F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("bigint").alias("cents"),
    )


cte(
    "job_events",
    """
select event_id, ts, user_id, event_type, coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) as generation,
  coalesce(round(value * 100), 0)::bigint as cents from events
""",
)


@query(
    "latest_n_per_kind",
    """
select event_id, event_type, row_number() over (partition by event_type order by ts desc, event_id desc) as rank from job_events qualify rank <= 30
""",
    uses=("job_events",),
)
def latest_n_per_kind(i):
    return LG.latest_per_kind(i.v("job_events"), "event_type", ["ts", "event_id"], 30).select("event_id", "event_type", "rank")


@query(
    "audit_tail",
    "select event_id, event_type, generation from job_events order by ts desc, event_id desc limit 200",
    uses=("job_events",),
)
def audit_tail(i):
    return LG.tail(i.v("job_events"), ["ts", "event_id"], 200).select("event_id", "event_type", "generation")


_LOG = """
log as (select event_id, ts, '{"time":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","event":"' || event_type || '","n":' || cents || '}' as line from job_events),
last as (select *, octet_length(line::blob) + 1 as bytes from (select * from log where ts >= (select max(ts) from log) - interval 7 day order by event_id desc limit 500)),
kept as (select * from (select *, sum(bytes) over (order by event_id desc) as s from last where bytes <= 9000) where s <= 9000)
"""


def _log(i):
    line = F.concat(
        F.lit('{"time":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('","event":"'), "event_type", F.lit('","n":'),
        F.col("cents").cast("string"), F.lit("}"),
    )
    # the log's own newest time stands for the wall clock
    log = i.v("job_events").select("event_id", F.col("ts").cast("string").alias("time"), line.alias("line"))
    newest = i.v("job_events").agg(F.max("ts").cast("timestamp")).scalar()
    return log, LG.retention(log, "time", "event_id", "line", newest, 7, 500, 9000)


@query("log_retention", "," + _LOG + "select event_id from kept", uses=("job_events",))
def log_retention(i):
    return _log(i)[1].select("event_id")


@query(
    "log_retention_report",
    "," + _LOG + "select (select count(*) from log) as before, count(*) as after, coalesce(sum(bytes), 0)::bigint as bytes from kept",
    uses=("job_events",),
)
def log_retention_report(i):
    log, kept = _log(i)
    return LG.retention_report(log, kept)


_USAGE = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, sum(cents)::bigint as cents from job_events group by all"
_STATE = """
select user_id, event_type, generation from job_events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
"""
_FRESH = """
select e.event_id, e.user_id, e.generation from job_events e
left join (select user_id, max(generation) as g from job_events where event_type = 'error' group by user_id) c on c.user_id = e.user_id
where c.g is null or e.generation >= c.g
"""


@query("usage_metrics", _USAGE, uses=("job_events",))
def usage_metrics(i):
    return LG.usage_by_day(i.v("job_events").withColumn("time", F.col("ts").cast("timestamp")), "time")


@query("job_state_latest", _STATE, uses=("job_events",))
def job_state_latest(i):
    return LG.latest_state(i.v("job_events"), "user_id", ["ts", "event_id"], ["event_type", "generation"])


@query("stale_generation_drop", _FRESH, uses=("job_events",))
def stale_generation_drop(i):
    jobs = i.v("job_events")
    current = LG.current_generations(jobs.filter("event_type = 'error'"), "user_id", "generation")
    return LG.drop_stale(jobs, current, "user_id", "generation").select("event_id", "user_id", "generation")


def _event_stream(i):
    raw = ST.parquet_stream(i.spark, i.sf_dir, "events.parquet", i.t("events").schema)
    k = F.try_element_at(S.json_or_empty(F.col("props")), F.lit("k")).try_cast("int")
    return raw.select(
        "event_id", "ts", "user_id", "event_type", F.coalesce(k, F.lit(0)).alias("generation"),
        F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("bigint").alias("cents"),
    )


@query("usage_metrics_stream", _USAGE, uses=("job_events",))
def usage_metrics_stream(i):
    updates = ST.run_to_table(ST.usage_windows(_event_stream(i)), "update", "usage")
    return ST.latest_update(updates, ["day", "event_type"])


@query("job_state_stream", _STATE, uses=("job_events",))
def job_state_stream(i):
    states = ST.job_states(_event_stream(i), "user_id", ["ts", "event_id"], ["event_type", "generation"])
    return ST.latest_update(ST.run_to_table(states, "update", "states"), ["user_id"])


@query("stale_generation_stream", _FRESH, uses=("job_events",))
def stale_generation_stream(i):
    current = LG.current_generations(i.v("job_events").filter("event_type = 'error'"), "user_id", "generation")
    kept = ST.fresh_results(_event_stream(i), current, "user_id", "generation")
    return ST.run_to_table(kept.select("event_id", "user_id", "generation"), "append", "fresh").drop("batch_id")


@query(
    "report_arrival_stream",
    """
, n as (select 'R' || (o_orderkey * 2) as record_id, case when o_custkey % 50 = 0 then 'unknown' else 'move' end as report_type, 'ACME 1' as rig,
    'W-' || (o_custkey % 50) as wellbore, substring(cast(o_orderdate as string), 1, 10) as report_date from orders),
good as (select n.* from n left join records r on r.record_id = n.record_id where n.report_type = 'move' and coalesce(r.locked, '') <> 'yes')
select coalesce(r.record_id, n.record_id) as record_id, coalesce(n.report_type, r.report_type) as report_type,
  coalesce(n.wellbore, r.wellbore) as wellbore, coalesce(n.report_date, r.report_date) as report_date, coalesce(r.locked, '') as locked
from records r full join good n on n.record_id = r.record_id
""",
    uses=("records",),
)
def report_arrival_stream(i):
    """Half of the arriving reports update stored ones, half are new."""
    raw = ST.parquet_stream(i.spark, i.sf_dir, "orders.parquet", i.t("orders").schema)
    arrivals = raw.select(
        F.concat(F.lit("R"), (F.col("o_orderkey") * 2).cast("string")).alias("record_id"),
        F.when(F.col("o_custkey") % 50 == 0, "unknown").otherwise("move").alias("report_type"), F.lit("ACME 1").alias("rig"),
        F.concat(F.lit("W-"), (F.col("o_custkey") % 50).cast("string")).alias("wellbore"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("report_date"), F.lit("").alias("locked"),
        F.col("o_orderkey").alias("arrival"),
    )
    stored = i.v("records").select("record_id", "report_type", "rig", "wellbore", "report_date", "locked")
    path = ST.intake(arrivals, stored, shared_dir(i.spark, "intake"), ["arrival"])
    out = i.spark.read.schema(stored.schema).parquet(path)
    return out.select("record_id", "report_type", "wellbore", "report_date", "locked")


def _arrivals(ops, heads):
    """Three waves of reports: half with edited texts, a third as they were (some of an unknown type), a sixth once more.

    ``ops`` are the rows of all reports with ``edit``, which marks those to edit; a wave reads and collects its own rows only.
    """
    edited = F.when(F.col("edit"), F.concat("operation_details", F.lit(" edited"))).otherwise(F.col("operation_details"))
    cells = ["from_time", "to_time", "hours", "op_code", "op_type"]
    key = F.col("record_id").substr(F.lit(2), F.lit(20)).cast("bigint")
    none = F.array().cast(f"array<struct<{IN.OPERATION}>>")
    waves = []
    plain = F.col("operation_details")
    for n, every, kind, text in (
        (1, 2, F.col("report_type"), edited), (2, 3, F.when(key % 5 == 0, "unknown").otherwise(F.col("report_type")), plain),
        (3, 6, F.when(key % 5 == 0, "unknown").otherwise(F.col("report_type")), plain),
    ):
        row = F.array_sort(F.collect_list(F.struct("row_no", *cells, text.alias("operation_details"))))
        pages = ops.filter(key % every == 0).groupBy("record_id", F.floor(F.col("row_no") / 1000).cast("int").alias("page")).agg(row.alias("rows"))
        waves.append(
            heads.filter(key % every == 0).join(pages, "record_id", "left").select(
                "record_id", kind.alias("report_type"), "rig", "wellbore", "report_date", "fields", F.coalesce("rows", none).alias("operations"),
                F.lit(n).cast("bigint").alias("arrival"), F.coalesce("page", F.lit(0)).alias("page"),
            )
        )
    return waves


@query(
    "report_intake_stream",
    f"""
, t as (select r.*, substr(r.record_id, 2)::bigint as k, r.locked <> 'yes' and trim(r.rig) <> '' and trim(r.wellbore) <> '' and trim(r.report_date) <> '' as open
  from records r),
w as (select *, open and k % 2 = 0 as first, open and k % 3 = 0 and k % 5 <> 0 as second from t),
o as (select record_id, count(*) as n_ops, count(*) filter (l_suppkey % 40 = 0) as marked, count(*) filter (upper(trim(op_type)) = 'NPT') as npt,
  count(*) filter (upper(trim(op_type)) = 'NPT' and l_suppkey % 40 = 0) as npt_marked from operations group by record_id),
v as (select distinct record_id from (({QQ._HEADER_RULES}) union all ({QQ._ROW_RULES})))
select w.record_id, coalesce(n_ops, 0) as n_ops, case when first and not second then coalesce(marked, 0) else 0 end as edited,
  case when first and marked > 0 then 'PENDING' else translation_status end as translation_status,
  case when not first and not second then extraction_status when coalesce(npt, 0) = 0 then 'NOT_REQUIRED'
    when extraction_version not in ('', 'v2') or (first and npt_marked > 0) then 'QUEUED' else extraction_status end as extraction_status,
  case when not first and not second then validation_status when v.record_id is null then 'ok' else 'warning' end as validation_status
from w left join o using (record_id) left join v using (record_id)
""",
    uses=("records", "field_base", "operations", "record_hours"),
)
def report_intake_stream(i):
    """Headers, rows, rules and job states of reports that arrive in three runs; the second one compacts."""
    log = ChangeLog(i.spark, shared_dir(i.spark, "reports"), IN.TABLES)
    # read by the base, the signatures and each wave: numbered once
    numbered = i.v("numbered_operations").select(*IN.OPERATIONS.names, (F.col("l_suppkey") % 40 == 0).alias("edit"))
    numbered = materialise(numbered, "numbered")
    operations = numbered.select(*IN.OPERATIONS.names)
    heads = materialise(i.v("records").join(i.v("headers").select("record_id", "fields"), "record_id"), "heads")
    lock = {c: F.lit("").alias(c) for c in IN.HEADERS.names if c.startswith("confirm")} | {"n_warnings": F.lit(0).cast("bigint").alias("n_warnings")}
    known = heads.join(IN.signed(operations), "record_id", "left")
    stored = known.select(*[lock.get(c, F.col(c)) for c in IN.HEADERS.names])
    log.load({"headers": stored, "operations": operations, "warnings": i.spark.createDataFrame([], IN.WARNINGS)})
    folder = shared_dir(i.spark, "arrivals")
    for n, wave in enumerate(_arrivals(numbered, heads)):
        wave.write.parquet(f"{folder}/p{n}")
        source = i.spark.readStream.schema(IN.ARRIVAL).parquet(f"{folder}/*")
        IN.run_intake(source, log, IN.Policy(as_of=QQ.AS_OF, rule_version="v2", compact_after=2))
    rows = log.state("operations").groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_ops"), F.count_if(F.col("operation_details").endswith(" edited")).alias("edited")
    )
    states = ["translation_status", "extraction_status", "validation_status"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return log.state("headers").select("record_id", *states).join(rows, "record_id", "left").select("record_id", zero("n_ops"), zero("edited"), *states)


# events in three waves by their number, so that most of a later wave is older than what came before
cte(
    "waved_events",
    """
select *, case event_id % 3 when 0 then false when 1 then ts < m[1] - interval 10 day else ts < greatest(m[1], m[2]) - interval 10 day end as late
from job_events, (select [max(ts) filter (event_id % 3 = 0), max(ts) filter (event_id % 3 = 1)] as m from job_events)
""",
    "job_events",
)


def _waves(i, take):
    folder = shared_dir(i.spark, "waves")
    events = i.v("job_events").withColumn("time", F.col("ts").cast("timestamp")).withColumn("record_id", F.col("user_id").cast("string"))
    rows = events.select("event_id", "record_id", "time", "event_type", "cents", F.col("generation").cast("bigint").alias("generation"))
    for n in range(3):
        rows.filter(F.col("event_id") % 3 == n).write.parquet(f"{folder}/p{n}")
        take(i.spark.readStream.schema(rows.schema).parquet(f"{folder}/*"))


@query(
    "usage_late_stream",
    """
select strftime(ts, '%Y-%m-%d') as day, event_type, late, count(*) as n, sum(cents)::bigint as cents from waved_events group by all
""",
    uses=("waved_events",),
)
def usage_late_stream(i):
    """Usage of three runs, in time and late: together they are the usage of all events."""
    run = TD.TimedRun(i.spark, shared_dir(i.spark, "usage"), timedelta(days=10))
    _waves(i, lambda stream: TD.count_usage(stream, run, compact_after=2))
    late = run.read("late", "event_id bigint, time timestamp, event_type string, cents bigint")
    aside = late.groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return TD.usage(run).withColumn("late", F.lit(False)).unionByName(aside.withColumn("late", F.lit(True)))


@query(
    "job_state_expiry_stream",
    """
select user_id::varchar as record_id, event_type, generation::bigint as generation from waved_events where not late
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
""",
    uses=("waved_events",),
)
def job_state_expiry_stream(i):
    """Latest state of every job from the events in time; jobs silent for five days are in the archive."""
    run = TD.TimedRun(i.spark, shared_dir(i.spark, "jobs"), timedelta(days=10))
    log = TD.state_log(i.spark, run.root, "event_id bigint, event_type string, generation bigint")
    _waves(i, lambda stream: TD.keep_states(stream, run, log, timedelta(days=5), compact_after=2))
    return TD.all_states(log).select("record_id", "event_type", "generation")


# --- sources and sinks -----------------------------------------------------------------------------------


@query(
    "jsonl_event_source",
    "select event_type as kind, count(*) as n, sum(cents)::bigint as cents from job_events where generation > 9 group by all",
    uses=("job_events",),
)
def jsonl_event_source(i):
    """A JSON log in which the lines of young jobs are cut off: only whole lines count."""
    whole = F.to_json(F.struct(F.col("ts").cast("string").alias("time"), F.col("event_type").alias("kind"), F.col("cents").cast("double").alias("value")))
    line = F.when(F.col("generation") > 9, whole).otherwise(F.lit('{"time": "2024'))
    path = shared_dir(i.spark, "jsonl")
    i.v("job_events").select(line.alias("value")).write.text(path)
    events = EV.read_events(i.spark, path)
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("cents"))


@query(
    "jsonl_event_sink",
    "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from job_events group by 1",
    uses=("job_events",),
)
def jsonl_event_sink(i):
    rows = _event_stream(i).select(F.col("ts").cast("string").alias("time"), F.col("event_type").alias("kind"))
    log = ST.event_sink(rows, shared_dir(i.spark, "sink"))
    back = i.spark.read.schema("time string, kind string, day string").json(log)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@view("report_rows")
def report_rows(i):
    """Long detail table: module, row number and row map."""
    names = {"from": "from_time", "to": "to_time", "hours": "hours", "op_code": "op_code", "op_sub": "op_sub", "op_type": "op_type",
             "operation_details": "operation_details"}
    pairs = [v for n, c in names.items() for v in (F.lit(n), F.col(c))]
    kind = F.when(F.col("l_suppkey") % 4 == 3, "bulks").otherwise("operations")
    return i.v("numbered_operations").select("record_id", kind.alias("module_name"), "row_no", F.create_map(*pairs).alias("row"))


@query(
    "load_payloads",
    """
select r.record_id, 0 as page, r.event, coalesce(o.details, '') as operations, coalesce(b.details, '') as bulks from records r
left join (select record_id, string_agg(operation_details, '|' order by row_no) as details from operations where l_suppkey % 4 <> 3 group by 1) o on o.record_id = r.record_id
left join (select record_id, string_agg(operation_details, '|' order by row_no) as details from operations where l_suppkey % 4 = 3 group by 1) b on b.record_id = r.record_id
""",
    uses=("records", "operations"),
)
def load_payloads(i):
    pages = PL.payload_pages(i.v("headers").select("record_id", "fields"), i.v("report_rows"))

    def joined(module):
        rows = F.coalesce(F.try_element_at("modules", F.lit(module)), F.array().cast("array<map<string,string>>"))
        return F.array_join(F.transform(rows, lambda r: r["operation_details"]), "|").alias(module)

    return pages.select("record_id", "page", F.col("fields")["event"].alias("event"), joined("operations"), joined("bulks"))


@query(
    "json_payload_source",
    "select record_id, case when l_suppkey % 4 = 3 then 'bulks' else 'operations' end as module_name, row_no, h, operation_details from operations",
    uses=("operations",),
)
def json_payload_source(i):
    """Reports written as JSON texts and shredded back into detail rows."""
    pages = PL.payload_pages(i.v("headers").select("record_id", "fields"), i.v("report_rows"))
    meta = F.create_map(F.lit("record_id"), F.col("record_id"), F.lit("report_type"), F.lit("move"))
    modules = [F.try_element_at("modules", F.lit(m)).alias(m) for m in ("operations", "bulks")]
    texts = pages.select(F.to_json(F.struct(meta.alias("metadata"), F.col("fields").alias("report_fields"), *modules)).alias("text"))
    _, _, rows = PL.shred(PL.parse_payloads(texts, "text"))
    row = F.col("row")
    return rows.select(
        "record_id", "module_name", "row_no", S.safe_float(row["hours"]).alias("h"), row["operation_details"].alias("operation_details")
    )


@query(
    "scan_records",
    """
select record_id, report_date, event, afe_number from records where report_type = 'drilling' and report_date >= '1996-01-01' and report_date <= '1999-06-30'
""",
    uses=("records",),
)
def scan_records(i):
    fields = i.v("headers").select("record_id", "fields")
    rows = PL.scan_records(i.v("records"), fields, report_type="drilling", date_from="1996-01-01", date_to="1999-06-30")
    return rows.select("record_id", "report_date", "event", "afe_number")


@query(
    "scan_operations_typed",
    "select record_id, row_no, h, op_code, op_type from operations where l_suppkey % 4 <> 3",
    uses=("operations",),
)
def scan_operations_typed(i):
    return PL.typed_operations(i.v("report_rows")).select("record_id", "row_no", "h", "op_code", "op_type")


@query(
    "records_fields_join",
    "select r.record_id, r.report_type, f.today_md, f.mud_type from records r left join field_base f on f.record_id = r.record_id",
    uses=("records", "field_base"),
)
def records_fields_join(i):
    return i.v("records").join(i.v("field_base"), "record_id", "left").select("record_id", "report_type", "today_md", "mud_type")


@query(
    "records_operations_join",
    """
select r.record_id, r.wellbore, coalesce(o.op_code, '') as op_code, count(*) as n, sum(coalesce(o.h, 0.0)) as hours
from records r left join operations o on o.record_id = r.record_id group by all
""",
    uses=("records", "operations"),
)
def records_operations_join(i):
    per = i.v("operations").groupBy("record_id", "op_code").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("hours"))
    rows = i.v("records").select("record_id", "wellbore").join(per, "record_id", "left")
    return rows.select(
        "record_id", "wellbore", F.coalesce("op_code", F.lit("")).alias("op_code"), F.coalesce("n", F.lit(1)).alias("n"),
        F.coalesce("hours", F.lit(0.0)).alias("hours"),
    )


@query(
    "structured_tables_sink",
    """
select 'fields' as table_name, count(*) as n from report_base union all select 'operations', count(*) from operations where l_suppkey % 4 <> 3
union all select 'warnings', count(*) from report_base where wellbore = ''
""",
    uses=("report_base", "operations"),
)
def structured_tables_sink(i):
    from tourlog.sources.sinks import write_tables

    path = shared_dir(i.spark, "tables")
    tables = {
        "fields": i.v("headers").select("record_id", "fields"),
        "operations": PL.typed_operations(i.v("report_rows")),
        "warnings": i.v("records").filter("wellbore = ''").select("record_id"),
    }
    write_tables(tables, path)
    out = None
    for name in tables:
        n = i.spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_FIELD_CELLS = ", ".join(f"('{name}', {col})" for name, col in sorted(QQ.HEADER_FIELDS.items()))
_ROW_CELLS = "from_time || '|' || hours || '|' || op_code || '|' || operation_details"


def _report_texts(i):
    """Reports as JSON texts, one in fifty cut short, one in fifty empty of content."""
    pages = PL.payload_pages(i.v("headers").select("record_id", "fields"), i.v("report_rows"), page_size=1_000_000)
    meta = F.create_map(F.lit("record_id"), F.col("record_id"), F.lit("report_type"), F.lit("move"))
    modules = [F.try_element_at("modules", F.lit(m)).alias(m) for m in ("operations", "bulks")]
    text = F.to_json(F.struct(meta.alias("metadata"), F.col("fields").alias("report_fields"), *modules))
    key = F.col("record_id").substr(F.lit(2), F.lit(20)).cast("bigint")
    return pages.select("record_id", F.when(key % 50 == 7, F.substring(text, 1, 40)).when(key % 50 == 8, "{}").otherwise(text).alias("text"))


@query(
    "structured_tables",
    f"""
, t as (select r.*, f.* exclude (record_id), substr(r.record_id, 2)::bigint % 50 as k
  from records r join field_base f on f.record_id = r.record_id),
g as (select * from t where k not in (7, 8)),
cells as (select record_id, unnest(range(1, {len(QQ.HEADER_FIELDS) + 1})) as row_no, unnest([{_FIELD_CELLS}]) as c from g)
select 'report_fields' as table_name, record_id, row_no::int as row_no, c[1] || '=' || c[2] as cells from cells
union all select 'metadata', record_id, unnest([1, 2]), unnest(['record_id=' || record_id, 'report_type=move']) from g
union all select case when l_suppkey % 4 = 3 then 'bulks' else 'operations' end, o.record_id, row_no, {_ROW_CELLS} from operations o join g on g.record_id = o.record_id
union all select 'parse_warnings', record_id, row_number() over (partition by record_id order by n), w from (
  select record_id, unnest(['wellbore missing', 'rig missing']) as w, unnest([trim(wellbore) = '', trim(rig) = '']) as is_on, unnest([1, 2]) as n from g) where is_on
union all select 'failures', record_id, 0, case when k = 7 then 'not a JSON object' else 'no report in it' end from t where k in (7, 8)
""",
    uses=("records", "field_base", "operations"),
)
def structured_tables(i):
    """All tables of the reports, written in one job and read back one by one."""
    path = shared_dir(i.spark, "structured")
    SR.write_routed(SR.route_reports(_report_texts(i), "record_id", "text"), path)
    joined = lambda sep, *c: F.concat_ws(sep, *c).alias("cells")
    shown = {
        "report_fields": (["field", "value"], joined("=", "field", "value")), "metadata": (["key", "value"], joined("=", "key", "value")),
        "parse_warnings": (["warning"], joined("", "warning")), "failures": (["reason"], joined("", "reason")),
    }
    row = ["from", "hours", "op_code", "operation_details"]
    shown |= {m: (row, joined("|", *[F.coalesce(c, F.lit("")) for c in row])) for m in ("operations", "bulks")}
    parts = [
        SR.read_table(i.spark, path, name, columns).select(F.lit(name).alias("table_name"), "record_id", "row_no", cells) for name, (columns, cells) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


REPORTS_PER_FILE = 10_000


@query(
    "json_lines_source",
    "select record_id, case when l_suppkey % 4 = 3 then 'bulks' else 'operations' end as module_name, row_no, operation_details from operations "
    "where substr(record_id, 2)::bigint % 50 not in (7, 8)",
    uses=("operations",),
)
def json_lines_source(i):
    """Files with a report per line, some of them cut short: every whole report comes back."""
    path = shared_dir(i.spark, "reports")
    # packed files are not split: bounded ones keep all cores busy
    texts = _report_texts(i).select(F.col("text").alias("value"))
    texts.write.option("compression", "gzip").option("maxRecordsPerFile", REPORTS_PER_FILE).text(path)
    payloads = PL.read_payload_files(i.spark, path, lines=True).filter(F.try_element_at("metadata", F.lit("record_id")).isNotNull())
    _, _, rows = PL.shred(payloads)
    return rows.select("record_id", "module_name", "row_no", F.col("row")["operation_details"].alias("operation_details"))


@query(
    "fetch_payloads",
    """
select r.record_id, r.event || case when substr(r.record_id, 2)::bigint % 14 = 0 then ' 译' else '' end as event, coalesce(o.details, '') as operations from records r
left join (select record_id, string_agg(operation_details || case when row_no % 2 = 0 then ' 译' else '' end, '|' order by row_no) as details
  from operations where l_suppkey % 4 <> 3 group by 1) o on o.record_id = r.record_id
where substr(r.record_id, 2)::bigint % 7 = 0
""",
    uses=("records", "operations"),
)
def fetch_payloads(i):
    """One report in seven, asked for twice, with the translations of even rows and of every second header."""
    heads = i.v("headers").select("record_id", "fields")
    key = F.col("record_id").substr(F.lit(2), F.lit(20)).cast("bigint")
    ids = i.v("records").filter(key % 7 == 0).select("record_id")
    place = [F.lit("operation_details").alias("field"), F.lit("zh").alias("target_language")]
    rows = i.v("report_rows").filter("row_no % 2 = 0").select(
        "record_id", "module_name", "row_no", *place, F.concat(F.col("row")["operation_details"], F.lit(" 译")).alias("translated_text")
    )
    top = heads.filter(key % 14 == 0).select(
        "record_id", F.lit("report_fields").alias("module_name"), F.lit(0).alias("row_no"), F.lit("event").alias("field"), F.lit("zh-CN").alias("target_language"),
        F.concat(F.col("fields")["event"], F.lit(" 译")).alias("translated_text"),
    )
    other = rows.withColumn("target_language", F.lit("es")).withColumn("translated_text", F.lit("no"))
    pages = PL.fetch_payloads(heads, i.v("report_rows"), ids.union(ids), rows.unionByName(top).unionByName(other), "zh-CN", page_size=1_000_000)
    listed = F.coalesce(F.try_element_at("modules", F.lit("operations")), F.array().cast("array<map<string,string>>"))
    return pages.select(
        "record_id", F.col("fields")["event"].alias("event"), F.array_join(F.transform(listed, lambda r: r["operation_details"]), "|").alias("operations")
    )


# --- small set operations -----------------------------------------------------------------------------------


@query(
    "union_rigs",
    "select distinct rig from (select rig from records where rig_ok union all select rig from project_rigs)",
    uses=("records", "project_rigs"),
)
def union_rigs(i):
    named = i.v("records").select("rig").union(i.v("project_rigs").select(S.canonical_rig(F.col("rig"), CONTRACTOR)))
    return named.filter(S.valid_rig(F.col("rig"))).distinct()


@query(
    "common_fields",
    """
select x.field from records r join field_base f on f.record_id = r.record_id, lateral (values ('event', event), ('mudType', case when report_type = 'drilling' then mud_type else '' end),
  ('currentOps', current_ops), ('summary24h', summary24h), ('afeCost', case when report_type in ('completion', 'workover') then afe_cost else '' end), ('wellbore', wellbore)) x(field, value)
where trim(value) <> '' group by x.field having count(distinct report_type) = 4
""",
    uses=("records", "field_base"),
)
def common_fields(i):
    """Header fields in use by every report type."""
    own = {"mudType": ("drilling",), "afeCost": ("completion", "workover")}
    names = ["event", "mudType", "currentOps", "summary24h", "afeCost", "wellbore"]
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                (F.when(F.col("report_type").isin(*own[n]), F.col("fields")[n]).otherwise("") if n in own else F.col("fields")[n]).alias("value"),
            )
            for n in names
        ]
    )
    used = i.v("headers").select("report_type", F.inline(cells)).filter(~S.blank(F.col("value")))
    return used.groupBy("field").agg(F.countDistinct("report_type").alias("n")).filter("n = 4").select("field")


@query(
    "first_last_wins",
    """
select wellbore, arg_min(record_id, (report_date, rk)) as first_record, arg_max(record_id, (report_date, rk)) as last_record from records group by wellbore
""",
    uses=("records",),
)
def first_last_wins(i):
    place = F.struct("report_date", "rk")
    return i.v("records").groupBy("wellbore").agg(
        F.min_by("record_id", place).alias("first_record"), F.max_by("record_id", place).alias("last_record")
    )


@query(
    "share_of_total",
    "select rig, sum(total_h) as hours, sum(total_h) / (select sum(total_h) from facts) as share from facts where n_ops > 0 group by rig",
    uses=("facts",),
)
def share_of_total(i):
    worked = i.v("facts").filter("n_ops > 0")
    whole = worked.agg(F.sum("total_h")).scalar()
    return worked.groupBy("rig").agg(F.sum("total_h").alias("hours")).withColumn("share", F.col("hours") / whole)


@query(
    "scope_by_rig",
    """
select u.c_custkey as user_id, coalesce(n, 0) as visible from customer u
left join (select rig, count(*) as n from records group by rig) r on r.rig = case when c_nationkey % 3 = 0 then 'ACME ' || (100 + c_nationkey % 8) else 'ACME ' || (100 + c_custkey % 8) end
where c_mktsegment <> 'HOUSEHOLD'
union all select c_custkey, (select count(*) from records) from customer where c_mktsegment = 'HOUSEHOLD'
""",
    uses=("records",),
)
def scope_by_rig(i):
    """Users see one rig (the first of their list, else their own); administrators see all."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    rigs = F.when(n % 3 == 0, F.array(F.concat(F.lit("ACME "), (100 + n % 8).cast("string")))).otherwise(F.array().cast("array<string>"))
    users = i.t("customer").select(
        k.alias("user_id"), (F.col("c_mktsegment") == "HOUSEHOLD").alias("admin"),
        F.coalesce(F.get(rigs, F.lit(0)), F.concat(F.lit("ACME "), (100 + k % 8).cast("string"))).alias("rig"),
    )
    per_rig = i.v("records").groupBy("rig").agg(F.count(F.lit(1)).alias("n"))
    every = i.v("records").agg(F.count(F.lit(1))).scalar()
    seen = users.join(per_rig, "rig", "left")
    return seen.select("user_id", F.when(F.col("admin"), every).otherwise(F.coalesce("n", F.lit(0))).alias("visible"))


@query(
    "project_config_clean",
    """
select project_contract as project_key, 'ACME ' || right(rig, 3) as rig, min(rig_ord) as rig_ord from project_rigs where rig like 'ACME%' group by 1, 2
union all select project_contract, rig, min(rig_ord) from project_rigs where rig like 'OLD%' group by 1, 2
""",
    uses=("project_rigs",),
)
def project_config_clean(i):
    rows = i.v("bindings").select(
        F.col("project_contract").alias("contract_no"), F.lit("").alias("project_name"), "rig_ord", "wells",
        F.concat(F.lit(" 00  "), F.lower("rig")).alias("raw"), "rig",
    )
    # configured names arrive in free spelling
    spelled = rows.withColumn("rig", F.when(F.startswith("rig", F.lit("ACME")), F.replace("rig", F.lit(" "), F.lit("-"))).otherwise(F.col("rig")))
    out = TM.clean_project_rigs(spelled.drop("raw"), CONTRACTOR, "rig_ord")
    return out.select("project_key", "rig", "rig_ord")


@query(
    "team_config_clean",
    """
select 'ACME ' || k as name, 'ACME-' || k || '|OLD RIG ' || (k - 100) as aliases from (select distinct 100 + n_nationkey % 8 as k from nation)
""",
)
def team_config_clean(i):
    base = i.v("team_names").select("team_ord", F.replace("team_name", F.lit(" "), F.lit("-")).alias("name"), "alias")
    teams = base.withColumn("aliases", F.array(F.col("alias"), F.lit(" "), F.lower("alias")))
    out = TM.clean_teams(teams.drop("alias"), CONTRACTOR, "team_ord")
    return out.select("name", F.array_join("aliases", "|").alias("aliases"))


@query(
    "row_grouping",
    """
select event_id, max(case when event_type = 'error' then event_id end) over (partition by user_id order by event_id) as opened_by from events
""",
)
def row_grouping(i):
    """Each event with the last error of the same user at or before it."""
    rows = i.t("events").select("event_id", "user_id", "event_type")
    opened = F.when(F.col("event_type") == "error", F.col("event_id"))
    return ordering.carry_forward(rows, ["user_id"], "event_id", opened, "opened_by", block=1024).select("event_id", "opened_by")


@query(
    "top_wells",
    "select wellbore, sum(total_h) as hours from facts where n_ops > 0 group by wellbore order by hours desc, wellbore limit 10",
    uses=("facts",),
)
def top_wells(i):
    hours = i.v("facts").filter("n_ops > 0").groupBy("wellbore").agg(F.sum("total_h").alias("hours"))
    return hours.orderBy(F.desc("hours"), "wellbore").limit(10)
