"""The registered queries of these operators, with production parameters, and their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tourlog.llm import bpe, conversations, exact_dedup, html_text, jaccard, licences, line_dedup, lm, mixing, quality, runs, secrets, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    """The public tokenizer file of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("name")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, vocabulary_path(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "anomaly", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_equal=2).select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / language / block of 64 ids / id."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan_licences(_table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """One text in ten gets a periodic end, by the checksum of its id; null ids keep their texts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    # whole periods, then cut; a function over the places would split the text once a word
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(repeated_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"))
    # of equal exponents the first run stays: runs are sorted by start, then period
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), longer)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """One turn in twenty each is dropped, emptied, cut, repeated or given to the user, by the checksum of its key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    turns = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return turns.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations")
    found = conversations.repair_conversations(damaged(table))
    everyone = table.select("conv_id").distinct()
    joined = everyone.alias("e").join(found.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("e.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), digest)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = [r.kind for r in secrets.BASE_RULES]
    of = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base]
    digest = F.sha2(secrets.listed(of(base)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.listed(F.col("secrets")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_bpe, op3_lm_score, op4_quality, op5_mixing, op6_html_text, op7_line_dedup, op8_sharding, op9_licences, op10_jaccard,
        op11_periodic_runs, op12_conversation_repair, op13_secret_scan,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
        with t as (
          select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content
          from documents
        ), g as (
          select content, count(*) as group_size, arg_min(doc_id, {'p': -points, 'd': doc_id}) as keep_id from t group by content
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (content)""",
    "op10_jaccard": r"""
        with recursive w as (
          select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
        ), s as (
          select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [words]
                 else list_transform(range(1, len(words) - 1), lambda i: words[i:i+2]) end) as g from w
        ), n as (select doc_id, count(*) as n_shingles from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 90 * (a.n_shingles + b.n_shingles - shared)),
        e as (select x, y from l union all select y, x from l),
        r as (select doc_id as node, doc_id as seen from documents union select r.node, e.y from r join e on e.x = r.seen)
        select w.doc_id, coalesce(n.n_shingles, 0) as n_shingles, min(r.seen) as component_id
        from w left join n using (doc_id) join r on r.node = w.doc_id group by all""",
    # the checksum of conv_id:turn bit by bit; faults; then the best (cost, audit) of each state of the roles
    # (none, s, u, a), turn by turn: insertions before a turn, then the turn
    "op12_conversation_repair": r"""
        with recursive raw as (
          select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')) as k from conversations
        ), crc as (
          select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(k) + 1), lambda i: ascii(substr(decode(k), i, 1))::bigint)),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 as kind from raw
        ), d as (
          select conv_id, turn, case kind when 4 then 'user' else role end as role,
                 case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                 unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from crc
        ), n as (
          select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d
        ), f as (
          select *, left(role, 1) as r, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') as body,
                 row_number() over (partition by conv_id, role, text order by i) > 1 as again,
                 lag(left(role, 1)) over (partition by conv_id order by i) as prior from n
        ), g as (
          select *, body = '' as blank, body <> '' and again as duplicate, body <> '' and not again and right(body, 1) not in ('.', '!', '?') as truncated from f
        ), c as (
          select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
                 count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
                 count(*) filter (i > 1 and prior || r not in ('su', 'ua', 'au')) as illegal, max(i) as last from g group by conv_id
        ), ins(p, q, edits, cost, lines) as (
          values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'),
                 (2, 3, 'I', 2, chr(10) || 'assistant:'), (3, 2, 'I', 2, chr(10) || 'user:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
                 (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'II', 4, chr(10) || 'assistant:' || chr(10) || 'user:'),
                 (3, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')
        ), act(r, p, q, edit, cost, said) as (
          values ('s', 0, 1, 'K', 0, ''), ('u', 0, 2, 'K', 0, ''), ('u', 1, 2, 'K', 0, ''), ('u', 3, 2, 'K', 0, ''), ('a', 2, 3, 'K', 0, ''),
                 ('', 0, 2, 'R', 2, 'user'), ('', 1, 2, 'R', 2, 'user'), ('', 3, 2, 'R', 2, 'user'), ('', 2, 3, 'R', 2, 'assistant'),
                 ('', 0, 0, 'D', 3, ''), ('', 1, 1, 'D', 3, ''), ('', 2, 2, 'D', 3, ''), ('', 3, 3, 'D', 3, '')
        ), dp as (
          select conv_id, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, '' as lines from (select distinct conv_id from g)
          union all
          select conv_id, i, state, best.cost, best.audit, best.lines from (
            select dp.conv_id, g.i, act.q as state, min({'cost': dp.cost + ins.cost + act.cost + case when g.truncated and act.edit <> 'D' then 1 else 0 end,
                   'audit': dp.audit || ins.edits || act.edit,
                   'lines': dp.lines || ins.lines || case act.edit when 'D' then '' when 'K' then chr(10) || g.role || ':' || g.text else chr(10) || act.said || ':' || g.text end}) as best
            from dp join g on g.conv_id is not distinct from dp.conv_id and g.i = dp.i + 1 join ins on ins.p = dp.state
            join act on act.p = ins.q and (act.edit = 'D' or not (g.blank or g.duplicate) and (act.edit = 'R' or act.r = g.r))
            group by dp.conv_id, g.i, act.q)
        ), done as (
          select dp.conv_id, min({'cost': dp.cost + ins.cost, 'audit': dp.audit || ins.edits, 'lines': dp.lines || ins.lines}) as best
          from dp join c on c.conv_id is not distinct from dp.conv_id and dp.i = c.last join ins on ins.p = dp.state
          where ins.q = 3 or dp.state = 0 and ins.q = 0 group by dp.conv_id
        )
        select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit, sha256(substr(coalesce(best.lines, ''), 2)) as repaired_sha256
        from (select distinct conv_id from conversations) e left join c on c.conv_id is not distinct from e.conv_id
        left join done on done.conv_id is not distinct from e.conv_id""",
    # a text is cut into what lies before a match and the match, over and over: lengths give the places
    "op13_secret_scan": r"""
        with rules(k, kind, pattern, head, least) as (
          values (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+',
                    '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', 8),
                 (1, 'access', 'AKIA[A-Z0-9]+', '', 16), (2, 'hex', '[0-9a-f]+', '', 32),
                 (3, 'github', 'gh[pousr]_[A-Za-z0-9]+', 'gh[pousr]_', 36), (4, 'slack', 'xox[abprs]-[A-Za-z0-9-]+', 'xox[abprs]-', 10),
                 (5, 'google', 'AIza[A-Za-z0-9_-]+', 'AIza', 35), (6, 'stripe', '[sr]k_live_[A-Za-z0-9]+', '[sr]k_live_', 16),
                 (7, 'jwt', 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '', 0), (8, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----', '', 0)
        ), t as (
          select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents
        ), m as (
          select row_id, k, kind, head, least, regexp_extract_all(text, '(?s)(?:.*?)(?:' || pattern || ')') as parts,
                 regexp_extract_all(text, pattern) as hits from t join rules on regexp_matches(text, pattern)
        ), s as (
          select row_id, k, kind, unnest(list_transform(range(1, len(hits) + 1), lambda j: {'j': j, 'hit': hits[j],
                 'stop': list_sum(list_transform(parts[1:j], lambda x: length(x)))})) as x, head, least from m
        ), h as (
          select row_id, k, kind, x.stop::bigint - length(x.hit) as start, x.stop::bigint as stop from s
          where length(x.hit) - length(case when head = '' then '' else regexp_extract(x.hit, '^' || head) end) >= least
        ), g as (
          select row_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (k < 3) as base,
                 string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans from h group by row_id
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join g using (row_id)""",
}
