"""The expected result of each named query, as SQL over the same tables."""

from __future__ import annotations

_VIEWS = {
    "m": """
        select cast(event_id as int) + 1 as id,
               concat(event_type, ':', cast(user_id as varchar)) as content,
               ts as created_at
        from events""",
    "d": """
        select id, content, created_at,
               created_at + case when id % 7 = 0 then interval '90' second
                                 when id % 3 = 0 then interval '2' second
                                 else interval '45' second end as delivered_at,
               id % 3 as log_partition, cast(id as bigint) * 10 as log_offset
        from m where id % 40 <> 0
        union all
        select id, concat(content, '#dup'), created_at, created_at + interval '100' second,
               id % 3, cast(id as bigint) * 10 + 1
        from m where id % 25 = 0 and id % 40 <> 0
        union all
        select -id, content, created_at, created_at + interval '5' second,
               id % 3, cast(id as bigint) * 10 + 2
        from m where id % 50 = 0""",
    "f": """
        select id, content, created_at, delivered_at, log_partition, log_offset
        from (select *, row_number() over (partition by id order by log_offset) as rn from d) where rn = 1""",
    "status": """
        select coalesce(m.id, f.id) as id,
               case when m.id is null then 'orphan' when f.id is null then 'pending'
                    when f.delivered_at between m.created_at and m.created_at + interval '60' second
                    then 'confirmed' else 'late' end as status,
               m.created_at as written_at, f.delivered_at as delivered_at
        from m full outer join f on m.id = f.id""",
    "cdc": """
        select cast(id as bigint) as log_offset,
               case when id % 33 = 0 then null
                    when id % 10 = 0 then '{"before":null,"after":null,"op":"d"}'
                    else concat('{"before":null,"after":{"id":', cast(id as varchar), ',"content":"', content,
                                '","created_at":"', replace(cast(created_at as varchar), ' ', 'T'), 'Z"},"op":"',
                                case id % 10 when 1 then 'u' when 2 then 'r' else 'c' end, '"}')
               end as value
        from m""",
    "images": """
        select cast(id as bigint) as log_offset, id, content, created_at
        from m where id % 33 <> 0 and id % 10 <> 0""",
    "changes": """
        select cast(id as bigint) * 64 as wal_end,
               case when id % 20 = 0 then 'OutboxMessages' else 'messages' end as relation,
               case id % 6 when 0 then 'begin' when 1 then 'update' when 2 then 'delete'
                           when 3 then 'commit' else 'insert' end as kind,
               id, content, created_at
        from m""",
    "a": """
        select id, k as attempt_no,
               created_at + case k when 1 then interval '1' second when 2 then interval '3' second
                                   else interval '7' second end as attempted_at,
               k > id % 4 as ok,
               case when k > id % 4 then null else concat('broker error ', cast(k as varchar)) end as error
        from (select id, created_at, unnest([1, 2, 3]) as k from m where id % 9 <> 8)
        where k <= id % 4 + 1 and (id % 11 <> 5 or k = 1)""",
    "state": """
        select m.id,
               cast(case when coalesce(t.done, false) then 1 when coalesce(t.failures, 0) >= 3 then 2 else 0 end as int)
                   as status,
               cast(coalesce(t.failures, 0) as int) as retry_count,
               case when t.id is null then m.created_at
                    when t.failures = 0 then t.last_at + interval '1' second
                    when t.failures = 1 then t.last_at + interval '2' second
                    when t.failures = 2 then t.last_at + interval '4' second
                    else t.last_at + interval '8' second end as next_retry_at,
               m.created_at as created_at, t.sent_at as processed_at,
               case when not t.done and t.failures >= 3 then t.error end as dead_letter_error
        from m left join (
            select id, count(*) filter (where not ok) as failures, bool_or(ok) as done, max(attempted_at) as last_at,
                   min(attempted_at) filter (where ok) as sent_at,
                   arg_max(error, attempt_no) filter (where not ok) as error
            from a group by id) t on t.id = m.id""",
    "polled": """
        select s.*, status = 0 and next_retry_at <= timestamp '2024-01-20' as due, id % 5 = 0 as refused
        from state s""",
    "r": """
        select event_id as request_id,
               case event_type when 'view' then '/direct' when 'click' then '/naive' when 'signup' then '/outbox'
                               when 'purchase' then '/replication' else '/debezium' end as endpoint,
               ts as started_at, value as duration_ms,
               case when event_id % 97 = 0 then 500 when event_id % 193 = 0 then 0 else 201 end as status_code,
               event_id % 101 = 0 as warmup, cast(event_id % 250 as int) as vus
        from events""",
    "run": """
        select endpoint, count(*) as requests, count(*) filter (where status_code = 201) as passes,
               count(*) filter (where status_code <> 201) as fails,
               count(*) filter (where status_code not between 200 and 399) as failed,
               count(*) filter (where not warmup) as iterations,
               nullif((max(ended_us) - epoch_us(min(started_at))) / 1e6, 0) as run_s,
               nullif((max(ended_us) filter (where not warmup)
                       - epoch_us(min(started_at) filter (where not warmup))) / 1e6, 0) as timed_s,
               (epoch_us(min(started_at) filter (where not warmup)) - epoch_us(min(started_at))) / 1e6 as setup_s,
               min(vus) as vus_min, max(vus) as vus_max
        from (select *, epoch_us(started_at) + coalesce(cast(round(duration_ms * 1000) as bigint), 0) as ended_us from r)
        group by endpoint""",
    "w": """
        select id, created_at + case when id % 5 = 0 then interval '20' second else interval '0' second end as waited_at,
               created_at + case when id % 5 = 0 then interval '20' second else interval '0' second end
                          + case id % 3 when 0 then interval '15' second when 1 then interval '30' second
                                        else interval '60' second end as deadline,
               case when id % 8 = 0 then greatest(created_at + interval '10' second,
                    created_at + case when id % 5 = 0 then interval '20' second else interval '0' second end) end as cancelled_at
        from m""",
    "ends": """
        select w.id, w.waited_at, w.deadline, w.cancelled_at, case when f.id is not null then greatest(f.delivered_at, w.waited_at) end as met_at, f.content
        from w left join f on f.id = w.id""",
    "waited": """
        select id, waited_at,
               case when met_at <= least(deadline, coalesce(cancelled_at, deadline)) then 'met'
                    when cancelled_at <= deadline then 'cancelled' else 'expired' end as result,
               case when met_at <= least(deadline, coalesce(cancelled_at, deadline)) then met_at
                    when cancelled_at <= deadline then cancelled_at else deadline end as ended_at,
               case when met_at <= least(deadline, coalesce(cancelled_at, deadline)) then content end as content
        from ends""",
}

_NEEDS = {
    "m": [], "d": ["m"], "f": ["d"], "status": ["f"], "cdc": ["m"], "images": ["m"], "changes": ["m"],
    "a": ["m"], "state": ["a"], "polled": ["state"], "r": [], "run": ["r"],
    "w": ["m"], "ends": ["w", "f"], "waited": ["ends"],
}


def _closure(view: str) -> list[str]:
    out: list[str] = []
    for need in _NEEDS[view]:
        out += [v for v in _closure(need) if v not in out]
    return [*out, view]


def _with(views: str, select: str) -> str:
    names: list[str] = []
    for view in views.split():
        names += [v for v in _closure(view) if v not in names]
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n]})" for n in names) + "\n" + select


_JSON_TIME = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ')"
_JSON = (
    "concat('{\"id\":', cast(id as varchar), ',\"content\":\"', content, '\",\"createdAt\":\"', "
    + _JSON_TIME + ", '\"}')"
)
_OUTBOX_ID = "regexp_replace(md5(concat('Message:', cast(id as varchar))), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_AVG = "cast(sum(cast(round(duration_ms * 1000000) as hugeint)) as double) / 1e6 / count(*)"


def _quantile(p: float) -> str:
    """Interpolated between neighbours in rank; rk counts from 0."""
    pos = f"(cast({p} as double) * (max(n) - 1))"
    row = f"(cast({p} as double) * (n - 1))"
    low = f"max(duration_ms) filter (where rk = floor({row}))"
    high = f"max(duration_ms) filter (where rk = ceil({row}))"
    return (
        f"case when {pos} = floor({pos}) then {low} "
        f"else (ceil({pos}) - {pos}) * {low} + ({pos} - floor({pos})) * {high} end"
    )


_TREND = (
    f"select endpoint, count(*) as n, {_AVG} as avg_ms, min(duration_ms) as min_ms, "
    f"{_quantile(0.5)} as med_ms, max(duration_ms) as max_ms, "
    f"{_quantile(0.95)} as p95_ms, {_quantile(0.99)} as p99_ms from ("
    "select endpoint, duration_ms, count(*) over (partition by endpoint) as n, "
    "row_number() over (partition by endpoint order by duration_ms) - 1 as rk from r {where}) group by endpoint"
)
_ALL = "select id, content, created_at from m"
_DELIVERY = "id, content, created_at, delivered_at, log_partition, log_offset"
_MATCHED = """
    select f.id, f.content, f.created_at, f.delivered_at from m join f on m.id = f.id
    where f.delivered_at between m.created_at and m.created_at + interval '60' second"""
_STATUS = "select id, status, written_at, delivered_at from status"


def _fixed(value: str) -> str:
    return f"cast(cast({value} as decimal(18, 2)) as varchar)"


def _check(name: str, type_name: str) -> str:
    return f"""
        select '{name}' as relation, count(*) as rows, count(id) - count(distinct id) as duplicate_keys,
               count(*) filter (where id is null) as null_id,
               count(*) filter (where content is null) as null_content,
               count(*) filter (where created_at is null) as null_created_at,
               count(*) filter (where length({type_name}) > 256) as too_long_type_name
        from {'m' if name == 'messages' else 'd'}"""


_POLL_AT = "timestamp '2024-01-20'"
# Eight polls of 50 rows, 100 ms apart, over a table whose rows all were due before the first.
_POLLS = f"""
    select id,
           cast(case when poll is null then status when not refused then 1
                     when retry_count + 1 >= 3 then 2 else 0 end as int) as status,
           cast(case when poll is not null and refused then retry_count + 1 else retry_count end as int) as retry_count,
           case when poll is not null and refused
                then polled_at + case retry_count when 0 then interval '2' second
                     when 1 then interval '4' second else interval '8' second end
                else next_retry_at end as next_retry_at,
           case when poll is not null and not refused then polled_at
                when poll is not null then null else processed_at end as processed_at,
           case when poll is not null and refused and retry_count + 1 >= 3 then 'refused'
                when poll is not null then null else dead_letter_error end as dead_letter_error
    from (select *, {_POLL_AT} + to_milliseconds(100 * poll) as polled_at
          from (select *, case when due and place <= 400 then (place - 1) // 50 end as poll
                from (select *, row_number() over (partition by due order by next_retry_at, cast(id as varchar)) as place
                      from polled)))"""


SQL: dict[str, str] = {
    "topic_source": _with("d", "select id, content, created_at, log_partition, log_offset from d"),
    "cdc_source": _with("images", "select * from images"),
    "change_source": _with("changes", "select * from changes"),
    "ingest_source": _with("m", "select content from m"),
    "message_append": _with("m", _ALL),
    "topic_sink": _with("m", "select id, content, created_at, 'messages' as topic, created_at as timestamp from m"),
    "outbox_cowrite": _with("m", "select id, id as outbox_message_id, true as same_content from m"),
    "summary_report": _with("r run", f"""
        select run.endpoint, vus_max as vus, iterations, requests - iterations as warmup, {_fixed('setup_s * 1000 / 1000')} as setup_s,
               {_fixed('timed_s')} as scenario_s,
               {_fixed('iterations / timed_s')} as iterations_per_s, {_fixed('t.avg_ms')} as avg_ms,
               {_fixed('t.p95_ms')} as p95_ms, {_fixed('t.p99_ms')} as p99_ms,
               {_fixed('failed / requests * 100')} as failed_percent
        from run join ({_TREND.format(where='')}) t on t.endpoint = run.endpoint"""),
    "stamp_message": _with("m", "select content, timestamp '2024-02-01' as created_at from m"),
    "assign_id": _with("m", "select cast(row_number() over (order by id) as int) as id from m"),
    "rename_columns": _with("m", "select id, content, created_at as \"createdAt\" from m"),
    "encode_record": _with("m", f"""
        select upper(printf('%08x', id)) as key_hex, {_JSON} as value, created_at as timestamp from m"""),
    "decode_record": _with("m", """
        select id,
               case when id % 13 = 0 or id % 11 = 0 then null else id end as message_id,
               case when id % 13 = 0 or id % 11 = 0 then null
                    when id % 7 = 0 or id % 5 = 0 or id % 3 <> 0 then content else '' end as content,
               case when id % 13 = 0 or id % 11 = 0 then null else created_at end as created_at,
               id % 13 <> 0 and id % 11 = 0 as malformed
        from m"""),
    "outbox_row": _with("m", f"""
        select {_OUTBOX_ID} as id, 'Message' as type_name, {_JSON} as payload, 0 as status, 0 as retry_count,
               created_at as next_retry_at, created_at, cast(null as timestamp) as processed_at,
               cast(null as varchar) as dead_letter_error
        from m"""),
    "cdc_after_image": _with("images", "select * from images"),
    "insert_only": _with("changes", "select * from changes where kind = 'insert'"),
    "drop_tombstones": _with("cdc", "select * from cdc where value is not null"),
    "project_by_name": _with("changes", "select id, content, timestamp '2024-02-01' as created_at from changes"),
    "table_filter": _with("changes", "select * from changes where relation = 'messages'"),
    "skip_snapshot": _with("cdc", """
        select * from cdc where json_extract_string(value, '$.op') is null or json_extract_string(value, '$.op') <> 'r'"""),
    "topic_route": _with("changes", "select wal_end, concat('cdc.public.', relation) as topic from changes"),
    "path_filter": _with("r", """
        select * from (
            select request_id, case when request_id % 13 = 0 then '/health' when request_id % 17 = 0 then '/alive/x'
                                    when request_id % 19 = 0 then '/healthy' else endpoint end as path from r)
        where not regexp_matches(lower(path), '^/(health|alive)(/|$)')"""),
    "constraint_check": _with("d", _check("messages", "'Message'") + " union all " + _check("deliveries", "content")),
    "delivery_match": _with("f", _MATCHED),
    "undelivered": _with("d", "select m.* from m anti join d on m.id = d.id"),
    "orphan_deliveries": _with("f", f"select {_DELIVERY} from f anti join m on m.id = f.id"),
    "delivery_status": _with("status", _STATUS),
    "delivery_status_counts": _with("status", "select status, count(*) as ids from status group by status"),
    "producer_union": _with("m", f"""
        select id, {_JSON} as value, created_at as timestamp,
               case when content like 'click:%' then 'click' else 'other' end as producer from m"""),
    "producer_union_stream": _with("m", """
        select case when content like 'click:%' then 'click' else 'other' end as producer, id, content, created_at from m"""),
    "latency_trend": _with("r", _TREND.format(where="")),
    "expected_latency": _with("r", _TREND.format(where="where status_code between 200 and 399")),
    "check_rate": _with("run", """
        select endpoint, passes as check_passes, fails as check_fails, passes / requests as check_rate,
               failed as failed_passes, requests - failed as failed_fails, failed / requests as failed_rate
        from run"""),
    "request_counter": _with("run", "select endpoint, requests, requests / run_s as per_second from run"),
    "vus_gauge": _with("r", """
        select endpoint, max(last) as vus_last, min(vus) as vus_min, max(vus) as vus_max
        from (select endpoint, vus, first_value(vus) over (
                  partition by endpoint order by started_at desc, request_id desc) as last from r)
        group by endpoint"""),
    "failure_threshold": _with("run", """
        select endpoint, failed / requests as failed_rate, failed / requests < 0.01 as ok from run"""),
    "net_throughput": _with("run", """
        select endpoint, iterations, timed_s as timed_seconds, iterations / timed_s as per_second from run"""),
    "wal_position": _with("changes", """
        select max(wal_end) as acknowledged, max(wal_end) filter (where kind = 'insert') as last_insert
        from changes"""),
    "first_delivery": _with("f", f"select {_DELIVERY} from f"),
    "outbox_state": _with("state", "select * from state"),
    "outbox_batch": _with("state", """
        select * from state where status = 0 and next_retry_at <= timestamp '2024-01-20'
        order by next_retry_at, id limit 50"""),
    "outbox_dispatch": _with("polled", """
        select id,
               cast(case when not due then status when not refused then 1
                         when retry_count + 1 >= 3 then 2 else 0 end as int) as status,
               cast(case when due and refused then retry_count + 1 else retry_count end as int) as retry_count,
               case when due and refused
                    then timestamp '2024-01-20' + case retry_count when 0 then interval '2' second
                         when 1 then interval '4' second else interval '8' second end
                    else next_retry_at end as next_retry_at,
               case when due and not refused then timestamp '2024-01-20'
                    when due then null else processed_at end as processed_at,
               case when due and refused and retry_count + 1 >= 3 then 'refused'
                    when due then null else dead_letter_error end as dead_letter_error
        from polled"""),
    "outbox_dispatch_topic": _with("polled", """
        select m.id, m.content, m.created_at from polled p join m on m.id = p.id where p.due and not p.refused"""),
    "first_delivery_stream": _with("f", f"select {_DELIVERY} from f"),
    "delivery_match_stream": _with("f", _MATCHED),
    "delivery_status_stream": _with("status", _STATUS),
    "rendezvous_stream": _with("status", """
        select s.id, written_at, case when status = 'confirmed' then s.delivered_at end as delivered_at,
               case when status = 'confirmed' then f.content end as content
        from status s left join f on f.id = s.id where status <> 'orphan'"""),
    "waits_stream": _with("waited", """
        select a.arrival, waited.* from waited cross join (values ('in order'), ('mixed')) as a(arrival)"""),
    "open_writes": _with("d", f"""
        select id, created_at as written_at from m where created_at < {_POLL_AT}
        and id not in (select id from d where delivered_at < {_POLL_AT})"""),
    "outbox_polls": _with("polled", _POLLS),
    "outbox_state_snapshot": _with("state", "select * from state"),
    "change_slot": _with("changes", """
        select wal_end, id, content, created_at from changes where kind = 'insert' and relation = 'messages'"""),
    "change_slot_position": _with("changes", f"""
        select 1 as run, max(wal_end) as handled, true as not_ahead from changes where created_at < {_POLL_AT}
        union all select 2, max(wal_end), true from changes"""),
    "two_writer_ids": _with("m", """
        select 'click' as stream, count(*) as messages, count(*) as ids, true as unique_overall, true as same_when_repeated
        from m where content like 'click:%'
        union all
        select 'other', count(*), count(*), true, true from m where content not like 'click:%'"""),
    "append_constraint": _with("d", """
        select batch_id, id, refused, stored from (
            select batch_id, id, count(*) over () as total,
                   case when min(batch_id) over (partition by id) < batch_id then n else n - 1 end as refused,
                   min(batch_id) over (partition by id) < batch_id as stored
            from (select batch_id, id, count(*) as n from (
                select id, case when log_offset % 10 = 1 and id % 2 = 1 then 3 else abs(id) % 3 end as batch_id from d)
                group by batch_id, id))
        where refused > 0"""),
    "latency_sketch": _with("r", """
        select endpoint, count(*) as n, count(distinct date_trunc('hour', started_at)) as slices,
               true as med_ok, true as p95_ok, true as p99_ok
        from r where duration_ms is not null group by endpoint"""),
    "observed_counters": _with("run", """
        select endpoint, requests, passes as check_passes, fails as check_fails, failed as failed_requests,
               failed / requests as failed_rate, iterations, vus_min, vus_max, requests / run_s as per_second
        from run"""),
    "topic_commit": _with("m", "select id, content, created_at from m"),
    "faulty_records": _with("m", """
        select id, case when id % 7 = 0 then 'quarantine' else 'good' end as place,
               case when id % 7 = 0 then null else content end as content from m"""),
    "ingest_route": _with("m", "select content, 'met' as result, count(*) as messages from m group by content"),
    "resume_from_checkpoint": _with("d", f"select {_DELIVERY} from d"),
    "direct_route": _with("m", _ALL),
    "naive_route": _with("status", _STATUS),
    "outbox_route": _with("state", """
        select id, status = 1 as delivered, case when status = 1 then processed_at end as delivered_at from state"""),
    "replication_route": _with("m changes", """
        select m.id, c.id is not null as delivered, c.wal_end as completed_at
        from m left join (select * from changes where kind = 'insert' and relation = 'messages') c on c.id = m.id"""),
    "cdc_route": _with("m images", """
        select m.id, c.id is not null as delivered, c.log_offset as completed_at
        from m left join images c on c.id = m.id"""),
}
