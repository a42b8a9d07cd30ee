"""DuckDB SQL for the queries over the log."""

from __future__ import annotations

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen({k})), lambda i: ('0x' || substr(hex({k}), (2*i+1)::BIGINT, 2))::INT::BIGINT)), lambda h, x: (xor(h, x) * 16777619::BIGINT) & 4294967295::BIGINT)"
_LOG = f"""
with recursive hashed as (select user_id, {_FNV.format(k="k")} as hash from (select distinct user_id, user_id::varchar as k from events)),
ev as (select event_id, ts, e.user_id, event_type, value, hash, (hash % 16)::int as shard_id, event_type || ':' || props as payload from events e join hashed h on e.user_id = h.user_id),
log as (select *, row_number() over (partition by shard_id order by event_id) - 1 as entry_number, 12 + strlen(payload) as stored_size from ev),
heads as (select shard_id, max(entry_number) + 1 as n from log group by shard_id),
off as (select 'fast' as "group", shard_id, floor(n * 0.9)::bigint as "offset" from heads union all select 'slow', shard_id, floor(n * 0.25)::bigint from heads),
acks as (select if(user_id % 2 = 0, 'even', 'odd') as "group", shard_id, entry_number, event_id as seq from log where event_type = 'click'),
lags as (select g as "group", h.shard_id, n as durable_entry, coalesce("offset", 0) as "offset", n - coalesce("offset", 0) as lag
  from heads h cross join (values ('fast'), ('slow'), ('new')) v(g) left join off o on o.shard_id = h.shard_id and o."group" = g)
"""
_SEG = (
    _LOG
    + """,
fold as (
  select shard_id, entry_number, ts, stored_size, 0::bigint as segment_id, 0::bigint as off, stored_size as filled from log where entry_number = 0
  union all
  select l.shard_id, l.entry_number, l.ts, l.stored_size, f.segment_id + (f.filled >= 4096)::int, if(f.filled >= 4096, 0, f.filled), if(f.filled >= 4096, 0, f.filled) + l.stored_size
  from fold f join log l on l.shard_id = f.shard_id and l.entry_number = f.entry_number + 1),
seg as (select shard_id, segment_id, min(entry_number) as start_entry, count(*) as entries, sum(stored_size)::bigint as bytes, min(ts) as start_time, max(ts) as end_time from fold group by all),
man as (select *, sum(bytes) over (partition by shard_id order by segment_id)::bigint as end_offset, (sum(bytes) over (partition by shard_id order by segment_id))::bigint - bytes as start_offset,
  lead(segment_id) over (partition by shard_id order by segment_id) is null as is_current from seg),
clock as (select max(ts) as now from events)
"""
)
_AGE = "epoch(now - end_time)::bigint"
_BY_AGE = f"""select shard_id, segment_id, not is_current and {_AGE} > 864000 as old, max(not is_current and {_AGE} > 1728000) over (partition by shard_id order by segment_id) as forced from man, clock"""
_SHARD_SIZE = """select *, not is_current and total - before > 10000 and place <= files - 1 as goes from (
  select *, sum(bytes) over (partition by shard_id) as total, row_number() over w as place, count(*) over (partition by shard_id) as files,
    coalesce(sum(if(is_current, 0, bytes)) over (partition by shard_id order by end_time, segment_id rows between unbounded preceding and 1 preceding), 0) as before
  from man window w as (partition by shard_id order by end_time, segment_id))"""
# A pass as the log's upkeep does it, file by file: by age, then by the shard's size, then by the size of all.
_PASS = """first as (
  select *, row_number() over w - 1 as i, count(*) over (partition by shard_id) as n, not is_current and age > 1728000 as forced, (select min("offset") from off o where o.shard_id = a.shard_id) as low
  from (select *, epoch(now - end_time)::bigint as age from man, clock) a window w as (partition by shard_id order by segment_id)),
by_age as (
  select shard_id, segment_id, i, n, bytes, entries, start_time, end_time, is_current, forced as lifted, 0::bigint as deleted, false as aged from first where i = 0
  union all
  select f.shard_id, f.segment_id, f.i, f.n, f.bytes, f.entries, f.start_time, f.end_time, f.is_current, b.lifted or f.forced, b.deleted + goes::int, goes
  from by_age b join first f on f.shard_id = b.shard_id and f.i = b.i + 1,
    lateral (select not f.is_current and (f.age > 864000 or f.forced) and f.i < f.n - 1 and (b.lifted or f.forced or f.low is null or f.start_entry + f.entries - 1 < f.low) and f.n - 1 - b.deleted > 2 as goes)),
by_size as (
  select *, not aged and not is_current and total - before > 20000 and place <= kept - 2 as sized from (
    select *, sum(bytes) over (partition by shard_id) as total, sum((not aged)::int) over (partition by shard_id) as kept, sum((not aged)::int) over (partition by shard_id order by end_time, segment_id) as place,
      coalesce(sum(if(is_current or aged, 0, bytes)) over (partition by shard_id order by end_time, segment_id rows between unbounded preceding and 1 preceding), 0) as before
    from by_age)),
passed as (
  select *, case when aged then 'age' when sized then 'shard size' when not is_current and rest - ahead > 200000 then 'total size' end as reason from (
    select *, sum(if(aged or sized, 0, bytes)) over () as rest,
      coalesce(sum(if(aged or sized or is_current, 0, bytes)) over (order by end_time, shard_id, segment_id rows between unbounded preceding and 1 preceding), 0) as ahead
    from by_size))"""
_THIN = """nodes as (select shard_id, entry_number, segment_id, off, row_number() over (partition by shard_id order by entry_number) as k from fold where entry_number % 10 = 0),
thin as (
  select shard_id, 1::bigint as k, [entry_number] as kept from nodes where k = 1
  union all
  select t.shard_id, n.k, if(len(t.kept) + 1 >= 10, list_filter(list_append(t.kept, n.entry_number), lambda x, i: i % 2 = 1), list_append(t.kept, n.entry_number))
  from thin t join nodes n on n.shard_id = t.shard_id and n.k = t.k + 1),
kept as (select shard_id, unnest(kept) as entry_number from thin where (shard_id, k) in (select (shard_id, max(k)) from nodes group by shard_id))"""
_MARKS = """ap as (select shard_id, event_id // 64 as seq, max(epoch(date_trunc('second', ts)))::bigint as at_s, count(*) as n, row_number() over (partition by shard_id order by event_id // 64) as k from log group by shard_id, event_id // 64),
marks as (
  select shard_id, seq, k, n >= 20 as due, at_s as since, if(n >= 20, 0, n) as unsaved from ap where k = 1
  union all
  select a.shard_id, a.seq, a.k, a.at_s - m.since > 86400 or m.unsaved + a.n >= 20, if(a.at_s - m.since > 86400 or m.unsaved + a.n >= 20, a.at_s, m.since), if(a.at_s - m.since > 86400 or m.unsaved + a.n >= 20, 0, m.unsaved + a.n)
  from marks m join ap a on a.shard_id = m.shard_id and a.k = m.k + 1)"""
_BATCHES = """sized as (select shard_id, event_id // 64 as b, sum(stored_size)::bigint as size, row_number() over (partition by shard_id order by event_id // 64) as k from log group by shard_id, event_id // 64),
whole as (
  select shard_id, b, k, size, 0::bigint as segment_id, 0::bigint as off from sized where k = 1
  union all
  select s.shard_id, s.b, s.k, s.size, w.segment_id + (w.off + w.size >= 4096)::int, if(w.off + w.size >= 4096, 0, w.off + w.size) from whole w join sized s on s.shard_id = w.shard_id and s.k = w.k + 1)"""
_DIAG = """diag as (
  select m.shard_id, list_filter([if(idle_s > 300, 'no recent writes', null), if(error_rate > 1.0, 'high error rate', null), if(error_age_s < 60, 'recent errors', null),
    if(m.shard_id % 4 > 0, 'file rotation failures', null), if(max_lag > 100000, 'consumer lag too high', null)], lambda x: x is not null) as reasons
  from (select shard_id, count(*) filter (value > 90) / 100.0 as error_rate, epoch(date_trunc('second', (select max(ts) from events)) - date_trunc('second', max(ts)))::bigint as idle_s,
      epoch(date_trunc('second', (select max(ts) from events)) - date_trunc('second', max(ts) filter (event_type = 'error')))::bigint as error_age_s from log group by shard_id) m
  join (select shard_id, max(lag) as max_lag from lags group by shard_id) l on l.shard_id = m.shard_id)"""
_STATE = "state as (select shard_id, n, case shard_id % 4 when 0 then 0 when 1 then 999 else 1 end as version, if(shard_id % 4 = 2, 2199023255552, n * 50)::bigint as write_offset, n - 1 as last_entry from heads)"
_OK = "(version = 1 and write_offset <= 1099511627776 and last_entry >= -1)"


def oracle_sql() -> dict[str, str]:
    log = {
        "route_shard": "select event_id, hash, shard_id from log",
        "stream_name": "select event_id, printf('events:v1:%04d', shard_id) as stream from log",
        "parse_stream": "select event_id, if(event_id % 4 = 1, null, shard_id)::bigint as shard from log",
        "owned_shards": "select shard_id from heads where shard_id % 3 = 1",
        "route_owned": "select event_id, ([1, 4, 7, 10, 13])[(hash % 5 + 1)::int]::int as shard from log",
        "append_ids": "select event_id, shard_id, entry_number, shard_id || '-' || entry_number as message_id from log",
        "message_id_roundtrip": "select event_id, if(event_id % 5 = 0, null, shard_id)::bigint as shard, if(event_id % 5 = 0, null, entry_number) as entry from log",
        "shard_len": "select shard_id, n from heads",
        "durable_heads": "select shard_id, n as next_entry, greatest(n - 5, 0) as durable_entry from heads",
        "list_recent": "select log.shard_id, entry_number, event_id, payload from log join heads using (shard_id) where entry_number >= n - 10",
        "scan_all": "select log.shard_id, entry_number, event_id from log join heads using (shard_id) where entry_number < n - 5",
        "scan_limit": "select shard_id, entry_number, event_id from log where entry_number < 10",
        "point_lookup": "select shard_id, entry_number, event_id, payload from log join heads using (shard_id) where entry_number in (0, n // 2)",
        "read_batch": "select log.shard_id, entry_number, event_id from log join off on off.shard_id = log.shard_id and \"group\" = 'fast' where entry_number >= \"offset\" and entry_number < \"offset\" + 20",
        "read_from_offset": "select log.shard_id, entry_number, event_id from log join off on off.shard_id = log.shard_id and \"group\" = 'slow' join heads h on h.shard_id = log.shard_id where entry_number >= greatest(\"offset\", n // 2)",
        "read_quota": "select log.shard_id, entry_number, event_id from log join off on off.shard_id = log.shard_id and \"group\" = 'fast' where entry_number >= \"offset\" order by log.shard_id, entry_number limit 100",
        "discover_assign": "select distinct shard_id, shard_id % 3 as consumer from log",
        "assignment_coverage": "select shard_id % 2 as consumer, count(distinct shard_id) as shards, count(*) as messages from log group by 1",
        "ack_cumulative": """select coalesce(a."group", o."group") as "group", coalesce(a.shard_id, o.shard_id) as shard_id, greatest(o."offset", least(a.t, n)) as "offset", coalesce(acked, 0) as acked
  from (select "group", shard_id, max(entry_number) + 1 as t, count(*) as acked from acks group by all) a full join off o on a."group" = o."group" and a.shard_id = o.shard_id left join heads h on h.shard_id = a.shard_id""",
        "ack_range": """select "group", shard_id, f as from_entry, t as to_entry, reason is null as accepted, reason, if(reason is null, t + 1, "offset") as "offset" from (
  select *, case when f > t then 'empty range' when "group" = 'fast' and t > "offset" - 1 then 'beyond what was read' end as reason from (
  select *, if(shard_id % 3 = 0, 5, 0)::bigint as f, case shard_id % 3 when 0 then 4 when 1 then "offset" else "offset" // 2 end::bigint as t from off))""",
        "reset_offset_neg": "select 'fast' as \"group\", shard_id, if(k < 0, greatest(n + k, 0), k)::bigint as \"offset\" from heads, (values (-10), (-1000000000), (7), (1000000000)) v(k)",
        "offset_upsert": "select \"group\", shard_id, \"offset\" + (\"group\" = 'slow' and shard_id < 8)::int as \"offset\" from off",
        "ack_gap": 'select * from (select "group", shard_id, entry_number, lag(entry_number) over (partition by "group", shard_id order by seq) as previous from acks) where entry_number > coalesce(previous, -1) + 1',
        "offset_progress": 'select "group", shard_id, seq, max(entry_number + 1) over (partition by "group", shard_id order by seq) as "offset" from acks',
        "segment_assign_batches": """$batches select l.shard_id, entry_number, segment_id, (off + sum(stored_size) over (partition by l.shard_id, w.b order by entry_number))::bigint - stored_size as offset_in_segment
  from log l join whole w on w.shard_id = l.shard_id and w.b = l.event_id // 64""",
        "process_resume": "select shard_id, entry_number, if(row_number() over (order by shard_id, entry_number) <= 300, 1, 2) as run from log",
        "process_reset": "select log.shard_id, entry_number from log join heads using (shard_id) where entry_number >= n - 10",
        "process_lag": "select g as \"group\", shard_id, n as durable_entry, if(g = 'g', n, 0) as \"offset\", if(g = 'g', 0, n) as lag from heads, (values ('g'), ('other')) v(g)",
        "recover_choose": "select shard_id, ['new', 'rebuild', 'fail', 'rebuild', 'load', 'load'][(shard_id % 6 + 1)::int] as action from heads",
        "state_sync": "$state select shard_id, not (write_offset = n * 50 and last_entry = n - 1) as moved, n - 1 as last_entry, n * 50 as write_offset from state",
        "checkpoint_marks": """$marks select shard_id, seq, due as checkpoint, unsaved from marks""",
        "write_requests": """select shard_id, event_id // 64 as batch_id, count(*) as entries, sum(stored_size)::bigint as bytes, min(entry_number) as first_entry, max(entry_number) as last_entry,
  count(*) filter (strlen(payload) >= 40) as compressed, count(*) filter (strlen(payload) < 40) as skipped from log group by shard_id, event_id // 64""",
        "client_rates": """select b::bigint as bytes_written, w as writes, r as reads, e + s as errors, round(b / 1048576 / 3600, 6) as write_mib_s, round(w / 3600, 6) as write_rate, round(r / 3600, 6) as read_rate,
  round((e + s) / 3600, 6) as error_rate, round((b + c) / b, 6) as compression_ratio, floor(l / w)::bigint as avg_latency from (
  select sum(strlen(payload)) as b, count(*) as w, count(*) filter (event_type = 'view') as r, count(*) filter (event_type = 'error') as e, count(distinct shard_id) as s,
    sum(if(strlen(payload) >= 40, strlen(payload) - strlen(payload) // 2, 0)) as c, sum(length(payload)) as l from log)""",
        "consumer_lags": 'select "group", sum(lag)::bigint as lag, max(lag) as max_lag from lags where lag > 0 group by 1',
        "last_batch_compression": """select shard_id, original, stored, floor((original - stored) * 10000 / original)::bigint as saved_bp, round(original / stored, 6) as ratio, round(stored / original, 6) as stored_share from (
  select l.shard_id, sum(strlen(payload))::bigint as original, sum(if(strlen(payload) >= 40, strlen(payload) // 2, strlen(payload)))::bigint as stored
  from log l join (select shard_id, max(event_id // 64) as b from log group by 1) m on m.shard_id = l.shard_id and m.b = l.event_id // 64 group by 1)""",
        "offset_migrate": "select \"group\", shard_id, \"offset\" from off union all select 'older', shard_id, 7 from heads",
        "group_slots": f"""select "group", shard_id, left("group", 47) as stored_name, ({_FNV.format(k='"group"')} % 512)::int as slot from (select "group" || repeat('x', shard_id * 8) as "group", shard_id from off)""",
        "highest_read": 'select "group", shard_id, max(entry_number) as highest from acks group by all',
        "pick_stream": "select event_id, printf('events:v1:%04d', shard_id) as stream from log",
        "discover_shards": "select shard_id from heads where shard_id % 3 = 1",
        "consumer_lag": "select * from lags",
        "lag_summary": 'select "group", sum(lag)::bigint as lag, max(lag) as max_lag from lags group by 1',
        "dedup_filter": "select shard_id, entry_number, event_id from log where event_type <> 'view'",
        "dedup_evict": "select log.shard_id, entry_number from log join off on off.shard_id = log.shard_id and \"group\" = 'fast' where entry_number >= \"offset\" - 100",
        "compress_class": "select shard_id, if(strlen(payload) >= 40, 'compressed', 'skipped') as class, count(*) as n, sum(strlen(payload))::bigint as bytes from log group by all",
        "compress_ratio": """select shard_id, original, stored, floor((original - stored) * 10000 / original)::bigint as saved_bp, round(original / stored, 6) as ratio, round(stored / original, 6) as stored_share from (
  select shard_id, sum(strlen(payload))::bigint as original, sum(if(strlen(payload) >= 40, strlen(payload) // 2, strlen(payload)))::bigint as stored from log group by 1)""",
        "shard_diagnostics": "$diag select shard_id, coalesce(list_aggregate(reasons, 'string_agg', '; '), '') as reasons, len(reasons) = 0 as is_healthy from diag",
        "unhealthy_shards": "$diag select shard_id from diag where len(reasons) > 0",
        "health": "select count(*) as error_count, h as healthy, if(h, 'healthy', 'degraded') as status from (select coalesce(epoch(date_trunc('second', (select max(ts) from events)) - date_trunc('second', max(ts) filter (event_type = 'error'))) >= 60, true) as h from log), (select event_id from log where event_type = 'error') group by h",
        "error_rate": "select shard_id, count(*) filter (value > 90) as errors, count(*) as writes, round(count(*) filter (value > 90) / count(*), 6) as error_rate from log group by 1",
        "batch_metrics": """select shard_id, sum(n)::bigint as writes, count(*) as batches, max_by(n, b) as last_batch, min(lo) as min_latency, max(hi) as max_latency, floor(sum(t) / sum(n))::bigint as avg_latency from (
  select shard_id, event_id // 64 as b, count(*) as n, min(length(payload)) as lo, max(length(payload)) as hi, sum(length(payload)) as t from log group by all) group by 1""",
        "slot_stats": "select shard_id, 2::bigint as used, 512 as total from heads",
        "state_validate": f"$state select shard_id, {_OK} as valid, 1 as version_now, if({_OK}, write_offset, 0) as write_offset_now, if({_OK}, last_entry, -1) as last_entry_now from state",
        "rebuild_needed": "select shard_id, (shard_id % 3 = 0 and n > 0) as needs_rebuild from heads",
        "all_streams": "select printf('events:v1:%04d', i) as stream from range(16) t(i)",
        "stream_process": "select 'g' as \"group\", shard_id, n as \"offset\" from heads",
        "stream_dedup": "select shard_id, entry_number, event_id from log",
        "tumbling_counts": "select shard_id, date_trunc('hour', ts) as start, count(*) as n from log group by all",
        "sliding_counts": "select shard_id, date_trunc('hour', ts) - to_hours(h) as start, count(*) as n from log, (values (0), (1)) t(h) group by all",
        "session_counts": """select user_id, min(ts) as start, count(*) as n from (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as session from (
  select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval 6 hours, true)::int as first from log)) group by user_id, session""",
    }
    seg = {
        "segment_assign": "select shard_id, entry_number, segment_id from fold",
        "byte_offsets": "select shard_id, entry_number, off as offset_in_segment from fold",
        "segment_manifest": "select * from man",
        "locate_entry": "select f.shard_id, f.entry_number, f.segment_id, start_entry from fold f join seg s on s.shard_id = f.shard_id and s.segment_id = f.segment_id",
        "sparse_index": "select shard_id, entry_number, segment_id, off as offset_in_segment from fold where entry_number % 100 = 0",
        "asof_position": "select w.shard_id, w.entry_number, i.entry_number as node_entry, i.segment_id, i.off as offset_in_segment from fold w asof join (select * from fold where entry_number % 100 = 0) i on w.shard_id = i.shard_id and w.entry_number >= i.entry_number",
        "shard_stats": "select m.*, a.\"offset\" as fast, b.\"offset\" as slow from (select shard_id, sum(entries)::bigint as total_entries, sum(bytes)::bigint as total_bytes, min(start_time) as oldest, max(end_time) as newest, count(*) as files from seg group by 1) m join off a on a.shard_id = m.shard_id and a.\"group\" = 'fast' join off b on b.shard_id = m.shard_id and b.\"group\" = 'slow'",
        "client_stats": "select (select sum(n)::bigint from heads) as total_entries, (select count(*) from heads) as active_shards, (select sum(bytes)::bigint from seg) as total_bytes, (select count(*) from seg) as total_files, max(lag) as max_lag, sum(greatest(lag, 0))::bigint as lag_sum, count(distinct \"group\") filter (lag > 0) as lagging_groups from lags",
        "retention_stats": "select shard_id, sum(bytes)::bigint as bytes, count(*) as files, min(start_time) as oldest, max(end_time) as newest from seg group by rollup (shard_id)",
        "retain_age": f"select shard_id, segment_id, old, forced from ({_BY_AGE})",
        "retain_protect": 'select shard_id, segment_id, start_entry + entries - 1 >= (select min("offset") from off where off.shard_id = seg.shard_id) as protected from seg',
        "group_stats": 'select h.shard_id, h.n as durable_entry, files, "group", "offset", h.n - "offset" as lag from heads h join (select shard_id, count(*) as files from seg group by 1) using (shard_id) join off using (shard_id)',
        "retain_reader_guard": f"select shard_id, segment_id, old and segment_id not in (lo, hi) as goes from (select *, min(segment_id) over (partition by shard_id) as lo, max(segment_id) over (partition by shard_id) as hi from ({_BY_AGE}))",
        "retain_min_files": f"select shard_id, segment_id, old and rank <= greatest(others - 2, 0) as goes from (select shard_id, segment_id, old, sum(old::int) over (partition by shard_id order by segment_id) as rank, count(*) over (partition by shard_id) - 1 as others from ({_BY_AGE}))",
        "binary_scan": """select f.shard_id, printf('log-%016d.seg', segment_id) as file, f.entry_number - min(f.entry_number) over (partition by f.shard_id, segment_id) as entry_in_file, off as offset_in_segment,
  epoch_us(f.ts) * 1000 as ts_nanos, payload, f.stored_size as stored_bytes from fold f join log l on l.shard_id = f.shard_id and l.entry_number = f.entry_number""",
        "binary_read_at": """select f.shard_id, printf('log-%016d.seg', f.segment_id) as file, off as offset_in_segment, payload from fold f join seg s on s.shard_id = f.shard_id and s.segment_id = f.segment_id
  and f.entry_number = start_entry + entries // 2 join log l on l.shard_id = f.shard_id and l.entry_number = f.entry_number""",
        "binary_rebuild": "select shard_id, printf('log-%016d.seg', segment_id) as path, entries, bytes, start_entry, start_offset, end_offset, is_current from man",
        "manifest_roundtrip": """select man.shard_id, n as head, max(end_offset) over (partition by man.shard_id) as write_offset, o.t as offsets, ((n + 99) // 100)::int as nodes, printf('log-%016d.seg', segment_id) as path,
  start_offset, end_offset, start_entry, entries, epoch_us(start_time) * 1000 as start_nanos, epoch_us(end_time) * 1000 as end_nanos
  from man join heads using (shard_id) join (select shard_id, sum("offset")::bigint as t from off group by 1) o using (shard_id)""",
        "recover_manifest": """select shard_id, ['gone', 'shorter', 'longer', 'whole'][(k + 1)::int] as state, if(k = 0, null, printf('log-%016d.seg', segment_id)) as last_path, if(k = 1, start_entry + scanned, n) as head,
  if(k in (1, 2), start_entry + scanned, n) as next_entry, case k when 0 then start_offset when 3 then end_offset else start_offset + size end as write_offset, if(k = 0, null, scanned) as last_entries
  from (select *, shard_id % 4 as k, case shard_id % 4 when 1 then entries // 2 when 2 then entries + 3 else entries end as scanned, case shard_id % 4 when 1 then bytes // 2 when 2 then bytes + 100 else bytes end as size from man where is_current) join heads using (shard_id)""",
        "shard_details": """select m.shard_id, n as head, max(end_offset) over (partition by m.shard_id) as write_offset, count(*) over (partition by m.shard_id) as files, 2::bigint as consumer_groups, (n + 99) // 100 as index_nodes,
  l.t as lags, segment_id, bytes as size, entries, start_entry, start_time as created, end_time as modified from man m join heads using (shard_id) join (select shard_id, sum(lag)::bigint as t from lags where "group" <> 'new' group by 1) l on l.shard_id = m.shard_id""",
        "retention_report": """select s.*, round(bytes / 1073741824, 9) as gib, a.lag as fast, b.lag as new from (select shard_id, sum(bytes)::bigint as bytes, count(*) as files, min(start_time) as oldest, max(end_time) as newest from seg group by 1) s
  left join lags a on a.shard_id = s.shard_id and a."group" = 'fast' and a.lag > 0 left join lags b on b.shard_id = s.shard_id and b."group" = 'new' and b.lag > 0""",
        "asof_pruned": f"$thin select w.shard_id, w.entry_number, i.entry_number as node_entry, i.segment_id, i.off as offset_in_segment from fold w asof join (select nodes.* from nodes join kept using (shard_id, entry_number)) i on w.shard_id = i.shard_id and w.entry_number >= i.entry_number",
        "index_prune": "$thin select shard_id, entry_number from kept",
        "retain_pass": "$pass select shard_id, segment_id, reason, reason is not null as goes from passed",
        "retain_metrics": """$pass select shard_id, count(*) filter (reason is not null) as files_deleted, coalesce(sum(entries) filter (reason is not null), 0)::bigint as entries_deleted,
  coalesce(sum(bytes) filter (reason is not null), 0)::bigint as bytes_reclaimed, min(start_time) filter (reason is null) as oldest_entry from passed group by 1""",
        "retain_shard_size": f"select shard_id, segment_id, goes from ({_SHARD_SIZE})",
        "retain_global_size": "select shard_id, segment_id, not is_current and total - before > 200000 as goes from (select *, sum(bytes) over () as total, coalesce(sum(if(is_current, 0, bytes)) over (order by end_time, shard_id, segment_id rows between unbounded preceding and 1 preceding), 0) as before from man)",
        "retain_apply": f"select shard_id, segment_id, start_entry, entries from ({_SHARD_SIZE}) where not goes",
        "rebuild_index": "select shard_id, printf('log-%016d.seg', segment_id) as path, entries, bytes, start_entry, start_offset, end_offset, is_current from man",
    }
    out = {}
    for name, sql in log.items():
        out[name] = _whole(_LOG, sql)
    return out | {name: _whole(_SEG, sql) for name, sql in seg.items()}


def _whole(base: str, sql: str) -> str:
    extra = {"$diag": _DIAG, "$state": _STATE, "$pass": _PASS, "$thin": _THIN, "$batches": _BATCHES, "$marks": _MARKS}
    head = next((k for k in extra if sql.startswith(k)), None)
    return f"{base}, {extra[head]} {sql[len(head) :]}" if head else f"{base} {sql}"
