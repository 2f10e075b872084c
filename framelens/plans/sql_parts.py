"""SQL building blocks for the twins: plain per-trace windows, as an independent statement."""

from __future__ import annotations

PK = """pk as (
  select trace_id, list_extract(['meet','teams','webex'], (trace_id % 3 + 1)::int) as vca,
    event_id as pkt_ord, t_us, t_us + 1704067200000000 as epoch_us,
    case when event_id % 13 = 0 then '10.0.1.9' else '10.0.1.1' end as ip_src,
    case when event_id % 11 = 0 then '10.0.0.9' else '10.0.0.1' end as ip_dst,
    case when event_id % 101 = 0 then '1,17' when event_id % 103 = 0 then null
         when event_id % 107 = 0 then '6' else '17' end as ip_proto,
    cast(least(1200, 100 + 200 * floor(value / 15)) as bigint) + event_id % 4 as length,
    case when p_type is not null then '0x1' end as ssrc, p_type,
    case when p_type is not null then (t_us // 100000) * 9000 end as rtp_ts,
    case when p_type is not null then t_us // 50000 end as seq,
    case when p_type = '98' and event_id % 10 < 7 then 1 when p_type is not null then 0 end as marker
  from (select *, user_id // 15 as trace_id,
          (epoch_us(ts) - 1704067200000000) // 50000 as t_us,
          case when event_type in ('click','view') then '98' when event_type = 'purchase' then '99'
               when event_type = 'signup' then '111' end as p_type
        from events))"""

CL = """cl as (
  select * replace (try_cast(ip_proto as int) as ip_proto) from pk
  where ip_proto is not null and ip_proto not like '%,%')"""

LB = """lb as (
  select trace_id, epoch_us // 1000000 as ts, count(distinct rtp_ts) as fps,
    cast(sum(length) * 8 as bigint) as bitrate,
    (max(t_us) - min(t_us)) / 1000.0 / count(*) as frame_jitter,
    case when count(distinct rtp_ts) <= 6 then 180 when count(distinct rtp_ts) <= 8 then 360
         else 720 end as height
  from pk where rtp_ts is not null group by 1, 2)"""


def best(name: str, population: str, endpoint: str = "ip_dst") -> str:
    return f"""{name} as (
  select trace_id, {endpoint} as best from (
    select trace_id, {endpoint},
      row_number() over (partition by trace_id order by sum(length) desc, {endpoint}) as rn
    from {population} where {endpoint} is not null group by 1, 2) where rn = 1)"""


def join_best(name: str, rows: str, chosen: str, where: str, endpoint: str = "ip_dst") -> str:
    return f"""{name} as (
  select r.* from {rows} r join {chosen} b on r.trace_id = b.trace_id and r.{endpoint} = b.best
  where {where})"""


HEUR_KEPT = [
    PK,
    CL,
    best("rcv", "cl"),
    join_best("kept", "cl", "rcv", "ip_proto = 17 and length > 306"),
]
# What the busiest sender sent the receiver.
FLOW = [
    PK,
    CL,
    best("rcv", "cl"),
    join_best("rx", "cl", "rcv", "ip_proto = 17"),
    best("snd", "rx", "ip_src"),
    join_best("flow", "rx", "snd", "true", "ip_src"),
]
FLOW_KEPT = [*FLOW, "kept as (select * from flow where length > 306)"]
ML_KEPT = [
    PK,
    CL,
    "udp as (select * from cl where ip_proto = 17)",
    best("rcv", "udp"),
    join_best("kept", "udp", "rcv", "length > 306"),
]
RTP_ROWS = [
    PK,
    CL,
    best("rcv", "pk"),
    join_best("rtp_rows", "cl", "rcv", "ssrc is not null"),
]
RTP_KEPT = RTP_ROWS + [
    """kept as (
  select *, case p_type when '98' then 'video' when '99' then 'rtx' end as role from rtp_rows
  where p_type = '98' or (p_type = '99' and length > 306))"""
]


def lookback(depth: str, deepest: int, source: str = "kept", name: str = "asg",
             include_first: bool = False) -> str:
    """Frame numbers by look-back, as lag + running sum."""
    lags = ", ".join(
        f"lag(length,{k}) over w as l{k}" for k in range(1, deepest + 2)
    )
    tests = " or ".join(
        f"({k} <= depth and abs(l{k} - length) <= 2"
        + ("" if include_first else f" and l{k + 1} is not null")
        + ")"
        for k in range(1, deepest + 1)
    )
    return f"""{name} as (
  select *, cast(sum(case when coalesce({tests}, false) then 0 else 1 end) over (
      partition by trace_id order by t_us, pkt_ord rows unbounded preceding) as bigint) as frame_num
  from (select *, {depth} as depth, {lags} from {source}
        window w as (partition by trace_id order by t_us, pkt_ord)))"""


LB3 = lookback("case vca when 'meet' then 3 when 'teams' then 2 else 1 end", 3)

SIZE_FRAMES = """fr as (
  select trace_id, vca, frame_num, min(epoch_us) as frame_st, max(epoch_us) as frame_et,
    cast(sum(length - 12) as bigint) as frame_size, count(*) as n_pkts, frame_num as tie
  from asg group by 1, 2, 3)"""

RTP_FRAMES = """fr as (
  select trace_id, vca, rtp_ts, min(epoch_us) as frame_st, max(epoch_us) as frame_et,
    cast(sum(length - 12) as bigint) as frame_size, count(*) as n_pkts, rtp_ts as tie
  from rtp_rows where p_type in ('98', '99') and length > 306
  group by 1, 2, 3 having sum(marker) = 1)"""

DURATIONS = """du as (
  select *, greatest(coalesce(frame_et - lag(frame_et, 1) over w, 0), 0) as dur,
    coalesce((frame_et - lag(frame_et, 30) over w) / 30.0, 0.0) as mean
  from fr window w as (partition by trace_id order by frame_et, tie))"""

FROZEN = """fz as (
  select *, case when dur / 1e6 > greatest(3 * mean / 1e6, mean / 1e6 + 0.15) then 1 else 0 end
    as is_freeze from {source})"""

TRIM = """tr as (
  select du.* from du left join (
    select trace_id, min(frame_num) as cut from du where dur >= 8000000 group by 1) c
  on du.trace_id = c.trace_id where frame_num > coalesce(cut, -1))"""

SECONDS = """{name} as (
  select trace_id, vca, frame_et // 1000000 + 1 as ft_end, count(*) as fps,
    cast(sum(frame_size) * 8 as bigint) as bitrate, stddev_samp(dur) / 1000 as jitter,
    cast(sum(is_freeze) as bigint) as freeze_count, sum(is_freeze * dur) / 1e6 as freeze_dur
  from fz group by 1, 2, 3)"""

IP_SECONDS = HEUR_KEPT + [
    LB3, SIZE_FRAMES, DURATIONS, TRIM, FROZEN.format(source="tr"), SECONDS.format(name="ip_sec"),
]
RTP_SECONDS = RTP_ROWS + [
    RTP_FRAMES, DURATIONS, FROZEN.format(source="du"), SECONDS.format(name="rtp_sec"),
]


def renamed(parts: list[str], names: dict[str, str]) -> list[str]:
    """The same blocks under other names, so two chains fit one WITH list."""
    import re

    out = []
    for part in parts:
        for old, new in names.items():
            part = re.sub(rf"\b{old}\b", new, part)
        out.append(part)
    return out


PREDICTIONS = (
    IP_SECONDS
    + renamed(RTP_SECONDS[2:], {"rcv": "rcv2", "fr": "fr2", "du": "du2", "fz": "fz2"})
    + [
        LB,
        """pred as (
  select m.metric, s.method, s.vca, s.trace_id, s.ft_end as ts,
    case m.metric when 'framesReceivedPerSecond' then s.fps when 'bitrate' then s.bitrate
      else s.jitter end::double as pred,
    case m.metric when 'framesReceivedPerSecond' then round_even(l.fps, 0) when 'bitrate' then l.bitrate
      else l.frame_jitter end::double as gt
  from (select 'ip-udp-heuristic' as method, * from ip_sec
        union all select 'rtp-heuristic', * from rtp_sec) s
  join lb l on l.trace_id = s.trace_id and l.ts = s.ft_end
  cross join (values ('framesReceivedPerSecond'), ('bitrate'), ('frame_jitter')) m(metric)
  where not (m.metric = 'frame_jitter' and s.jitter is null))""",
    ]
)


def anchors(window_us: int = 1_000_000, source: str = "kept", name: str = "an") -> list[str]:
    """Window openers by recursion over one trace's packets."""
    return [
        f"""{name} as (
  select trace_id, 1 as n, min(t_us) as t_us from {source} group by 1
  union all
  select a.trace_id, a.n + 1, min(k.t_us) from {name} a
  join {source} k on k.trace_id = a.trace_id and k.t_us > a.t_us + {window_us}
  group by 1, 2)""",
    ]


def placed(closed: str = "left", source: str = "kept", name: str = "win", an: str = "an") -> list[str]:
    behind = (
        "case when n > 1 and k.t_us = a.t_us and k.first_at then 1 else 0 end"
        if closed == "right"
        else "0"
    )
    return [
        f"""{name}_k as (
  select *, row_number() over (partition by trace_id order by t_us, pkt_ord) - 1 as pkt_idx,
    row_number() over (partition by trace_id, t_us order by pkt_ord) = 1 as first_at,
    t_us - coalesce(lag(t_us) over (partition by trace_id order by t_us, pkt_ord), 0) as iat_us,
    lag(seq) over (partition by trace_id order by t_us, pkt_ord) as prev_seq
  from {source})""",
        f"""{name}_e as (
  select a.trace_id, a.n, coalesce(
    (select min(k.epoch_us) from {source} k, {an} b where b.trace_id = a.trace_id and b.n = a.n + 1
      and k.trace_id = a.trace_id and k.t_us = b.t_us),
    (select max(k.epoch_us) from {source} k where k.trace_id = a.trace_id)) // 1000000 as et
  from {an} a)""",
        f"""{name} as (
  select p.*, e.et from (
    select k.*, cast(a.n - {behind} as bigint) as "interval" from {name}_k k
    asof join {an} a on k.trace_id = a.trace_id and k.t_us >= a.t_us) p
  join {name}_e e on e.trace_id = p.trace_id and e.n = p."interval")""",
    ]


def stats(value: str, prefix: str, default: float | None = None) -> str:
    def d(x):
        return x if default is None else f"coalesce({x}, {default})"

    return ", ".join(
        f"round({d(expr)}, 6) as {prefix}_{k}" if k not in ("min", "max") or default is not None
        else f"{expr} as {prefix}_{k}"
        for k, expr in {
            "mean": f"avg({value})",
            "std": f"stddev_pop({value})",
            "min": f"min({value})",
            "max": f"max({value})",
            "q1": f"quantile_cont({value}, 0.25)",
            "q2": f"quantile_cont({value}, 0.5)",
            "q3": f"quantile_cont({value}, 0.75)",
        }.items()
    )


L_COLS = (
    stats("length", "l")
    + ", count(*) as l_num_pkts, cast(sum(length) as bigint) as l_num_bytes, "
    "count(distinct length) as l_num_unique"
)
T_COLS = (
    stats("(iat_us / 1000)", "t")
    + ", case when count(*) <= 1 then 0 else count(*) filter (iat_us >= 30000) end as t_burst_count"
)

RTP_STATS = [
    """st as (
  select trace_id, vca, "interval", et, rtp_ts, max((role = 'video')::int) as vid,
    max((role = 'rtx')::int) as rtx,
    sum(case when role = 'video' then marker end) as vm, sum(case when role = 'rtx' then marker end) as rm,
    sum(case when role = 'video' and seq - prev_seq <> 1 then 1 else 0 end) as ooo,
    max(t_us) as t_last, max(pkt_idx) - min(pkt_idx) as span
  from win group by 1, 2, 3, 4, 5)""",
    """og as (
  select trace_id, rtp_ts as rtp0, max(t_last) as t0 from st
  where (trace_id, rtp_ts) in (select (trace_id, min(rtp_ts)) from st group by trace_id)
  group by 1, 2)""",
    """tm as (
  select st.*,
    90 / (rtp_ts - lag(rtp_ts) over (partition by st.trace_id, "interval" order by rtp_ts)) as buffer,
    case when "interval" = max("interval") over (partition by st.trace_id, rtp_ts) then
      (max(t_last) over (partition by st.trace_id, rtp_ts) - t0) / 1e6 - (rtp_ts - rtp0) / 90000
    end as lag
  from st join og on st.trace_id = og.trace_id)""",
    f"""rf as (
  select trace_id, vca, "interval", et, cast(sum(vid) as bigint) as vid_ts_unique,
    cast(sum(rtx) as bigint) as rtx_ts_unique, cast(coalesce(sum(vm), 0) as bigint) as vid_marker_sum,
    cast(coalesce(sum(rm), 0) as bigint) as rtx_marker_sum,
    count(*) filter (vid = 1 and rtx = 1) as common_vid_rtx_ts_unique,
    count(*) as union_ts_unique, cast(sum(ooo) as bigint) as ooo_seqno_vid,
    {stats('buffer', 'buffer_time', 0.0)}, {stats('span', 'n_pkt_diff', -1.0)},
    {stats('lag', 'rtp_lag', 100000.0)}
  from tm group by 1, 2, 3, 4)""",
]


def sql(parts: list[str], select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
