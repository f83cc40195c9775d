"""Registered queries and the SQL that checks each: filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Windows of the registered queries: an hour every half hour, eight bins, microseconds.
WIDTH, HOP, BINS = 3_600_000_000, 1_800_000_000, 8

#: The packet view in SQL, for the oracle.
PACKETS = """e as (
  select event_id as packet_no, epoch_us(ts) as us, strftime(ts, '%Y-%m-%d') as capture, user_id as u, json_extract_string(props, '$.k')::int as k, event_type, round(value * 100)::bigint as len from events),
p as (
  select packet_no, us, capture, len, 'mac-' || u as src_mac, '10.0.' || (u // 256) || '.' || (u % 256) as src_ip, '10.1.0.' || (k % 16) as dst_ip, (packet_no % 50)::int as src_port, k as dst_port,
    (event_type in ('click', 'signup'))::int as is_tcp, (event_type in ('view', 'purchase'))::int as is_udp, (event_type = 'error')::int as is_icmp,
    (event_type in ('click', 'signup'))::int as tcp_syn, (event_type = 'signup')::int as tcp_synack,
    (event_type = 'signup' or event_type = 'click' and packet_no % 3 = 0)::int as tcp_ack, (event_type in ('click', 'signup') and packet_no % 11 = 0)::int as tcp_rst, (event_type in ('click', 'signup') and packet_no % 7 = 1)::int as tcp_fin,
    case when event_type in ('view', 'purchase') and k < 50 then 'st-' || (u % 5) end as ssdp_st, case when event_type = 'view' and k < 50 then 'man-' || (k % 3) end as ssdp_man, case when event_type = 'view' and k < 50 and packet_no % 2 = 0 then 'agent-' || (u % 4) end as ssdp_user_agent,
    case when event_type = 'view' and k < 50 then 'M-SEARCH' when event_type = 'purchase' and k < 50 then '200-OK' end as ssdp_method, (u % 7 + 58)::int as ttl,
    (packet_no % 5 <> 0)::int as is_arp, case when event_type = 'error' then 1 else 2 end as arp_opcode, 'a' || (u % 20) as arp_sender_mac, 's' || (k % 25) as arp_sender_ip, 't' || (packet_no % 7) as arp_target_ip,
    case when packet_no % 3 = 0 then '00:00:00:00:00:00' else 'b' || (u % 11) end as arp_target_mac, (k % 25 = packet_no % 7)::int as arp_is_gratuitous from e)"""


def windows_sql(anchor: str = "min(us)", source: str = "p") -> str:
    """CTEs a and w: packets in their windows."""
    return f"""a as (select capture, {anchor} as u0, max(us) as u1 from {source} group by capture),
w0 as (select q.*, a.u0, unnest(generate_series(case when us - u0 < {WIDTH} then 0 else (us - u0 - {WIDTH}) // {HOP} + 1 end, (us - u0) // {HOP})) as window_index from {source} q join a using (capture) where us >= u0),
w as (select *, u0 + window_index * {HOP} as w_start, least({BINS - 1}, greatest(0, ((us - u0 - window_index * {HOP}) * {BINS}) // {WIDTH})) as bin from w0)"""


WINDOWED = f"with {PACKETS}, {windows_sql()}"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL for the same rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add
