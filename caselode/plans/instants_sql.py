"""The SQL of p1_found: the same ordered cascade, generated from the same fixed values, for another engine."""

from __future__ import annotations

from caselode.functions.times import ABBREVIATIONS, CASCADE, DAY_S, MAX_UTC_S, MIN_UTC_S, MONTH_NAMES, MONTHS, UNITS, WEEKDAYS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _unit(x: str) -> str:
    return "case " + " ".join(f"when {x} >= {(MIN_UTC_S - DAY_S - u.zero_s) * u.per_second} and {x} < {(MAX_UTC_S + DAY_S - u.zero_s) * u.per_second} then '{u.name}'" for u in UNITS) + " end"


def _seconds(x: str, unit: str) -> str:
    return "case " + " ".join(f"when {unit} = '{u.name}' then cast(floor({x}) as bigint) // {u.per_second} + {u.zero_s}" for u in UNITS) + " end"


def _shown(t: str, zone: str) -> str:
    return f"epoch(timezone({zone}, to_timestamp({t})))"


def _instant(w: str, zone: str) -> str:
    at = [f"({w} - ({_shown(f'({w} + {far})', zone)} - ({w} + {far})))" for far in (-129_600, 129_600)]
    ok = [f"case when {_shown(a, zone)} = {w} then {a} end" for a in at]
    return f"case when {zone} is null then null when ({ok[0]}) <> ({ok[1]}) then null else coalesce({ok[0]}, {ok[1]}) end"


def _sql() -> str:
    canon = "case " + " ".join(f"when regexp_matches(v, {_text(p)}) then regexp_replace(v, {_text(p)}, {_text(''.join(chr(92) + c[1:] if c.startswith('$') else c for c in _parts(o)))})" for _, p, o in CASCADE) + " end"
    months = "map {" + ", ".join(f"'{m}': {i + 1}" for names in (MONTHS, MONTH_NAMES) for i, m in enumerate(names) if names is MONTHS or m not in MONTHS) + "}"
    zones = "map {" + ", ".join(f"'{k}': {v}" for k, v in ABBREVIATIONS.items()) + "}"
    days = "[" + ", ".join(f"'{d}'" for d in WEEKDAYS) + "]"
    return f"""with z as (select lower(trim(regexp_replace(examiner, '\\s+', ' ', 'g'))) as who, case when min(tz) = max(tz) then min(tz) end as tz from examiner_zone group by 1),
    s as (select image_set, case when min(z.tz) = max(z.tz) and count(z.tz) = count(*) then min(z.tz) end as tz
        from (select distinct image_set, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) as who from case_metadata where metadata_field = 'ExaminerName' and value is not null) n left join z using (who) where who <> '' group by 1),
    v as (select meta_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') as v, s.tz from case_metadata left join s using (image_set) where metadata_field in ('AcquiredDate', 'SystemDate')),
    c as (select meta_id, tz, case when regexp_matches(v, '^\\d{{9,19}}$') and not regexp_matches(v, '^\\d{{14}}$') then try_cast(v as bigint) end as ticks, string_split({canon}, '|') as f from v),
    n as (select *, try_cast(f[1] as int) as y, coalesce(try_cast(f[2] as int), ({months})[f[2]]) as mo, try_cast(f[3] as int) as d, try_cast(f[4] as int) as h, try_cast(f[5] as int) as mi, try_cast(f[6] as int) as s from c),
    w as (select *, try_cast(lpad(cast(y as varchar), 4, '0') || '-' || lpad(cast(mo as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date) as day,
        case when f[7] = '' then case when h < 24 then h end when h between 1 and 12 then h % 12 + case f[7] when 'PM' then 12 else 0 end end as hour from n),
    l as (select *, case when mi < 60 and s < 60 and (f[9] = '' or ({days})[isodow(day)] = f[9]) then cast(epoch(day) as bigint) + hour * 3600 + mi * 60 + s end as wall,
        case when f[8] = '' then tz when contains(f[8], '/') then f[8] end as zone,
        case when regexp_matches(f[8], '^[+-](0\\d|1[0-4]):?[0-5]\\d$') then case f[8][1] when '-' then -1 else 1 end * (cast(f[8][2:3] as int) * 3600 + cast(right(f[8], 2) as int) * 60) else ({zones})[f[8]] end as off from w),
    m as (select 'case_metadata' as rec_table, meta_id as rec_id, coalesce({_seconds("ticks", _unit("ticks"))}, wall - off, {_instant("wall", "zone")}) as t from l),
    k as (select evidence_id, volume_label, case when min(tz) = max(tz) then min(tz) end as tz, true as local from volume_clock group by all),
    fs as (select id, mtime, {_unit("mtime")} as unit, k.local, k.tz from files left join k on k.evidence_id = files.evidence_id and k.volume_label = split_part(files.volume_label, '/', 1) where mtime is not null and not isnan(mtime)),
    fw as (select *, {_seconds("mtime", "unit")} as wall from fs where unit is not null and (unit <> 'unix_s' or local)),
    r as (select 'files' as rec_table, id as rec_id, case when local then {_instant("wall", "tz")} else wall end as t from fw)
    select rec_table, rec_id, cast(t as bigint) as utc_s from (select * from m union all select * from r) where t >= {MIN_UTC_S} and t < {MAX_UTC_S}"""


def _parts(order: str) -> list[str]:
    out, i = [], 0
    while i < len(order):
        out.append(order[i : i + 2] if order[i] == "$" else order[i])
        i += len(out[-1])
    return out


P1_FOUND = _sql()
