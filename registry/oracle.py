"""The same queries as DuckDB SQL over the driver tables.

Every statement reads the study-shaped views below, written once as common
table expressions and pulled in by name.  Fitted values are rounded like the Spark
side's; all other arithmetic is the same to the last bit.
"""

from __future__ import annotations

import re

# Study-shaped inputs, then shared intermediate results; each may use earlier ones.
_VIEWS = {
    "player": """
        select c_custkey as player_id, c_name as name_full,
          case when c_mktsegment = 'MACHINERY' then 'C'
               when c_mktsegment = 'FURNITURE' then null else 'P' end as position
        from customer""",
    "season": """
        select cast(year(o_orderdate) + 13 as integer) as year,
          case o_orderpriority when '1-URGENT' then 'MLB' when '2-HIGH' then 'AAA'
            when '3-MEDIUM' then 'AA' when '4-NOT SPECIFIED' then 'A+' when '5-LOW' then 'A' end as level,
          cast(101 + o_custkey % 5 as bigint) as league_id,
          o_custkey as player_id,
          cast(count(distinct o_orderkey) as bigint) as games,
          cast(4 * count(*) as bigint) as batters_faced,
          cast(sum(l_quantity) as bigint) as pitches
        from orders join lineitem on o_orderkey = l_orderkey
        group by all""",
    "season_by_file": """
        select year, player_id as pitcher_id, cast(sum(batters_faced) as bigint) as batters_faced,
          case when sum(games) <= 1 then null
               when sum(pitches) >= 75 * sum(games) then 'starter' else 'reliever' end as role
        from season group by year, player_id""",
    "tracked": """
        select l_partkey as pitcher, cast(year(l_shipdate) + 13 as integer) as year,
          l_returnflag as flag, cast(sum(l_quantity) as bigint) as pitches,
          case when count(*) <> 4 then round(90 + 40 * avg(l_discount), 6) end as fb_velo
        from lineitem group by all""",
    "order_surgery": """
        select *, case when o_totalprice between 460000 and 464000 then null
            else cast(cast(o_orderdate as date) + interval 156 month as date) end as shifted
        from orders""",
    "reported": """
        select o_custkey as player_id, cast(year(shifted) as integer) as year,
          strftime(shifted, '%m/%d/%y') as date_surgery,
          case o_orderpriority when '1-URGENT' then 'Major' when '2-HIGH' then 'Minor'
            when '3-MEDIUM' then 'Amateur' end as level
        from order_surgery where o_totalprice >= 455000""",
    "surgery_list": """
        select o_custkey as player_id,
          case o_orderpriority when '1-URGENT' then 'MLB' when '2-HIGH' then 'AAA'
            when '3-MEDIUM' then 'A' when '4-NOT SPECIFIED' then 'HS' when '5-LOW' then 'Ind' end as level,
          case when o_orderstatus = 'P' then 'C' else 'P' end as position,
          strftime(shifted, '%m/%d/%y') as date_surgery,
          o_orderstatus in ('F', 'P') as is_tommy_john
        from order_surgery where o_totalprice >= 425000 and o_totalprice < 480000""",
    "pitch": """
        select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as game_id,
          cast(user_id * 100 + hour(ts) as bigint) as event_index,
          event_id as play_index, cast(event_id as varchar) as play_id,
          case event_type when 'click' then 'FF' when 'view' then 'SI' when 'error' then 'SL'
            when 'purchase' then 'CH' when 'signup' then 'FC' end as pitch_type,
          130 + value / 50 + ((user_id * 37) % 11 - 5) * 0.5 + ((day * 5 + user_id * 3) % 7 - 3) * 0.25
            + hour(ts) * ((user_id * 13) % 5 - 2) * 0.03125
            + hour(ts) * ((day * 3 + user_id) % 3 - 1) * 0.015625 as release_speed,
          user_id as pitcher_id
        from (select *, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as day from events)""",
    "event": """
        select distinct game_id, event_index, cast(event_index % 100 as integer) as inning from pitch""",
    "game": """
        select distinct cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as game_id,
          cast(ts as date) as date
        from events""",
    "biomechanics": """
        select cast(vec_id as varchar) as org_movement_id, label as metric from embeddings""",
    "minors": """
        select pitcher as player_id, year, 'minors' as level,
          case flag when 'N' then 'he' else 'tm' end as vendor, pitches, fb_velo
        from tracked where flag in ('N', 'R') and fb_velo is not null""",
    "minors_wide": """
        select player_id, year, level,
          cast(max(case when vendor = 'he' then pitches end) as double) as pitches_he,
          cast(max(case when vendor = 'tm' then pitches end) as double) as pitches_tm,
          max(case when vendor = 'he' then fb_velo end) as fb_velo_he,
          max(case when vendor = 'tm' then fb_velo end) as fb_velo_tm
        from minors group by all""",
    "minors_blend": """
        select player_id, year, level,
          coalesce(pitches_he, 0) + coalesce(pitches_tm, 0) as pitches,
          (coalesce(pitches_he, 0) * coalesce(fb_velo_he, 0)
            + coalesce(pitches_tm, 0) * coalesce(fb_velo_tm, 0))
            / nullif(coalesce(pitches_he, 0) + coalesce(pitches_tm, 0), 0) as fb_velo
        from minors_wide
        where fb_velo_he is null or fb_velo_tm is null or abs(fb_velo_he - fb_velo_tm) < 1""",
    "level_wide": """
        select coalesce(a.player_id, b.player_id) as player_id, coalesce(a.year, b.year) as year,
          a.pitches as pitches_majors, a.fb_velo as fb_velo_majors,
          b.pitches as pitches_minors, b.fb_velo as fb_velo_minors
        from (select pitcher as player_id, year, pitches, fb_velo from tracked
              where flag = 'A' and fb_velo is not null) a
        full join (select * from minors_blend where fb_velo is not null) b
          on a.player_id is not distinct from b.player_id and a.year is not distinct from b.year""",
    "tracking": """
        select player_id, year,
          cast(coalesce(pitches_majors, 0) + coalesce(pitches_minors, 0) as double) as pitches,
          (coalesce(pitches_majors, 0) * coalesce(fb_velo_majors, 0)
            + coalesce(pitches_minors, 0) * coalesce(fb_velo_minors, 0))
            / nullif(coalesce(pitches_majors, 0) + coalesce(pitches_minors, 0), 0) as fb_velo
        from level_wide
        where fb_velo_majors is null or fb_velo_minors is null
          or abs(fb_velo_majors - fb_velo_minors) < 2""",
    "both_lists": """
        select player_id, level, position, date_surgery, 'tommy_john' as surgery
        from surgery_list where is_tommy_john and position = 'P'
        union all
        select player_id, level, null, date_surgery, 'internal_brace'
        from surgery_list where not is_tommy_john""",
    "listed": """
        select player_id, level, cast(strptime(date_surgery, '%m/%d/%y') as date) as date_surgery,
          surgery, cast(year(strptime(date_surgery, '%m/%d/%y')) as integer) as year
        from both_lists""",
    "injury_sources": """
        select coalesce(r.player_id, l.player_id) as player_id, coalesce(r.year, l.year) as year,
          cast(strptime(r.date_surgery, '%m/%d/%y') as date) as date_surgery_reported,
          r.level as level_reported, l.level as level_listed,
          l.date_surgery as date_surgery_listed, l.surgery
        from reported r full join listed l
          on r.player_id is not distinct from l.player_id and r.year is not distinct from l.year""",
    "injury": """
        select player_id, year, coalesce(date_surgery_reported, date_surgery_listed) as date_surgery,
          case when level_reported is not null then level_reported
               when level_listed = 'MLB' then 'Major'
               when level_listed in ('AAA', 'AA', 'A+', 'A', 'A-', 'Rk') then 'Minor'
               when level_listed in ('Coll', 'HS') then 'Amateur' end as level
        from injury_sources""",
    "totals": """
        select year, player_id,
          first(level order by batters_faced desc nulls last, level asc nulls last) as level,
          cast(sum(games) as bigint) as games, cast(sum(batters_faced) as bigint) as batters_faced,
          cast(sum(pitches) as bigint) as pitches
        from season group by year, player_id""",
    "rollup_": """
        select *, case when games = 0 and pitches = 0 then null
            when pitches >= 75 * games then 'starter' when pitches < 75 * games then 'reliever' end as role
        from totals""",
    "filled": """
        select * replace (last_value(role ignore nulls) over (
            partition by player_id order by year nulls last
            rows between unbounded preceding and current row) as role)
        from rollup_""",
    "eligible": """
        select f.*, p.name_full, p.position from filled f left join player p using (player_id)
        where (p.position is null or p.position = 'P') and batters_faced >= 27""",
    "at_risk": """
        select coalesce(e.year, i.year) as year, coalesce(e.player_id, i.player_id) as player_id,
          e.name_full, coalesce(e.batters_faced, 0) as batters_faced, e.role, i.date_surgery,
          case when e.level = 'MLB' then 'Majors' when e.level <> 'MLB' then 'Minors' end as level,
          e.level as level_pss
        from eligible e full join injury i
          on e.year is not distinct from i.year and e.player_id is not distinct from i.player_id
        where (i.level is null or i.level in ('Major', 'Minor')) and coalesce(e.year, i.year) > 2008""",
    "cohort": """
        select a.year, a.player_id, a.name_full, a.batters_faced, a.role, a.date_surgery, a.level,
          p.pitches as previous_pitches
        from at_risk a left join rollup_ p on p.player_id = a.player_id and p.year + 1 = a.year""",
    "velo_cohort": """
        select a.year, a.player_id, a.name_full, a.batters_faced, a.role, t.fb_velo, a.date_surgery,
          a.level, a.level_pss
        from at_risk a left join tracking t on t.player_id = a.player_id and t.year + 1 = a.year""",
    "season_or_surgery": """
        select coalesce(s.year, l.year) as year, coalesce(s.pitcher_id, l.player_id) as pitcher_id,
          s.batters_faced, s.role, l.level, l.date_surgery
        from season_by_file s full join listed l
          on s.year is not distinct from l.year and s.pitcher_id is not distinct from l.player_id""",
    "baseline": """
        select year, pitcher_id, name_full, batters_faced, role, level, date_surgery
        from (
          select s.*, p.name_full, p.position from (
            select * replace (last_value(role ignore nulls) over (
                partition by pitcher_id order by year nulls last, date_surgery nulls last
                rows between unbounded preceding and current row) as role)
            from season_or_surgery) s
          left join player p on s.pitcher_id = p.player_id)
        where position = 'P' and year >= (select min(year) from season_by_file)
          and (level = 'MLB' or batters_faced >= 27)""",
    "season_rows": """
        select year, player_id as pitcher_id, batters_faced,
          case when games <= 1 then null when pitches >= 75 * games then 'starter' else 'reliever' end as role
        from season""",
    "level_timeline": """
        select year, pitcher_id, last_value(role ignore nulls) over (
            partition by pitcher_id order by year nulls last
            rows between unbounded preceding and current row) as known
        from (select year, pitcher_id, max(role) as role
              from (select year, pitcher_id, role from season_rows
                    union all select year, player_id, null from listed) group by all)""",
    "baseline_levels": """
        select s.year, s.pitcher_id, p.name_full, s.batters_faced, coalesce(s.role, t.known) as role,
          s.level, s.date_surgery
        from (select coalesce(s.year, l.year) as year, coalesce(s.pitcher_id, l.player_id) as pitcher_id,
                s.batters_faced, s.role, l.level, l.date_surgery
              from season_rows s full join listed l
                on s.year is not distinct from l.year and s.pitcher_id is not distinct from l.player_id) s
        left join level_timeline t
          on t.year is not distinct from s.year and t.pitcher_id is not distinct from s.pitcher_id
        join player p on s.pitcher_id = p.player_id and p.position = 'P'
        where s.year >= (select min(year) from season_rows)
          and (s.level = 'MLB' or s.batters_faced >= 27)""",
    "baseline_rates": """
        select year, role, yes + no as count, yes / (yes + no) as injury_rate
        from (
          select year, role, nullif(count(date_surgery), 0) as yes,
            nullif(count(*) - count(date_surgery), 0) as no
          from baseline group by year, role)""",
    "enriched": """
        select p.*, g.date, e.inning, b.metric, 0.681818 * p.release_speed as release_speed_mph,
          row_number() over (partition by p.game_id, p.pitcher_id
            order by p.event_index, p.play_index) as pitch_number
        from pitch p
        left join game g on p.game_id = g.game_id
        left join event e on p.game_id = e.game_id and p.event_index = e.event_index
        left join biomechanics b on p.play_id = b.org_movement_id""",
    "primary_type": """
        select pitcher_id, pitch_type from (
          select pitcher_id, pitch_type, row_number() over (
            partition by pitcher_id order by count(*) desc, pitch_type asc nulls last) as place
          from pitch group by pitcher_id, pitch_type)
        where place = 1 and pitch_type in ('FF', 'SI')""",
    "starter": """
        select pitcher_id, count(*) as pitches,
          count(distinct game_id) + max(cast(game_id is null as integer)) as games,
          count(*) / (count(distinct game_id) + max(cast(game_id is null as integer))) as pitches_per_game
        from pitch group by pitcher_id having pitches_per_game >= 2.5""",
    "model_rows": """
        select e.*, s.pitches, s.games, s.pitches_per_game from enriched e
        join primary_type p on e.pitcher_id = p.pitcher_id and e.pitch_type = p.pitch_type
        join starter s on e.pitcher_id = s.pitcher_id""",
}


def _significant(expression: str) -> str:
    """Six significant digits, like the Spark side."""
    return f"cast(format('{{:.5e}}', {expression}) as double)"


def _cox(steps: int = 8) -> str:
    """Newton's method with Efron's ties, one block per step; two standardised covariates.

    The common table expressions end with the fit b, s and risk sets r of the last step.
    """
    sums = {"0": "1", "1": "z1", "2": "z2", "11": "z1 * z1", "12": "z1 * z2", "22": "z2 * z2"}
    blocks = ["b0 as materialized (select 0.0::double as b1, 0.0::double as b2)"]
    for k in range(steps + 1):
        at_time = ", ".join(
            f"sum(w * {e}) as a{i}, coalesce(sum(w * {e}) filter (event), 0) as e{i}" for i, e in sums.items()
        )
        risk = ", ".join(f"sum(a{i}) over (order by time desc) as s{i}" for i in sums)
        phi = ", ".join(f"s{i} - l / d * e{i} as p{i}" for i in sums)
        blocks.append(f"""t{k} as materialized (
            select time, sum(n) as n_rows, coalesce(sum(n) filter (event), 0) as d, {at_time},
              coalesce(sum(n * z1) filter (event), 0) as x1, coalesce(sum(n * z2) filter (event), 0) as x2
            from (select *, n * exp(b1 * z1 + b2 * z2) as w from standard, b{k}) group by time)""")
        blocks.append(f"""r{k} as materialized (
            select *, sum(n_rows) over (order by time desc) as n_risk, {risk} from t{k})""")
        blocks.append(f"""s{k} as materialized (
            select sum(case when l = 0 then x1 else 0 end - p1 / p0) as u1,
              sum(case when l = 0 then x2 else 0 end - p2 / p0) as u2,
              sum(p11 / p0 - p1 * p1 / (p0 * p0)) as i11, sum(p12 / p0 - p1 * p2 / (p0 * p0)) as i12,
              sum(p22 / p0 - p2 * p2 / (p0 * p0)) as i22
            from (select l, x1, x2, {phi}
                  from (select *, unnest(range(cast(d as bigint))) as l from r{k} where d > 0)))""")
        blocks.append(f"""b{k + 1} as materialized (
            select b1 + (i22 * u1 - i12 * u2) / (i11 * i22 - i12 * i12) as b1,
              b2 + (i11 * u2 - i12 * u1) / (i11 * i22 - i12 * i12) as b2 from b{k}, s{k})""")
    joined = ",".join(blocks)
    return f"""
      with grouped as materialized (
        select batters_faced as time, date_surgery is not null as event,
          cast(role = 'starter' as double) as x1, cast(previous_pitches as double) as x2, count(*) as n
        from cohort where role is not null and previous_pitches is not null and batters_faced is not null
        group by all),
      middle as materialized (
        select sum(n * x1) / sum(n) as m1, sum(n * x2) / sum(n) as m2, sum(n) as n_all from grouped),
      spread as materialized (
        select m1, m2, sqrt(sum(n * (x1 - m1) ^ 2) / any_value(n_all)) as k1,
          sqrt(sum(n * (x2 - m2) ^ 2) / any_value(n_all)) as k2 from grouped, middle group by m1, m2),
      standard as materialized (
        select time, event, n, (x1 - m1) / k1 as z1, (x2 - m2) / k2 as z2 from grouped, spread),
      {joined},
      fit as materialized (
        select b1, b2, i11, i12, i22, i11 * i22 - i12 * i12 as det, m1, m2, k1, k2
        from b{steps}, s{steps}, spread),
      risk_sets as (select * from r{steps})"""


def _cox_fit() -> str:
    columns = ", ".join(
        f"{_significant(e)} as {name}"
        for name, e in (("coef", "c"), ("hazard_ratio", "exp(c)"), ("std_err", "se"), ("z", "c / se"))
    )
    return f"""{_cox()},
      terms as (
        select 'role_starter' as term, b1 / k1 as c, sqrt(i22 / det) / k1 as se from fit
        union all
        select 'previous_pitches', b2 / k2, sqrt(i11 / det) / k2 from fit)
      select term, {columns} from terms"""


def _cox_curve() -> str:
    """The fit's curve for a reliever with the mean of last year's pitches."""
    phi = ", ".join(f"s{i} - l / d * e{i} as p{i}" for i in ("0", "1", "2"))
    numbers = {
        "cum_hazard": "hazard",
        "survival": "exp(-hazard)",
        "std_err": "se",
        "lower": "exp(-hazard - 1.959963984540054 * se)",
        "upper": "least(1.0, exp(-hazard + 1.959963984540054 * se))",
    }
    columns = ", ".join(f"{_significant(e)} as {name}" for name, e in numbers.items())
    return f"""{_cox()},
      jumps as (
        select time, sum(1 / p0) as h, sum(1 / (p0 * p0)) as v,
          sum((p1 / p0 + m1 / k1) / p0) as q1, sum((p2 / p0) / p0) as q2
        from (select time, m1, k1, {phi}
              from (select *, unnest(range(cast(d as bigint))) as l from risk_sets where d > 0), fit)
        group by time),
      steps as (
        select time, n_risk, d as n_event, n_rows - d as n_censor, sum(coalesce(h, 0)) over w as h,
          sum(coalesce(v, 0)) over w as v, sum(coalesce(q1, 0)) over w as q1, sum(coalesce(q2, 0)) over w as q2
        from risk_sets left join jumps using (time) window w as (order by time)
        union all
        select 0, sum(n), 0, 0, 0, 0, 0, 0 from grouped having min(time) > 0),
      curve as (
        select *, exp(-m1 / k1 * b1) * h as hazard, exp(-m1 / k1 * b1)
          * sqrt(v + (q1 * q1 * i22 - 2 * q1 * q2 * i12 + q2 * q2 * i11) / det) as se
        from steps, fit)
      select cast(time as bigint) as time, cast(n_risk as bigint) as n_risk, cast(n_event as bigint) as n_event,
        cast(n_censor as bigint) as n_censor, {columns} from curve"""


# Covariances of the pitcher's and the game's lines, relative to the residual variance.
_GIVEN = {"b": (0.5, -0.01, 0.002), "c": (0.3, 0.005, 0.001)}


def _shrunk(s: str, v: str, cov: str) -> str:
    """(I + S L)^-1 times S and times a vector, and log det(I + S L), as columns."""
    s11, s12, s22 = (f"{s}{e}" for e in ("11", "12", "22"))
    l11, l12, l22 = (f"{cov}{e}" for e in ("11", "12", "22"))
    det = (
        f"(1 + {s11} * {l11} + 2 * {s12} * {l12} + {s22} * {l22}"
        f" + ({s11} * {s22} - {s12} * {s12}) * ({l11} * {l22} - {l12} * {l12}))"
    )
    w11, w12 = f"(1 + {s11} * {l11} + {s12} * {l12})", f"({s11} * {l12} + {s12} * {l22})"
    w21, w22 = f"({s12} * {l11} + {s22} * {l12})", f"(1 + {s12} * {l12} + {s22} * {l22})"
    return f"""({w22} * {s11} - {w12} * {s12}) / {det} as m11, ({w22} * {s12} - {w12} * {s22}) / {det} as m12,
          ({w11} * {s22} - {w21} * {s12}) / {det} as m22, ({w22} * {v}1 - {w12} * {v}2) / {det} as m1,
          ({w11} * {v}2 - {w21} * {v}1) / {det} as m2, ln({det}) as logdet"""


def _given_lines() -> str:
    """The mixed model at given covariances; ends with total, pitcher_line and game_line."""
    entries = ", ".join(
        f"{a}::double + 2 * mx * {b}::double + mx * mx * {c}::double as {n}11, k * ({b}::double + mx * {c}::double) as {n}12,"
        f" k * k * {c}::double as {n}22"
        for n, (a, b, c) in _GIVEN.items()
    )
    explained = lambda v, cov: (
        f"({v}1 * {cov}11 * m1 + {v}1 * {cov}12 * m2 + {v}2 * {cov}12 * m1 + {v}2 * {cov}22 * m2)"
    )
    return f"""
      with line_sums as materialized (
        select pitcher_id, game_id, count(*)::double as n, regr_avgx(y, x) as ax, regr_avgy(y, x) as ay,
          regr_sxx(y, x) as xx, regr_sxy(y, x) as xy, regr_syy(y, x) as yy
        from (select pitcher_id, game_id, release_speed_mph as y, pitch_number::double as x from model_rows)
        where x is not null and y is not null group by all),
      middle as materialized (
        select sum(n) as n_all, sum(n * ax) / sum(n) as mx, sum(n * ay) / sum(n) as my from line_sums),
      scaled as materialized (
        select any_value(n_all) as n_all, any_value(mx) as mx, any_value(my) as my,
          sqrt(sum(xx + n * (ax - mx) ^ 2) / any_value(n_all)) as k from line_sums, middle),
      cov as materialized (select *, {entries} from scaled),
      games as materialized (
        select pitcher_id, game_id, n as s11, n * (ax - mx) / k as s12, (xx + n * (ax - mx) ^ 2) / k ^ 2 as s22,
          n * (ay - my) as r1, (xy + n * (ax - mx) * (ay - my)) / k as r2, yy + n * (ay - my) ^ 2 as yy, cov.* exclude (mx, my, k, n_all)
        from line_sums, cov),
      inner_part as materialized (select *, {_shrunk("s", "r", "c")} from games),
      outer_sums as materialized (
        select pitcher_id, sum(m11) as a11, sum(m12) as a12, sum(m22) as a22, sum(m1) as u1, sum(m2) as u2,
          sum(yy - {explained("r", "c")}) as yy, sum(logdet) as inner_logdet,
          any_value(b11) as b11, any_value(b12) as b12, any_value(b22) as b22
        from inner_part group by all),
      outer_part as materialized (select *, {_shrunk("a", "u", "b")} from outer_sums),
      whole_sums as materialized (
        select sum(yy - {explained("u", "b")}) as square, sum(logdet + inner_logdet) as logs,
          sum(m11) as i11, sum(m12) as i12, sum(m22) as i22, sum(m1) as t1, sum(m2) as t2 from outer_part),
      fixed as materialized (
        select *, (i22 * t1 - i12 * t2) / (i11 * i22 - i12 * i12) as f1,
          (i11 * t2 - i12 * t1) / (i11 * i22 - i12 * i12) as f2 from whole_sums),
      total as materialized (
        select f1 - mx / k * f2 + my as intercept, f2 / k as slope, f1, f2, mx, k,
          sqrt((square - f1 * t1 - f2 * t2) / (n_all - 2)) as sigma,
          logs + (n_all - 2) * (1 + ln(2 * pi() * (square - f1 * t1 - f2 * t2) / (n_all - 2)))
            + ln(i11 * i22 - i12 * i12) + 2 * ln(k) as criterion
        from fixed, scaled),
      pitcher_part as materialized (
        select pitcher_id, b11 * h1 + b12 * h2 as d1, b12 * h1 + b22 * h2 as d2, mx, k, f1, f2
        from (select *, m1 - m11 * f1 - m12 * f2 as h1, m2 - m12 * f1 - m22 * f2 as h2 from outer_part, total)),
      pitcher_line as materialized (
        select pitcher_id as player_id, d1 - mx * (d2 / k) as intercept, d2 / k as slope from pitcher_part),
      game_part as materialized (
        select pitcher_id, game_id, mx, k, c11 * g1 + c12 * g2 as e1, c12 * g1 + c22 * g2 as e2
        from (select i.*, mx, k, m1 - m11 * (f1 + d1) - m12 * (f2 + d2) as g1, m2 - m12 * (f1 + d1) - m22 * (f2 + d2) as g2
              from inner_part i join pitcher_part p on i.pitcher_id is not distinct from p.pitcher_id)),
      game_line as materialized (
        select g.pitcher_id as player_id, name_full, g.game_id, date, e1 - mx * (e2 / k) as intercept_game, e2 / k as slope_game,
          p.intercept as intercept_pitcher, p.slope as slope_pitcher,
          t.intercept + p.intercept + (e1 - mx * (e2 / k)) as intercept_total, t.slope + p.slope + e2 / k as slope_total
        from game_part g join pitcher_line p on g.pitcher_id is not distinct from p.player_id
        left join player n on g.pitcher_id is not distinct from n.player_id
        left join game d on g.game_id is not distinct from d.game_id, (select intercept, slope from total) t)"""


def _given(columns: str, source: str) -> str:
    """A statement over the given-covariance fit; names after a bar are fitted values."""
    plain, _, fitted = columns.partition("|")
    picked = [c.strip() for c in plain.split(",") if c.strip()]
    picked += [f"{_significant(c.strip())} as {c.strip()}" for c in fitted.split(",") if c.strip()]
    return f"{_given_lines()}\n      select {', '.join(picked)} from {source}"


_GAME_LINE = "intercept_game, slope_game, intercept_pitcher, slope_pitcher, intercept_total, slope_total"
_FITTED = """(
        select m.pitcher_id, m.game_id, date, pitch_number, release_speed_mph,
          intercept_total + slope_total * pitch_number as fitted_mph
        from (select pitcher_id, game_id, pitch_number, release_speed_mph from model_rows) m
        join game_line l on m.pitcher_id is not distinct from l.player_id and m.game_id is not distinct from l.game_id)"""


def _km(stratum: str) -> str:
    return f"""
      with per_time as (
        select {stratum}, batters_faced as time, count(date_surgery) as n_event,
          count(*) - count(date_surgery) as n_censor
        from cohort where {stratum} is not null and batters_faced is not null group by all),
      risk as (
        select *, sum(n_event + n_censor) over (partition by {stratum} order by time desc) as n_risk
        from per_time),
      steps as (
        select {stratum}, time, n_risk, n_event, n_censor,
          sum(case when n_event < n_risk then ln(1 - n_event / n_risk) else 0 end) over w as log_survival,
          sqrt(sum(case when n_event < n_risk
            then n_event / (cast(n_risk as double) * (n_risk - n_event)) else 0 end) over w) as std_err,
          max(cast(n_event = n_risk as integer)) over w as ended
        from risk window w as (partition by {stratum} order by time)
        union all
        select {stratum}, 0, sum(n_event + n_censor), 0, 0, 0, 0, 0
        from per_time group by {stratum} having min(time) > 0)
      select {stratum}, cast(time as bigint) as time, cast(n_risk as bigint) as n_risk,
        cast(n_event as bigint) as n_event, cast(n_censor as bigint) as n_censor,
        {_significant("case when ended = 1 then 0.0 else exp(log_survival) end")} as survival,
        {_significant("case when ended = 0 then std_err end")} as std_err,
        {_significant("case when ended = 0 then exp(log_survival - 1.959963984540054 * std_err) end")} as lower,
        {_significant("case when ended = 0 then least(1.0, exp(log_survival + 1.959963984540054 * std_err)) end")}
          as upper
      from steps"""


_STATEMENTS = {
    "scan_csv_untyped": """
        select cast(o_orderkey as integer) as whole,
          case when o_orderkey % 7 <> 0 then cast(o_orderkey as bigint) * 10000000000 end as long,
          o_totalprice / 8 as fraction,
          case when o_orderkey % 2 = 0 then o_orderkey::double else o_orderkey + 0.5::double end as mixed_number,
          case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as date,
          case when o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as varchar)
            else cast(o_orderkey as varchar) end as date_or_number,
          case when o_orderkey % 3 <> 0 then o_orderpriority end as text, cast(null as varchar) as nothing
        from orders""",
    "scan_csv": """select pitcher, year, pitches as "TotalPitches", fb_velo as "PrimaryFB_Velo"
        from tracked where flag = 'A'""",
    "scan_partitioned_dir": "select * from season_by_file",
    "sink_season_summary": "select * from season",
    "filter_position": """select player_id, level, position, date_surgery
        from surgery_list where is_tommy_john and position = 'P'""",
    "filter_scalar_min": "select * from listed where year >= (select min(year) from season_by_file)",
    "player_lookup": "select name_full from player where player_id = 42",
    "parse_date": """
        select o_orderkey, strftime(o_orderdate, '%-m/%-d/%y') as text,
          cast(o_orderdate as date) as parsed, cast(year(o_orderdate) as integer) as parsed_year
        from orders""",
    "split_label": """
        select pitcher_id || ':' || game_id as pitcher_game, cast(pitcher_id as integer) as player_id,
          cast(game_id as integer) as game_id
        from pitch""",
    "speed_mph": "select play_id, 0.681818 * release_speed as release_speed_mph from pitch",
    "left_join_player": "select r.*, p.name_full, p.position from rollup_ r left join player p using (player_id)",
    "prior_year_join": """
        select r.*, p.pitches as previous_pitches
        from rollup_ r left join rollup_ p on p.player_id = r.player_id and p.year + 1 = r.year""",
    "pitch_biomech_join": """
        select play_id, p.pitch_type as pitch_type_pitch,
          case when b.org_movement_id is not null then 'measured' end as pitch_type_biomech, b.metric
        from pitch p left join biomechanics b on p.play_id = b.org_movement_id""",
    "injury_reconcile": "select * from injury_sources",
    "union_surgery_lists": "select * from both_lists",
    "unpivot_metrics": """
        select player_id, year, level, vendor, 'pitches' as name, cast(pitches as double) as value from minors
        union all
        select player_id, year, level, vendor, 'fb_velo', fb_velo from minors""",
    "pivot_vendor": "select * from minors_wide",
    "fill_role": """
        select year, pitcher_id, batters_faced, last_value(role ignore nulls) over (
            partition by pitcher_id order by year nulls last
            rows between unbounded preceding and current row) as role
        from season_by_file""",
    "duplicate_injuries": """
        select player_id, year, count(*) as n from injury group by player_id, year having count(*) > 1""",
    "reconcile_vendor": "select * from minors_blend",
    "reconcile_level": "select * from tracking",
    "pitch_tracking": "select * from tracking",
    "pitch_tracking_csv": "select * from tracking",
    "listed_surgeries": "select * from listed",
    "ucl_injury": "select * from injury",
    "ucl_injury_csv": "select * from injury",
    "surgeries_by_year_level": """
        select year, case when level = 'MLB' then 'MLB' when level <> 'MLB' then 'Minors/Amateur' end as level,
          count(*) as n
        from listed where year > 2009 group by all""",
    "year_histogram": """
        with rows_ as (
          select year, case when level = 'MLB' then 'MLB'
            when level <> 'MLB' then 'Minors/Amateur' end as level
          from listed where year > 2009),
        span as (select min(year) as lo, max(year) - min(year) as width from rows_),
        counts as (
          select level, cast(ceil((year - lo) * 14 / width + 0.5) - 1 as integer) as bin, count(*) as n
          from rows_, span group by all),
        grid as (select distinct level, bin from rows_, (select unnest(range(15)) as bin))
        select g.level, cast(g.bin as integer) as bin, lo + width * g.bin / 14 as center,
          cast(coalesce(c.n, 0) as bigint) as n
        from grid g cross join span
        left join counts c on g.level is not distinct from c.level and g.bin = c.bin""",
    "season_rollup": "select * from rollup_",
    "survival_cohort": "select * from cohort",
    "cox_fit": _cox_fit(),
    "cox_curve": _cox_curve(),
    "injury_counts": """
        select year, level, date_surgery is not null as injury, count(*) as n from cohort group by all""",
    "injury_rate_year_level": """
        select year, level, yes as injured, no as uninjured, yes + no as count,
          yes / (yes + no) as injury_rate
        from (
          select year, level, nullif(count(date_surgery), 0) as yes,
            nullif(count(*) - count(date_surgery), 0) as no
          from cohort group by year, level)""",
    "velo_injury_cohort": "select * from velo_cohort",
    "velo_missing_rate": """
        select year, level_pss, avg(cast(fb_velo is null as double)) as missing_rate
        from velo_cohort where year > 2012 group by all""",
    "baseline_cohort": "select * from baseline",
    "baseline_cohort_levels": "select * from baseline_levels",
    "baseline_risk": "select * from baseline_rates order by role nulls last, year nulls last",
    "baseline_risk_display": """
        select year, role, count, round(injury_rate, 3) as injury_rate from baseline_rates""",
    "pitch_sequence": "select game_id, pitcher_id, play_id, pitch_number from enriched",
    "pitch_enriched": "select * from enriched",
    "pitch_enriched_csv": "select * from enriched",
    "pitch_type_counts": "select pitcher_id, pitch_type, count(*) as n from pitch group by all",
    "primary_pitch": "select * from primary_type",
    "starters": "select * from starter",
    "pitch_model_data": "select * from model_rows",
    "km_by_role": _km("role"),
    "km_by_level": _km("level"),
    "velo_ols_game": f"""
        select pitcher_id, game_id, n, {_significant("intercept")} as intercept, {_significant("slope")} as slope
        from (
          select pitcher_id, game_id, count(*) as n,
            case when min(pitch_number) < max(pitch_number) then regr_intercept(release_speed_mph, pitch_number) end as intercept,
            case when min(pitch_number) < max(pitch_number) then regr_slope(release_speed_mph, pitch_number) end as slope
          from model_rows group by pitcher_id, game_id)""",
    "velo_given_summary": _given("|intercept, slope, sigma, criterion", "total"),
    "velo_given_pitcher": _given(
        "player_id, name_full|intercept, slope", "(select * from pitcher_line left join player using (player_id))"
    ),
    "velo_given_game": _given(f"player_id, name_full, game_id, date|{_GAME_LINE}", "game_line"),
    "velo_given_fitted": _given("pitcher_id, game_id, date, pitch_number|release_speed_mph, fitted_mph", _FITTED),
    "velo_given_fitted_pitcher": _given(
        "pitcher_id, game_id, date, pitch_number|release_speed_mph, fitted_mph", f"{_FITTED} where pitcher_id = 7"
    ),
    "velo_decay_gradient": """
        select unnest(['outer_11', 'outer_21', 'outer_22', 'inner_11', 'inner_21', 'inner_22']) as factor,
          0.0::double as slope""",
}


def _needed(sql: str) -> list[str]:
    """Views a statement reads, directly or through other views, in order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name in set(re.findall(r"[a-z_]+", text)) & set(_VIEWS) - needed:
            needed.add(name)
            pending.append(_VIEWS[name])
    return [name for name in _VIEWS if name in needed]


def all_statements() -> dict[str, str]:
    statements = {}
    for key, sql in _STATEMENTS.items():
        views = ",\n".join(f"{name} as ({_VIEWS[name]})" for name in _needed(sql))
        body = sql.strip()
        if body.startswith("with "):
            statements[key] = f"with {views},\n{body[len('with '):]}"
        else:
            statements[key] = f"with {views}\n{body}" if views else body
    return statements
