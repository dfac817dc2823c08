"""DuckDB SQL of the catalogue's queries."""

from __future__ import annotations

from ..config import GRADE_BANDS, MILE_M, MatchConfig
from ..sources.fixtures import cte

C = MatchConfig()
BIN = C.bin_m
T_M, T_BINS = 3000.0, 7


def r6(e: str, digits: int = 6) -> str:
    return f"round({e},{digits})+0.0::double"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2*6371000.0::double*asin(sqrt(least(1.0::double, power(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-{b})/2),2))))"


def at(items: str, x: str) -> str:
    """The value of a list at place x of a unit grid, between its neighbours."""
    k = f"least(cast(floor({x}) as bigint), len({items})-2)"
    return f"({items}[{k}+1]+({x}-{k})*({items}[{k}+2]-{items}[{k}+1]))"


RESAMPLED = """
 tot as (select profile_id, list(ele_m order by seq) e, max(dist_m) total, greatest(2, cast(round_even(max(dist_m)/{bin}::double,0) as bigint)) n from {points} group by 1 having max(dist_m)>0),
 edge as (select profile_id, total, n, list_transform(range(0,n+1), lambda i: {edge}) b from tot),
 grades as (select profile_id, n, list_transform(range(0,n), lambda i: (b[i+2]-b[i+1])/(total/n)*100.0::double) g from edge)"""


def resampled(points: str) -> str:
    """Grades of profiles with knots each 100 m."""
    return cte(points) + "," + RESAMPLED.format(bin=BIN, points=points, edge=at("e", "(i*(total/n)/100.0::double)"))


BANDS = ", ".join(f"({i},{low}::double,{high}::double,'{label}')" for i, (low, high, label) in enumerate(GRADE_BANDS))
DTW = (
    "list_reduce(list_transform({a}, lambda x: [x]), lambda row, x: list_reduce(list_transform(range(0,len({b})), lambda j: [j::double]),"
    " lambda acc, j: list_append(acc, abs(x[1]-{b}[cast(j[1] as bigint)+1])+least(row[cast(j[1] as bigint)+1], row[cast(j[1] as bigint)+2], acc[-1])), [1e18::double]),"
    " list_prepend(0.0::double, list_transform({b}, lambda y: 1e18::double)))[-1]/greatest(len({a}),len({b}))"
)


def dtw(a: str, b: str) -> str:
    return DTW.format(a=a, b=b)


def emd(qa: str, qb: str) -> str:
    return f"list_sum(list_transform(range(1,101), lambda i: abs({qa}[i]-{qb}[i])))/100.0::double"


def quant(s: str) -> str:
    """100 quantiles of a sorted list."""
    return f"list_transform(range(0,100), lambda i: {at(s, f'(i*(len({s})-1)/99.0::double)')})"


TARGET = f"""
 tg as (select list(ele_m order by seq) te from profile_points where profile_id=1 and seq<=30),
 tb as (select te, list_transform(range(0,{T_BINS + 1}), lambda i: {at("te", f"(i*{T_M}::double/{T_BINS}/100.0::double)")}) b from tg),
 tt as (select list_transform(range(0,{T_BINS}), lambda i: (b[i+2]-b[i+1])/({T_M}::double/{T_BINS})*100.0::double) tgr,
   greatest(list_sum(list_transform(range(1,len(te)), lambda i: greatest(te[i+1]-te[i],0))), list_sum(list_transform(range(1,len(te)), lambda i: greatest(te[i]-te[i+1],0)))) tv from tb),
 ts as (select *, list_sort(tgr) so from tt),
 target as (select tgr, tv, {quant("so")} tq from ts)"""

WINDOWS = f"""
 prof as (select profile_id, list(ele_m order by seq) e, max(dist_m) total from profile_points group by 1 having max(dist_m) >= {C.min_window_frac * T_M}),
 lens as (select i::int as li, {T_M}::double*f as wl from (values {", ".join(f"({i},{f!r}::double)" for i, f in enumerate(C.length_fracs))}) v(i,f)),
 win as (select profile_id, e, total, li, wl, unnest(range(0, greatest(1, cast(ceil((total-wl+1e-9::double)/60.0::double) as bigint)))) as si from prof, lens where wl<=total),
 samp as (select *, si*60.0::double as st, list_transform(range(0,100), lambda k: {at("e", "(case when k=99 then (si*60.0::double+wl)/100.0::double else (si*60.0::double+k*(wl/99.0::double))/100.0::double end)")}) s from win),
 bn as (select *, greatest(2, cast(round_even(wl/{BIN}::double,0) as bigint)) nb from samp),
 ed as (select *, list_transform(range(0,nb+1), lambda i: {at("s", "(i*99.0::double/nb)")}) b,
   list_sum(list_transform(range(1,100), lambda i: greatest(s[i+1]-s[i],0))) gain, list_sum(list_transform(range(1,100), lambda i: greatest(s[i]-s[i+1],0))) loss from bn),
 feat as (select *, list_transform(range(0,nb), lambda i: (b[i+2]-b[i+1])/(wl/nb)*100.0::double) g from ed)"""


def best(both: bool) -> str:
    ways = "(values (0),(1)) d(dir)" if both else "(values (0)) d(dir)"
    return f"""
 way as (select profile_id, li, si, st, wl, gain, loss, dir, case when dir=0 then g else list_transform(list_reverse(g), lambda x: -x) end gg from feat, {ways}),
 ord as (select *, list_sort(gg) so from way),
 qs as (select *, {quant("so")} q from ord),
 sc as (select qs.*, tv, {dtw("tgr", "gg")} shape, {emd("tq", "q")} dist, case when tv>0 then abs(greatest(gain,loss)-tv)/tv else 0.0::double end dev from qs, target),
 rk as (select *, {C.weight_shape}::double*shape+{C.weight_distribution}::double*dist+{C.weight_gain}::double*dev as score from sc),
 best as (select * from (select *, row_number() over (partition by profile_id order by round(score,9), li, si, dir) rn from rk) where rn=1)"""


BEST_COLUMNS = f"""select profile_id, {r6("score")} as score, li, cast(si as int) as si, {r6("st")} as start_m, {r6("st+wl")} as end_m,
 {r6("case when dir=0 then gain else loss end*3.28084::double")} as gain_ft, {r6("case when dir=0 then loss else gain end*3.28084::double")} as loss_ft,
 case when dir=0 then 'forward' else 'reverse' end as direction, {r6("shape")} as shape_score, {r6("dist")} as dist_score, {r6("dev")} as gain_dev from best"""

# places of a track that has a knot each 100 m
GEO = "geo as (select profile_id, list(lat order by seq) la, list(lon order by seq) lo from geo_track group by 1)"
STARTS = f"""{GEO}, bstart as (select best.profile_id, best.score, best.st, best.wl, best.dir, best.gg, {at("la", "(case when dir=1 then st+wl else st end/100.0::double)")} as lat, {at("lo", "(case when dir=1 then st+wl else st end/100.0::double)")} as lon,
 case when dir=0 then gain else loss end*3.28084::double gain_ft, case when dir=0 then loss else gain end*3.28084::double loss_ft, shape, dist, dev from best join geo on geo.profile_id=best.profile_id)"""

TILES = """
 c as (select 40.0::double la, -105.3::double lo, 15.0/111.0::double dlat, 15.0/(111.0::double*cos(radians(40.0::double))) dlon, 4.0/111.0::double slat, 4.0/(111.0::double*cos(radians(40.0::double))) slon),
 n as (select *, cast(ceil(((la+dlat)-(la-dlat))/slat) as bigint) nla, cast(ceil(((lo+dlon)-(lo-dlon))/slon) as bigint) nlo from c),
 tiles as (select cast(i*nlo+j as int) tile_idx, cast(i as int) i, cast(j as int) j, (la-dlat)+i*slat sw_lat, (lo-dlon)+j*slon sw_lon, (la-dlat)+i*slat+slat ne_lat, (lo-dlon)+j*slon+slon ne_lon
   from n, range(0,100) a(i), range(0,100) b(j) where i<nla and j<nlo)"""
SCAN = """
 hit as (select s.*, t.tile_idx, row_number() over (partition by s.id order by t.tile_idx, s.discovery_idx) rn from segments s join tiles t on s.start_lat between t.sw_lat and t.ne_lat and s.start_lon between t.sw_lon and t.ne_lon where s.activity_type='running'),
 scan as (select * from hit where rn=1)"""
LOW, HIGH = C.min_window_frac * (T_M / MILE_M), C.max_segment_mult * (T_M / MILE_M)
LENGTH = f"fit as (select * from {{0}} where distance/{MILE_M}::double between {LOW!r}::double and {HIGH!r}::double)"


def nearest(starts: str) -> str:
    return f"select s.key, s.lat, s.lon, s.discovery_idx, (select min({hav('s.lat', 's.lon', 'r.lat', 'r.lon')}) from roads r) d from {starts} s"


def tiers(starts: str) -> str:
    """Status and tier of each start, by the first start of its memo cell."""
    return f"""near as ({nearest(starts)}), keyed as (select *, round_even(lat,4) a4, round_even(lon,4) o4 from near),
 firsts as (select *, first_value(d) over (partition by a4, o4 order by discovery_idx) fd from keyed),
 tier as (select key, case when fd<=2500 then 'found' else 'none' end status, case when fd<=300 then 300.0 when fd<=1000 then 1000.0 when fd<=2500 then 2500.0 end::double dist_m from firsts)"""


PENALTY = "case when status='none' then 3.0 when status='found' then case when dist_m<=400 then 0.0 when dist_m>=1200 then 2.5 else round_even(2.5::double*(dist_m-400.0::double)/800.0::double,2) end else 0.0 end::double"
SLUG = r"nullif(regexp_replace(lower(trim(regexp_replace(name, '[^\p{L}\p{N}_\s-]', '', 'g'))), '\s+', '_', 'g'),'')"


def oracle_sql() -> dict[str, str]:
    bands = f"bands as (select * from (values {BANDS}) b(band_idx,lo,hi,label)), share as (select g.profile_id, band_idx::int band_idx, label, avg(case when v>=lo and v<hi then 1.0::double else 0.0::double end) share from (select profile_id, unnest(g) v from grades) g, bands group by 1,2,3)"
    steps = f"st as (select *, case when lag(lat) over w is null then 0.0::double else {hav('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} end step_m from geo_track window w as (partition by profile_id order by seq))"
    emb = "v as (select profile_id, list(ele_m order by seq) e from embedding_profile group by 1), d as (select profile_id, list_transform(range(1,64), lambda i: (e[i+1]-e[i])) g from v), t as (select g tg from d where profile_id=0)"
    win = f"{cte('profile_points')},{TARGET},{WINDOWS}"
    geo_best = f"{cte('profile_points', 'geo_track', 'segments', 'roads')},{TARGET},{WINDOWS},{best(True)},{STARTS}"
    top = f"""{geo_best},{TILES},{SCAN}, {LENGTH.format("scan")},
 cand as (select fit.*, b.* exclude (profile_id) from bstart b join fit on fit.id=b.profile_id), starts as (select id as key, lat, lon, discovery_idx from cand), {tiers("starts")},
 fin as (select cand.*, status, dist_m, {PENALTY} pen, score+{PENALTY} final from cand join tier on key=id),
 top as (select *, row_number() over (order by final, discovery_idx) rank from fin)"""
    lines = [
        "printf('%d. %s  (segment is %.1f mi total)', rank, name, distance/1609.34::double)",
        "'   '||case when dir=1 then printf('Run the segment BACKWARD (%s) \u2014 start at mile %.2f, finish at mile %.2f', leg, b, a) else printf('Run the segment as-recorded (%s) \u2014 mile %.2f to %.2f (%.2f mi)', leg, a, b, b-a) end",
        "printf('   Gain: %.0f ft | Loss: %.0f ft | Grade: %.1f%% (target vertical: %.0f ft)', gain_ft, loss_ft, (gain_ft-loss_ft)/((b-a)*5280.0::double)*100, tv*3.28084::double)",
        "'   Grade composition: '||composition",
        "printf('   Scores: shape %.2f | distribution %.2f | gain dev %.0f%% | access %.2f | COMBINED %.2f', shape, dist, dev*100, pen, final)",
        "'   '||case when status='found' then printf('~%dm from a road', cast(round_even(dist_m,0) as bigint)) when status='none' then 'no road within 2.5km' else 'access not confirmed' end",
        "'   https://example.org/segments/'||cast(id as varchar)",
    ]
    block = "||chr(10)||".join(f"({x})" for x in lines)
    rounded = "g as (select profile_id, case when profile_id%2=0 then -seq else seq end seq, round_even(lat,6) lat, round_even(lon,6) lon, round_even(ele_m,1) ele_m from geo_track)"
    walked = f"""{rounded}, st as (select *, case when lag(lat) over w is null then 0.0::double else {hav('lag(lat) over w', 'lag(lon) over w', 'lat', 'lon')} end step_m, ele_m-lag(ele_m) over w up from g window w as (partition by profile_id order by seq)),
 cu as (select *, sum(step_m) over (partition by profile_id order by seq) d from st)"""
    seg_starts = "starts as (select id as key, start_lat as lat, start_lon as lon, discovery_idx from segments)"
    q = {
        "haversine_step": f"with {cte('geo_track')}, {steps} select profile_id, seq, {r6('step_m')} as step_m from st",
        "cumulative_distance": f"with {cte('geo_track')}, {steps} select profile_id, seq, {r6('sum(step_m) over (partition by profile_id order by seq)', 4)} as dist_m from st",
        "gain_loss": f"with {cte('profile_points')}, d as (select profile_id, ele_m-lag(ele_m) over (partition by profile_id order by seq) d from profile_points), s as (select profile_id, sum(greatest(coalesce(d,0),0)) g, sum(greatest(-coalesce(d,0),0)) l from d group by 1) select profile_id, {r6('g')} as gain_m, {r6('l')} as loss_m, {r6('greatest(g,l)')} as max_vert_m from s",
        "profile_summary": f"with {cte('profile_points')}, s as (select profile_id, count(*) n_points, max(dist_m) total_m, arg_min(ele_m,seq) f, arg_max(ele_m,seq) l from profile_points group by 1) select profile_id, n_points, {r6('total_m')} as total_m, {r6(f'total_m/{MILE_M}')} as total_mi, {r6('case when total_m>0 then (l-f)/total_m*100 end')} as avg_grade from s",
        "interp_asof": f"""with {cte("profile_points_irregular")}, t as (select profile_id, max(dist_m) m from profile_points_irregular group by 1),
 x as (select profile_id, cast(k as int) k, k*37.3::double x from t, range(0,100000) r(k) where k*37.3 <= m+75),
 kn as (select *, lead(dist_m) over (partition by profile_id order by seq) d1, lead(ele_m) over (partition by profile_id order by seq) e1 from profile_points_irregular)
 select x.profile_id, k, {r6("x")} as x, {r6("case when e1 is null then ele_m else ele_m+(e1-ele_m)*((x-dist_m)/(d1-dist_m)) end")} as ele_m from x join kn on x.profile_id=kn.profile_id and x>=dist_m and (d1 is null or x<d1)""",
        "resample_grades": f"with {resampled('profile_points')} select profile_id, cast(unnest(range(0,n)) as int) as bin_idx, {r6('unnest(g)')} as grade from grades",
        "reverse_profile": f"with {resampled('profile_points')} select profile_id, cast(unnest(range(0,n)) as int) as bin_idx, {r6('-unnest(list_reverse(g))')} as grade from grades",
        "grade_bands": f"with {resampled('profile_points_gentle')}, {bands} select profile_id, band_idx, label, {r6('share')} as share from share",
        "composition_text": f"with {resampled('profile_points_gentle')}, {bands} select profile_id, coalesce(string_agg(cast(cast(round_even(share*100,0) as int) as varchar)||'% '||label, ', ' order by share desc, band_idx) filter (where share>0),'') as composition from share group by 1",
        "dtw_pairwise": f"with {cte('embedding_profile')}, {emb} select profile_id, {r6(dtw('tg', 'g'))} as dtw from d, t",
        "emd_pairwise": f"with {cte('embedding_profile')}, {emb}, s as (select profile_id, list_sort(g) s, list_sort(tg) ts from d, t), q as (select profile_id, {quant('s')} qa, {quant('ts')} qb from s) select profile_id, {r6(emd('qa', 'qb'))} as emd from q",
        "window_enumerate": f"with {win} select profile_id, li, cast(si as int) as si, {r6('si*60.0::double')} as start_m, {r6('wl')} as win_len from win",
        "window_features": f"with {win} select profile_id, li, cast(si as int) as si, {r6('gain')} as gain_m, {r6('loss')} as loss_m, {r6('g[1]')} as first_grade, {r6('g[-1]')} as last_grade from feat",
        "best_window": f"with {win},{best(True)} {BEST_COLUMNS}",
        "best_window_forward_only": f"with {win},{best(False)} {BEST_COLUMNS}",
        "match_start_point": f"with {geo_best} select profile_id, {r6('lat')} as start_lat, {r6('lon')} as start_lon from bstart",
        "tile_grid": f"with {TILES} select tile_idx, i, j, {r6('sw_lat')} as sw_lat, {r6('sw_lon')} as sw_lon, {r6('ne_lat')} as ne_lat, {r6('ne_lon')} as ne_lon from tiles",
        "tile_scan_dedup": f"with {cte('segments')},{TILES},{SCAN} select id, name, tile_idx from scan",
        "length_filter": f"with {cte('segments')}, {LENGTH.format('segments')} select id, name, {r6('distance')} as distance, {r6(f'distance/{MILE_M}')} as mi from fit",
        "stream_join": f"with {cte('segments')}, p as (select profile_id, count(*) n_knots, max(dist_m) total_m from profile_points group by 1) select id, name, n_knots, {r6('total_m')} as total_m from segments join p on id=profile_id where activity_type='running'",
        "nearest_road": f"with {cte('segments', 'roads')}, {seg_starts}, near as ({nearest('starts')}) select key as id, {r6('case when d<=2500 then d end')} as road_m from near",
        "nearest_road_exact": f"with {cte('segments', 'roads')}, {seg_starts}, near as ({nearest('starts')}) select key as id, 'found' as status, cast(round_even(d,0) as double) as dist_m from near",
        "road_tier_probe": f"with {cte('segments', 'roads')}, {seg_starts}, {tiers('starts')} select key as id, status, dist_m from tier",
        "access_penalty": f"with {cte('access_readings')} select profile_id, status, {r6(PENALTY)} as penalty, case when status='found' then '~'||cast(cast(round_even(dist_m,0) as bigint) as varchar)||'m from a road' when status='none' then 'no road within 2.5km' else 'access not confirmed' end as access from access_readings",
        "topk_matches": f"""with {top}
 select cast(rank as int) as rank, id as segment_id, name, {r6("final")} as final_score, {r6("score")} as terrain_score, {r6("pen")} as access_penalty, status as road_status, dist_m as road_dist_m,
 {r6("st")} as win_start_m, {r6("st+wl")} as win_end_m, {r6("gain_ft")} as gain_ft, {r6("loss_ft")} as loss_ft, {r6(f"(gain_ft-loss_ft)/(((st+wl)/{MILE_M}::double-st/{MILE_M}::double)*5280.0::double)*100")} as net_avg_grade,
 case when dir=0 then 'forward' else 'reverse' end as direction, case when gain_ft>=loss_ft then 'CLIMB' else 'DESCENT' end as leg, {r6("shape")} as shape_score, {r6("dist")} as dist_score, {r6("dev")} as gain_dev,
 {r6("lat")} as start_lat, {r6("lon")} as start_lon, {r6(f"distance/{MILE_M}")} as segment_total_mi, 'https://example.org/segments/'||cast(id as varchar) as url from top where rank<=10""",
        "ranked_report": f"""with {top}, t10 as (select *, st/{MILE_M}::double a, (st+wl)/{MILE_M}::double b, case when gain_ft>=loss_ft then 'CLIMB' else 'DESCENT' end leg from top where rank<=10),
 gv as (select id, unnest(gg) v from t10), bnd as (select * from (values {BANDS}) b(band_idx,lo,hi,label)),
 shr as (select id, band_idx, label, avg(case when v>=lo and v<hi then 1.0::double else 0.0::double end) share from gv, bnd group by 1,2,3),
 cmp as (select id, string_agg(cast(cast(round_even(share*100,0) as int) as varchar)||'% '||label, ', ' order by share desc, band_idx) filter (where share>0) composition from shr group by 1)
 select cast(rank as int) as rank, {block} as block from t10 join cmp using (id), (select tv from target)""",
        "report_header": f"with {top} select printf('TOP %d MATCHES (lower combined score = more similar shape + more reachable)', count(*)) as header from top where rank<=10",
        "search_totals": f"""with {cte("profile_points", "segments")},{TILES},{SCAN}, {LENGTH.format("scan")} select 'tiles' as measure, count(*) as n from tiles union all select 'candidates', count(*) from scan
 union all select 'survivors', count(*) from fit union all select 'scored', count(*) from fit where distance >= {C.min_window_frac * T_M!r}::double""",
        "access_sources": f"""with {cte("segments", "roads")}, {seg_starts}, {tiers("starts")}, ex as (select key, 'found' as status, cast(round_even(d,0) as double) as dist_m from near),
 e as (select key, status, dist_m, {r6(PENALTY)} p from ex), t as (select key, status, dist_m, {r6(PENALTY)} p from tier)
 select e.key as id, e.status as exact_status, e.dist_m as exact_m, e.p as exact_penalty, t.status as tier_status, t.dist_m as tier_m, t.p as tier_penalty from e join t on e.key=t.key""",
        "nearest_road_globe": f"with {cte('far_starts', 'far_roads')} select s.id, {r6('min(' + hav('s.start_lat', 's.start_lon', 'r.lat', 'r.lon') + ')', 3)} as road_m from far_starts s, far_roads r group by 1",
        "segment_metadata": f"with {cte('segment_refs', 'segments')}, i as (select ref_id, case when regexp_full_match(trim(ref), '\\d+') then try_cast(trim(ref) as bigint) when regexp_extract(trim(ref), '/segments/(\\d+)', 1)<>'' then try_cast(regexp_extract(trim(ref), '/segments/(\\d+)', 1) as bigint) end as segment_id from segment_refs) select ref_id, segment_id, coalesce(name, 'Segment '||cast(segment_id as varchar)) as name, name is not null as known from i left join segments s on s.id=segment_id",
        "sql_functions_on_roads": f"with {cte('roads')} select road_id, {r6(hav('40.0::double', '(-105.3::double)', 'lat', 'lon'), 4)} as dist_m, {r6('1.0/(111.0::double*cos(radians(lat)))', 9)} as degrees, {r6('1.0/111.0::double', 9)} as degrees_lat, cast(road_id as bigint) as again, 'road_'||cast(road_id as varchar)||'_é' as slug from roads",
        "sql_tile_grid": f"with {TILES} select tile_idx, {r6('sw_lat')} as sw_lat, {r6('sw_lon')} as sw_lon, {r6('ne_lat')} as ne_lat, {r6('ne_lon')} as ne_lon from tiles",
        "cache_lookup": f"""with {cte("cache_entries")}, l as (select *, row_number() over (partition by cache_key order by fetched_at desc, payload_id desc) rn from cache_entries),
 f as (select * from l where rn=1 and fetched_at >= timestamp '1998-07-15' - interval 30 days), s as (select o_custkey k, max(o_orderkey) p from orders where o_custkey%3=0 group by 1)
 select c_custkey as cache_key, case when is_miss then 'none' when not is_miss then 'cache' when p is not null then 'service' else 'none' end as source, case when is_miss then null when not is_miss then payload_id else p end as payload_id
 from customer left join f on f.cache_key=c_custkey left join s on s.k=c_custkey""",
        "gpx_profile": f"""with {cte("geo_track", "segments")}, {walked}, z as (select profile_id, count(*) n_points, max(d) total_m, sum(greatest(coalesce(up,0),0)) gain, sum(greatest(-coalesce(up,0),0)) loss, arg_min(ele_m,seq) e0, arg_max(ele_m,seq) e1 from cu group by 1)
 select s.name||case when id%2=0 then ' (reversed)' else '' end as name, n_points, {r6("total_m", 4)} as total_m, {r6("gain", 4)} as gain_m, {r6("loss", 4)} as loss_m, {r6("case when total_m>0 then (e1-e0)/total_m*100 end", 4)} as avg_grade from z join segments s on s.id=profile_id""",
        "gpx_roundtrip": f"""with {cte("geo_track", "segments")}, {rounded} select s.name||case when id%2=0 then ' (reversed)' else '' end as name, cast(row_number() over (partition by profile_id order by seq)-1 as int) as seq, lat, lon, ele_m as ele from g join segments s on s.id=profile_id""",
        "gpx_target": f"""with {cte("geo_track")}, {walked}, one as (select * from cu where profile_id=1), kn as (select *, lead(d) over (order by seq) d1, lead(ele_m) over (order by seq) e1 from one),
 tt as (select max(d) total, greatest(2, cast(round_even(max(d)/{BIN}::double,0) as bigint)) n from one), ed as (select i, case when i=n then total else i*(total/n) end x, total, n from tt, range(0,100000) r(i) where i<=n),
 att as (select i, total, n, case when e1 is null then ele_m else ele_m+(e1-ele_m)*((x-d)/(d1-d)) end e from ed join kn on x>=d and (d1 is null or x<d1)),
 nx as (select *, lead(e) over (order by i) en from att) select cast(i as int) as bin_idx, {r6("(en-e)/(total/n)*100")} as grade from nx where en is not null""",
        "parse_segment_id": f"with {cte('segment_refs')} select ref_id, case when regexp_full_match(trim(ref), '\\d+') then try_cast(trim(ref) as bigint) when regexp_extract(trim(ref), '/segments/(\\d+)', 1)<>'' then try_cast(regexp_extract(trim(ref), '/segments/(\\d+)', 1) as bigint) end as segment_id from segment_refs",
        "slugify_names": f"with {cte('names')} select doc_id, {SLUG} as slug, coalesce({SLUG}, 'segment_'||cast(doc_id as varchar))||case when doc_id%2=0 then '_reversed' else '' end||'.gpx' as file from names",
        "tile_cache_key": f"with {TILES} select tile_idx, translate(concat_ws('_', printf('%.4f',sw_lat), printf('%.4f',sw_lon), printf('%.4f',ne_lat), printf('%.4f',ne_lon)),'-.','mp')||'.json' as cache_key from tiles",
        "cache_freshness": f"""with {cte("cache_entries")}, l as (select *, row_number() over (partition by cache_key order by fetched_at desc, payload_id desc) rn from cache_entries),
 f as (select * from l where rn=1 and fetched_at >= timestamp '1998-07-15' - interval 30 days), k as (select c_custkey cache_key from customer)
 select k.cache_key, case when is_miss is null then 'fetch' when is_miss then 'miss' else 'hit' end as state, case when not is_miss then payload_id end as payload_id from k left join f on f.cache_key=k.cache_key""",
        "gpx_lines": f"""with {cte("geo_track", "segments")}, p as (select profile_id, seq, lat, lon, ele_m, count(*) over (partition by profile_id) n from geo_track),
 l as (select profile_id as segment_id, cast(7+case when profile_id%2=0 then n-1-seq else seq end as int) as line_no, printf('      <trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', round_even(lat,6), round_even(lon,6), round_even(ele_m,1)) as line from p
 union all select id, 3, '    <name>'||name||case when id%2=0 then ' (reversed)' else '' end||'</name>' from segments
 union all select id, 4, '    <link href="https://example.org/segments/'||cast(id as varchar)||'"/>' from segments)
 select segment_id, line_no, line from l""",
    }
    return q
