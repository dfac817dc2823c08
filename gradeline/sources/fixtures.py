"""Tracks, segments, roads and caches derived from the star-schema tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RANKED = "(select *, row_number() over (partition by user_id order by ts, event_id) as rn from {events}) b"

#: name: (SQL with the tables it reads in braces, those tables)
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "profile_points": (f"select user_id as profile_id, cast(rn-1 as int) as seq, cast(rn-1 as double)*cast(100 as double) as dist_m, value as ele_m from {_RANKED}", ("events",)),
    "profile_points_gentle": (f"select user_id as profile_id, cast(rn-1 as int) as seq, cast(rn-1 as double)*cast(100 as double) as dist_m, value*cast(0.1 as double) as ele_m from {_RANKED}", ("events",)),
    "profile_points_irregular": (
        "select user_id as profile_id, cast(rn-1 as int) as seq, sum(case when rn=1 or event_id%5=0 then cast(0 as double) else cast(10+event_id%37 as double) end)"
        f" over (partition by user_id order by rn rows between unbounded preceding and current row) as dist_m, value as ele_m from {_RANKED}",
        ("events",),
    ),
    "geo_track": (
        "select user_id as profile_id, cast(rn-1 as int) as seq,"
        " cast(40.0 as double)+cast(user_id%20 as double)*cast(0.01 as double)+case when user_id%10=0 then cast(-0.2 as double) else cast(0 as double) end+cast(rn-1 as double)*cast(0.0009 as double) as lat,"
        f" cast(-105.3 as double)+cast(user_id%15 as double)*cast(0.012 as double)+cast(rn-1 as double)*cast(0.0004 as double) as lon, value as ele_m from {_RANKED}",
        ("events",),
    ),
    "segments": (
        "select g.profile_id as id, concat('Seg ', cast(g.profile_id as varchar(20))) as name, p.distance, case when g.profile_id%7=0 then 'riding' else 'running' end as activity_type,"
        " g.lat as start_lat, g.lon as start_lon, cast(g.profile_id as int) as discovery_idx"
        " from {geo_track} g join (select profile_id, max(dist_m) as distance from {profile_points} group by profile_id) p on g.profile_id = p.profile_id where g.seq = 0",
        ("geo_track", "profile_points"),
    ),
    "roads": (
        "select s_suppkey as road_id, cast(40.0 as double)+cast(s_suppkey%23 as double)*cast(0.009 as double) as lat, cast(-105.3 as double)+cast(s_suppkey%19 as double)*cast(0.011 as double) as lon from {supplier}",
        ("supplier",),
    ),
    "far_starts": (
        "select s_suppkey as id, asin(cast(s_suppkey%41 as double)/cast(20.5 as double)-cast(1 as double))*cast(57.29577951308232 as double) as start_lat,"
        " cast(s_suppkey*37%360 as double)-cast(179.9 as double) as start_lon from {supplier}",
        ("supplier",),
    ),
    "far_roads": (
        "select n_nationkey as road_id, cast(n_nationkey*53%171 as double)-cast(85 as double) as lat, case when n_nationkey%3=0 then cast(179.5 as double) else cast(n_nationkey*67%359 as double)-cast(179 as double) end as lon from {nation}",
        ("nation",),
    ),
    "access_readings": (
        "select c_custkey as profile_id, case when c_custkey%10=0 then 'unchecked' when c_custkey%10=1 then 'none' else 'found' end as status,"
        " case when c_custkey%10<2 then cast(null as double) else abs(cast(c_acctbal as double)) end as dist_m from {customer}",
        ("customer",),
    ),
    "cache_entries": ("select o_custkey as cache_key, o_orderkey as payload_id, cast(o_orderdate as timestamp) as fetched_at, o_orderstatus='F' as is_miss from {orders}", ("orders",)),
    "segment_refs": (
        "select p_partkey as ref_id, case when p_partkey%3=0 then cast(p_partkey as varchar(20))"
        " when p_partkey%3=1 then concat('https://example.org/segments/', cast(p_partkey as varchar(20)), '?x=1') else concat('bad-', p_name) end as ref from {part}",
        ("part",),
    ),
    "names": ("select p_partkey as doc_id, concat(p_name, case when p_partkey%3=0 then ' / #é  ' else '' end, p_name) as name from {part}", ("part",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a base one where there is none of this name."""
    if name == "embedding_profile":
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        return e.selectExpr("vec_id as profile_id", "posexplode(embedding) as (seq, e)").selectExpr("profile_id", "seq", "seq*100.0D as dist_m", "cast(e as double)*1000.0D as ele_m")
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, needs = SQL[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in needs})


def cte(*names: str) -> str:
    """The same tables for DuckDB, as named queries without the leading WITH."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts or name not in SQL and name != "embedding_profile":
            return
        if name == "embedding_profile":
            parts[name] = "select vec_id as profile_id, cast(i as int) as seq, i*100.0::double as dist_m, embedding[i+1]::double*1000.0::double as ele_m from embeddings, range(0,64) r(i)"
            return
        text, needs = SQL[name]
        for n in needs:
            add(n)
        parts[name] = text.format(**{n: n for n in needs})

    for name in names:
        add(name)
    return ", ".join(f"{n} as ({q})" for n, q in parts.items())
