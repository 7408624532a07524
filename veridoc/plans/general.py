"""Queries of the general data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators import timestamps
from veridoc.runtime import table


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise(table(spark, d, "source_metadata"), table(spark, d, "source_registry"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.stated_instants(p1_normalised(spark, d))


def p1_inferred(spark: SparkSession, d: str) -> DataFrame:
    """The choices of the Viterbi pass against a known truth: the declared date orders are withheld, and the
    rows that then have several readings come out with the instant chosen and the one that the declaration states."""
    rows, registry = table(spark, d, "source_metadata"), table(spark, d, "source_registry")
    truth = timestamps.normalise(rows, registry).where("status = 'stated'").select("meta_id", F.col("utc_ts").alias("declared_ts"))
    blind = timestamps.normalise(rows, registry.withColumn("date_order", F.lit(None).cast("string"))).where("status = 'inferred'")
    return blind.join(truth, "meta_id").select("meta_id", "notation", "utc_ts", "declared_ts", (F.col("utc_ts") == F.col("declared_ts")).alias("agrees"))


_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?\s?[Mm](?:\.|\b))?\s*(.*)"
_SEP = r"(?:[Tt\s]\s*|,\s*|\s+at\s+)"
_REST = "'h','mi','s','f','ap','z'"
_DAY = r"(?:([A-Za-z]{3,9})\.?,?\s+)?"
_MONTHS = "instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(x.mon,3)))"


def _branch(kind: str, pattern: str, names: str, day: str, where: str = "true") -> str:
    return (
        f"SELECT meta_id, nz, sz, '{kind}' AS k, x.h, x.mi, x.s, x.f, x.ap, x.z, {day} AS d FROM (SELECT *, regexp_extract(v, '^(?:{pattern})$', [{names},{_REST}]) AS x FROM t WHERE NOT count_ AND regexp_full_match(v, '{pattern}')) WHERE {where}"
    )


def _ymd(y: str, m: str, d: str) -> str:
    return f"try_cast({y}||'-'||lpad({m},2,'0')||'-'||lpad({d},2,'0') AS DATE)"


def _named(kind: str, pattern: str, names: str) -> str:
    number = f"(({_MONTHS}+2)//3)::VARCHAR"
    return _branch(kind, pattern, names, _ymd("x.y", number, "x.d"), f"{_MONTHS}%3=1 AND (x.dow='' OR lower(left(x.dow,3))=lower(left(dayname({_ymd('x.y', number, 'x.d')}),3)))")


def _numeric(order: str, y: str, m: str, d: str) -> str:
    pattern = r"(\d{1,4})([/.\-])(\d{1,2})([/.\-])(\d{1,4})" + _SEP + _TIME
    iso = r"\d{4}-\d{1,2}-\d{1,2}" + _SEP + ".*"
    where = f"x.p=x.q AND len(x.{y})=4 AND len(x.{m})<=2 AND len(x.{d})<=2 AND coalesce(o,'{order}')='{order}' AND NOT regexp_full_match(v,'{iso}')"
    return _branch("numeric", pattern, "'a','p','b','q','c'", _ymd(f"x.{y}", f"x.{m}", f"x.{d}"), where)


_MINUTES = "MAP {" + ", ".join(f"'{k}':{v}" for k, v in timestamps.ABBREVIATIONS.items()) + "}"
_OFFSET = r"(?i)(?:UTC|GMT)?\s*([+\-−])(\d{1,2}):?(\d{2})?"


def _zone(c: str) -> str:
    """A zone text as ``{o: minutes, n: name}``; both null where it is no zone."""
    part = f"regexp_extract({c}, '^{_OFFSET}$', ['g','h','m'])"
    minutes = f"(CASE {part}.g WHEN '+' THEN 1 ELSE -1 END * ({part}.h::INT*60 + coalesce(nullif({part}.m,''),'0')::INT))"
    return f"{{'o': CASE WHEN regexp_full_match({c}, '{_OFFSET}') THEN {minutes} ELSE {_MINUTES}[upper({c})] END, 'n': CASE WHEN contains({c},'/') AND NOT regexp_full_match({c}, '{_OFFSET}') THEN {c} END}}"


SQL: dict[str, str] = {
    "p1_found": f"""WITH r AS (SELECT lower(trim(source_id)) AS s, native_zone, date_order FROM source_registry),
 t0 AS (SELECT meta_id, regexp_replace(native_timestamp,'^\\s+|\\s+$','','g') AS v, nullif(regexp_extract(regexp_replace(coalesce(timestamp_semantics,''),'^\\s+|\\s+$','','g'),'(?i)(?:;\\s*zone\\s*=\\s*|@\\s*|\\()\\s*([^)\\s]+)\\s*\\)?\\s*$',1),'') AS sz,
 native_zone AS nz, date_order AS o, native_timestamp AS raw FROM source_metadata LEFT JOIN r ON r.s = regexp_replace(lower(source_id),'^\\s+|\\s+$','','g') WHERE native_timestamp IS NOT NULL),
 t AS (SELECT *, regexp_full_match(v,'[+-]?\\d{{9,17}}(?:\\.\\d+)?') AND NOT (regexp_full_match(v,'\\d{{14}}') OR (regexp_full_match(v,'\\d{{12}}') AND try_strptime(v,'%Y%m%d%H%M') IS NOT NULL AND left(v,4) BETWEEN '1000' AND '2999')) AS count_ FROM t0),
 p AS ({_branch('iso', r'(\d{4})-(\d{1,2})-(\d{1,2})' + _SEP + _TIME, "'y','mo','d'", _ymd('x.y', 'x.mo', 'x.d'))}
 UNION ALL SELECT * FROM ({_branch('week', r'(\d{4})-?W(\d{2})-?([1-7])' + _SEP + _TIME, "'y','w','wd'", "try_strptime(x.y||' '||x.w||' '||x.wd,'%G %V %u')::DATE")})
 UNION ALL {_branch('ordinal', r'(\d{4})-(\d{3})' + _SEP + _TIME, "'y','doy'", "try_strptime(x.y||' '||x.doy,'%Y %j')::DATE")}
 UNION ALL {_branch('basic', r'(\d{4})(\d\d)(\d\d)[Tt]?(\d\d)(\d\d)(\d\d)?(?:[.,](\d{1,9}))?()\s*(.*)', "'y','mo','d'", _ymd('x.y', 'x.mo', 'x.d'))}
 UNION ALL {_numeric('dmy', 'c', 'b', 'a')} UNION ALL {_numeric('mdy', 'c', 'a', 'b')} UNION ALL {_numeric('ymd', 'a', 'b', 'c')}
 UNION ALL {_named('day-first', _DAY + r'(\d{1,2})[\s-]([A-Za-z]{3,9})\.?[\s,-]+(\d{4})' + _SEP + _TIME, "'dow','d','mon','y'")}
 UNION ALL {_named('month-first', _DAY + r'([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})' + _SEP + _TIME, "'dow','mon','d','y'")}),
 w AS (SELECT meta_id, nz, sz, z, try_cast(d::VARCHAR||' '||lpad((CASE WHEN ap='' THEN h::INT WHEN h::INT BETWEEN 1 AND 12 THEN h::INT%12 + CASE WHEN lower(left(ap,1))='p' THEN 12 ELSE 0 END ELSE 99 END)::VARCHAR,2,'0')||':'||mi||':'||coalesce(nullif(s,''),'00')||'.'||rpad(left(coalesce(f,''),6),6,'0') AS TIMESTAMP) AS wall FROM p),
 k AS (SELECT meta_id, nz, sz, wall, list_transform(list_transform(regexp_extract_all(z,'\\[[^\\]]*\\]|\\([^)]*\\)|[^\\s\\[(]+'), lambda y: trim(y,'[]() ')), lambda y: {_zone('y')}) AS zs FROM w WHERE wall IS NOT NULL),
 c AS (SELECT meta_id, wall, CASE WHEN len(zs)>0 THEN coalesce(list_filter(zs, lambda y: y.o IS NOT NULL)[1], zs[1]) WHEN sz IS NOT NULL AND ({_zone('sz')}.o IS NOT NULL OR {_zone('sz')}.n IS NOT NULL) THEN {_zone('sz')} ELSE {_zone("coalesce(nz,'')")} END AS zone
 FROM k WHERE len(list_filter(zs, lambda y: y.o IS NULL AND y.n IS NULL))=0),
 u AS (SELECT meta_id, wall - to_minutes(zone.o::BIGINT) AS at_ FROM c WHERE zone.o IS NOT NULL
 UNION SELECT meta_id, g FROM (SELECT meta_id, wall, zone.n AS n, unnest([wall - (timezone(zone.n, timezone('UTC', wall - INTERVAL 1 DAY)) - (wall - INTERVAL 1 DAY)), wall - (timezone(zone.n, timezone('UTC', wall + INTERVAL 1 DAY)) - (wall + INTERVAL 1 DAY))]) AS g FROM c WHERE zone.o IS NULL AND zone.n IS NOT NULL)
 WHERE timezone(n, timezone('UTC', g)) = wall
 UNION SELECT meta_id, make_timestamp(round(v::DECIMAL(28,6) * CASE WHEN len(regexp_extract(v,'\\d+'))<=11 THEN 1000000 WHEN len(regexp_extract(v,'\\d+'))<=14 THEN 1000 ELSE 1 END)::BIGINT) FROM t WHERE count_)
 SELECT meta_id, strftime(min(at_),'%Y-%m-%dT%H:%M:%S.%fZ') AS utc_ts FROM u JOIN t0 USING (meta_id) WHERE NOT regexp_full_match(raw,'\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z') GROUP BY meta_id HAVING count(DISTINCT at_)=1""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_normalised, p1_inferred)}
