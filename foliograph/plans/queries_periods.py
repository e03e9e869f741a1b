"""Queries on employment periods."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import MONTH_NAMES, SHAPES, UNTIL_TODAY
from ..operators import periods
from ..sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods.employment_periods(table(spark, folder, "canonical_resume"))


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per doc_id: number of periods and gaps, months employed and months of gaps."""
    resume = table(spark, folder, "canonical_resume")
    both = periods.with_gaps(periods.continuous(periods.employment_months(resume), "doc_id", "first", "last"), "doc_id", "first", "last")
    length = F.col("last") - F.col("first") + 1
    is_period = F.col("kind") == "period"
    return both.groupBy("doc_id").agg(
        F.count_if(is_period).alias("periods"),
        F.count_if(~is_period).alias("gaps"),
        F.sum(F.when(is_period, length).otherwise(0)).alias("months_employed"),
        F.sum(F.when(~is_period, length).otherwise(0)).alias("months_of_gaps"),
    )


def _dated_sql(column: str, alone: int, to: str) -> str:
    """CTEs that end in ``to`` (period_id, doc_id, n): n is the month number of a typed date."""
    plain = str.maketrans("äéèêûçôíáóú", "aeeeucoiaou")
    names = dict(sorted((n.translate(plain), k) for k, group in MONTH_NAMES.items() for n in group))
    listed = ", ".join(f"('{n}', {k})" for n, k in names.items())
    words = ", ".join("('" + w.replace("'", "''") + "')" for w in UNTIL_TODAY)

    def part(x: str) -> str:
        found = []
        for shape in SHAPES:
            groups = [m[1] for m in re.finditer(r"\(\?P<(\w)>", shape)]
            if x in groups:
                pattern = re.sub(r"\(\?P<(\w)>", "(", shape).replace("'", "''")
                found.append(f"nullif(regexp_extract(q, '^(?:{pattern})$', {groups.index(x) + 1}), '')")
        return f"coalesce({', '.join(found)})"

    return f"""{to}_p as materialized (select period_id, doc_id, created_at,
  trim(regexp_replace(strip_accents(lower(replace({column}, '’', ''''))), '\\s+', ' ', 'g')) as p from canonical_resume),
{to}_w as materialized (select *, regexp_replace(p, '^[-–(\\[ ]+|[.)\\] ]+$', '', 'g') as bare, regexp_extract(p, '(\\p{{L}}{{3,}})\\.?', 1) as w from {to}_p),
{to}_q as materialized (select x.*, case when m.k is null then p else regexp_replace(p, '(\\p{{L}}{{3,}})\\.?', '#' || m.k) end as q
  from {to}_w as x left join (values {listed}) as m(name, k) on m.name = x.w),
{to}_s as materialized (select *, {part("y")} as ys, {part("m")} as ms, {part("d")} as ds, bare in (select v from (values {words}) as t(v)) as today from {to}_q),
{to}_n as materialized (select *,
  case when length(ys) = 4 then cast(ys as int) when cast(ys as int) <= 39 then 2000 + cast(ys as int) else 1900 + cast(ys as int) end as y,
  case when ms is null then {alone} else cast(ms as int) end as m from {to}_s),
{to} as materialized (select period_id, doc_id, case when today then 12 * year(created_at) + month(created_at) - 1
  when y >= 1000 and m between 1 and 12 and (ds is null or cast(ds as int) between 1 and day(last_day(make_date(y, case when m between 1 and 12 then m end, 1))))
  then 12 * y + m - 1 end as n from {to}_n)"""


_RUNS = f"""with {_dated_sql("start_date", 1, "f")}, {_dated_sql("end_date", 12, "l")},
dated as (select f.doc_id, f.n as a, l.n as b from f join l using (period_id)),
good as (select * from dated where doc_id is not null and a <= b),
opened as (select *, case when a > max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as opens from good),
numbered as (select *, sum(opens) over (partition by doc_id order by a, b rows unbounded preceding) as run from opened),
runs as (select doc_id, run, min(a) as a, max(b) as b from numbered group by doc_id, run),
pieces as (
  select doc_id, 'period' as kind, a, b from runs
  union all
  select doc_id, 'gap', before + 1, a - 1 from (select *, lag(b) over (partition by doc_id order by a) as before from runs) where before is not null
)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_summary": p2_summary}


def oracle_sql() -> dict[str, str]:
    text = lambda x: f"format('{{:04d}}-{{:02d}}', cast({x} // 12 as int), cast({x} % 12 as int) + 1)"
    return {
        "p2_found": f"{_RUNS} select doc_id, kind, {text('a')} as first_month, {text('b')} as last_month from pieces",
        "p2_summary": f"""{_RUNS} select doc_id, count(*) filter (kind = 'period') as periods, count(*) filter (kind = 'gap') as gaps,
            cast(coalesce(sum(b - a + 1) filter (kind = 'period'), 0) as bigint) as months_employed,
            cast(coalesce(sum(b - a + 1) filter (kind = 'gap'), 0) as bigint) as months_of_gaps from pieces group by doc_id""",
    }
