"""Inputs the registered queries share: layouts, source spaces and labels from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, and turn -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields])


def layout_pairs(spark, sf, count: int = 1) -> DataFrame:
    """``count`` comparisons: layout 1 is two components, layout 2 the same two plus a tenth
    of the next two."""
    e = table(spark, sf, "embeddings").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    at = lambda k: F.get("embedding", F.col("c") * 4 + k).cast("double")
    return e.select(
        F.concat(F.lit("pair"), F.col("c").cast("string")).alias("space"),
        F.col("vec_id").alias("id"), "label",
        at(0).alias("x1"), at(1).alias("y1"),
        (at(0) + 0.1 * at(2)).alias("x2"), (at(1) + 0.1 * at(3)).alias("y2"))


def layout(spark, sf) -> DataFrame:
    return layout_pairs(spark, sf).select("space", "id", "label", F.col("x1").alias("x"),
                                          F.col("y1").alias("y"))


def source_space(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.lit("pair0").alias("space"), F.col("vec_id").alias("id"), "label",
                    F.col("embedding").cast("array<double>").alias("v"))


def pairs_cte(count: int = 1) -> str:
    """SQL counterpart of ``layout_pairs`` with distances (d) and ranks (r)."""
    at = lambda k: f"embedding[c*4+{k + 1}]::double"
    return f"""
p as (select 'pair' || c as s, vec_id i, label y, {at(0)} x1, {at(1)} y1,
             {at(0)} + 0.1::double*{at(2)} x2, {at(1)} + 0.1::double*{at(3)} y2
      from embeddings, (select unnest(range({count})) c)),
d as (select a.s, a.i, b.i j, a.y ya, b.y yb,
             sqrt((a.x1-b.x1)*(a.x1-b.x1)+(a.y1-b.y1)*(a.y1-b.y1)) d1,
             sqrt((a.x2-b.x2)*(a.x2-b.x2)+(a.y2-b.y2)*(a.y2-b.y2)) d2
      from p a join p b on a.s = b.s and a.i <> b.i),
r as (select *, row_number() over (partition by s, i order by d1, j) r1,
             row_number() over (partition by s, i order by d2, j) r2 from d),
n as (select s, count(*)::double n from p group by s)"""


RANK = """rank() over (partition by s order by {c}) + (count(*) over (partition by s, {c}) - 1)/2.0"""
MRRE_NORM = "(" + "+".join(f"abs(n-2*{i}+1)/{i}" for i in range(1, 8)) + ")"

LOCAL_CTE = f"""
lab as (select s, i, yb, count(*) filter (r1<=7) c1, count(*) filter (r2<=7) c2
        from r where r1<=7 or r2<=7 group by s, i, yb),
labs as (select s, sum(least(c1,c2))::double l from lab group by s),
loc as (select r.s, any_value(n) n,
   sum(case when r2<=7 and r1>7 then r1-7 else 0 end)::double intr,
   sum(case when r1<=7 and r2>7 then r2-7 else 0 end)::double lost,
   (count(*) filter (r1<=7 and r2<=7))::double both_,
   sum(case when r2<=7 then abs(r1-r2)::double/r2 else 0 end) ef,
   sum(case when r1<=7 then abs(r1-r2)::double/r1 else 0 end) em
   from r join n using (s) group by r.s),
local_ as (select loc.s, 1 - 2.0/(n*7*(2*n-22)) * intr trustworthiness,
   1 - 2.0/(n*7*(2*n-22)) * lost continuity,
   (both_ - n*49/(n-1))/(n*7) local_continuity,
   1 - em/(n*{MRRE_NORM}) mrre_missing, 1 - ef/(n*{MRRE_NORM}) mrre_false,
   l/(n*7) label_preservation
   from loc join labs using (s))"""

GLOBAL_CTE = f"""
q as (select s, d1, d2, {RANK.format(c='d1')} q1, {RANK.format(c='d2')} q2 from d where i < j),
glo as (select s, corr(q1,q2) spearman, corr(d1,d2) pearson,
   sum((d1-d2)*(d1-d2))/sum(d1*d1) stress from q group by s),
cen as (select s, y, avg(x1) x1, avg(y1) y1, avg(x2) x2, avg(y2) y2 from p group by s, y),
cd as (select a.s, sqrt((a.x1-b.x1)**2+(a.y1-b.y1)**2) d1, sqrt((a.x2-b.x2)**2+(a.y2-b.y2)**2) d2
   from cen a join cen b on a.s=b.s and a.y<b.y),
cq as (select s, {RANK.format(c='d1')} q1, {RANK.format(c='d2')} q2 from cd),
co as (select s, corr(q1,q2) cluster_ordering from cq group by s),
nc as (select p.s, p.i, p.y,
   arg_min(cen.y, (sqrt((p.x1-cen.x1)*(p.x1-cen.x1)+(p.y1-cen.y1)*(p.y1-cen.y1)), cen.y)) n1,
   arg_min(cen.y, (sqrt((p.x2-cen.x2)*(p.x2-cen.x2)+(p.y2-cen.y2)*(p.y2-cen.y2)), cen.y)) n2
   from p join cen using (s) group by p.s, p.i, p.y),
dc as (select s, avg((n1=y)::int)::double dc1, avg((n2=y)::int)::double dc2 from nc group by s),
sl as (select s, i, ya, yb, avg(d1) a1, avg(d2) a2 from d group by s, i, ya, yb),
sp as (select s, i, max(a1) filter (ya=yb) a1, min(a1) filter (ya<>yb) b1,
   max(a2) filter (ya=yb) a2, min(a2) filter (ya<>yb) b2 from sl group by s, i),
si as (select s, avg(coalesce((b1-a1)/greatest(a1,b1),0)) s1, avg(coalesce((b2-a2)/greatest(a2,b2),0)) s2
   from sp group by s)"""

PROCRUSTES_CTE = """
pm as (select s, count(*)::double n, avg(x1) mx1, avg(y1) my1, avg(x2) mx2, avg(y2) my2,
   var_pop(x1)+var_pop(y1) v1, var_pop(x2)+var_pop(y2) v2,
   covar_pop(x1,x2) xx, covar_pop(x1,y2) xy, covar_pop(y1,x2) yx, covar_pop(y1,y2) yy
   from p group by s),
pn as (select *, xx/sqrt(v1*v2) a, xy/sqrt(v1*v2) b, yx/sqrt(v1*v2) c, yy/sqrt(v1*v2) d from pm),
pr as (select *, a*d-b*c det, a*a+b*b+c*c+d*d sq from pn),
pt as (select *, case when det>0 then atan2(b-c,a+d) else atan2(b+c,a-d) end t,
   sqrt(greatest(sq+2*abs(det),0)) tr, case when det>0 then 1.0 else -1.0 end sg,
   case when det<=0 then atan2(b-c,a+d) else atan2(b+c,a-d) end tf from pr)"""
