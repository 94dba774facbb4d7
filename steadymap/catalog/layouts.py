"""Queries over layouts: neighbourhoods, global measures, class measures, composite rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import (
    GLOBAL_CTE, LOCAL_CTE, PROCRUSTES_CTE, layout, layout_pairs, pairs_cte, rounded, source_space,
    table)
from steadymap.functions.distance import METRICS, column_distance
from steadymap.functions.scoring import combined_scores
from steadymap.operators import classes, local, scores, shape
from steadymap.operators.lsh import approx_knn, recall
from steadymap.operators.neighbours import knn, neighbour_ranks
from steadymap.operators.pivots import Index, visited
from steadymap.operators.pairs import pair_moments, pair_spearman
from steadymap.session import materialize


def _local_sql(*cols):
    picked = ", ".join(f"round({c}, 6) {c}" for c in cols)
    return f"with {pairs_cte()}, {LOCAL_CTE} select s as space, {picked} from local_"


def _points(spark, sf, count=1):
    return scores.as_points(layout_pairs(spark, sf, count))


@query("knn", """
with p as (select vec_id i, embedding::double[] v from embeddings),
d as (select a.i, b.i j, list_distance(a.v, b.v) d from p a join p b on a.i<>b.i),
r as (select *, row_number() over (partition by i order by d, j) r from d)
select i, j, r::bigint r, round(d, 6) d from r where r <= 7""")
def knn_query(spark, sf):
    near = knn(source_space(spark, sf).drop("label"), 7)
    return rounded(near.select("i", "j", F.col("r").cast("long").alias("r"), "d"))


@query("knn_pivots", """
with p as (select vec_id i, embedding[1]::double x, embedding[2]::double y from embeddings),
d as (select a.i, b.i j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) d from p a join p b on a.i<>b.i),
r as (select *, row_number() over (partition by i order by d, j) r from d)
select i, j, r::bigint r, round(d, 6) d from r where r <= 7""")
def knn_pivots(spark, sf):
    """Neighbours in a layout, where the pivot index leaves most cells out."""
    points = layout(spark, sf).select("space", "id", F.array("x", "y").alias("v"))
    near = knn(points, 7, index=Index(cell=128))
    return rounded(near.select("i", "j", F.col("r").cast("long").alias("r"), "d"))


@query("pivot_visits", "select 'pair0' space, count(*)::bigint points, true saved from embeddings")
def pivot_visits(spark, sf):
    """Whether the index visits under half of the cells of a layout."""
    points = layout(spark, sf).select("space", "id", F.array("x", "y").alias("v"))
    return visited(points, 7, index=Index(cell=64)).select("space", "points", (F.col("visited") * 2 < F.col("possible")).alias("saved"))


@query("knn_approx", "select 'pair0' space, 7 * count(*)::bigint pairs, true reached from embeddings")
def knn_approx(spark, sf):
    """Whether projection buckets find nine of ten neighbours in the source space."""
    points = materialize(source_space(spark, sf).drop("label"))
    met = recall(approx_knn(points, 7), knn(points, 7))
    return met.select("space", "pairs", (F.col("recall") >= 0.9).alias("reached"))


@query("column_distances", """
with h as (select vec_id, list_transform(embedding[1:32], lambda x: case when vec_id % 97 = 0 then 0.0 else abs(x)::double end) a,
  list_transform(embedding[33:64], lambda x: abs(x)::double) b from embeddings),
m as (select *, list_sum(a) sa, list_sum(b) sb from h),
e as (select m.*, unnest(a) x, unnest(b) y from m),
g as (select vec_id, sum((x-y)*(x-y)) sq, sum(x*y) xy, sum(x*x) xx, sum(y*y) yy,
  sum(case when x > 0 then x/sa * ln(x/sa) else 0 end / 2 + case when y > 0 then y/sb * ln(y/sb) else 0 end / 2
    - case when x/sa + y/sb > 0 then (x/sa + y/sb)/2 * ln((x/sa + y/sb)/2) else 0 end) js, any_value(sa) sa from e group by 1)
select vec_id, round(sqrt(sq), 6) euclidean, case when xx > 0 then round(1 - xy/sqrt(xx)/sqrt(yy), 6) end cosine,
  case when sa > 0 then round(sqrt(greatest(js, 0)), 6) end jensenshannon from g""")
def column_distances(spark, sf):
    """All distances as native expressions, between the halves of every vector; some halves have no mass."""
    half = lambda lo: F.transform(F.slice("embedding", lo, 32), lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 97 == 0, F.transform(half(1), lambda x: F.lit(0.0))).otherwise(half(1)).alias("a"), half(33).alias("b"))
    return rounded(rows.select("vec_id", *[column_distance(F.col("a"), F.col("b"), m).alias(m) for m in METRICS]))


@query("rank_lookup", f"""with {pairs_cte()}
select i, j, r1::bigint r1, r2::bigint r2 from r where r1 <= 7 or r2 <= 7""")
def rank_lookup(spark, sf):
    return neighbour_ranks(_points(spark, sf).drop("label")).select("i", "j", "r1", "r2")


@query("neighbour_set_changes", f"""with {pairs_cte()}
select i, (count(*) filter (r1<=7 and r2<=7))::bigint kept,
  (count(*) filter (r1<=7 and r2>7))::bigint lost, (count(*) filter (r2<=7 and r1>7))::bigint gained
from r where r1<=7 or r2<=7 group by i""")
def neighbour_set_changes(spark, sf):
    r = neighbour_ranks(_points(spark, sf).drop("label"))
    in1, in2 = F.col("r1") <= 7, F.col("r2") <= 7
    return r.groupBy("i").agg(
        F.count_if(in1 & in2).alias("kept"), F.count_if(in1 & ~in2).alias("lost"),
        F.count_if(in2 & ~in1).alias("gained"))


def _register_local(name, cols):
    @query(name, _local_sql(*cols))
    def run(spark, sf):
        return rounded(local.local_measures(_points(spark, sf), index=Index()).select("space", *cols))


_register_local("trustworthiness", ["trustworthiness"])
_register_local("continuity", ["continuity"])
_register_local("mrre", ["mrre_missing", "mrre_false"])
_register_local("local_continuity", ["local_continuity"])


@query("label_preservation", _local_sql("label_preservation"))
def label_preservation(spark, sf):
    return rounded(local.label_preservation(_points(spark, sf), index=Index()))


@query("neighborhood_hit", f"""with {pairs_cte()}
select s as space, round((count(*) filter (ya=yb) + count(distinct i))/(count(distinct i)*7.0), 6) neighborhood_hit
from r where r1 <= 6 group by s""")
def neighborhood_hit(spark, sf):
    pts = layout(spark, sf).select("space", "id", "label", F.array("x", "y").alias("v"))
    return rounded(local.neighborhood_hit(pts, index=Index()))


def _global_sql(cols, source):
    return f"with {pairs_cte()}, {GLOBAL_CTE} select {source}.s as space, {cols} from {source}"


@query("spearman_distance", _global_sql("round(spearman, 6) spearman", "glo"))
def spearman_distance(spark, sf):
    return rounded(pair_spearman(_points(spark, sf)))


@query("pearson_distance", _global_sql("round(pearson, 6) pearson", "glo"))
def pearson_distance(spark, sf):
    return rounded(pair_moments(_points(spark, sf)).select("space", "pearson"))


@query("named_measures", f"""with {pairs_cte()}, {LOCAL_CTE}, {GLOBAL_CTE},
sh as (select s, avg(sqrt((x1-x2)**2 + (y1-y2)**2)) shift, max(abs(x1-x2) + abs(y1-y2)) farthest from p group by s)
select glo.s as space, round(pearson, 6) pearson, round(stress, 6) normalized_stress, round(trustworthiness, 6) trustworthiness,
  round(shift, 6) shift, round(farthest, 6) farthest from glo join local_ using (s) join sh using (s)""")
def named_measures(spark, sf):
    """Measures by name next to two of the caller's own."""
    step = lambda points, metric: column_distance(F.col("v1"), F.col("v2"), metric)
    walk = F.abs(F.col("v1")[0] - F.col("v2")[0]) + F.abs(F.col("v1")[1] - F.col("v2")[1])
    own = [("shift", lambda points: points.groupBy("space").agg(F.avg(step(points, "euclidean")).alias("shift"))),
           ("farthest", lambda points: points.groupBy("space").agg(F.max(walk).alias("farthest")))]
    return rounded(scores.run_measures(_points(spark, sf), ["pearson", "normalized_stress", "trustworthiness", *own]))


@query("normalized_stress", _global_sql("round(stress, 6) stress", "glo"))
def normalized_stress(spark, sf):
    return rounded(pair_moments(_points(spark, sf)).select("space", "stress"))


@query("cluster_ordering", _global_sql("round(cluster_ordering, 6) cluster_ordering", "co"))
def cluster_ordering(spark, sf):
    return rounded(scores.cluster_ordering(layout_pairs(spark, sf)))


@query("reconstruction_mse", """
select 'pair0' as space, round(avg((embedding[k] - round(embedding[k]::double, 2))**2), 6) mse
from embeddings, (select unnest(range(1, 65)) k)""")
def reconstruction_mse(spark, sf):
    v = source_space(spark, sf)
    rebuilt = F.transform("v", lambda x: F.round(x, 2))
    return rounded(scores.reconstruction_mse(v.select("space", F.col("v").alias("v1"),
                                                      rebuilt.alias("v2"))))


@query("centred_layout", """
select vec_id id, round(embedding[1]::double - avg(embedding[1]::double) over (), 6) + 0.0::double x,
 round(embedding[2]::double - avg(embedding[2]::double) over (), 6) + 0.0::double y from embeddings""")
def centred_layout(spark, sf):
    return rounded(shape.centre(layout(spark, sf)).select("id", "x", "y"))


@query("procrustes", f"""with {pairs_cte(4)}, {PROCRUSTES_CTE}
select s as space, round(degrees(t), 6) rotation, round(degrees(tf), 6) rotation_flipped,
  round(tr*sqrt(v1)/sqrt(v2), 6) scale, round(1-tr*tr, 6) residual,
  round(mx1 - tr*sqrt(v1)/sqrt(v2)*(mx2*cos(t) + my2*sin(t)), 6) shift_x,
  round(my1 - tr*sqrt(v1)/sqrt(v2)*(-sg*mx2*sin(t) + sg*my2*cos(t)), 6) shift_y from pt""")
def procrustes(spark, sf):
    pairs = layout_pairs(spark, sf, 4)
    flipped = shape.procrustes(pairs, "forced_flip").select(
        "space", F.col("rotation").alias("rotation_flipped"))
    best = shape.procrustes(pairs, "best").drop("t00", "t01", "t10", "t11")
    return rounded(best.join(flipped, "space"))


@query("rotate_layout", f"""with {pairs_cte(4)}, {PROCRUSTES_CTE}
select p.s as space, i as id, round(x2*cos(t) - y2*sin(t), 6) x_new, round(x2*sin(t) + y2*cos(t), 6) y_new
from p join pt using (s)""")
def rotate_layout(spark, sf):
    pairs = layout_pairs(spark, sf, 4)
    turned = shape.rotate(scores.side(pairs, 2), shape.procrustes(pairs, "best"))
    return rounded(turned.select("space", "id", "x_new", "y_new"))


@query("nearest_centroid", _global_sql("i as id, n1::bigint nearest", "nc"))
def nearest_centroid(spark, sf):
    return classes.nearest_centroid(layout(spark, sf)).select(
        "space", "id", F.col("nearest").cast("long").alias("nearest"))


@query("distance_consistency", _global_sql("round(dc1, 6) distance_consistency", "dc"))
def distance_consistency(spark, sf):
    return rounded(classes.distance_consistency(layout(spark, sf)))


@query("silhouette", _global_sql("round(s1, 6) silhouette", "si"))
def silhouette(spark, sf):
    pts = layout(spark, sf).select("space", "id", "label", F.array("x", "y").alias("v"))
    return rounded(classes.silhouette(pts))


@query("calinski_harabasz", f"""with {pairs_cte()},
c as (select s, y, avg(x1) cx, avg(y1) cy, count(*) m from p group by s, y),
g as (select s, avg(x1) gx, avg(y1) gy, count(*) n, count(distinct y) k from p group by s),
w as (select p.s, sum((x1-cx)**2 + (y1-cy)**2) w from p join c using (s, y) group by p.s),
b as (select c.s, sum(m*((cx-gx)**2 + (cy-gy)**2)) b from c join g using (s) group by c.s)
select g.s as space, round(b*(n-k)/(w*(k-1)), 6) calinski_harabasz from g join w using (s) join b using (s)""")
def calinski_harabasz(spark, sf):
    return rounded(classes.calinski_harabasz(layout(spark, sf)))


@query("davies_bouldin", f"""with {pairs_cte()},
c as (select s, y, avg(x1) cx, avg(y1) cy from p group by s, y),
m as (select p.s, p.y, cx, cy, avg(sqrt((x1-cx)**2+(y1-cy)**2)) sd from p join c using (s, y) group by 1,2,3,4),
w as (select a.s, a.y, max((a.sd+b.sd)/sqrt((a.cx-b.cx)**2+(a.cy-b.cy)**2)) w
      from m a join m b on a.s=b.s and a.y<>b.y group by 1,2)
select s as space, round(avg(w), 6) davies_bouldin from w group by s""")
def davies_bouldin(spark, sf):
    return rounded(classes.davies_bouldin(layout(spark, sf)))


S_DBW_CTE = """
sc as (select s, y, count(*)::double m, avg(x1) mx, avg(y1) my, var_pop(x1) vx, var_pop(y1) vy from p group by s, y),
su as (select p.s, p.y, arg_min(x1, (sqrt((x1-mx)*(x1-mx)+(y1-my)*(y1-my)), i)) ux,
   arg_min(y1, (sqrt((x1-mx)*(x1-mx)+(y1-my)*(y1-my)), i)) uy from p join sc using (s, y) group by p.s, p.y),
sk as (select * from sc join su using (s, y)),
st as (select s, var_pop(x1) tx, var_pop(y1) ty from p group by s),
scat as (select sk.s, avg(sqrt(vx**2+vy**2)/sqrt(tx**2+ty**2)) scat from sk join st using (s) group by sk.s),
pj as (select a.s, a.y ya, b.y yb, a.ux aux, a.uy auy, b.ux bux, b.uy buy,
   1.96::double*sqrt((a.m*a.vx+b.m*b.vx)/(a.m+b.m) + a.m*b.m/((a.m+b.m)**2)*(a.mx-b.mx)**2)/sqrt(a.m+b.m) rx,
   1.96::double*sqrt((a.m*a.vy+b.m*b.vy)/(a.m+b.m) + a.m*b.m/((a.m+b.m)**2)*(a.my-b.my)**2)/sqrt(a.m+b.m) ry
   from sk a join sk b on a.s=b.s and a.y<b.y),
dn as (select pj.s, ya, yb, count(*) filter (abs(x1-(aux+bux)/2)<=rx and abs(y1-(auy+buy)/2)<=ry) mid,
   greatest(count(*) filter (abs(x1-aux)<=rx and abs(y1-auy)<=ry),
            count(*) filter (abs(x1-bux)<=rx and abs(y1-buy)<=ry)) top
   from pj join p on p.s=pj.s and (p.y=ya or p.y=yb) group by 1,2,3),
sdbw as (select scat.s, any_value(scat) + avg(case when top>0 then mid::double/top else 0 end) s_dbw
   from dn join scat using (s) group by scat.s)"""


@query("s_dbw", f"with {pairs_cte()}, {S_DBW_CTE} select s as space, round(s_dbw, 6) s_dbw from sdbw")
def s_dbw(spark, sf):
    return rounded(classes.s_dbw(layout(spark, sf)))


@query("metric_absdiff", f"""with {pairs_cte()}, {GLOBAL_CTE}
select dc.s as space, round(abs(dc1-dc2), 6) distance_consistency, round(abs(s1-s2), 6) silhouette_coefficient,
  round(dc1-dc2, 6) + 0.0::double consistency_change from dc join si using (s)""")
def metric_absdiff(spark, sf):
    pairs = layout_pairs(spark, sf)
    one, two = (classes.distance_consistency(scores.side(pairs, n)) for n in (1, 2))
    out = scores.absolute_difference(one, two, "distance_consistency")
    signed = scores.signed_difference(one, two, "distance_consistency").withColumnRenamed(
        "distance_consistency", "consistency_change")
    return rounded(out.join(scores.silhouette_difference(pairs), "space").join(signed, "space"))


LAYOUT_SCORES_SQL = f"""with {pairs_cte()}, {GLOBAL_CTE}, {S_DBW_CTE},
hv as (select vec_id i, embedding::double[] v from embeddings),
hd as (select d.s, d.i, d.j, ya, yb, d1 dl, 1 - list_cosine_similarity(a.v, b.v) dh
   from d join hv a on a.i=d.i join hv b on b.i=d.j),
hr as (select *, row_number() over (partition by i order by dh, j) r1,
   row_number() over (partition by i order by dl, j) r2 from hd),
hq as (select s, dl, dh, {{rh}} qh, {{rl}} ql from hd where i<j),
hg as (select s, corr(qh, ql) shepard, sum((dh-dl)**2)/sum(dh*dh) normalized_stress from hq group by s),
ht as (select hr.s, 1 - 2.0/(any_value(n)*7*(2*any_value(n)-22))*sum(case when r2<=7 and r1>7 then r1-7 else 0 end) trustworthiness,
   1 - 2.0/(any_value(n)*7*(2*any_value(n)-22))*sum(case when r1<=7 and r2>7 then r2-7 else 0 end) continuity,
   (count(*) filter (r2<=6 and ya=yb) + any_value(n))/(any_value(n)*7.0) neighborhood_hit
   from hr join n using (s) group by hr.s),
c as (select s, y, avg(x1) cx, avg(y1) cy, count(*) m from p group by s, y),
g as (select s, avg(x1) gx, avg(y1) gy, count(*) n, count(distinct y) k from p group by s),
w as (select p.s, sum((x1-cx)**2 + (y1-cy)**2) w from p join c using (s, y) group by p.s),
b as (select c.s, sum(m*((cx-gx)**2 + (cy-gy)**2)) b from c join g using (s) group by c.s),
chx as (select g.s, b*(n-k)/(w*(k-1)) calinski_harabasz from g join w using (s) join b using (s)),
m as (select p.s, p.y, cx, cy, avg(sqrt((x1-cx)**2+(y1-cy)**2)) sd from p join c using (s, y) group by 1,2,3,4),
wx as (select a.s, a.y, max((a.sd+b.sd)/sqrt((a.cx-b.cx)**2+(a.cy-b.cy)**2)) w
      from m a join m b on a.s=b.s and a.y<>b.y group by 1,2),
db as (select s, avg(w) davies_bouldin from wx group by s)
select ht.s as space, round(trustworthiness,6) trustworthiness, round(continuity,6) continuity, round(shepard,6) shepard,
  round(normalized_stress,6) normalized_stress, round(neighborhood_hit,6) neighborhood_hit,
  round(calinski_harabasz,6) calinski_harabasz, round(s1,6) silhouette, round(davies_bouldin,6) davies_bouldin,
  round(s_dbw,6) s_dbw, round(dc1,6) distance_consistency
from ht join hg using (s) join chx using (s) join si using (s) join db using (s) join sdbw using (s) join dc using (s)"""
LAYOUT_SCORES_SQL = LAYOUT_SCORES_SQL.format(
    rh="rank() over (order by dh) + (count(*) over (partition by dh) - 1)/2.0",
    rl="rank() over (order by dl) + (count(*) over (partition by dl) - 1)/2.0")


@query("layout_scores", LAYOUT_SCORES_SQL)
def layout_scores(spark, sf):
    low = layout(spark, sf).select("space", "id", F.array("x", "y").alias("v2"))
    high = source_space(spark, sf).select("space", "id", "label", F.col("v").alias("v1"))
    return rounded(scores.layout_scores(high.join(low, ["space", "id"])))


_STABILITY_COLS = """round(spearman,6) spearman_correlation, round(pearson,6) pearson_correlation,
  round(cluster_ordering,6) cluster_ordering, round(degrees(t),6) rotation,
  round(abs(dc1-dc2),6) distance_consistency, round(abs(s1-s2),6) silhouette_coefficient,
  round(trustworthiness,6) trustworthiness, round(continuity,6) continuity,
  round(local_continuity,6) local_continuity, round(mrre_missing,6) mrre_missing,
  round(mrre_false,6) mrre_false, round(label_preservation,6) label_preservation"""


def stability_sql(count):
    return f"""with {pairs_cte(count)}, {LOCAL_CTE}, {GLOBAL_CTE}, {PROCRUSTES_CTE}
select local_.s as space, {_STABILITY_COLS}
from local_ join glo using (s) join co using (s) join dc using (s) join si using (s) join pt using (s)"""


@query("stability_row", stability_sql(4))
def stability_row(spark, sf):
    return rounded(scores.stability_rows(layout_pairs(spark, sf, 4)))


@query("alpha_beta_gamma", f"""with t as ({stability_sql(1)})
select space, round((0.25*(trustworthiness+continuity+mrre_missing+mrre_false)+label_preservation+local_continuity)/3.0, 5) alpha,
 round(0.5*(0.5*(0.5*(pearson_correlation+1)+0.5*(spearman_correlation+1))+0.5*(cluster_ordering+1)), 5) beta,
 round(1-distance_consistency, 5) gamma from t""")
def alpha_beta_gamma(spark, sf):
    rows = scores.stability_rows(layout_pairs(spark, sf), rotation_mode=None)
    return rounded(combined_scores(rows).select("space", "alpha", "beta", "gamma"), 5)


@query("backfill_metric", f"""with {pairs_cte(4)}, {LOCAL_CTE}
select space, round(coalesce(old, case when space <> 'pair3' then label_preservation end, -1.0), 6) label_preservation
from (select 'pair' || c as space, case when c = 0 then (select round(avg(label),6) from embeddings) end old
      from (select unnest(range(5)) c)) t
left join local_ on local_.s = t.space""")
def backfill_metric(spark, sf):
    base = table(spark, sf, "embeddings").groupBy().agg(F.round(F.avg("label"), 6).alias("v"))
    results = base.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"), "v").select(
        F.concat(F.lit("pair"), F.col("c").cast("string")).alias("space"),
        F.when(F.col("c") == 0, F.col("v")).alias("label_preservation"))
    present = layout_pairs(spark, sf, 4).filter("space <> 'pair3'")
    fresh = local.label_preservation(scores.as_points(present), index=Index())
    return rounded(scores.backfill(results, fresh, "label_preservation", ["space"]))
