"""Queries that plan comparisons and runs over datasets taken from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadymap.catalog import query
from steadymap.catalog.common import table
from steadymap.functions import naming
from steadymap.plans import comparisons, grid
from steadymap.session import spread

# every supplier stands for a dataset with its own number of topics and categories
_DATASETS = """ds as (select 'set_' || s_suppkey as dataset, (s_nationkey + 2)::varchar topics,
  (s_suppkey % 9 + 2)::varchar categories from supplier)"""


def datasets(spark, sf):
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("set_"), F.col("s_suppkey").cast("string")).alias("dataset"),
        (F.col("s_nationkey") + 2).cast("string").alias("topics"),
        (F.col("s_suppkey") % 9 + 2).cast("string").alias("categories"))


_MODELS = "ml as (select dataset, replace(replace(m, '{t}', topics), '{c}', categories) model from ds, (select unnest([" \
    + ", ".join(f"'{m}'" for m in comparisons.MODEL_NAMES) + "]) m))"


@query("model_list", f"with {_DATASETS}, {_MODELS} select dataset, model from ml")
def model_list(spark, sf):
    return comparisons.model_list(datasets(spark, sf))


def _list(values):
    return "[" + ", ".join(f"{v}::double" if isinstance(v, float) else str(v) for v in values) + "]"


def _successor_sql():
    metric = "case when model like '%lda%' then 'jensenshannon' else 'cosine' end"
    text = {
        "mds": "'mds_' || dataset || '_' || model || '_True_' || {metric} || '_' || {n_iter}",
        "som": "'som_' || dataset || '_' || model || '_' || {n} || '_' || {m}",
        "umap": "'umap_' || dataset || '_' || model || '_' || {n_neighbor} || '_' || {min_dist} || '_' || {metric}",
        "tsne": "'tsne_' || dataset || '_' || model || '_' || {perplexity} || '_12.0_' || {learning_rate} || '_' || {n_iter}"
                " || '_random_barnes_hut_0.5_' || {metric}",
    }
    parts = []
    for dr, params in comparisons.GRIDS.items():
        for n, varied in enumerate(params):
            steps = f"(select a, b from (select v a, lead(v) over (order by o) b from (select unnest({_list(params[varied])}) v, generate_subscripts({_list(params[varied])}, 1) o)) where b is not null)"
            held = "".join(f", (select unnest({_list(v)}) {p})" for p, v in params.items() if p != varied)
            name = lambda s: text[dr].format(metric=metric, **{p: f"({s if p == varied else p})::varchar" for p in params})
            config = dr if len(params) == 1 else f"{dr}{n}"
            parts.append(f"select dataset, model, '{config}' config, {name('a')} name_1, {name('b')} name_2 from ml, {steps}{held}")
    return " union all ".join(parts)


_PAIRS = f"with {_DATASETS}, {_MODELS}, pr as ({_successor_sql()})"


@query("successor_pairs", _PAIRS + """
select dataset, config, count(*)::bigint pairs, count(distinct model)::bigint models,
 (sum(('0x' || substr(md5(name_1 || '|' || name_2), 1, 8))::bigint))::bigint digest from pr group by 1, 2""")
def successor_pairs(spark, sf):
    pairs = comparisons.successor_pairs(comparisons.model_list(datasets(spark, sf)))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", "name_1", "name_2")), 1, 8), 16, 10).cast("long")
    return pairs.withColumn("_h", digest).groupBy("dataset", "config").agg(
        F.count("*").alias("pairs"), F.count_distinct("model").alias("models"),
        F.sum("_h").alias("digest"))


# layout files: one per order, filed by customer, clerk and date under a seed and a jitter
_FILES = """fl as (select 'set_' || o_custkey % 3 as dataset, o_orderkey % 5 seed,
  case o_orderkey % 3 when 0 then 0.0::double when 1 then 0.1::double else 0.25::double end jitter,
  'results/random_seed_' || o_orderkey % 5 || '/jitter_amount_' ||
   case o_orderkey % 3 when 0 then '0.0' when 1 then '0.1' else '0.25' end ||
   '/layout_' || o_custkey || '_' || substr(md5(o_orderkey::varchar), 1, 8) || '_' || substr(md5(o_custkey::varchar), 1, 8) || '.npy' as path,
  'layout_' || o_custkey as identifier from orders)"""


def layout_files(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    jitter = F.element_at(F.array(F.lit("0.0"), F.lit("0.1"), F.lit("0.25")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    hashed = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 8)
    path = F.concat(
        F.lit("results/random_seed_"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/jitter_amount_"), jitter,
        F.lit("/layout_"), F.col("o_custkey").cast("string"), F.lit("_"), hashed("o_orderkey"), F.lit("_"),
        hashed("o_custkey"), F.lit(".npy"))
    files = o.select((F.concat(F.lit("set_"), (F.col("o_custkey") % 3).cast("string"))).alias("dataset"), path.alias("path"))
    return files.select(
        "dataset", naming.run_seed(F.col("path")).alias("seed"), naming.run_jitter(F.col("path")).alias("jitter"),
        "path", naming.identifier(naming.file_name(F.col("path"))).alias("identifier"))


@query("discover_runs", f"with {_FILES} select dataset, seed::int seed, jitter, path, identifier from fl")
def discover_runs(spark, sf):
    return layout_files(spark, sf)


def _run_pairs_sql(varied, held, value, kind):
    return f"""with {_FILES}, one as (select dataset, identifier, {varied} v, min(path) path from fl where {held} = {value} group by 1, 2, 3)
select a.dataset, a.identifier, a.v::{kind} {varied}_1, b.v::{kind} {varied}_2, a.path path_1, b.path path_2
from one a join one b on a.dataset=b.dataset and a.identifier=b.identifier and a.v < b.v"""


@query("seed_pairs", _run_pairs_sql("seed", "jitter", "0.0::double", "int"))
def seed_pairs(spark, sf):
    return comparisons.run_pairs(layout_files(spark, sf), "seed", "jitter", 0.0)


@query("jitter_pairs", _run_pairs_sql("jitter", "seed", "2", "double"))
def jitter_pairs(spark, sf):
    return comparisons.run_pairs(layout_files(spark, sf), "jitter", "seed", 2)


@query("common_identifiers", f"""with {_FILES}
select identifier from fl where seed = 0 intersect select identifier from fl where seed = 1""")
def common_identifiers(spark, sf):
    files = layout_files(spark, sf)
    return comparisons.common_identifiers(files.filter("seed = 0"), files.filter("seed = 1"))


@query("random_pairs", """with o as (select o_orderkey id, row_number() over (order by ('0x' || substr(md5(o_orderkey || ':42'), 1, 12))::bigint, o_orderkey) - 1 rn from orders)
select a.id layout_1, b.id layout_2 from o a join o b on b.rn > a.rn and b.rn <= a.rn + 3""")
def random_pairs(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("layout_id"))
    return comparisons.random_pairs(ids, 3)


@query("resolve_names", f"""with {_FILES}, w as (select distinct 'layout_' || c_custkey as name from customer),
f1 as (select identifier, min(path) path from fl group by 1)
select name, path as name_path, path is null missing from w left join f1 on f1.identifier = w.name""")
def resolve_names(spark, sf):
    wanted = table(spark, sf, "customer").select(
        F.concat(F.lit("layout_"), F.col("c_custkey").cast("string")).alias("name"))
    found = comparisons.resolve_names(wanted, layout_files(spark, sf), "name")
    return found.select("name", "name_path", F.col("name_path").isNull().alias("missing"))


@query("resume_antijoin", f"""with {_FILES},
plan as (select a.identifier, a.seed seed_1, b.seed seed_2, a.path path_1, b.path path_2 from fl a join fl b
  on a.dataset=b.dataset and a.identifier=b.identifier and a.jitter=b.jitter and a.seed < b.seed)
select seed_1::int seed_1, seed_2::int seed_2, path_1, path_2 from plan
where not (('0x' || substr(md5(path_1), 1, 4))::int % 3 = 0 and ('0x' || substr(md5(path_2), 1, 4))::int % 2 = 0)""")
def resume_antijoin(spark, sf):
    files = layout_files(spark, sf)
    a = files.select("dataset", "identifier", "jitter", F.col("seed").alias("seed_1"), F.col("path").alias("path_1"))
    b = files.select("dataset", "identifier", "jitter", F.col("seed").alias("seed_2"), F.col("path").alias("path_2"))
    planned = a.join(b, ["dataset", "identifier", "jitter"]).filter("seed_1 < seed_2")
    hashed = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    finished = planned.filter((hashed("path_1") % 3 == 0) & (hashed("path_2") % 2 == 0))
    keys = ["seed_1", "seed_2", "path_1", "path_2"]
    return comparisons.unfinished(planned, finished, keys).select(*keys)


def _grid_sql(mode):
    flags = grid.perturbation_flags(mode)
    reductions = grid.reduction_flags(**grid.DEFAULTS)
    models = [f" --topic_model {m}" + (" --alpha_lda auto" if m == "lda" else "") for m in grid.GRID_MODELS]
    texts = lambda vs: "[" + ", ".join(f"'{v}'" for v in vs) + "]"
    return f"""with {_DATASETS},
cm as (select dataset, topics, 'run' || r || ' --dataset_name ' || dataset || ' --n_topics_lda ' || topics || ' --n_topics_lsi ' || topics
  || ' --n_topics_nmf ' || topics || m || p as command from ds, (select unnest({texts(reductions)}) r), (select unnest({texts(models)}) m), (select unnest({texts(flags)}) p)),
nm as (select dataset, command, replace(replace(replace(replace(replace(command, 'run', ''), '-', ''), 'n_topics_lda ' || topics, ''),
  'n_topics_lsi ' || topics, ''), '_nmf', '') raw from cm),
rs as (select dataset, command, 'results/' || dataset || '/results_' || replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' ', '_') || '.csv' result_path from nm)"""


@query("run_grid", _grid_sql("full") + """
select dataset, count(*)::bigint runs, (sum(('0x' || substr(md5(command || '|' || result_path), 1, 8))::bigint))::bigint digest,
 count(*) filter (('0x' || substr(md5(result_path), 1, 4))::int % 5 <> 0)::bigint open_runs from rs group by 1""")
def run_grid(spark, sf):
    runs = grid.run_grid(spread(datasets(spark, sf).drop("categories"), "dataset"))
    hashed = lambda c, n: F.conv(F.substring(F.md5(c), 1, n), 16, 10).cast("long")
    finished = runs.filter(hashed(F.col("result_path"), 4) % 5 == 0)
    todo = grid.open_runs(runs, finished).groupBy("dataset").agg(F.count("*").alias("open_runs"))
    every = runs.groupBy("dataset").agg(
        F.count("*").alias("runs"),
        F.sum(hashed(F.concat_ws("|", "command", "result_path"), 8)).alias("digest"))
    return every.join(todo, "dataset")
