"""Measures over predictions derived from the embeddings: all components, dealt to ten classes, summed and
squashed to probabilities, with the label as target."""

from pyspark.sql import functions as F

from webloom.functions import vectors as V
from webloom.operators import measures as M
from webloom.plans.registry import query

CLASSES = 10
PRED = """pred as (select vec_id as id, label as target, list_transform(o, lambda x: x / list_sum(o)) as pred from
   (select vec_id, label, list_transform(range(0, 10), lambda c: 1.0::double / (1.0::double + exp(-round(list_sum(list_transform(list_filter(range(1, len(embedding) + 1),
     lambda i: (i - 1) % 10 = c), lambda i: embedding[i]::double)), 9)))) as o from embeddings))"""
ARG = "list_position(pred, list_max(pred)) - 1"
CONF = f"conf as (select {ARG} as p, target as t, count(*) as n from pred group by all)"
F1 = f"""{CONF}, cl as (select unnest(range(10)) as c), d as (select c, coalesce((select sum(n) from conf where p = c and t = c), 0)::double as diag,
   coalesce((select sum(n) from conf where t = c), 0)::double as targ, coalesce((select sum(n) from conf where p = c), 0)::double as got from cl),
   pr as (select sum(diag / (targ + 1e-8::double)) / 10 as precision, sum(diag / (got + 1e-8::double)) / 10 as recall, sum(diag) / sum(targ) as accp from d)"""


def predictions(t):
    values = F.col("embedding").cast("array<double>")
    part = lambda c: F.aggregate(F.filter(values, lambda x, i: i % CLASSES == c), F.lit(0.0), lambda a, x: a + x)
    # Rounded, so that equal sums in another order stay equal.
    odds = F.array(*[1.0 / (1.0 + F.exp(-F.round(part(c), 9))) for c in range(CLASSES)])
    total = F.aggregate("o", F.lit(0.0), lambda s, x: s + x)
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("target"), odds.alias("o"))
    return rows.select("id", "target", F.transform("o", lambda x: x / total).alias("pred"))


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


RANK = "len(list_filter(range(1, 11), lambda i: pred[i] > pred[target + 1] or (pred[i] = pred[target + 1] and i < target + 1))) + 1"


@query("accuracy_at_k", f"""with {PRED}, r as (select {RANK} as rank from pred) select round(avg((rank <= 1)::int), 6) as acc,
  round(avg((rank <= 3)::int), 6) as acc3, round(avg((rank <= 5)::int), 6) as acc5 from r""")
def accuracy_at_k(t):
    return rounded(M.accuracy_at_k(predictions(t), [1, 3, 5]).toDF("acc", "acc3", "acc5"))


@query("confusion_matrix", f"with {PRED}, {CONF} select cast(p as int) as predicted, t as target, n from conf")
def confusion_matrix(t):
    return M.confusion_matrix(predictions(t))


@query("confusion_full", f"""with {PRED}, {CONF}, cl as (select unnest(range(10))::int as c)
  select a.c as predicted, b.c as target, round(coalesce(n, 0)::double / (select sum(n) from conf where t = b.c), 9) as share
  from cl a cross join cl b left join conf on p = a.c and t = b.c""")
def confusion_full(t):
    return rounded(M.confusion_full(predictions(t), CLASSES), 9)


@query("precision_recall_f1", f"""with {PRED}, {F1} select round(precision, 6) as precision, round(recall, 6) as recall,
  round(2 * precision * recall / (precision + recall), 6) as f1, round(accp, 6) as accp from pr""")
def precision_recall_f1(t):
    return rounded(M.precision_recall_f1(predictions(t), CLASSES))


BINARY = "b as (select id, (target % 2)::int as y, round(pred[2], 3) as s from pred)"
AUC = f"{BINARY}, r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as rk from b)"


@query("auc_by_rank", f"""with {PRED}, {AUC} select round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double)
   / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6) as auc from r""")
def auc_by_rank(t):
    return rounded(M.auc(predictions(t), F.round(F.get("pred", 1), 3), F.col("target") % 2 == 1))


GINI = """g as (select vec_id as id, label::double as a, round(embedding[1]::double, 2) as p from embeddings),
 s as (select sum(a) as total, count(*) as n from g),
 x as (select sum(a) over (order by p desc, id rows unbounded preceding) / total as ca, row_number() over (order by p desc, id) / n::double as cp,
       sum(a) over (order by a desc, id rows unbounded preceding) / total as pa, row_number() over (order by a desc, id) / n::double as pp from g, s)"""


@query("gini_cumulative", f"with {GINI} select round(sum(ca - cp) / sum(pa - pp), 6) as gini from x")
def gini_cumulative(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("a"), F.round(F.get("embedding", 0).cast("double"), 2).alias("p"))
    return rounded(M.gini(rows, "a", "p", "id"))


@query("log_loss", f"with {PRED} select round(avg(-ln(pred[target + 1])), 6) as mcll from pred")
def log_loss(t):
    return rounded(predictions(t).agg(M.log_loss_column().alias("mcll")))


@query("matthews_corr", f"""with {PRED}, b as (select case when round(list_sum(list_transform(range(1, 11, 2), lambda i: pred[i])), 9) >= round(list_sum(list_transform(range(2, 11, 2), lambda i: pred[i])), 9)
    then 0 else 1 end as p, target % 2 as t from pred),
  c as (select count(*) filter (p = 0 and t = 0)::double as tp, count(*) filter (p = 1 and t = 1)::double as tn, count(*) filter (p = 0 and t = 1)::double as fn,
   count(*) filter (p = 1 and t = 0)::double as fp from b)
  select round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from c""")
def matthews_corr(t):
    """Even against odd classes, each side with the probabilities of all its classes."""
    side = lambda k: F.round(F.aggregate(F.filter("pred", lambda p, i: i % 2 == k), F.lit(0.0), lambda a, p: a + p), 9)
    two = predictions(t).select((F.col("target") % 2).alias("target"), F.array(side(0), side(1)).alias("pred"))
    return rounded(two.agg(M.matthews_column().alias("mcc")))


@query("euclidean_loss", """select round(avg(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::double - embedding[i + 32]::double) * (embedding[i]::double - embedding[i + 32]::double)))), 6) as eucll from embeddings""")
def euclidean_loss(t):
    v = F.col("embedding").cast("array<double>")
    halves = t.embeddings.select(F.slice(v, 1, 32).alias("p"), F.slice(v, 33, 32).alias("t"))
    return rounded(halves.agg(M.euclidean_loss_column("p", "t").alias("eucll")))


@query("per_position_accuracy", """with s as (select vec_id, unnest(range(1, 33)) as i, embedding from embeddings),
  l as (select vec_id, (case when embedding[i] <= 0 then 0 else 1 end) + (case when embedding[i] > 0.1 then 1 else 0 end) as p,
    (case when embedding[i + 32] <= 0 then 0 else 1 end) + (case when embedding[i + 32] > 0.1 then 1 else 0 end) as t from s),
  a as (select avg(acc) as acc from (select avg((p = t)::int) as acc from l group by vec_id)),
  c as (select vec_id, c, count(*) filter (p = c and t = c)::double as k, count(*) filter (t = c)::double as nt, count(*) filter (p = c)::double as np
    from l, (select unnest([0, 1, 2]) as c) group by all),
  m as (select c, sum(k / nt) filter (k > 0) / count(*) filter (k > 0) as ma, sum(case when nt + np - k > 0 then k / (nt + np - k) else 0 end) / count(*) as mi from c group by c)
  select round((select acc from a), 6) as acc, round(sum(ma) / count(*), 6) as mean_acc, round(sum(mi) / count(*), 6) as mean_iou from m""")
def per_position_accuracy(t):
    label = lambda v: F.transform(v, lambda x: F.when(x <= 0, 0).otherwise(1) + F.when(x > 0.1, 1).otherwise(0))
    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select(label(F.slice(v, 1, 32)).alias("p"), label(F.slice(v, 33, 32)).alias("t"))
    return rounded(M.per_position_accuracy(rows, "p", "t", 3))


MILLIONTHS = "cast(round(({}) * 1000000) as bigint)"


@query("measure_report", f"""with {PRED}, {F1}, k as (select {RANK} as rank, -ln(pred[target + 1]) as ll, id,
    list_sum(list_transform(range(1, 11), lambda i: (pred[i] - (i - 1 = target)::int) * (pred[i] - (i - 1 = target)::int))) as e from pred),
  b2 as (select (target = 1)::int as y, pred[2] as s from pred), r2 as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as rk from b2),
  au as (select (sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc from r2),
  g as (select target::double as a, {ARG} as p, id from pred),
  gx as (select sum(a) over (order by p desc, id rows unbounded preceding) / sum(a) over () - row_number() over (order by p desc, id) / count(*) over ()::double as d1,
    sum(a) over (order by a desc, id rows unbounded preceding) / sum(a) over () - row_number() over (order by a desc, id) / count(*) over ()::double as d2 from g),
  gi as (select sum(d1) / sum(d2) as gini from gx),
  two as (select coalesce(sum(n) filter (p = 0 and t = 0), 0)::double as tp, coalesce(sum(n) filter (p = 1 and t = 1), 0)::double as tn,
    coalesce(sum(n) filter (p = 0 and t = 1), 0)::double as fn, coalesce(sum(n) filter (p = 1 and t = 0), 0)::double as fp from conf),
  mc as (select (tp * tn - fp * fn) / sqrt(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 then 1 else (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) end) as mcc from two),
  dg as (select string_agg({MILLIONTHS.format('diag / (targ + 1e-8::double)')}::varchar, ',' order by c) as cmdiag from d),
  cf as (select string_agg({MILLIONTHS.format('coalesce((select n from conf where p = x.c and t = y.c), 0)::double / y.targ')}::varchar, ',' order by y.c, x.c) as cmfull from d x, d y)
  select count(*) as rows, round(avg((rank <= 1)::int), 6) as acc, round(avg((rank <= 3)::int), 6) as acc3, round(avg(ll), 6) as mcll, round(avg(e), 6) as eucll,
   any_value(round(precision, 6)) as precision, any_value(round(recall, 6)) as recall, any_value(round(2 * precision * recall / (precision + recall), 6)) as f1,
   any_value(round(accp, 6)) as accp, any_value(round(auc, 6)) as auc, any_value(round(gini, 6)) as gini, any_value(round(mcc, 6)) as mcc,
   any_value(cmdiag) as cmdiag, any_value(cmfull) as cmfull, round(avg(ll), 6) as loss from k, pr, au, gi, mc, dg, cf""")
def measure_report(t):
    """Every measure the report knows; the loss told by the job is the log loss here."""
    rows = predictions(t)
    loss = rows.agg(M.log_loss_column()).first()[0]
    names = ["acc", "acc-3", "f1", "cmdiag", "cmfull", "auc", "gini", "mcll", "mcc", "eucll", "loss"]
    report = M.measure_report(rows, names, CLASSES, known={"loss": loss})
    listed = lambda values: F.array_join(F.transform(values, lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")
    return rounded(report.withColumnRenamed("acc-3", "acc3").withColumn("cmdiag", listed(F.col("cmdiag"))).withColumn("cmfull", listed(F.flatten("cmfull"))))


@query("measure_history", """select event_type as measure, row_number() over (partition by event_type order by event_id) as step, value from events""")
def measure_history(t):
    return M.measure_history(t.events.select(F.col("event_type").alias("measure"), F.col("event_id").alias("iteration"), "value"))


@query("best_categories", f"""with {PRED}, e as (select id, generate_subscripts(pred, 1) - 1 as cat, unnest(pred) as prob from pred)
  select id, row_number() over (partition by id order by prob desc, cat) as rank, cast(cat as int) as cat, round(prob, 9) as prob from e qualify rank <= 3""")
def best_categories(t):
    best = V.best_categories(F.col("pred"), 3)
    return predictions(t).select("id", F.posexplode(best).alias("pos", "b")).select(
        "id", (F.col("pos") + 1).cast("bigint").alias("rank"), "b.cat", F.round("b.prob", 9).alias("prob"))


@query("top5_classes", f"""with {PRED}, e as (select id, generate_subscripts(pred, 1) - 1 as cat, unnest(pred) as prob from pred)
  select id, string_agg(cat, ',' order by prob desc, cat) as classes from (select * from e qualify row_number() over (partition by id order by prob desc, cat) <= 5) group by id""")
def top5_classes(t):
    best = V.best_categories(F.col("pred"), 5)
    return predictions(t).select("id", F.array_join(F.transform(best, lambda b: b["cat"].cast("string")), ",").alias("classes"))


@query("confidence_filter", f"""with {PRED}, e as (select id, generate_subscripts(pred, 1) - 1 as cat, unnest(pred) as prob from pred)
  select id, cast(cat as int) as cat, round(prob, 9) as prob from e where prob >= 0.105""")
def confidence_filter(t):
    kept = F.filter(V.best_categories(F.col("pred"), -1), lambda b: b["prob"] >= 0.105)
    return predictions(t).select("id", F.explode(kept).alias("b")).select("id", "b.cat", F.round("b.prob", 9).alias("prob"))


@query("best_per_box", """select l_suppkey as uri, l_linenumber as box, l_orderkey as cat, l_extendedprice as prob,
  row_number() over (partition by l_suppkey, l_linenumber order by l_extendedprice desc, l_orderkey, l_partkey) as rank from lineitem qualify rank <= 2""")
def best_per_box(t):
    """Two best rows per (uri, box); the rank filter also runs before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey")
    return t.lineitem.select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_extendedprice").withColumn(
        "rank", F.row_number().over(w)).filter("rank <= 2").select(
            F.col("l_suppkey").alias("uri"), F.col("l_linenumber").alias("box"), F.col("l_orderkey").alias("cat"),
            F.col("l_extendedprice").alias("prob"), F.col("rank").cast("bigint").alias("rank"))
