"""Quality measures of predictions.

Input rows: ``id``, ``pred`` (probability per class) and ``target`` (class number).
Every measure is one aggregation; ranks come from the ordered operators, so neither a
frequent class nor a tied score gathers rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.vectors import argmax, squared_distance
from webloom.operators.ordered import ordinal, running
from webloom.session import checkpoint

EPS = 1e-8


def target_rank() -> Column:
    """1-based rank of the target among the predictions; ties go to the lower class."""
    hit = F.get("pred", F.col("target"))
    ahead = F.filter("pred", lambda p, i: (p > hit) | ((p == hit) & (i < F.col("target"))))
    return F.size(ahead) + 1


def accuracy_columns(ks: list[int]) -> list[Column]:
    hit = lambda k: (F.size("pred") >= k) & F.coalesce(target_rank() <= k, F.lit(False))
    return [F.avg(hit(k).cast("double")).alias("acc" if k == 1 else f"acc-{k}") for k in ks]


def accuracy_at_k(rows: DataFrame, ks: list[int]) -> DataFrame:
    """Share of rows whose target is among the k best predictions."""
    return rows.agg(*accuracy_columns(ks))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """(predicted, target, n)."""
    return rows.groupBy(argmax(F.col("pred")).alias("predicted"), "target").agg(F.count("*").alias("n"))


def confusion_full(rows: DataFrame, classes: int) -> DataFrame:
    """All cells as shares of their target class; NULL for a class without rows."""
    counts = confusion_matrix(rows)
    cells = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("predicted", "target"), F.col("n")))).alias("m"))
    grid = F.array(*[F.struct(F.lit(p).alias("predicted"), F.lit(t).alias("target")) for p in range(classes) for t in range(classes)])
    cell = lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0))
    total = lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(classes - 1)), F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(
        F.try_element_at("m", F.struct(p.alias("predicted"), c["target"].alias("target"))), F.lit(0)))
    return cells.select(F.inline(F.transform(grid, lambda c: F.struct(
        c["predicted"].alias("predicted"), c["target"].alias("target"), F.try_divide(cell(c), total(c)).alias("share")))))


def precision_recall_f1(rows: DataFrame, classes: int) -> DataFrame:
    """Macro precision, recall, F1 and accuracy.

    "precision" divides by target totals and "recall" by prediction totals, the reverse of the
    usual convention, because users of these measures expect it so. F1 is the same either way.
    """
    counts = confusion_matrix(rows)
    by_target = counts.groupBy(F.col("target").alias("c")).agg(F.sum("n").alias("targets"), F.sum(F.when(F.col("predicted") == F.col("target"), F.col("n"))).alias("diag"))
    by_pred = counts.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("preds"))
    joined = by_target.join(by_pred, "c", "full").fillna(0, ["targets", "preds", "diag"])
    share = lambda total: F.sum(F.col("diag") / (F.col(total) + EPS)) / classes
    means = joined.agg(share("targets").alias("precision"), share("preds").alias("recall"), (F.sum("diag") / F.sum("targets")).alias("accp"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return means.select("precision", "recall", f1.alias("f1"), "accp")


def auc(rows: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Area under the ROC curve with tied scores joined by straight lines; 1 for a single class.

    Rows are first added up per distinct score, then accumulated over the score order.
    """
    points = checkpoint(rows.select(score.alias("score"), positive.cast("bigint").alias("one")).groupBy("score").agg(
        F.sum("one").alias("ones"), (F.count("*") - F.sum("one")).alias("zeros")))
    summed = running(points, ["score"], {"ones_to": ("sum", F.col("ones"))})
    whole = summed.agg(
        F.sum("ones").alias("p"), F.sum("zeros").alias("n"),
        F.sum(F.col("zeros") * F.col("ones")).alias("tied"), F.sum(F.col("zeros") * F.col("ones_to")).alias("below"))
    # Twice the area: each zero meets the ones above it fully and its ties by half.
    doubled = 2.0 * F.col("n") * F.col("p") - 2 * F.col("below") + F.col("tied")
    return whole.select(F.when((F.col("p") == 0) | (F.col("n") == 0), 1.0).otherwise(
        F.try_divide(doubled, 2.0 * F.col("p") * F.col("n"))).alias("auc"))


def gini(rows: DataFrame, actual: str, predicted: str, id_col: str) -> DataFrame:
    """Normalized Gini: cumulative share of the actual values in predicted order, minus the
    population share, relative to the perfect order."""
    n = rows.select(F.count("*")).scalar()
    total = rows.select(F.sum(actual)).scalar()

    def area(by: str) -> Column:
        keyed = rows.select(F.col(actual).cast("double").alias("a"), (-F.col(by)).alias("key"), F.col(id_col).alias("tie"))
        ranked = ordinal(keyed, ["key", "tie"], "place")
        # The cumulative sums add every value once per later place.
        return ranked.select(F.sum(F.col("a") * (n - F.col("place") + 1)) / total - (n + 1) / 2).scalar()

    one = rows.groupBy().agg(F.count("*").alias("n"))
    return one.select((area(predicted) / area(actual)).alias("gini"))


def log_loss_column() -> Column:
    return F.avg(-F.log(F.get("pred", F.col("target"))))


def matthews_column() -> Column:
    got = argmax(F.col("pred"))
    count = lambda p, t: F.count_if((got == p) & (F.col("target") == t)).cast("double")
    tp, tn, fn, fp = count(0, 0), count(1, 1), count(0, 1), count(1, 0)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / F.sqrt(F.when(spread == 0, 1.0).otherwise(spread))


def euclidean_loss_column(pred: str, target: str) -> Column:
    return F.avg(squared_distance(F.col(pred), F.col(target)))


def per_position_accuracy(rows: DataFrame, pred: str, target: str, classes: int) -> DataFrame:
    """Rows hold label sequences. Mean accuracy per row, mean accuracy over classes and mean
    intersection over union, each class averaged over the rows it was right in."""
    pairs = F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))
    count = lambda keep: F.size(F.filter(pairs, keep)).cast("double")
    acc = count(lambda x: x["p"] == x["t"]) / F.size(pairs)
    sums = [F.avg(acc).alias("acc")]
    for c in range(classes):
        both, targ, got = count(lambda x: (x["p"] == c) & (x["t"] == c)), count(lambda x: x["t"] == c), count(lambda x: x["p"] == c)
        right = both > 0
        sums += [F.coalesce(F.sum(F.when(right, both / targ)), F.lit(0.0)).alias(f"s{c}"), F.count_if(right).alias(f"n{c}"),
                 F.coalesce(F.sum(F.try_divide(both, targ + got - both)), F.lit(0.0)).alias(f"u{c}"), F.count("*").alias(f"m{c}")]
    totals = rows.agg(*sums)
    used = lambda c: F.col(f"n{c}") > 0
    over = lambda c, s, n: F.when(used(c), F.col(f"{s}{c}") / F.col(f"{n}{c}")).otherwise(0.0)
    kinds = sum((used(c).cast("int") for c in range(classes)), F.lit(0))
    mean = lambda s, n: F.try_divide(sum((over(c, s, n) for c in range(classes)), F.lit(0.0)), kinds)
    # The union is averaged over all rows, the accuracy over the rows right for the class.
    return totals.select("acc", mean("s", "n").alias("mean_acc"), mean("u", "m").alias("mean_iou"))


def target_vector() -> Column:
    """What ``pred`` should have been: the target itself, or one at its class and zero elsewhere."""
    return F.when(F.size("pred") == 1, F.array(F.col("target").cast("double"))).otherwise(
        F.transform("pred", lambda p, i: (i == F.col("target")).cast("double")))


def class_measures(rows: DataFrame, classes: int) -> dict[str, object]:
    """f1, precision, recall, accp, mcc, cmdiag and cmfull from one confusion table of ``classes`` squared cells.

    ``cmdiag`` has a class's share of its own rows that were right, ``cmfull`` a list per target class with the share
    of its rows given to each class (null for a class without rows). Rows without a target count nowhere.
    """
    cells = {(r["predicted"], r["target"]): r["n"] for r in confusion_matrix(rows.filter("target is not null")).collect()}
    if any(t < 0 or t >= classes or p is None or p >= classes for p, t in cells):
        raise ValueError(f"a target or prediction is not among {classes} classes")
    n = lambda p, t: float(cells.get((p, t), 0))
    every = range(classes)
    targets, given = [sum(n(p, t) for p in every) for t in every], [sum(n(p, t) for t in every) for p in every]
    precision = sum(n(c, c) / (targets[c] + EPS) for c in every) / classes
    recall = sum(n(c, c) / (given[c] + EPS) for c in every) / classes
    tp, tn, fn, fp = (n(0, 0), n(1, 1), n(0, 1), n(1, 0)) if classes > 1 else (n(0, 0), 0.0, 0.0, 0.0)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return {
        "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else None,
        "accp": sum(n(c, c) for c in every) / sum(targets) if sum(targets) else None,
        "mcc": (tp * tn - fp * fn) / (spread or 1.0) ** 0.5,
        "cmdiag": [n(c, c) / (targets[c] + EPS) for c in every],
        "cmfull": [[n(p, t) / targets[t] if targets[t] else None for p in every] for t in every]}


#: Measures by name; f1 brings three more.
FROM_CELLS = {"f1": ["precision", "recall", "f1", "accp"], "mcc": ["mcc"], "cmdiag": ["cmdiag"], "cmfull": ["cmfull"]}
KINDS = {"cmdiag": "array<double>", "cmfull": "array<array<double>>"}


def measure_report(rows: DataFrame, names: list[str], classes: int, regression: bool = False, known: dict[str, float] | None = None) -> DataFrame:
    """One row with the chosen measures: acc, acc-k, f1, cmdiag, cmfull, auc, gini, mcll, mcc, eucll, and
    loss, train_loss or iteration, which the training job tells in ``known``.

    Gini compares the targets in the order of the best class with their own, for ``regression`` in the order
    of the predicted value.
    """
    direct, nested, fixed = [], [], []
    cells = class_measures(rows, classes) if any(name in FROM_CELLS for name in names) else {}
    literal = lambda value, kind: F.lit(None).cast(kind) if value is None else F.array(*[literal(v, kind[6:-1]) for v in value]) if kind[:5] == "array" else F.lit(value).cast(kind)
    for name in names:
        if name == "acc" or name.startswith("acc-"):
            direct += accuracy_columns([int(name[4:] or 1)])
        elif name == "mcll":
            direct.append(log_loss_column().alias("mcll"))
        elif name == "eucll":
            direct.append(F.avg(squared_distance(F.col("pred"), target_vector())).alias("eucll"))
        elif name in FROM_CELLS:
            fixed += [literal(cells[m], KINDS.get(m, "double")).alias(m) for m in FROM_CELLS[name]]
        elif name == "auc":
            nested.append(("auc", auc(rows, F.get("pred", 1), F.col("target") == 1), "auc"))
        elif name == "gini":
            told = F.get("pred", 0) if regression else argmax(F.col("pred")).cast("double")
            nested.append(("gini", gini(rows.select("id", F.col("target").cast("double").alias("a"), told.alias("p")), "a", "p", "id"), "gini"))
        elif name in ("loss", "train_loss", "iteration"):
            if name not in (known or {}):
                raise ValueError(f"{name} must be told by the training job")
            fixed.append(F.lit(known[name]).cast("double").alias(name))
        else:
            raise ValueError(f"unknown measure {name}")
    base = rows.agg(F.count("*").alias("rows"), *direct)
    return base.select("*", *fixed, *[frame.select(column).scalar().alias(alias) for alias, frame, column in nested])


def measure_history(log: DataFrame) -> DataFrame:
    """(measure, step, value): values of each measure numbered in iteration order."""
    return ordinal(log, ["iteration"], "step", by=["measure"]).select("measure", "step", "value")
