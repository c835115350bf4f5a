"""Losses and run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_loss(df: DataFrame, by: list[str], loss: Column, weight: Column | None = None, strict: bool = False) -> DataFrame:
    """Mean loss by weight (1 for all without it), and its perplexity; null, or with `strict` an error, where all weights are zero."""
    weight = F.lit(1.0) if weight is None else weight
    total = F.sum(weight)
    if strict:
        total = F.when(total == 0, F.raise_error(F.lit("all weights are zero")).cast("double")).otherwise(total)
    mean = F.sum(loss * weight) / F.nullif(total, F.lit(0.0))
    return df.groupBy(*by).agg(mean.alias("mean_loss"), F.exp(mean).alias("perplexity"), F.count_if(weight > 0).alias("targets"))


def moving_loss(df: DataFrame, run: list[str], step: str, loss: str, n: int) -> DataFrame:
    order = Window.partitionBy(*run).orderBy(step).rowsBetween(1 - n, 0)
    return df.withColumn("recent_loss", F.avg(loss).over(order))


def update_loss(df: DataFrame, run: list[str], step: str, loss: str, k: int) -> DataFrame:
    """Means of each k microbatches in order; the last group may be short."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(step)) - 1)
    return numbered.groupBy(*run, F.floor(F.col("_n") / k).alias("update")).agg(F.avg(loss).alias("update_loss"), F.count("*").alias("microbatches"))


def best_record(df: DataFrame, run: list[str], pass_rate: str, loss: str, step: str) -> DataFrame:
    """Of each run the record of highest pass rate, then lowest loss, then latest step."""
    return df.groupBy(*run).agg(F.max_by(F.struct("*"), F.struct(F.col(pass_rate), -F.col(loss), F.col(step))).alias("r")).select("r.*")


def stop_reason(df: DataFrame, run: list[str], step: str, min_step: int, pretrain_loss: str, baseline: Column, pass_rate: str, target: float, sft_loss: str) -> DataFrame:
    """Why and when each run stops: regression of the pretraining loss, a passed gate, or neither."""
    late = F.col(step) >= min_step
    reason = F.when(late & (F.col(pretrain_loss) > baseline * 1.25), "pretrain_validation_regression").when(late & (F.col(pass_rate) >= target) & (F.col(sft_loss) <= 1.2), "behavior_gate_passed")
    told = df.withColumn("_r", reason)
    first = F.min(F.when(F.col("_r").isNotNull(), F.col(step)))
    return told.groupBy(*run).agg(F.coalesce(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col(step))), F.lit("max_behavior_updates_reached")).alias("stop_reason"), first.alias("stop_step"))


def stage_metrics(df: DataFrame, run: list[str], stage: str, epoch: Column, step: str, loss: str) -> DataFrame:
    """Of each epoch of a stage: microbatches, mean loss and last step."""
    return df.groupBy(*run, stage, epoch.alias("epoch")).agg(F.count("*").alias("microbatches"), F.avg(loss).alias("mean_loss"), F.max(step).alias("last_step"))


def final_epoch(epochs: DataFrame, run: list[str], epoch: str = "epoch") -> DataFrame:
    """Of each run the row of its last epoch."""
    return epochs.groupBy(*run).agg(F.max_by(F.struct("*"), epoch).alias("r")).select("r.*")


def sweep_table(finals: DataFrame, swept: str, fixed: list[str], loss: str) -> DataFrame:
    """By value of the swept setting: runs, best and mean loss, and whether each of the other settings is held fixed."""
    held = [(F.count_distinct(c) <= 1).alias(f"{c}_held") for c in fixed]
    return finals.groupBy(swept).agg(F.count("*").alias("runs"), F.min(loss).alias("best_loss"), F.avg(loss).alias("mean_loss"), *held)


def progress(df: DataFrame, run: list[str], step: str, loss: str, target: int) -> DataFrame:
    """Of each run its latest step and loss, and whether the target step is reached."""
    last = df.groupBy(*run).agg(F.max(step).alias("latest_step"), F.max_by(loss, step).alias("latest_loss"), F.count("*").alias("records"))
    return last.withColumn("status", F.when(F.col("latest_step") >= target, "completed").otherwise("running"))


def source_totals(df: DataFrame, source: str, targets: str) -> DataFrame:
    """Microbatches and loss targets of each source."""
    return df.groupBy(source).agg(F.count("*").alias("microbatches"), F.sum(targets).alias("loss_targets"))


def run_summary(metrics: DataFrame, split_stats: DataFrame, run: str = "experiment") -> DataFrame:
    """A row a run: its settings, the losses of its last epoch, its test loss and perplexity, and the sizes of its splits.

    metrics: nested run records (experiment, settings, training<test_loss, final_step>, epoch_metrics array<struct<epoch, ...>>);
    split_stats: (run, split, lines, stream_length). A run without epochs has null losses.
    """
    last = F.element_at(F.sort_array(F.transform("epoch_metrics", lambda e: F.struct(e["epoch"].alias("epoch"), e.alias("e")))), -1)["e"]
    final = metrics.withColumn("_last", F.when(F.size("epoch_metrics") > 0, last))
    rows = final.select(
        run, "settings.*", F.col("_last.epoch").alias("epochs"), F.col("_last.train_loss").alias("train_loss"), F.exp("_last.train_loss").alias("train_perplexity"),
        F.col("training.test_loss").alias("test_loss"), F.exp("training.test_loss").alias("test_perplexity"), F.col("training.final_step").alias("final_step"),
    )
    sizes = split_stats.groupBy(run).agg(*[F.sum(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("training", "validation", "testing") for c in ("lines", "stream_length")])
    return rows.join(sizes, run, "left")


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def metric_values(records: DataFrame, record: str, run: str = "$.experiment", depth: int = 8) -> DataFrame:
    """(run, path, number, text, truth) of every value in run records of any shape: a row a number, string, boolean or null, and a row for an
    empty list or object (no value). One pass, without a shuffle.

    record: a VARIANT column (see files.read_records); run: where it has its run's name. path: keys behind dots and list places, from 0,
    in brackets; a key with other characters than letters, digits and underscores stands quoted in brackets. A record that isn't nested at all is one row with
    an empty path. Values nested deeper than `depth` are an error. A null record has no rows, a run without a name a null one.
    """
    at, v = F.col("at"), F.col("v")
    rows = records.select(F.try_variant_get(F.col(f"`{record}`"), run, "string").alias("run"), F.lit("").alias("at"), F.col(f"`{record}`").alias("v")).where("v IS NOT NULL")
    member = lambda key: F.when(key.rlike(r"\A[A-Za-z0-9_]+\z"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit('["'), key, F.lit('"]')))
    under = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(at, member(e["key"])).alias("at"), e["value"].alias("v")))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")).alias("at"), x.alias("v")))
    inner = F.when(_kind(v, "OBJECT"), under).when(_kind(v, "ARRAY"), listed)
    for _ in range(depth):
        rows = rows.select("run", F.explode(F.when(F.size(inner) > 0, inner).otherwise(F.array(F.struct("at", "v")))).alias("c")).select("run", "c.at", "c.v")
    number = F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    told = F.when(F.size(inner) > 0, F.raise_error(F.concat(F.lit(f"nested deeper than {depth}: "), at)).cast("string")).otherwise(F.regexp_replace("at", r"^\.", ""))
    return rows.select(
        "run", told.alias("path"), F.when(number, F.try_variant_get(v, "$", "double")).alias("number"), F.when(_kind(v, "STRING"), F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(_kind(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")).alias("truth"),
    )


def metric_history(records: DataFrame, record: str, paths: list[str], fields: dict[str, str], run: str = "$.experiment") -> DataFrame:
    """(run, place, and a column a field) of the entries of a list in run records: the list at the first of `paths` where there is one; a
    record without one has no rows. fields: name -> type; an entry without a field, or with one of another kind, has null there."""
    found = F.coalesce(*[F.try_variant_get(F.col(f"`{record}`"), p, "array<variant>") for p in paths])
    rows = records.select(F.try_variant_get(F.col(f"`{record}`"), run, "string").alias("run"), F.posexplode(found).alias("place", "_e"))
    return rows.select("run", "place", *[F.try_variant_get("_e", f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def metric_columns(records: DataFrame, record: str, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """A row a record with the given columns: name -> type and the paths that may have it; the first that has a value of that type counts."""
    one = lambda kind, paths: F.coalesce(*[F.try_variant_get(F.col(f"`{record}`"), p, kind) for p in paths])
    return records.select(*[one(kind, paths).alias(name) for name, (kind, paths) in fields.items()])
