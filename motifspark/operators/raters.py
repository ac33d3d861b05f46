"""Raters' votes to ground truth, agreement, and the bookkeeping of an annotation round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normal_key
from ..schema import NON_MEME, TEMPLATE_FREE

KINDS = ["TEMPLATE", "TEMPLATELESS", "NON_MEME"]


def folded(kind: Column, keep_unsure: bool = False) -> Column:
    return kind if keep_unsure else F.when(kind == "UNSURE", "TEMPLATELESS").otherwise(kind)


def kind_label(kind: Column) -> Column:
    return F.when(kind == "NON_MEME", NON_MEME).when(kind == "TEMPLATELESS", TEMPLATE_FREE).otherwise("Templated-Meme")


def tally(votes: DataFrame, keep_unsure: bool = False) -> DataFrame:
    """(image_id, n_votes, kind, n_agree, tied): the leading kind of votes (image_id, kind, ...); tied with none or equal leaders."""
    v = votes.withColumn("kind", folded(F.col("kind"), keep_unsure))
    by = v.groupBy("image_id", "kind").agg(F.count("*").alias("n"))
    total = by.groupBy("image_id").agg(F.sum("n").alias("n_votes"))
    valid = by.filter(F.col("kind").isin(KINDS))
    w = Window.partitionBy("image_id").orderBy(F.col("n").desc(), "kind")
    top = valid.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).filter("k = 1")
    return total.join(top.select("image_id", "kind", F.col("n").alias("n_agree"), F.coalesce(F.col("n") == F.col("second"), F.lit(False)).alias("t")), "image_id", "left").select("image_id", "n_votes", "kind", "n_agree", F.coalesce("t", F.lit(True)).alias("tied"))


def template_names(votes: DataFrame) -> DataFrame:
    """(image_id, name): the most frequent key among TEMPLATE voters' names, ties to the one seen first (ord), in its first spelling."""
    n = votes.filter((F.col("kind") == "TEMPLATE") & (F.trim("name") != "")).withColumn("key", normal_key(F.col("name")))
    by = n.groupBy("image_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("ord", F.trim("name").alias("name"))).alias("f"))
    w = Window.partitionBy("image_id").orderBy(F.col("n").desc(), "f.ord")
    return by.withColumn("k", F.row_number().over(w)).filter("k = 1").select("image_id", F.col("f.name").alias("name"))


def ground_truth(votes: DataFrame, breaks: DataFrame | None = None, keep_unsure: bool = False) -> DataFrame:
    """(sample_id, label, kind, n_votes, n_agree); tied images only by a tie break (image_id, kind, label), else left out."""
    t = tally(votes, keep_unsure).join(template_names(votes), "image_id", "left")
    clear = t.filter("not tied").withColumn("label", F.when((F.col("kind") == "TEMPLATE") & F.col("name").isNotNull(), F.col("name")).otherwise(kind_label(F.col("kind"))))
    out = clear.select(F.col("image_id").alias("sample_id"), "label", "kind", "n_votes", "n_agree")
    if breaks is None:
        return out
    b = breaks.select("image_id", F.col("kind").alias("bk"), F.trim(F.coalesce("label", F.lit(""))).alias("bl"))
    tied = t.filter("tied").select("image_id", "n_votes").join(b, "image_id")
    v = votes.withColumn("kind", folded(F.col("kind"), keep_unsure))
    support = tied.join(v.select("image_id", "kind"), "image_id").groupBy("image_id").agg(F.count_if(F.col("kind") == F.col("bk")).alias("n_agree"))
    label = F.when((F.col("bk") == "TEMPLATE") & (F.col("bl") != ""), F.col("bl")).otherwise(kind_label(F.col("bk")))
    broken = tied.join(support, "image_id").select(F.col("image_id").alias("sample_id"), label.alias("label"), F.col("bk").alias("kind"), "n_votes", "n_agree")
    return out.unionByName(broken)


def codings(votes: DataFrame, keep_unsure: bool = False) -> DataFrame:
    """Each vote once for each recoding: three classes, templated or not, meme or not, and with UNSURE apart if kept."""
    k = folded(F.col("kind"), keep_unsure)
    code = lambda name, c: F.struct(F.lit(name).alias("coding"), c.alias("code"))
    some = [code("three_class", folded(F.col("kind"))), code("templated_vs_rest", F.when(k == "TEMPLATE", "templated").otherwise("rest")), code("meme_vs_rest", F.when(k == "NON_MEME", "non_meme").otherwise("meme"))]
    if keep_unsure:
        some.append(code("four_class", k))
    return votes.select("image_id", "annotator", F.explode(F.array(*some)).alias("c")).select("image_id", "annotator", "c.*")


def agreement(coded: DataFrame, raters: int) -> DataFrame:
    """(coding, n_items, kappa, pairwise, unanimous) over images that all raters voted on: Fleiss' kappa and plain shares; where all votes are of one kind, chance is certain and kappa 1."""
    full = coded.groupBy("coding", "image_id").agg(F.count("*").alias("n")).filter(F.col("n") == raters).select("coding", "image_id")
    counts = coded.join(full, ["coding", "image_id"]).groupBy("coding", "image_id", "code").agg(F.count("*").alias("c"))
    items = counts.groupBy("coding", "image_id").agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("kinds"))
    a = items.groupBy("coding").agg(F.count("*").alias("n_items"), F.avg((F.col("s") - raters) / (raters * (raters - 1))).alias("pa"), F.avg((F.col("kinds") == 1).cast("double")).alias("u"))
    totals = counts.groupBy("coding", "code").agg(F.sum("c").alias("c"))
    e = totals.join(a.select("coding", "n_items"), "coding").groupBy("coding").agg(F.sum(F.pow(F.col("c") / (F.col("n_items") * raters), 2)).alias("pe"))
    return a.join(e, "coding").select("coding", "n_items", F.round(F.when(F.col("pe") < 1, F.try_divide(F.col("pa") - F.col("pe"), 1 - F.col("pe"))).otherwise(1.0), 6).alias("kappa"), F.round("pa", 6).alias("pairwise"), F.round("u", 6).alias("unanimous"))


def rater_pairs(votes: DataFrame) -> DataFrame:
    """(rater_a, rater_b, n, agreement, kappa) of raters on the images both judged; kappa 1 or 0 where chance is certain."""
    a = votes.select("image_id", F.col("annotator").alias("rater_a"), F.col("kind").alias("ka"))
    b = votes.select("image_id", F.col("annotator").alias("rater_b"), F.col("kind").alias("kb"))
    counts = a.join(b, "image_id").filter("rater_a < rater_b").groupBy("rater_a", "rater_b", "ka", "kb").agg(F.count("*").alias("n"))
    keys = ["rater_a", "rater_b"]
    side = lambda c: counts.groupBy(*keys, F.col(c).alias("k")).agg(F.sum("n").alias(c))
    chance = side("ka").join(side("kb"), [*keys, "k"]).groupBy(*keys).agg(F.sum(F.col("ka") * F.col("kb")).alias("tp"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ka") == F.col("kb"), F.col("n")).otherwise(0)).alias("c"))
    po, pe = F.col("c") / F.col("n"), F.coalesce("tp", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.when(po == 1, 1.0).otherwise(0.0))
    return sums.join(chance, keys, "left").select(*keys, "n", F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def model_accuracy(wide: DataFrame, models: list[str]) -> DataFrame:
    """(annotator, model, n, accuracy) of columns <model>__correct (1, 0 or null); rows whose decision is UNSURE are left out."""
    long = wide.filter("decision <> 'UNSURE'").unpivot(["annotator"], [f"{m}__correct" for m in models], "model", "correct")
    return long.withColumn("model", F.regexp_replace("model", "__correct$", "")).groupBy("annotator", "model").agg(F.count("correct").alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"))


def consensus(rows: DataFrame) -> DataFrame:
    """(image_id, consensus_label, n_annotators, n_agree): of each annotator's last row (ord) for an image; a tie leaves the label blank."""
    last = rows.groupBy("image_id", "annotator").agg(F.max_by("label", "ord").alias("label"))
    by = last.groupBy("image_id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id").orderBy(F.col("n").desc(), "label")
    top = by.withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("image_id"))).filter("k = 1")
    tie = F.coalesce(F.col("n") == F.col("second"), F.lit(False))
    return top.select("image_id", F.when(tie, "").otherwise(F.col("label")).alias("consensus_label"), F.col("all").alias("n_annotators"), F.col("n").alias("n_agree"))


def assign(items: DataFrame, roster: list[str], overlap: int) -> DataFrame:
    """(annotator, idx): the first ``overlap`` items (idx from 0) to everyone, the rest round robin; without overlap all to all."""
    people = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("annotator")) for i, n in enumerate(roster)])).alias("p")
    dealt = items.select("idx", people).select("idx", "p.*")
    mine = (F.col("idx") < overlap) | (F.pmod(F.col("idx") - overlap, F.lit(len(roster))) == F.col("i")) if overlap else F.lit(True)
    return dealt.filter(mine).select("annotator", "idx")


def display_order(items: DataFrame, models: list[str], seed: int) -> DataFrame:
    """(image_id, model, place): a seeded order of the models, the same for every rater of an image."""
    m = items.select("image_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string"), "model"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(key, "model")))


def last_session(log: DataFrame, current_run: str) -> DataFrame:
    """(annotator, run_id, ts): each person's last event of another run."""
    return log.filter(F.col("run_id") != current_run).groupBy("annotator").agg(F.max(F.struct("ts", "run_id")).alias("s")).select("annotator", "s.run_id", "s.ts")


def coverage_gaps(labels: DataFrame, preds: DataFrame) -> DataFrame:
    """(sample_id, model): labelled samples that a model has no prediction for. Models are a short list."""
    models = [r["model"] for r in preds.select("model").distinct().orderBy("model").collect()]
    wanted = labels.select("sample_id", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return wanted.join(preds.select("sample_id", "model"), ["sample_id", "model"], "left_anti")
