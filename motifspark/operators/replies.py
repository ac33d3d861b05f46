"""Prompts out, model replies in: tables of texts to tables of labels; and template search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import lenient_key, lenient_lookup
from ..schema import INVALID_TEMPLATE


def reply_object(text: Column) -> Column:
    """The JSON object text of a reply: code fences off; if that is none, from the first brace to the last; else null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```(json)?\s*", ""), r"(?s)\s*```$", ""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    known = lambda c: F.call_function("try_parse_json", c).isNotNull()
    return F.when(known(t), t).when((inner != "") & known(inner), inner)


def resolve(replies: DataFrame, labels: DataFrame, text: str = "raw_response_text") -> DataFrame:
    """replies with raw_template_id, raw_template, template_pred, valid and match_mode.

    labels: (label_idx, label), the label space. In order: a whole number in template_id (or its digits in text, or
    one in a list); an exact name in template, then in template_id; then names that differ in case and marks only.
    """
    obj = replies.withColumn("__o", reply_object(F.col(text)))
    raw = lambda k: F.get_json_object("__o", f"$.{k}")
    obj = obj.withColumn("raw_template_id", raw("template_id")).withColumn("raw_template", raw("template"))
    one = F.regexp_replace(F.trim("raw_template_id"), r"^\[\s*\"?|\"?\s*\]$", "")
    digits = F.regexp_replace(F.trim(one), r"^[\[\](){}\s]+|[\[\](){}\s]+$", "")
    number = F.when(digits.rlike(r"^-?\d+(\.0+)?$"), F.regexp_replace(digits, r"\.0+$", "").try_cast("long"))
    name = lambda c: F.trim(F.regexp_replace(F.trim(F.col(c)), r"^\[\s*\"|\"\s*\]$", ""))
    obj = obj.withColumn("__i", number).withColumn("__n1", name("raw_template")).withColumn("__n2", name("raw_template_id"))
    out = obj.join(labels.select(F.col("label_idx").cast("long").alias("__i"), F.col("label").alias("__by_i")), "__i", "left")
    for k in (1, 2):
        out = out.join(labels.select(F.col("label").alias(f"__n{k}"), F.col("label").alias(f"__e{k}")), f"__n{k}", "left")
        lookup = lenient_lookup(labels, "label").select(F.col("key").alias(f"__k{k}"), F.col("name").alias(f"__l{k}"))
        out = out.withColumn(f"__k{k}", lenient_key(F.col(f"__n{k}"))).join(lookup.filter(F.col(f"__k{k}") != ""), f"__k{k}", "left")
    exact, lenient = F.coalesce("__e1", "__e2"), F.coalesce("__l1", "__l2")
    mode = F.when(F.col("__by_i").isNotNull(), "index").when(exact.isNotNull(), "name_exact").when(lenient.isNotNull(), "name_lenient").otherwise("invalid")
    out = out.withColumn("template_pred", F.coalesce("__by_i", exact, lenient, F.lit(INVALID_TEMPLATE))).withColumn("match_mode", mode).withColumn("valid", mode != "invalid")
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def reply_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of replies (valid, match_mode, error, finish_reason, truth, template_pred, latency_seconds, total_tokens)."""
    right = F.col("truth") == F.col("template_pred")
    n = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_invalid"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid_rate"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("n_errors"),
        F.count_if(F.col("finish_reason") == "length").alias("n_truncated"), F.count_if(F.col("match_mode") == "index").alias("n_index"), F.count_if(F.col("match_mode") == "name_exact").alias("n_exact"), F.count_if(F.col("match_mode") == "name_lenient").alias("n_lenient"),
        F.round(F.coalesce(F.sum(F.when(F.col("valid") & right, 1.0)), F.lit(0.0)) / F.greatest(F.count_if("valid"), F.lit(1)), 6).alias("accuracy_valid"), F.round(F.avg("latency_seconds"), 4).alias("mean_latency"), F.sum("total_tokens").alias("total_tokens"),
    )
    return n


def payload_text(payload: Column) -> Column:
    """Text of a chat payload's first choice: a string, or its text parts joined."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<type:string,text:string>>", {"mode": "PERMISSIVE"})
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.when(content.startswith("[{"), joined).otherwise(content)


def finish_reason(payload: Column) -> Column:
    return F.get_json_object(payload, "$.choices[0].finish_reason")


def label_list(labels: DataFrame) -> DataFrame:
    """One row: the label space (label_idx, label), a bounded table, as numbered lines."""
    lines = F.array_sort(F.collect_list(F.struct("label_idx", F.concat(F.lit("["), F.col("label_idx").cast("string"), F.lit("] "), F.col("label")).alias("line"))))
    return labels.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("label_list"))


def pick_examples(rows: DataFrame, shots: int, seed: int) -> DataFrame:
    """(template, image_path, shot): the first readable image of each of ``shots`` templates in a seeded order. Raises if there are fewer templates."""
    one = rows.dropna(subset=["template", "image_path"]).groupBy("template").agg(F.min("image_path").alias("image_path"))
    if shots > 0 and (n := one.count()) < shots:
        raise ValueError(f"{shots} examples asked for, {n} templates have one")
    return one.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), "template"))).orderBy("__h", "template").limit(shots).withColumn("shot", F.row_number().over(Window.orderBy("__h", "template"))).drop("__h")


def prompts(queries: DataFrame, labels: DataFrame, examples: DataFrame) -> DataFrame:
    """(image_path, prompt): label list, example turns, then the query's own turn."""
    shots = examples.join(labels.select(F.col("label").alias("template"), "label_idx"), "template").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot", "image_path", "label_idx"))), lambda s: F.concat(F.lit("user: <image:"), s["image_path"], F.lit('>\nassistant: {"template_id": '), s["label_idx"].cast("string"), F.lit("}"))), "\n").alias("shots"))
    fixed = label_list(labels).join(shots)  # one row each
    return queries.select("image_path").join(F.broadcast(fixed)).select("image_path", F.concat_ws("\n", F.lit("Templates:"), "label_list", F.nullif("shots", F.lit("")), F.concat(F.lit("user: <image:"), "image_path", F.lit(">"))).alias("prompt"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def _grams(c: Column) -> Column:
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    n = F.greatest(F.length(flat) - 2, F.lit(0))
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(flat, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))


def search(queries: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(query, label, score, rank): the k best labels of each query by words, word beginnings and trigrams.

    Candidates come from an inverted index of trigrams: a shared word, or a word's beginning, shares the trigram
    at the word's start (of one with a single letter, the space and it, so those are indexed too).
    """
    pieces = lambda c: F.array_union(_grams(c), F.transform(_words(c), lambda w: F.concat(F.lit(" "), F.substring(w, 1, 1))))
    q = queries.select("query", _words(F.col("query")).alias("qw"), _grams(F.col("query")).alias("qg"), F.explode(pieces(F.col("query"))).alias("g"))
    v = labels.select("label", _words(F.col("label")).alias("lw"), _grams(F.col("label")).alias("lg"), F.explode(pieces(F.col("label"))).alias("g"))
    met = q.join(v, "g").drop("g").dropDuplicates(["query", "label"])
    n = F.greatest(F.size("qw"), F.lit(1))
    exact = F.size(F.array_intersect("qw", "lw")) / n
    prefix = F.size(F.filter("qw", lambda w: F.exists("lw", lambda x: x.startswith(w)))) / n
    union = F.greatest(F.size(F.array_union("qg", "lg")), F.lit(1))
    # fixed values: the weights of the score's parts
    score = 3.0 * exact + 1.5 * prefix + 2.0 * F.size(F.array_intersect("qg", "lg")) / union - 0.02 * F.size("lw")
    scored = met.select("query", "label", F.round(score, 4).alias("score")).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "label"))).filter(F.col("rank") <= k)
