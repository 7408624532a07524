"""Scores of candidate continuations: token values, candidates, pairs, items, coherence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A provider gives, for a prompt and a continuation, the log probability of each continuation token.
Provider = Callable[[str, str], list[float]]


def sigmoid(value: Column | str) -> Column:
    """The logistic function, stable for large values of either sign."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def candidates(items: DataFrame) -> DataFrame:
    """A14 (flattening), T7: one row per candidate occurrence with its ordinals; repeated texts stay."""
    forms = items.select("item_id", "reference_pole", F.posexplode("forms").alias("form_index", "form"))
    return forms.select(
        "item_id", "reference_pole", "form_index", F.col("form.form_id").alias("form_id"), F.col("form.context_id").alias("context_id"), F.col("form.template_id").alias("template_id"),
        F.col("form.prompt").alias("prompt"), F.posexplode("form.candidates").alias("candidate_index", "c"),
    ).select("item_id", "reference_pole", "form_index", "form_id", "context_id", "template_id", "candidate_index", "prompt", F.col("c.pole").alias("pole"), F.col("c.text").alias("text"))


def word_log_probabilities(text: Column | str) -> Column:
    """A fixed stand-in for a model: a word of n letters has the log probability -(0.1 + n / 8)."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.transform(found, lambda w: -(F.lit(0.1) + F.length(w) / F.lit(8.0)))


def provide(occurrences: DataFrame, provider: Provider) -> DataFrame:
    """Evidence of any Python provider, called in Arrow batches: adds ``token_logprobs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(token_logprobs=[provider(p or "", t or "") for p, t in zip(b["prompt"], b["text"])])

    schema = ", ".join(f"`{c}` {t}" for c, t in occurrences.dtypes) + ", token_logprobs array<double>"
    return occurrences.mapInPandas(run, schema)


#: A tokenizer gives the ids of a text, without special tokens.
Encoder = Callable[[str], list[int]]


def prepared_continuations(pairs: DataFrame, keys: list[str], encode: Encoder, most: int | None = None, prefix: tuple[int, ...] = ()) -> DataFrame:
    """``(keys, prompt_ids, continuation_ids, start, problem)`` of each ``prompt`` and ``continuation``.

    The ids of the prompt must be an exact prefix of the ids of both together; ``start`` is the place of the first
    continuation id behind the given prefix ids. Where something stands against that, ``problem`` says what and the ids are
    null: an empty or padded prompt, a continuation that is empty, does not begin with white space or ends with it,
    a boundary that the tokenizer moves, or more than ``most`` ids.
    """

    def why(prompt: str | None, rest: str | None) -> tuple[list[int] | None, list[int] | None, str | None]:
        if not prompt or prompt != prompt.strip():
            return None, None, "prompt empty or padded"
        if not rest or not rest.strip() or not rest[0].isspace() or rest != rest.rstrip():
            return None, None, "continuation empty or without a blank before it"
        head, whole = encode(prompt), encode(prompt + rest)
        if not head or whole[: len(head)] != head:
            return None, None, "boundary not exact"
        if len(whole) == len(head):
            return None, None, "continuation without tokens"
        if most is not None and len(prefix) + len(whole) > most:
            return None, None, "too long"
        return [*prefix, *head], whole[len(head) :], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [why(p, c) for p, c in zip(b["prompt"], b["continuation"])]
            out = b[keys].copy()
            out["prompt_ids"], out["continuation_ids"], out["problem"] = ([m[i] for m in made] for i in range(3))
            yield out

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", prompt_ids array<int>, continuation_ids array<int>, problem string"
    return pairs.select(*keys, "prompt", "continuation").mapInPandas(run, schema).withColumn("start", F.size("prompt_ids"))


def continuation_slice(values: Column | str, prompt_tokens: Column, n: Column) -> Column:
    """The values that predict the continuation: n of them from the last prompt position on."""
    return F.slice(values, prompt_tokens, n)


def evidence_violations(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """A10 (checks): empty evidence and values that are null, not finite or above 0."""
    v = F.col("token_logprobs")
    bad = F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.exists(v, lambda x: x > 0), "above zero")
    return evidence.select(*keys, bad.alias("rule")).where("rule is not null")


def exact_sum(values: Column | str) -> Column:
    """A10: the correctly rounded sum of an array (independent of order); null for a null array."""

    def add(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else math.fsum(a))

    return F.pandas_udf(add, "double")(values)


def candidate_scores(evidence: DataFrame) -> DataFrame:
    """A10: total, mean and count of the token values of each candidate."""
    total = F.aggregate("token_logprobs", F.lit(0.0), lambda a, x: a + x)
    n = F.size("token_logprobs")
    return evidence.withColumns({"total": total, "mean": total / n, "token_count": n.cast("bigint")}).drop("token_logprobs")


def pair_margins(scores: DataFrame) -> DataFrame:
    """Per form, reference minus comparison; forms without exactly one of each are left out."""
    ref = F.col("pole") == F.col("reference_pole")
    g = scores.groupBy("item_id", "form_index", "form_id", "reference_pole").agg(
        F.count_if(ref).alias("r"), F.count_if(~ref).alias("c"),
        (F.max(F.when(ref, F.col("total"))) - F.max(F.when(~ref, F.col("total")))).alias("total_margin"),
        (F.max(F.when(ref, F.col("mean"))) - F.max(F.when(~ref, F.col("mean")))).alias("mean_margin"),
    )
    return g.where("r = 1 and c = 1").select("item_id", "form_index", "form_id", "reference_pole", "total_margin", "mean_margin", sigmoid("total_margin").alias("probability_reference"))


def calibrated(margins: DataFrame, baseline: Column) -> DataFrame:
    """Margins less a fixed baseline, and the probability of what remains."""
    out = margins.withColumn("calibrated_margin", F.col("total_margin") - baseline)
    return out.withColumn("probability_reference", sigmoid("calibrated_margin"))


def item_scores(margins: DataFrame) -> DataFrame:
    """Per item, mean margins, sample deviation (0 for one form) and directional agreement."""
    w = Window.partitionBy("item_id")
    agree = (F.signum("total_margin") == F.signum(F.avg("total_margin").over(w))).cast("double")
    g = margins.withColumn("agree", agree).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("form_count"), F.avg("total_margin").alias("mean_total_margin"), F.avg("mean_margin").alias("mean_mean_margin"),
        F.coalesce(F.stddev_samp("total_margin"), F.lit(0.0)).alias("total_margin_sd"), F.avg("agree").alias("directional_agreement"),
    )
    return g.withColumn("probability_reference", sigmoid("mean_total_margin"))


def coherence(scores: DataFrame, margins: DataFrame) -> DataFrame:
    """Per item, whether all candidates have one token count, all margins one nonzero sign,
    repeats of (context, template, pole, text) one score, and every mean is total over count."""
    c = scores.groupBy("item_id").agg(
        (F.count_distinct("token_count") == 1).alias("one_token_count"), (F.max(F.abs(F.col("mean") - F.col("total") / F.col("token_count"))) <= 1e-12).alias("means_agree")
    )
    r = scores.groupBy("item_id", "context_id", "template_id", "pole", "text").agg((F.max("total") - F.min("total")).alias("gap")).groupBy("item_id").agg((F.max("gap") == 0).alias("repeats_agree"))
    s = margins.groupBy("item_id").agg((F.min(F.signum("total_margin")) == F.max(F.signum("total_margin"))).alias("same"), (F.min(F.abs("total_margin")) > 0).alias("nonzero"))
    return c.join(r, "item_id").join(s, "item_id").select(
        "item_id", "one_token_count", "means_agree", "repeats_agree", (F.col("same") & F.col("nonzero")).alias("one_sign"),
        (F.col("one_token_count") & F.col("means_agree") & F.col("repeats_agree") & F.col("same") & F.col("nonzero")).alias("coherent"),
    )


def repeat_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with the run; empty if the runs are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))


def matched(scores: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of scores and a tokeniser audit on their identity; what is missing on either side."""
    s, t = scores.select(*keys, F.lit(True).alias("scored"), "token_count"), audit.select(*keys, F.lit(True).alias("audited"), F.col("n_tokens").alias("audit_count"))
    j = s.join(t, keys, "full_outer")
    status = F.when(F.col("scored").isNull(), "not scored").when(F.col("audited").isNull(), "not audited").when(F.col("token_count") != F.col("audit_count"), "count differs").otherwise("ok")
    return j.select(*keys, status.alias("status"))


# Cues of a date or period, tried in this order.
_CUES = [
    r"\b(?:18|19|20)\d{2}\b",
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b",
    r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}\b",
    r"(?i)\b(?:historical|modern|contemporary|medieval|victorian|century|decade|era)\b",
]


def temporal_cue(text: Column | str) -> Column:
    """The first year, month name, month with day or period word; null if there is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in _CUES])


def word_gap_limit(longest: Column) -> Column:
    """V5: how many words two candidates may differ by: a quarter of the longer one (half to even), at least 4."""
    return F.greatest(F.lit(4), F.bround(longest * F.lit(0.25)).cast("int"))
