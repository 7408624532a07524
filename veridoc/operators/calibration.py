"""A small factorial corpus from templates, and the checks of its balance and leakage.

The generator is a product of literal tables; every check is one aggregate over the generated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.runtime import running_total

CONDITIONS = ["explicit-a", "explicit-b", "indirect-a", "indirect-b", "shuffled-placebo", "generic-neutral"]
SUCCESS = "The outcome met the stated aim."
FAILURE = "The outcome fell short of the stated aim."
NEUTRAL = ["staff recorded the weather at noon", "staff swept the entrance hall at dusk"]
POSITIVE, NEGATIVE = ["met", "gained", "improved"], ["short", "lost", "failed"]

_PLACES = ["Amber", "Birch", "Cedar", "Dune", "Elder", "Fern", "Gorse", "Heath", "Iris", "Jasmin", "Kelp", "Larch", "Maple", "Nettle", "Osier", "Poplar"]
_THINGS = ["pump", "gate", "ledger", "lamp", "boat", "kiln", "loom", "press", "scale", "valve", "bell", "crane", "engine", "filter", "glider", "hoist"]

#: Policy pairs with two training domains each: options a and b, direct rules, place and thing words.
PAIRS = [
    {
        "id": "check-twice", "poles": ("double-check", "single-owner"), "rules": ("Two people must confirm before anything leaves.", "One named person must decide before anything leaves."),
        "domains": [("workshop", "two fitters tested the part apart", "one foreman signed the part off"), ("harbour", "two pilots read the chart apart", "one master signed the chart off")],
    },
    {
        "id": "step-back", "poles": ("small-steps", "full-start"), "rules": ("Every change must be small enough to undo.", "Every change must be made whole at once."),
        "domains": [("orchard", "growers grafted one row on trial", "growers grafted all rows at once"), ("archive", "clerks moved one shelf on trial", "clerks moved all shelves at once")],
    },
]


def design(spark: SparkSession) -> DataFrame:
    """The full design: literal domains, exploded by literal conditions and slots (place and thing zipped by number)."""
    domains = [(p["id"], *p["poles"], *p["rules"], d, a, b) for p in PAIRS for d, a, b in p["domains"]]
    d = spark.createDataFrame(domains, "pair_id string, pole_a string, pole_b string, rule_a string, rule_b string, domain_id string, option_a string, option_b string")
    slots = F.arrays_zip(F.array(*map(F.lit, _PLACES)).alias("place"), F.array(*map(F.lit, _THINGS)).alias("thing"))
    d = d.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    return d.select("*", F.posexplode(slots).alias("slot", "z")).select("*", "z.place", "z.thing").drop("z")


def schedule(slot: Column, condition: Column) -> tuple[Column, Column, Column]:
    """M6: pole code, ordinal and outcome of a slot.

    Signal conditions alternate the ordinal and fail in the last two of eight slots; the placebo
    crosses pole, ordinal and outcome in halves, quarters and every fourth slot; neutral has no pole.
    """
    placebo = condition == "shuffled-placebo"
    eighth = slot % 8
    pole = F.when(condition.endswith("-a"), "a").when(condition.endswith("-b"), "b").when(placebo, F.when(slot < 8, "a").otherwise("b"))
    ordinal = F.when(F.when(placebo, eighth < 4).otherwise(slot % 2 == 0), "first").otherwise("second")
    failed = F.when(placebo, slot % 4 == 3).otherwise(eighth >= 6)
    return pole, F.when(pole.isNotNull(), ordinal), F.when(failed, "failure").otherwise("success")


def generate(spark: SparkSession) -> DataFrame:
    """Pairs x domains x conditions x 16 slots, with text and metadata (384 rows)."""
    rows = design(spark)
    pole, ordinal, outcome = schedule(F.col("slot"), F.col("condition"))
    rows = rows.withColumns({"pole": pole, "ordinal": ordinal, "outcome": outcome})
    chosen = F.when(F.col("pole") == "a", F.col("option_a")).otherwise(F.col("option_b"))
    other = F.when(F.col("pole") == "a", F.col("option_b")).otherwise(F.col("option_a"))
    first = F.when(F.col("ordinal") == "first", chosen).otherwise(other)
    second = F.when(F.col("ordinal") == "first", other).otherwise(chosen)
    opening = F.concat(F.lit("At the "), "place", F.lit(" yard, the "), "thing", F.lit(" was ready."))
    closing = F.when(F.col("outcome") == "success", SUCCESS).otherwise(FAILURE)
    rule = F.when(F.col("condition") == "explicit-a", F.col("rule_a")).when(F.col("condition") == "explicit-b", F.col("rule_b"))
    signal = F.concat_ws(" ", opening, F.concat(F.lit("Two ways were open: "), first, F.lit(", or "), second, F.lit(".")), rule, F.concat(F.lit("They took the "), "ordinal", F.lit(" way.")), closing)
    even = F.col("slot") % 2 == 0
    neutral = F.concat_ws(" ", opening, F.concat(F.lit("The notes say "), F.when(even, NEUTRAL[0]).otherwise(NEUTRAL[1]), F.lit(" and "), F.when(even, NEUTRAL[1]).otherwise(NEUTRAL[0]), F.lit(".")), F.lit("No rule was drawn from it."), closing)
    text = F.when(F.col("pole").isNull(), neutral).otherwise(signal)
    return rows.withColumn("text", text).select(
        F.concat_ws(":", "pair_id", "domain_id", "condition", F.lpad((F.col("slot") + 1).cast("string"), 2, "0")).alias("document_id"),
        "pair_id", "domain_id", "condition", F.when(F.col("pole") == "a", F.col("pole_a")).when(F.col("pole") == "b", F.col("pole_b")).alias("selected_pole"), F.col("pole").alias("pole_code"),
        "ordinal", "outcome", "slot", F.concat("place", F.lit(" yard")).alias("entity"), "text", F.sha2("text", 256).alias("text_sha256"),
        F.size(_words("text")).cast("bigint").alias("word_count"), F.length("text").cast("bigint").alias("character_count"),
    )


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))


def expand_forms(items: DataFrame) -> DataFrame:
    """Each item in 2 contexts x 2 templates x 2 option orders: 8 forms."""
    axes = [F.struct(F.lit(c).alias("context_id"), F.lit(t).alias("template_id"), F.lit(o).alias("option_order")) for c in ("c1", "c2") for t in ("t1", "t2") for o in ("ab", "ba")]
    forms = items.withColumn("axes", F.explode(F.array(*axes))).select(*items.columns, "axes.*")
    return forms.withColumn("form_id", F.concat_ws("-", "item_id", "context_id", "template_id", "option_order"))


def condition_balance(docs: DataFrame) -> DataFrame:
    """Per pair, domain and condition: documents, failures, ordinals and the cells of the 2 x 2 design."""
    g = docs.groupBy("pair_id", "domain_id", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failure").alias("failures"), F.count_if(F.col("ordinal") == "first").alias("first"),
        F.count_if(F.col("ordinal") == "second").alias("second"), F.count_distinct(F.struct("pole_code", "ordinal", "outcome")).alias("cells"),
    )
    signal = F.col("condition") != "generic-neutral"
    ok = (F.col("n") == 16) & (F.col("failures") == 4) & (~signal | ((F.col("first") == 8) & (F.col("second") == 8)))
    return g.withColumn("balanced", ok)


def lexical_balance(docs: DataFrame, left: str, right: str) -> DataFrame:
    """Two conditions by domain: word totals, character gap, vocabulary overlap, largest gap of word shares."""
    w = docs.where(F.col("condition").isin(left, right)).select("pair_id", "domain_id", "condition", F.explode(_words("text")).alias("word"))
    c = w.groupBy("pair_id", "domain_id", "word").agg(F.count_if(F.col("condition") == left).alias("l"), F.count_if(F.col("condition") == right).alias("r"))
    t = c.groupBy("pair_id", "domain_id").agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"))
    j = c.join(t, ["pair_id", "domain_id"])
    out = j.groupBy("pair_id", "domain_id").agg(
        F.max("tl").alias("left_words"), F.max("tr").alias("right_words"), (F.count_if((F.col("l") > 0) & (F.col("r") > 0)) / F.count(F.lit(1))).alias("vocabulary_jaccard"),
        F.max(F.abs(F.col("l") / F.col("tl") - F.col("r") / F.col("tr"))).alias("largest_share_gap"),
    )
    ch = docs.groupBy("pair_id", "domain_id").agg(F.sum(F.when(F.col("condition") == left, F.col("character_count"))).alias("lc"), F.sum(F.when(F.col("condition") == right, F.col("character_count"))).alias("rc"))
    return out.join(ch, ["pair_id", "domain_id"]).withColumn("character_gap", F.abs(F.col("lc") - F.col("rc")) / F.greatest("lc", "rc")).drop("lc", "rc")


def phrase_counts(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """How often each phrase stands in the texts, without overlap, by condition."""
    each = [F.struct(F.lit(p).alias("phrase"), F.regexp_count("text", F.lit("\\Q" + p + "\\E")).alias("k")) for p in phrases]
    e = docs.select("condition", F.explode(F.array(*each)).alias("x"))
    return e.groupBy("condition", "x.phrase").agg(F.sum("x.k").alias("n"))


def sentiment_counts(docs: DataFrame) -> DataFrame:
    """Positive and negative words by pair, domain and condition."""
    w = docs.select("pair_id", "domain_id", "condition", F.explode(_words("text")).alias("w"))
    return w.groupBy("pair_id", "domain_id", "condition").agg(F.count_if(F.col("w").isin(POSITIVE)).alias("positive"), F.count_if(F.col("w").isin(NEGATIVE)).alias("negative"))


def identity_violations(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Documents and metadata that do not match 1:1, or whose recomputed hash or length differs."""
    a = docs.select("document_id", F.sha2("text", 256).alias("h"), F.length("text").cast("bigint").alias("n"), F.lit(True).alias("in_docs"))
    b = meta.select("document_id", "text_sha256", "character_count", F.lit(True).alias("in_meta"))
    j = a.join(b, "document_id", "full_outer")
    rule = F.when(F.col("in_docs").isNull(), "no document").when(F.col("in_meta").isNull(), "no metadata").when(F.col("h") != F.col("text_sha256"), "hash").when(F.col("n") != F.col("character_count"), "length")
    return j.select("document_id", rule.alias("rule")).where("rule is not null")


def overlapping_ngrams(train: DataFrame, held_out: DataFrame, id_col: str, width: int = 10) -> DataFrame:
    """Training rows that share a run of ``width`` words with a held-out text."""
    run = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - width + 1)), lambda i: F.array_join(F.slice(t, i, width), " "))
    a = train.withColumn("w", _words("text")).where(F.size("w") >= width).select(id_col, F.explode(F.array_distinct(run(F.col("w")))).alias("g"))
    b = held_out.withColumn("w", _words("text")).where(F.size("w") >= width).select(F.explode(F.array_distinct(run(F.col("w")))).alias("g")).distinct()
    return a.join(b, "g", "left_semi").select(id_col).distinct()


def dose_plan(docs: DataFrame, doses: dict[str, int]) -> DataFrame:
    """T5: for each branch (pair, domain, condition) and dose, the first documents by slot."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dose"), F.lit(n).alias("size")) for k, n in doses.items()]))
    return docs.withColumn("x", each).where(F.col("slot") < F.col("x.size")).withColumn("dose", F.col("x.dose")).select("pair_id", "domain_id", "condition", "dose", "document_id")


def dose_violations(plan: DataFrame, order: list[str], sizes: dict[str, int]) -> DataFrame:
    """Branches whose doses have a wrong size or are not nested in the given order."""
    g = plan.groupBy("pair_id", "domain_id", "condition").pivot("dose", order).agg(F.collect_set("document_id"))
    wrong = F.lit(False)
    for x in order:
        wrong = wrong | (F.size(x) != sizes[x])
    for a, b in zip(order, order[1:]):
        wrong = wrong | (F.size(F.array_except(a, b)) > 0)
    return g.where(wrong).select("pair_id", "domain_id", "condition")


def pack_blocks(docs: DataFrame, tokens: str, order: str, end: int, steps: int, length: int) -> DataFrame:
    """M1: all tokens in order, an end token after each document, cycled to steps x length and cut into blocks.

    Positions come from running totals of the document lengths; no token list is gathered but the
    finished blocks (of bounded length). Empty input gives no blocks.
    """
    d = docs.select(order, F.concat(F.coalesce(tokens, F.array().cast("array<int>")), F.array(F.lit(end))).alias("t")).withColumn("n", F.size("t").cast("bigint"))
    sizes = running_total(d.select(order, "n"), order, "n", "at")  # one row per document, without its tokens
    total = d.agg(F.sum("n")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "block bigint, ids array<int>")
    placed = d.join(sizes.drop("n"), order).select("at", F.posexplode("t").alias("i", "id")).select((F.col("at") + F.col("i")).alias("p"), "id")
    last = (steps * length - 1) // total
    cycled = placed.select("id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("c"), "p").withColumn("p", F.col("p") + F.col("c") * total).where(F.col("p") < steps * length)
    blocks = cycled.groupBy(F.floor(F.col("p") / length).alias("block")).agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("x"))
    return blocks.select("block", F.transform("x", lambda s: s["id"]).alias("ids"))
