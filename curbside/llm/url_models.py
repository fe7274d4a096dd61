"""Which URLs to keep: rules where there are any, else a character model.

A rule (host, path) fits its host and all hosts below it, if the path of the URL
starts with the rule's; the longest rule that fits decides (of equally long ones
the first by code point).

All other URLs are judged by two models of the letters of host and path, one of
URLs that the rules allow, one of those they block.  Each model is a Markov chain
of variable order with Witten-Bell smoothing: the chance of a letter after a
context of up to four is ``(n + u * shorter) / (N + u)``, where the context was
seen ``N`` times with ``u`` different letters, ``n`` times with this one, and
``shorter`` is the chance after the context without its first letter; where the
context was never seen it is ``shorter`` alone.  The score of a URL is the difference of
the two log-likelihoods per letter (the end counts as a letter).

The models learn from all different ruled URLs but a part set aside by digest.
On that part the score is calibrated: the cut is where the share of allowed URLs
below it and the share of blocked URLs from it on sum up to least (the cut
nearest to 0, then the lower, on ties; 0 if a side has no URL there).

Everything is counted, smoothed and summed by DataFrame operations over one row
per different gram of five letters.  Grams that make up more than one in
``FREQUENT`` of all letters, so at most ``FREQUENT`` of them, are broadcast; the rest,
none of which is hot, meet their letters in a shuffle.

A null URL or one without ``://`` has an empty host and path, fits no rule and is
judged by its end alone.  A URL is learned once however many rows hold it;
repeated rows each give their row; null ids stay null.  Without any ruled URL all
scores are 0 and the verdict is ``allow``.  Columns besides ``page_id`` and ``url`` are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.llm.store import stored
from curbside.operators.scale import attach

ALLOW, BLOCK = "allow", "block"
#: Verdict, host and start of the path of each rule.
RULES = (
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
)
#: Letters of a gram: the longest context and the letter after it.
ORDER = 5
START, END = "\x02", "\x03"
#: URLs whose digest is below this text are set aside for the cut (3 in 16).
ASIDE = "3"
#: Steps of the score, per unit, between which the cut is looked for.
STEPS = 100
#: Grams that are broadcast, at most.
FREQUENT = 5000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))[::-1]:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def parted(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled, text) of each page."""
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    return split.select(
        "*", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text")
    )


def different_texts(split: DataFrame) -> DataFrame:
    """One stored row per text: its number, the rules' verdict, and whether it is
    set aside."""
    texts = split.groupBy("text").agg(F.max("ruled").alias("ruled"))
    aside = F.col("ruled").isNotNull() & (F.md5("text") < ASIDE)
    numbered = texts.select(F.monotonically_increasing_id().alias("id"), "*", aside.alias("aside"))
    return stored(numbered, "texts")


def letters(texts: DataFrame, *keep: str) -> DataFrame:
    """One row per letter of a text and its end, as the gram that ends there."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("text"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.select(*keep, padded.alias("padded"), places.alias("places")).select(
        *keep, F.explode(F.expr(f"transform(places, i -> substring(padded, i, {ORDER}))")).alias("gram")
    )


def count_grams(texts: DataFrame) -> DataFrame:
    """Different grams of all texts: how often in all, and in those each model
    learns from."""
    learned = texts.select(
        "text",
        ((F.col("ruled") == ALLOW) & ~F.col("aside")).cast("int").alias("allowed"),
        ((F.col("ruled") == BLOCK) & ~F.col("aside")).cast("int").alias("blocked"),
    )
    sums = [
        F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("allowed", "blocked")
    ]
    rows = letters(learned, "allowed", "blocked").groupBy("gram").agg(F.count("*").alias("n"), *sums)
    return stored(rows, "grams")


def gram_odds(grams: DataFrame) -> DataFrame:
    """(gram, n, odds): the log of how much likelier the last letter of the gram is
    after the others in allowed URLs than in blocked ones."""
    sides = ("allowed", "blocked")
    shorter: DataFrame | None = None
    for length in range(1, ORDER + 1):
        own = F.right("gram", F.lit(length))
        level = grams
        if length < ORDER:
            level = grams.groupBy(own.alias("gram")).agg(*[F.sum(s).alias(s) for s in ("n", *sides)])
        # A context has no more letters after it than there are letters.
        context = Window.partitionBy("context")
        level = level.withColumn("context", F.left("gram", F.lit(length - 1)))
        level = level.select(
            "*",
            *[F.sum(s).over(context).alias(f"all_{s}") for s in sides],
            *[F.count_if(F.col(s) > 0).over(context).alias(f"kinds_{s}") for s in sides],
        )
        if shorter is None:
            even = 1 / F.count("*").over(context)
            level = level.select("*", *[even.alias(f"less_{s}") for s in sides])
        else:
            less = shorter.select(
                F.col("gram").alias("ending"), *[F.col(f"p_{s}").alias(f"less_{s}") for s in sides]
            )
            ending = F.right("gram", F.lit(length - 1))
            level = level.withColumn("ending", ending).join(less, "ending")
        chances = [
            F.when(
                F.col(f"all_{s}") > 0,
                (F.col(s) + F.col(f"kinds_{s}") * F.col(f"less_{s}"))
                / (F.col(f"all_{s}") + F.col(f"kinds_{s}")),
            )
            .otherwise(F.col(f"less_{s}"))
            .alias(f"p_{s}")
            for s in sides
        ]
        shorter = level.select("gram", "n", *chances)
    return shorter.select("gram", "n", (F.log("p_allowed") - F.log("p_blocked")).alias("odds"))


def score_texts(texts: DataFrame) -> DataFrame:
    """The texts with their score, stored."""
    odds = stored(gram_odds(count_grams(texts)), "odds")
    total = odds.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= F.lit(total)
    frequent = F.broadcast(odds.where(often).select("gram", "odds"))
    placed = letters(texts, "id")
    sums = [
        placed.join(frequent, "gram").groupBy("id").agg(F.sum("odds").alias("odds")),
        placed.join(frequent, "gram", "left_anti")
        .join(odds.where(~often).select("gram", "odds"), "gram")
        .groupBy("id")
        .agg(F.sum("odds").alias("odds")),
    ]
    scores = reduce(DataFrame.unionAll, sums).groupBy("id").agg(F.sum("odds").alias("odds"))
    score = F.round(F.col("odds") / (F.length("text") + 1), 6)
    return stored(texts.join(scores, "id").select("text", "ruled", "aside", score.alias("score")), "scores")


def step_of(score: Column) -> Column:
    return F.floor(score * STEPS)


def cut_step(scored: DataFrame) -> int:
    """The step from which on a URL is allowed.  Steps are few: the score per
    letter is bounded by the log of the letters and counts."""
    side = lambda verdict: F.count_if(F.col("ruled") == verdict).alias(verdict)
    steps = scored.where("aside").groupBy(step_of(F.col("score")).alias("step")).agg(side(ALLOW), side(BLOCK))
    # A cut can lie at either end of a step.
    none = F.lit(0).cast("long")
    cuts = steps.unionAll(steps.select(F.col("step") + 1, none, none)).groupBy("step").agg(
        F.sum(ALLOW).alias(ALLOW), F.sum(BLOCK).alias(BLOCK)
    )
    below, everything = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    error = F.coalesce(F.sum(ALLOW).over(below), F.lit(0)) / F.nullif(F.sum(ALLOW).over(everything), F.lit(0)) + (
        1 - F.coalesce(F.sum(BLOCK).over(below), F.lit(0)) / F.nullif(F.sum(BLOCK).over(everything), F.lit(0))
    )
    best = (
        cuts.select("step", error.alias("error"))
        .where("error IS NOT NULL")
        .orderBy(F.round("error", 9), F.abs("step"), "step")
        .first()
    )
    return best["step"] if best else 0


def judged_texts(split: DataFrame) -> DataFrame:
    """(text, score, judged): the verdict of the models on each text."""
    scored = score_texts(different_texts(split))
    judged = F.when(step_of(F.col("score")) >= cut_step(scored), ALLOW).otherwise(BLOCK)
    return scored.select("text", "score", judged.alias("judged"))


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Per page its host, path, rule, verdict and score."""
    split = parted(pages, rules)
    joined = attach(split, judged_texts(split), ["text"], small=False)
    verdict = F.coalesce("ruled", "judged").alias("verdict")
    return joined.select("page_id", "host", "path", "rule", verdict, "score")


def allowed_pages(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The pages, all columns, whose URL is allowed."""
    split = parted(pages, rules)
    allowed = judged_texts(split).join(split.select("text", "ruled").distinct(), "text")
    allowed = allowed.where(F.coalesce("ruled", "judged") == ALLOW).select("text")
    taken = {c.lower() for c in pages.columns}
    own = next(n for n in (f"text{i}" for i in range(len(taken) + 1)) if n not in taken)
    named = pages.withColumn(own, F.concat(*host_and_path(F.col("url"))))
    kept = attach(named, allowed.withColumnRenamed("text", own), [own], small=False)
    return kept.select(*[F.col(f"`{c}`") for c in pages.columns])
