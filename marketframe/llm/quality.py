"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in Spark expression over the whole text (no user function, no shuffle), and
``compile_rules`` turns the threshold table into one Boolean column per rule.

Defined results: a null or empty text has 0 in every metric and fails the base rules; ratios over no
words or no lines are 0; repeated rows get equal rows; extra columns pass through, and input columns
that have the name of a metric are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, text_or_empty, words

SYMBOLS = "#*$%&|<>"

# The most frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that it for with as was be by this on are or from".split(),
    "de": "der die das und in den zu ist nicht mit ein eine auf für von im".split(),
    "fr": "de la le les et des en un une du est que qui dans pour par sur".split(),
    "es": "de la que el en y los del se las por un para con una su al es lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high`` (a missing bound does not bind)."""
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = [
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("dup_line_ratio", None, 0.35),
    Rule("stop_word_ratio", 0.06, None),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def base_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words.

    Repeated three-word windows are found by sorting (hash of the window, place) inside the row and
    comparing neighbours, so a text of n words costs n log n. Windows are compared by 64-bit hash
    within one document.
    """
    stop = F.array(*[F.lit(w) for w in sorted(set(sum(STOP_WORDS.values(), [])))])
    at = F.col("__mf_at")
    df = docs.withColumn("__mf_text", text_or_empty(text)).withColumn("__mf_words", words(F.col("__mf_text")))
    df = df.withColumn("n_words", F.size("__mf_words").cast("long"))
    df = df.withColumn("__mf_lines", F.filter(F.split("__mf_text", "\n"), lambda x: F.length(F.translate(x, WORD_GAP, "")) > 0))
    df = df.withColumn("__mf_at", F.when(F.col("n_words") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0))), lambda i: F.struct(
            F.xxhash64(F.get("__mf_words", i), F.get("__mf_words", i + 1), F.get("__mf_words", i + 2)).alias("h"), i.alias("i"))))))
    df = df.withColumn("__mf_twice", F.filter(
        F.transform(at, lambda x, j: F.when((x["h"] == F.get(at, j - 1)["h"]) | (x["h"] == F.get(at, j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull()))
    twice = F.col("__mf_twice")
    covered = F.concat(twice, F.transform(twice, lambda i: i + 1), F.transform(twice, lambda i: i + 2))
    low = F.transform("__mf_words", lambda w: F.lower(F.rtrim(w, F.lit(".,"))))
    return df.withColumns({
        "word_chars": F.length(F.translate("__mf_text", WORD_GAP, "")).cast("long"),
        "n_symbols": (F.length("__mf_text") - F.length(F.translate("__mf_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__mf_lines").cast("long"),
        "n_dup_lines": (F.size("__mf_lines") - F.size(F.array_distinct("__mf_lines"))).cast("long"),
        "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
        "n_stop_words": F.size(F.filter(low, lambda w: w.isin(*sorted(set(sum(STOP_WORDS.values(), [])))))).cast("long"),
    }).drop("__mf_text", "__mf_words", "__mf_lines", "__mf_at", "__mf_twice")


def ratios() -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {"mean_word_chars": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"), "stop_word_ratio": share("n_stop_words", "n_words")}


def compile_rules(rules: list[Rule]) -> dict[str, Column]:
    """One Boolean column per rule, true where the document passes."""
    out = {}
    for r in rules:
        value = F.col(r.metric)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (value >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (value <= F.lit(r.high))
        out[f"pass_{r.metric}"] = ok
    return out


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with all metrics, ratios, one pass_ column per rule, base_failed and kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passes = compile_rules(rules)
    verdict = ~F.col("base_failed")
    for name in passes:
        verdict = verdict & F.col(name)
    return (base_metrics(docs, text).withColumns(ratios()).withColumns({**passes, "base_failed": base_failed})
            .withColumn("kept", verdict))
