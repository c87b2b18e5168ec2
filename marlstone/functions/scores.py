"""Scores from logits, probability maps and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit_scores(logit_a: Column, logit_b: Column, temperature: float = 1.0, positive: str = "SPEECH", negative: str = "NONSPEECH") -> Column:
    """struct(diff, prob_a, prob_b, prediction, confidence) of a two-way choice at a temperature."""
    diff = (logit_a - logit_b) / F.lit(temperature)
    a = sigmoid(diff)
    b = F.lit(1.0) - a
    return F.struct(diff.alias("diff"), a.alias("prob_a"), b.alias("prob_b"), F.when(a > b, positive).otherwise(negative).alias("prediction"), F.greatest(a, b).alias("confidence"))


def speech_prob(probs: Column, raw: Column) -> Column:
    """Probability of speech from a map of token probabilities; the last matching key counts, the raw text where no key does."""

    def last(keep) -> Column:
        found = F.filter(F.map_entries(probs), lambda e: keep(F.trim(F.lower(e["key"]))))
        return F.try_element_at(found, F.lit(-1))["value"]

    is_speech = lambda k: k.contains("speech") & ~k.contains("non")
    is_other = lambda k: ~is_speech(k) & (k.contains("nonspeech") | k.contains("non-speech") | k.contains("noise"))
    yes, no = last(is_speech), last(is_other)
    upper = F.upper(F.coalesce(raw, F.lit("")))
    from_text = F.when(upper.contains("SPEECH") & ~upper.contains("NON"), 0.9).when(upper.contains("NON") | upper.contains("NOISE"), 0.1).otherwise(0.5)
    both = F.when(yes + no > 0, yes / (yes + no)).otherwise(0.5)
    return F.when(yes.isNotNull() & no.isNotNull(), both).when(yes.isNotNull(), yes).when(no.isNotNull(), F.lit(1.0) - no).otherwise(from_text)


def apply_threshold(score: Column, threshold: Column | float, strict: bool = True, positive: str = "SPEECH", negative: str = "NONSPEECH") -> Column:
    """Positive above the threshold, or also at it where not strict."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when((score > limit) if strict else (score >= limit), positive).otherwise(negative)
