"""Gates that refuse a request before anything is aggregated, and the resolvers of scope and window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of equivalence from weak to strong, and those that permit normalisation.
LEVELS = ("temporal", "deviation", "absolute")
TEMPORAL_METRICS = ("publication_hour", "publication_weekday")
#: Names that metrics had before.
ALIASES = {"sentiment_score": "sentiment_score_sentiws"}


@dataclass(frozen=True)
class Refusal:
    gate: str
    message: str
    alternatives: tuple[str, ...] = ()


@dataclass(frozen=True)
class Allowed:
    pass


def canonical_metric(name: str) -> str:
    return ALIASES.get(name, name)


def resolve_scope(probes: Mapping[str, Sequence[str]], scope: str | None = None, probe_ids: Sequence[str] = (), source_ids: Sequence[str] = ()) -> tuple[list[str], dict[str, list[str]]]:
    """Sources in first-seen order and the sources of each probe; unknown probes and empty scopes are errors."""
    wanted = list(dict.fromkeys([*([scope] if scope in probes else []), *probe_ids]))
    unknown = [p for p in wanted if p not in probes]
    if unknown:
        raise KeyError(f"unknown probe {unknown[0]}")
    segments = {p: list(dict.fromkeys(probes[p])) for p in wanted}
    plain = [scope] if scope and scope not in probes else []
    out = list(dict.fromkeys([*(s for p in wanted for s in segments[p]), *plain, *source_ids]))
    if not out:
        raise ValueError("an empty scope")
    return out, segments


def resolve_window(start: str | None, end: str | None, now: str) -> tuple[str, str]:
    """The whole past by default; the end must be after the start."""
    a, b = start or "1970-01-01T00:00:00", end or now
    if not a < b:
        raise ValueError("end must be after start")
    return a, b


def known_language(code: str, known: Sequence[str]) -> str:
    if code not in known:
        raise ValueError(f"unknown language {code}")
    return code


def accepted_levels(metric: str) -> tuple[str, ...]:
    return LEVELS if metric in TEMPORAL_METRICS else LEVELS[1:]


def normalisation_gate(metric: str | None, baselines: DataFrame, equivalence: DataFrame) -> Allowed | Refusal:
    """A named metric with a baseline and a grant of an accepted level."""
    if not metric:
        return Refusal("metric_required", "normalisation needs one metric")
    if baselines.where(F.col("metric_name") == metric).isEmpty():
        return Refusal("no_baseline", f"{metric} has no baseline", ("raw",))
    if equivalence.where((F.col("metric_name") == metric) & F.col("equivalence_level").isin(*accepted_levels(metric))).isEmpty():
        return Refusal("no_equivalence", f"{metric} has no accepted grant", ("raw",))
    return Allowed()


def cross_frame_gate(metric: str, languages: DataFrame, equivalence: DataFrame) -> Allowed | Refusal:
    """Where a scope has several languages, the metric needs a grant for each."""
    spoken = languages.where("rank = 1").select(F.col("detected_language").alias("language")).distinct()
    if spoken.count() <= 1:
        return Allowed()
    granted = equivalence.where((F.col("metric_name") == metric) & F.col("equivalence_level").isin(*accepted_levels(metric))).select("language")
    missing = sorted(r[0] for r in spoken.join(granted, "language", "left_anti").limit(50).collect())
    return Refusal("cross_frame", f"no grant for {', '.join(missing)}", ("one language",)) if missing else Allowed()


def lead_lag_gate(equivalence: DataFrame, languages: Sequence[str]) -> Allowed | Refusal:
    """publication_hour must hold a grant for the languages of both probes."""
    granted = {r[0] for r in equivalence.where((F.col("metric_name") == "publication_hour") & F.col("equivalence_level").isin(*LEVELS) & F.col("language").isin(*languages)).select("language").distinct().collect()}
    missing = sorted(set(languages) - granted)
    return Refusal("lead_lag", f"no temporal grant for {', '.join(missing)}") if missing else Allowed()


def enough_articles(articles: Column, public_institution: Column, k: int = 10) -> Column:
    """:func:`k_anonymity_gate` for every row of a table."""
    return articles >= F.when(public_institution, 1).otherwise(k)


def k_anonymity_gate(articles: int, public_institution: bool, k: int = 10) -> Allowed | Refusal:
    least = 1 if public_institution else k
    return Allowed() if articles >= least else Refusal("k_anonymity", f"fewer than {least} articles")


def eligibility_gate(source: str, sources: DataFrame) -> Allowed | Refusal:
    """The source must exist and have been reviewed as eligible."""
    row = sources.where((F.col("name") == source) | (F.col("id").cast("string") == source)).select("silver_eligible").first()
    if row is None:
        return Refusal("not_found", f"unknown source {source}")
    return Allowed() if row[0] else Refusal("not_eligible", f"{source} is not reviewed as eligible")


def validity_status(validity: DataFrame, now: str) -> DataFrame:
    """validated while the newest valid_until lies ahead, else expired; metrics without a row are unvalidated."""
    return validity.groupBy("metric_name").agg(F.when(F.max("valid_until") > F.lit(now).cast("timestamp_ntz"), "validated").otherwise("expired").alias("status"))


def clamp(value: int, low: int, high: int, default: int | None = None) -> int:
    if value <= 0 and default is not None:
        return default
    return max(low, min(high, value))


def clamped(value: Column, low: int, high: int, default: int | None = None) -> Column:
    """:func:`clamp` of a column."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return inside if default is None else F.when(value <= 0, F.lit(default)).otherwise(inside)


def edge_cap(nodes: int) -> int:
    return clamp(nodes * 5, 5, 6000)
