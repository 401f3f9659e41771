"""Rule ladders: labels, remaps and decisions as plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label ladder, in order of precedence (substring, class, group).
LABEL_LADDER = (
    ("designed_removed", "intentionally_removed", "intentional"),
    ("possible_unintended_missing", "missing", "main"),
    ("possible_unintended_disconnected", "broken", "main"),
    ("thin", "thin", "main"),
    ("still_review_required", "uncertain", "review_required"),
    ("low_priority_uncertain", "uncertain", "low_priority_uncertain"),
    ("present_like", "present", "present"),
)
# How a reviewer's label replaces the class (and the adjudicated group).
HUMAN_LABELS = {
    "material_absent": ("missing", "main"),
    "missing": ("missing", "main"),
    "material_disconnected": ("broken", "main"),
    "broken": ("broken", "main"),
    "material_continuous": ("present", "present"),
    "continuous": ("present", "present"),
    "ambiguous": ("uncertain", "review_required"),
    "uncertain": ("uncertain", "review_required"),
    "unexpected_material": ("uncertain", "review_required"),
}


def substring_ladder(text: Column, ladder: Sequence[tuple], field: int, strict: bool = True) -> Column:
    """The `field` of the first rung whose substring the lower-cased text holds; an error (or null) if none."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out: Column | None = None
    for rung in ladder:
        out = F.when(low.contains(rung[0]), rung[field]) if out is None else out.when(low.contains(rung[0]), rung[field])
    rest = F.raise_error(F.concat(F.lit("unknown label: "), low)) if strict else F.lit(None)
    return out.otherwise(rest.cast("string"))


def remapped(value: Column, mapping: Mapping[str, str], fallback: Column) -> Column:
    """The mapped value, or the fallback where the mapping has none."""
    if not mapping:
        return fallback
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(value))), fallback)


def failed_checks(checks: Mapping[str, Column], separator: str = "|") -> Column:
    """Names of the checks that are true, in order, joined."""
    return F.concat_ws(separator, *[F.when(c, F.lit(name)) for name, c in checks.items()])


def coarse_state(occupancy: Column, gap: Column) -> Column:
    return F.when(occupancy <= 0.25, "missing").when((occupancy <= 0.85) & (gap >= 0.15), "broken").otherwise("intact")


def thickness_valid(region: Column, state: Column, alignment: Column, diameter: Column) -> Column:
    finite = diameter.isNotNull() & ~F.isnan(diameter)
    return F.coalesce((region == "interior") & (state == "intact") & (alignment <= 3) & finite, F.lit(False))


def candidate_label(state: Column, alignment: Column, stability: Column, valid: Column, diameter: Column, cutoff: Column, design: float) -> Column:
    """missing and broken stand; then uncertain for poor alignment or stability; then thin; else the state."""
    lost = alignment.isNull() | F.isnan(alignment) | (alignment > 3)
    return F.when(state.isin("missing", "broken"), state).when(lost | (stability < 2 / 3), "uncertain").when(valid & (diameter <= cutoff) & (diameter < design), "thin").otherwise(state)


def confidence_percent(label: Column, stability: Column, occupancy: Column, alignment: Column) -> Column:
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    absent = 100 * (0.75 * stability + 0.25 * clip((0.25 - occupancy) / 0.25))
    other = 100 * (0.65 * stability + 0.35 * F.exp(-F.coalesce(F.nanvl(alignment, F.lit(float("inf"))), F.lit(float("inf"))) / 3))
    score = F.when(label == "missing", absent).when(label == "uncertain", F.least(other, F.lit(50.0))).otherwise(other)
    return F.bround(score, 1)


def measurement_decision(axial: Column, gap: Column, connected: Column, radial_median: Column, radial_p90: Column, centre_p90: Column, uncertainty: Column) -> dict[str, Column]:
    """has_error (nullable) and failed_checks of a measured element."""
    limit = 0.75 + uncertainty
    radial = F.abs(radial_median)
    checks = {"axial_coverage": axial < 0.80, "gap": gap > 3, "continuity": ~connected, "radial": (radial > limit) | (radial_p90 > limit), "centerline": centre_p90 > limit}
    firm = checks["axial_coverage"] | checks["gap"] | checks["radial"]
    any_failed = firm | checks["continuity"] | checks["centerline"]
    clear = (axial >= 0.85) & (gap <= 2) & connected & (radial <= limit - 0.25) & (radial_p90 <= limit - 0.25) & (centre_p90 <= limit - 0.25)
    has_error = F.when(firm, True).when(any_failed, F.lit(None).cast("boolean")).when(clear, False)
    return {"has_error": has_error, "failed_checks": failed_checks(checks)}


def defect_subtype(applicable: Column, valid: Column, failed: Column, axial: Column, gap: Column, radial_median: Column, radial_p90: Column, limit: Column, has_error: Column) -> Column:
    has = lambda name: F.array_contains(F.split(failed, r"\|"), name)
    return (
        F.when(~applicable, "excluded")
        .when(~valid, "uncertain")
        .when(has("axial_coverage") & has("gap"), F.when(axial < 0.35, "missing").otherwise("broken"))
        .when(has("continuity") | (gap > 3), "broken")
        .when(radial_p90 > limit, F.when(radial_median < 0, "thin").otherwise("thick"))
        .when(has("centerline"), "bent_or_misaligned")
        .when(has_error.eqNullSafe(F.lit(False)), "healthy")
        .otherwise("uncertain")
    )


def profile_decision(realised: Column, gap: Column, agreement: Column, bridged: Column, margin: Column) -> dict[str, Column]:
    unstable = agreement < 0.8
    error = (realised < 0.80) | (gap >= 3)
    verdict = F.when(unstable, F.lit(None).cast("boolean")).when(error, True).when(~bridged, F.lit(None).cast("boolean")).otherwise(False)
    return {"has_error": verdict, "confidence": F.when(verdict.isNull(), 0.0).otherwise(agreement * (0.75 + 0.25 * margin))}


def integrity_state(first_end: Column, second_end: Column, middle: Column, gaps: Column, baseline: Column, diameter: Column, design: float, peer_median: Column) -> Column:
    """endpoint_disconnected, likely_discontinuous, thin_continuous, good or uncertain. gaps: longest gap at each threshold."""
    thin = diameter < F.least(F.lit(0.8 * design), 0.8 * peer_median)
    return (
        F.when((middle >= 0.85) & (F.least(first_end, second_end) < 0.70), "endpoint_disconnected")
        .when(F.forall(gaps, lambda g: g >= 2) & (baseline < 0.95), "likely_discontinuous")
        .when((baseline >= 0.95) & thin, "thin_continuous")
        .when(baseline >= 0.95, "good")
        .otherwise("uncertain")
    )


def anomaly_score(realised: Column, gap: Column) -> Column:
    """The larger of two normalised deficits; null if either is missing."""
    return F.when(realised.isNotNull() & gap.isNotNull(), F.greatest((1 - realised) / 0.2, gap / 3))


def gate(name: str, value: Column, threshold: float) -> Column:
    """Names that end in _max are upper limits, others lower ones; null fails."""
    return F.coalesce(value <= threshold if name.endswith("_max") else value >= threshold, F.lit(False))
