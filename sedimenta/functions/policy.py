"""The planner's rules as column expressions: no state, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions import constants as C


def file_class(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(C.CLASS_MEDIA), "media").when(e.isin(C.CLASS_DOC), "doc").when(e.isin(C.CLASS_TEXT), "text").otherwise("bin")


def is_container(ext: Column, content: Column) -> Column:
    head = F.substring(F.hex(F.substring(content, 1, 4)), 1, 8)
    return F.lower(ext).isin(C.CONTAINERS) | (head == "25504446") | (head == "504B0304")


def work_factor(entropy: Column) -> Column:
    t = (entropy - C.BH_LOW) / (C.BH_HIGH - C.BH_LOW)
    return F.when(entropy <= C.BH_LOW, 1.0).when(entropy >= C.BH_HIGH, 0.0).otherwise((1.0 - t) * (1.0 - t))


def threshold_bump(entropy: Column) -> Column:
    t = (entropy - C.BH_LOW) / (C.BH_HIGH - C.BH_LOW)
    return F.when(entropy <= C.BH_LOW, 0.0).when(entropy >= C.BH_HIGH, C.BH_BUMP).otherwise(t * C.BH_BUMP)


def level_for_gain(gain: Column) -> Column:
    return F.when(gain >= 0.30, 7).when(gain >= 0.18, 5).otherwise(3)


def state(entropy: Column, gain: Column, motif: Column, container: Column, ext: Column) -> Column:
    entropic = (entropy >= 0.985) | (gain <= 0.02)
    return (
        F.when(entropic & container, "CONTAINER_ENTROPIC")
        .when(entropic, "RAW_ENTROPIC")
        .when((motif >= C.MOTIF_SCORE) & ~container & F.lower(ext).isin(C.TEXT_LIKE), "STRUCT_MOTIF")
        .when(container, "CONTAINER_COMPRESSIBLE")
        .otherwise("GENERIC_COMPRESSIBLE")
    )


def gate_hint(size: Column, ext: Column, fast: bool = True) -> Column:
    """The first gate's hint: which lanes are closed, and how much to probe. Entropy is at most 1, so its test at 7.85 closes nothing."""
    if not fast:
        return F.struct(*[F.lit(False).alias(n) for n in ("skip_deep", "no_structure", "force_whole")], F.lit(C.PROBE_BYTES).alias("probe_bytes"), F.lit(C.PROBE_LEVEL).alias("probe_level"), F.lit(C.CHUNK_SIZE).alias("chunk_size"))
    media = F.lower(ext).isin(C.FAST_MEDIA)
    closed = media | (size <= max(C.WHOLE_MAX, 256 * C.KIB))
    return F.struct(
        closed.alias("skip_deep"), closed.alias("no_structure"), media.alias("force_whole"), F.lit(min(C.PROBE_BYTES, C.FAST_PROBE_BYTES)).alias("probe_bytes"),
        F.lit(min(C.PROBE_LEVEL, C.FAST_PROBE_LEVEL)).alias("probe_level"), F.when(size >= C.FAST_BIG_FILE, C.FAST_BIG_CHUNK).otherwise(C.CHUNK_SIZE).alias("chunk_size"),
    )


def hinted(hint: Column, entropy: Column, gain: Column, motif: Column, container: Column, similarity: Column, fast: bool = True, gate: bool = True) -> Column:
    """struct(entropy, gain, motif, container, similarity) as the planner takes them after the first gate's hint.

    A closed structure lane has no motifs and no base; a file forced to be whole looks incompressible. Without a gate all files look alike but
    for their gain.
    """
    closed, whole = (hint["no_structure"], hint["force_whole"]) if fast else (F.lit(False), F.lit(False))
    found = {
        "entropy": F.when(whole, F.greatest(entropy, F.lit(C.FORCED_ENTROPY))).otherwise(entropy),
        "gain": F.when(whole, F.least(gain, F.lit(0.0))).otherwise(gain),
        "motif": F.when(closed, 0.0).otherwise(motif),
        "container": container,
        "similarity": F.when(closed, 0.0).otherwise(similarity),
    }
    if not gate:
        found |= {"entropy": F.lit(C.UNGATED_ENTROPY), "motif": F.lit(0.0), "container": F.lit(False), "similarity": F.lit(0.0)}
    return F.struct(*[v.alias(k) for k, v in found.items()])


def plan(size: Column, ext: Column, entropy: Column, gain: Column, motif: Column, container: Column, similarity: Column, bias: Column, dedupe: bool = True, micro: bool = True, chunk_size: int = C.CHUNK_SIZE) -> Column:
    """struct(state, action, level, threshold, reason) of a file whose best earlier base has the given similarity (0: none)."""
    kind = file_class(ext)
    floor = F.lit(C.FLOORS["bin"])
    for name, value in C.FLOORS.items():
        floor = F.when(kind == name, value).otherwise(floor)
    start = F.when(size <= C.SMALL_SIZE, C.THRESHOLD_SMALL).otherwise(C.THRESHOLD)
    threshold = F.least(F.greatest(floor, start + bias + threshold_bump(entropy), F.lit(0.0)), F.lit(0.40))
    work = work_factor(entropy)
    base = size.between(C.PI_MIN, C.PI_MAX) & (similarity >= C.PI_SIMILAR)
    bypass = base & (similarity >= C.PI_BYPASS)
    entropic = F.when(container, "CONTAINER_ENTROPIC").otherwise("RAW_ENTROPIC")
    is_state = F.when(base & ((work > 0.05) | bypass), "STRUCT_GENERATIVE").when(work <= 0.05, entropic).otherwise(state(entropy, gain, motif, container, ext))
    level = F.when(work > 0, level_for_gain(gain)).otherwise(3)
    small = F.lit(micro and not dedupe) & (size <= C.MICRO_CUTOFF) & (work > 0)
    kept = F.when(small, "MICRO").otherwise("WHOLE")
    structured = is_state.isin("STRUCT_GENERATIVE", "STRUCT_MOTIF")
    cap = F.when(is_state == "STRUCT_GENERATIVE", C.PI_MAX).otherwise(C.DNA_MAX)
    large = size > C.WHOLE_MAX
    net = gain * F.least(size, F.lit(C.PROBE_BYTES)).cast("double") - C.CHUNK_OVERHEAD * F.ceil(size / chunk_size)
    made = lambda action, lvl, reason: F.struct(action.alias("action"), lvl.alias("level"), F.lit(reason).alias("reason"))
    decided = (
        F.when(large & ~structured, made(F.lit("CDC"), level, "LARGE"))
        .when(large & (size > cap), made(F.lit("CDC"), level, "CAP"))
        .when((is_state == "STRUCT_MOTIF") & (work > 0.2) & (gain >= F.greatest(F.lit(0.03), 0.7 * threshold)), made(F.lit("DNA"), level, "MOTIF"))
        .when((is_state == "STRUCT_GENERATIVE") & ((work > 0.2) | bypass), made(F.lit("PI"), level, "BASE"))
        .when(is_state.isin("RAW_ENTROPIC", "CONTAINER_ENTROPIC"), made(kept, F.lit(3), "ENTROPIC"))
        .when((is_state == "CONTAINER_COMPRESSIBLE") & (gain >= F.greatest(threshold, F.lit(0.20))), made(F.lit("CDC"), level, "CONTAINER"))
        .when((is_state != "CONTAINER_COMPRESSIBLE") & (gain >= threshold) & (net > 0) & (work > 0), made(F.lit("CDC"), level, "GAIN"))
        .otherwise(made(kept, level, "NO_GAIN"))
    )
    return F.struct(is_state.alias("state"), decided["action"].alias("action"), decided["level"].alias("level"), threshold.alias("threshold"), decided["reason"].alias("reason"))
