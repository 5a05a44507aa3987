"""Folds whose result depends on the order of rows, in two passes over blocks of rows instead of one long loop.

A block's effect on the moving average is affine, and its effect on the clamped bias is x -> clamp(x + shift, low, high); both compose,
so blocks are reduced side by side, the short list of blocks is folded, and no task holds more than a block or the list.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import constants as C


def _step(ema: float) -> float:
    """How the bias moves at a moving average."""
    under = C.EMA_TARGET - ema
    return min(C.EMA_STEP, under * 0.05) if under > 0 else -min(C.EMA_STEP, -under * 0.02)


def _by_block(gains: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """gains with their block and its starting average; and (grp, block, n, ema, shift, low, high), each block's effect."""
    keyed = gains.select("grp", "idx", "gain", F.floor(F.col("idx") / block).alias("block"))

    def average(key, table):
        a, b = 1.0, 0.0  # ema -> a * ema + b
        for g in table.sort_by("idx").column("gain").to_pylist():
            a, b = a * (1 - C.EMA_ALPHA), b * (1 - C.EMA_ALPHA) + C.EMA_ALPHA * g
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "n": [table.num_rows], "a": [a], "b": [b]})

    def starts(key, table):
        table, ema, out = table.sort_by("block"), 0.0, []
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            out.append(ema)
            ema = a * ema + b
        return pa.table({"grp": table.column("grp"), "block": table.column("block"), "start": pa.array(out, pa.float64())})

    def clamp(key, table):
        table = table.sort_by("idx")
        ema, shift, low, high = table.column("start")[0].as_py(), 0.0, C.BIAS_LOW, C.BIAS_HIGH
        first = True
        for g in table.column("gain").to_pylist():
            ema = (1 - C.EMA_ALPHA) * ema + C.EMA_ALPHA * g
            step = _step(ema)
            shift += step
            if first:
                low, high, first = C.BIAS_LOW, C.BIAS_HIGH, False
            else:
                low, high = max(C.BIAS_LOW, min(C.BIAS_HIGH, low + step)), max(C.BIAS_LOW, min(C.BIAS_HIGH, high + step))
        return pa.table({"grp": [key[0].as_py()], "block": [key[1].as_py()], "n": [table.num_rows], "ema": [ema], "shift": [shift], "low": [low], "high": [high]})

    grp = gains.schema["grp"].dataType.simpleString()
    affine = keyed.groupBy("grp", "block").applyInArrow(average, f"grp {grp}, block long, n long, a double, b double")
    begun = affine.groupBy("grp").applyInArrow(starts, f"grp {grp}, block long, start double")
    ready = keyed.join(begun, ["grp", "block"])
    return ready, ready.groupBy("grp", "block").applyInArrow(clamp, f"grp {grp}, block long, n long, ema double, shift double, low double, high double")


def adaptive_bias(gains: DataFrame, block: int = 4096) -> DataFrame:
    """(grp, n, ema, bias) at the end of each group of gains (grp, idx, gain), taken in the order of idx, a non-negative long."""

    def finish(key, table):
        table, bias, ema = table.sort_by("block"), 0.0, 0.0
        for shift, low, high, e in zip(*[table.column(c).to_pylist() for c in ("shift", "low", "high", "ema")]):
            bias, ema = min(high, max(low, bias + shift)), e
        return pa.table({"grp": [key[0].as_py()], "n": [sum(table.column("n").to_pylist())], "ema": [ema], "bias": [bias]})

    return _by_block(gains, block)[1].groupBy("grp").applyInArrow(finish, f"grp {gains.schema['grp'].dataType.simpleString()}, n long, ema double, bias double")


def before_each(gains: DataFrame, block: int = 4096) -> DataFrame:
    """(grp, idx, ema, bias) before each row of gains: what a planner knows when it comes to that row."""

    def starts(key, table):
        table, bias, out = table.sort_by("block"), 0.0, []
        for shift, low, high in zip(*[table.column(c).to_pylist() for c in ("shift", "low", "high")]):
            out.append(bias)
            bias = min(high, max(low, bias + shift))
        return pa.table({"grp": table.column("grp"), "block": table.column("block"), "bias": pa.array(out, pa.float64())})

    def rows(key, table):
        table = table.sort_by("idx")
        ema, bias, emas, biases = table.column("start")[0].as_py(), table.column("bias")[0].as_py(), [], []
        for g in table.column("gain").to_pylist():
            emas.append(ema)
            biases.append(bias)
            ema = (1 - C.EMA_ALPHA) * ema + C.EMA_ALPHA * g
            bias = min(C.BIAS_HIGH, max(C.BIAS_LOW, bias + _step(ema)))
        return pa.table({"grp": table.column("grp"), "idx": table.column("idx"), "ema": emas, "bias": biases})

    grp = gains.schema["grp"].dataType.simpleString()
    ready, moved = _by_block(gains, block)
    begun = moved.groupBy("grp").applyInArrow(starts, f"grp {grp}, block long, bias double")
    return ready.join(begun, ["grp", "block"]).groupBy("grp", "block").applyInArrow(rows, f"grp {grp}, idx long, ema double, bias double")
