"""Texts of several sources combined so that each gives a target share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.session import written

#: A refinement divides a cell of ranks into so many; DEPTH refinements tell apart CELLS**DEPTH ranks.
CELLS, DEPTH = 512, 4
#: Size classes an octave; texts of one class have the same chance.
CLASSES = 2


def _uniform(row_id: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the row's id and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(row_id)), 11).cast("double") + 0.5) / float(1 << 53)


def _size_class(tokens: Column) -> Column:
    return F.floor(F.log2(tokens + 1) * CLASSES).cast("int")


def _plan(sizes: dict[str, dict[int, tuple[int, int]]], targets: list[tuple[str, float, int]], total: int | None, power: float) -> dict[str, dict]:
    """Per source: target share, wanted tokens, and of each size class the expected copies of a text.

    sizes: per source and class the tokens and the texts. The expected copies
    are proportional to a power of the class's mean size, at most the cap, and
    so that the source's tokens come to what is wanted.
    """
    tokens = {s: sum(t for t, _ in classes.values()) for s, classes in sizes.items()}
    usable = [(s, w, cap) for s, w, cap in targets if w and w > 0 and cap and cap > 0 and tokens.get(s, 0) > 0]
    mass = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    most = min(cap * tokens[s] * mass / w for s, w, cap in usable)
    total = most if total is None else min(total, most)
    out = {}
    for s, w, cap in usable:
        wanted = total * w / mass
        size = {k: max(1.0, t / n) ** power for k, (t, n) in sizes[s].items()}
        copies = lambda c: {k: min(float(cap), c * size[k]) for k in size}  # noqa: B023, E731
        gives = lambda c: sum(e * sizes[s][k][0] for k, e in copies(c).items())  # noqa: B023, E731
        low, high = 0.0, cap / min(size.values())
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if gives(middle) < wanted else (low, middle)
        each = {k: float(round(e)) if abs(e - round(e)) < 1e-9 else e for k, e in copies(high).items()}
        out[s] = {"share": w, "wanted": wanted, "each": each, "certain": sum(math.floor(e) * sizes[s][k][0] for k, e in each.items())}
    return out


def mixed(df: DataFrame, row_id: str, text: str, source: str, targets: list[tuple[str, float, int]], seed: int = 42, total: int | None = None, power: float = 1.0) -> DataFrame:
    """One row for each text that is used: row_id, source, n_tokens, copies,
    and of its source target_share and actual_share (of all tokens used).

    targets: (source, weight, most copies of a text). The mixture is the
    largest at which every source still reaches its weight (or `total`
    tokens, where that is less). The expected copies of a text are
    proportional to its size class's mean size to the given power (1: the
    chance proportional to size that keeps the tokens of a fixed-size sample
    steady; 0: equal chances), never over the cap. The whole part is given for
    certain; who gets one copy more is decided by Pareto order sampling: texts
    are ranked by the odds of a random number over the odds of their
    inclusion, and the first are taken until the source's tokens are reached.
    The cut is found by counting tokens in ever finer cells of rank, so no
    source is sorted or brought to one task. The texts are read once.

    A token is a byte of the UTF-8 form. Null texts, null sources and sources
    without a target are not used; empty texts are worth no tokens but drawn
    like others; weights of absent or empty sources are shared out among the
    rest in proportion. Rows that repeat an id in a source are drawn together.
    """
    spark, key = df.sparkSession, df.schema[row_id].dataType.simpleString()
    named = sorted({s for s, _, _ in targets})
    rows = df.where(F.col(source).isin(named)).select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.octet_length(text).cast("long").alias("n_tokens")).where("n_tokens is not null")
    rows = written(rows.withColumn("class", _size_class(F.col("n_tokens"))), "sizes")
    sizes: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("source", "class").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect():  # targets times 64 * CLASSES at most
        sizes.setdefault(r["source"], {})[r["class"]] = r["t"], r["n"]
    plan = _plan(sizes, targets, total, power)
    if not plan:
        return spark.createDataFrame([], f"row_id {key}, source string, n_tokens bigint, copies int, target_share double, actual_share double").withColumnRenamed("row_id", row_id)
    chances = spark.createDataFrame([(s, k, p["share"], math.floor(e), e - math.floor(e)) for s, p in plan.items() for k, e in p["each"].items()], "source string, class int, target_share double, whole int, rest double")
    u, p = _uniform("row_id", seed), F.col("rest")
    ratio = (u / (1 - u)) / (p / (1 - p))
    ranked = rows.join(F.broadcast(chances), ["source", "class"]).withColumn("rank", F.when(p > 0, ratio / (1 + ratio)))  # targets times classes
    edges = spark.createDataFrame([(s, edge, str(last) if last is not None else None) for s, (edge, last) in _cuts(ranked, plan).items()], "source string, edge double, last string")
    extra = (F.col("rank") < F.col("edge")) | ((F.col("rank") == F.col("edge")) & (F.col("row_id") <= F.col("last").cast(key)))
    used = ranked.join(F.broadcast(edges), "source", "left").withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0)).where("copies > 0")
    reached = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    total_used = sum(reached.values()) or 1
    shares = spark.createDataFrame([(s, reached.get(s, 0) / total_used) for s in plan], "source string, actual_share double")
    out = used.join(F.broadcast(shares), "source").select("row_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"), "target_share", "actual_share")
    return out.withColumnRenamed("row_id", row_id)


def _cuts(ranked: DataFrame, plan: dict[str, dict]) -> dict[str, tuple[float, object]]:
    """Per source the rank (and id among equals) of the last text that gets a copy more."""
    spark = ranked.sparkSession
    left = {s: p["wanted"] - p["certain"] for s, p in plan.items() if any(e > math.floor(e) for e in p["each"].values())}
    low = dict.fromkeys(left, 0.0)
    width = 1.0
    rest = ranked.where("rank is not null").select("source", "rank", "n_tokens", "row_id")

    def within() -> DataFrame:
        starts = spark.createDataFrame(sorted(low.items()), "source string, low double")
        return rest.join(F.broadcast(starts), "source").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + width))

    for _ in range(DEPTH):
        if not low:
            return {}
        part = width / CELLS
        cell = F.least(F.floor((F.col("rank") - F.col("low")) / part), F.lit(CELLS - 1))
        cells: dict[str, list[tuple[int, int]]] = {}
        for r in within().groupBy("source", cell.alias("cell")).agg(F.sum("n_tokens").alias("t")).toLocalIterator():  # at most CELLS a source
            cells.setdefault(r["source"], []).append((r["cell"], r["t"]))
        for s in low:
            found = sorted(cells.get(s, []))
            for number, tokens in found:
                if tokens > left[s] or number == found[-1][0]:
                    low[s] += number * part
                    break
                left[s] -= tokens
        width = part
    out: dict[str, tuple[float, object]] = {s: (edge, None) for s, edge in low.items()}
    closed: set[str] = set()
    last = within().groupBy("source", "rank", "row_id").agg(F.sum("n_tokens").alias("n_tokens"))  # the ids of one cell of CELLS**DEPTH a source
    for r in last.orderBy("source", "rank", "row_id").toLocalIterator():
        s = r["source"]
        if s in closed:
            continue
        if r["n_tokens"] - left[s] > left[s]:  # without it the tokens are nearer to the target
            closed.add(s)
            continue
        out[s] = (r["rank"], r["row_id"])
        left[s] -= r["n_tokens"]
    return out
