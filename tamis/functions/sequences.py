"""Expressions over score sequences (arrays of doubles in frame order). No UDFs, no shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def holding(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, not once per element of what `body` goes over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def linspace_indices(n: Column, k: int) -> Column:
    """k positions spread evenly over 0..n-1, cut to whole numbers; zeros for an empty sequence."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(n <= 0, 0).otherwise(F.floor(i * (n - 1) / F.lit(max(1, k - 1)))).cast("int"))


def resample(x: Column, m: int) -> Column:
    """Linear interpolation to m points; a single value is repeated, an empty sequence gives zeros."""
    n = F.size(x)

    def point(i: Column) -> Column:
        at = i * (n - 1) / F.lit(float(max(1, m - 1)))
        low = F.least(F.floor(at), n - 1).cast("int")
        high = F.least(low + 1, n - 1)
        return F.get(x, low) + (F.get(x, high) - F.get(x, low)) * (at - low)

    return F.when(n <= 0, F.array_repeat(F.lit(0.0), m)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), point))


def min_max(x: Column, least_range: float = 1e-8) -> Column:
    ends = F.struct(F.array_min(x).alias("low"), (F.array_max(x) - F.array_min(x)).alias("width"))
    return holding(ends, lambda e: F.transform(x, lambda v: F.when(e["width"] < least_range, 0.0).otherwise((v - e["low"]) / e["width"])))


def pad(x: Column, length: int) -> Column:
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), length)), 1, length)


def clean(x: Column) -> Column:
    """NaN to 0, infinities to a million."""
    big = F.lit(float("inf"))
    return F.transform(x, lambda v: F.when(F.isnan(v), 0.0).when(v == big, 1e6).when(v == -big, -1e6).otherwise(v))


def top(x: Column, k: Column) -> Column:
    return F.slice(F.sort_array(x, False), 1, k)


def noisy_or(x: Column, share: float = 0.2, least: int = 3) -> Column:
    """1 - product of (1 - p + 1e-6) over the highest scores: a share of them, `least` at least; 0 if there are none."""
    n = F.size(x)
    k = F.least(n, F.greatest(F.lit(least), F.ceil(n * share))).cast("int")
    return F.when(n > 0, 1 - F.aggregate(top(x, k), F.lit(1.0), lambda a, p: a * (1 - p + 1e-6))).otherwise(0.0)


def gated_noisy_or(x: Column, attention: Column, share: float = 0.2, least: int = 3) -> Column:
    """As noisy_or, with each score weighted by its attention relative to the highest."""
    highest = F.greatest(F.array_max(attention), F.lit(1e-8))
    gated = holding(highest, lambda h: F.zip_with(x, attention, lambda p, a: p * (0.5 + 0.5 * a / h)))
    return holding(gated, lambda g: noisy_or(g, share, least))


def weighted_mean(x: Column, weights: Column) -> Column:
    w = total(weights)
    return F.when(w != 0, total(F.zip_with(x, weights, lambda a, b: a * b)) / w)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def rms_unit(x: Column) -> Column:
    root = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + 1e-8)
    return holding(root, lambda r: F.transform(x, lambda v: v / r))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    e = holding(F.array_max(x), lambda h: F.transform(x, lambda v: F.exp((v - h) / temperature)))
    return holding(e, lambda e: holding(total(e), lambda t: F.transform(e, lambda v: v / t)))


def guarded(x: Column, least: float = 1e-6) -> Column:
    """Weights of at least `least` that add up to 1; what is no finite number counts as 0."""
    plain = F.transform(x, lambda v: F.greatest(F.lit(least), F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.coalesce(v, F.lit(0.0)))))
    return holding(plain, lambda p: holding(total(p), lambda t: F.transform(p, lambda v: v / F.greatest(t, F.lit(least)))))


def softened(x: Column, temperature: float, least: float = 1e-6) -> Column:
    """Softmax of scores over a temperature, no share under `least`, made to add up to 1 again. NaN counts as 0.5, an
    infinity as 1 or 0."""
    clean = F.transform(x, lambda v: F.when(F.isnan(v), 0.5).when(v == float("inf"), 1.0).when(v == float("-inf"), 0.0).otherwise(v))
    return guarded(softmax(clean, temperature), least)


def respeeded(x: Column, factor: Column, least: int = 4) -> Column:
    """The sequence played faster by a factor from 0.5 to 2, by taking rows at even steps; shorter ones than `least` stay."""
    n = F.size(x)
    m = F.greatest(F.lit(least), F.floor(n / F.least(F.lit(2.0), F.greatest(F.lit(0.5), factor))).cast("int"))
    step = (n - 1) / (m - 1)
    at = lambda i: F.when(i == m - 1, n - 1).otherwise(F.floor(i * step)).cast("int")
    return F.when(n < least, x).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.get(x, at(i))))


def started_later(x: Column, offset: Column, jitter: int) -> Column:
    """The sequence without its first `offset` rows (none if negative), if it is longer than twice the jitter."""
    return F.when((F.size(x) > 2 * jitter) & (offset > 0), F.slice(x, offset + 1, F.greatest(F.size(x), F.lit(1)))).otherwise(x)


def entropy_ratio(attention: Column) -> Column:
    """Entropy of weights against that of equal ones."""
    return -total(F.transform(attention, lambda a: a * F.log(a + 1e-8))) / F.log(F.size(attention).cast("double"))


def count_above(x: Column, cut: float) -> Column:
    return F.size(F.filter(x, lambda v: v > cut))


def windows(n: Column, size: int, stride: int) -> Column:
    """Starts of overlapping windows; a last one is anchored at the tail if the stride misses it."""
    last = F.greatest(n - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def peak_evidence(x: Column) -> tuple[Column, Column]:
    """(pattern, evidence): the highest score, weighted by the shape of the two scores on either side of it."""
    peak = F.array_max(x)
    at = F.array_position(x, peak).cast("int")  # from 1; the first of equals
    first = F.greatest(at - 2, F.lit(1))
    near = F.concat(F.slice(x, first, at - first), F.slice(x, at + 1, 2))
    highest, average = F.array_max(near), mean(near)
    rules = [
        ("no_context", 0.30, F.size(near) == 0),
        ("fast_action", 0.65, (peak >= 0.78) & (highest >= 0.12)),
        ("sustained_action", 0.80, (peak >= 0.65) & (average >= 0.18)),
        ("isolated_spike", 0.25, (peak >= 0.65) & (highest < 0.12)),
    ]
    pattern, weight = F.lit("weak_signal"), F.lit(0.40)
    for name, w, rule in reversed(rules):
        pattern, weight = F.when(rule, name).otherwise(pattern), F.when(rule, w).otherwise(weight)
    return pattern, peak * weight


def resample_columns(x: Column, m: int) -> Column:
    """Rows of a matrix (array of equally long arrays) resampled to m, each column by itself; no rows stay none."""
    n = F.size(x)

    def row(i: Column) -> Column:
        at = i * (n - 1) / F.lit(float(max(1, m - 1)))
        low = F.least(F.floor(at), n - 1).cast("int")
        return F.zip_with(F.get(x, low), F.get(x, F.least(low + 1, n - 1)), lambda a, b: a + (b - a) * (at - low))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), row)).otherwise(x)


def fitted(x: Column, rows: int, columns: int) -> Column:
    """A matrix cut and padded with zeros to a number of rows and columns."""
    blank = F.array_repeat(F.lit(0.0), columns)
    wide = F.transform(x, lambda r: pad(r, columns))
    return F.slice(F.concat(wide, F.array_repeat(blank, rows)), 1, rows)


# Fixed layout of a packed frame: an embedding, then these; the shorter layout lacks self_harm.
EMBEDDING, AUXILIARY = 768, ("flow_x", "flow_y", "flow_m", "weapon", "gore", "self_harm", "nsfw")


def unpacked(x: Column, embedding: int = EMBEDDING) -> tuple[Column, Column]:
    """(embedding, auxiliary values by name) of a packed frame; self_harm is 0 in the shorter layout."""
    aux = F.slice(x, embedding + 1, len(AUXILIARY))
    short = F.size(aux) < len(AUXILIARY)
    full = F.when(short, F.concat(F.slice(aux, 1, 5), F.array(F.lit(0.0)), F.slice(aux, 6, 1))).otherwise(aux)
    return F.slice(x, 1, embedding), F.struct(*(F.get(full, i).alias(n) for i, n in enumerate(AUXILIARY)))


def aligned(blocks: list[tuple[Column, int]]) -> Column:
    """Matrices (array of rows, width) side by side, as many rows as the longest has; missing rows are zeros."""
    longest = F.greatest(*(F.size(b) for b, _ in blocks)) if len(blocks) > 1 else F.size(blocks[0][0])
    part = lambda b, w, i: F.coalesce(F.get(b, i), F.array_repeat(F.lit(0.0), w))
    rows = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.concat(*(part(b, w, i) for b, w in blocks)))
    return F.when(longest > 0, rows).otherwise(F.array().cast("array<array<double>>"))


def shot_frames(shots: Column, most_shots: int, per_shot: int) -> Column:
    """Frame numbers from the longest shots (start, end): per_shot of each by an even stride, the last repeated where a
    shot is short, and the last of all repeated up to most_shots * per_shot. Equally long shots keep their order."""
    numbered = F.transform(shots, lambda s, i: F.struct((s["start"] - s["end"]).alias("minus"), i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
    longest = F.filter(F.slice(F.array_sort(numbered), 1, most_shots), lambda s: s["minus"] < 0)

    def of(s: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor((s["end"] - s["start"]) / per_shot)).cast("int")
        indices = F.slice(F.sequence(s["start"], s["end"] - 1, step), 1, per_shot)
        return F.slice(F.concat(indices, F.array_repeat(F.element_at(indices, -1), per_shot)), 1, per_shot)

    frames = F.flatten(F.transform(longest, of))
    total = most_shots * per_shot
    return F.when(F.size(frames) > 0, F.slice(F.concat(frames, F.array_repeat(F.element_at(frames, -1), total)), 1, total)).otherwise(frames)


def early_stop(log: Column, patience: int, start: float = -1.0) -> Column:
    """(best, best_epoch, stopped_at) of a log of (epoch, value) in epoch order: stopped after `patience` epochs without a
    better value, null if never; a patience of 0 never stops."""
    first = F.struct(F.lit(start).alias("best"), F.lit(None).cast("int").alias("best_epoch"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("stopped_at"))

    def step(s: Column, x: Column) -> Column:
        better = x["value"] > s["best"]
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        stop = F.when((F.lit(patience) > 0) & (wait >= patience), x["epoch"])
        new = F.struct(F.when(better, x["value"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"), wait.alias("wait"), stop.alias("stopped_at"))
        return F.when(s["stopped_at"].isNotNull(), s).otherwise(new)

    return F.aggregate(log, first, step)


def diagnosis(train: Column, val: Column, score: Column, target: float) -> Column:
    """What the losses of a run say, in epoch order."""
    back = lambda x, k: F.element_at(x, F.lit(-k))
    over = (F.size(val) > 3) & (back(val, 1) > F.try_element_at(val, F.lit(-3))) & (back(train, 1) < F.try_element_at(train, F.lit(-3)))
    return (
        F.when((F.size(train) == 0) | score.isNull(), "error")
        .when((score < 0.40) & (F.element_at(train, 1) - back(train, 1) < 0.5), "underfit")
        .when(over, "overfit")
        .when(score >= target, "success")
        .otherwise("good_but_low")
    )


def jittered(x: Column, shift: int) -> Column:
    """The sequence moved by a number of places, its ends repeated."""
    n = F.size(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, F.greatest(F.lit(0), F.least(n - 1, i + shift))))).otherwise(x)


def binary_entropy(score: Column, eps: float = 1e-6) -> Column:
    """Entropy in bits of a score and its complement, both kept off 0."""
    p = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), score))
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.ln(F.lit(2.0))
