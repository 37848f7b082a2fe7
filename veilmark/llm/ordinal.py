"""Ordinal quality classifier: one shared weight vector over hashed text, and ordered thresholds between grades.

P(grade >= k) = sigmoid(score - threshold_k). Grades follow the review statuses: rejected 0, pending 1, accepted 2.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm import words as W
from veilmark.plans.session import settle

# ---- fixed values: grades of the review statuses ---------------------------------------------
GRADES = {"rejected": 0, "pending": 1, "accepted": 2}
DIMENSIONS = 1 << 22
SAMPLE_PER_GRADE = 6000
MIN_TEXTS = 8
MIN_SIGMAS = 5.0
MIN_RATIO = 1.0
MIN_TAIL = 0.7
LEAST_GAP = 1e-3
WINDOW_WORDS = 256
WORST_SHARE = 0.2
SHINGLE_WORDS = 5
ROUNDS = 300
PENALTY = 1e-6


_PLACES = np.random.default_rng(31).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KINDS = np.zeros(256, np.uint64)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 4


def _ends(data: np.ndarray, first: np.ndarray, size: np.ndarray, chars: int, backward: bool) -> np.ndarray:
    """Hash of the first or last bytes of each word, A-Z as a-z forward and as they are backward."""
    out = np.zeros(len(first), np.uint64)
    for k in range(chars):
        at = np.clip(first + (size - 1 - k if backward else k), 0, len(data) - 1)
        byte = data[at] if backward else W.LOWER[data[at]]
        out += np.where(size > k, byte.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _PLACES[k]
    return W.mix(out + np.uint64(chars + 100 * backward))


# Places and values of the weights other than 0, and the thresholds.
Model = tuple[tuple[np.ndarray, np.ndarray], np.ndarray]


def _windows(column: pa.Array) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Hashed features (index, value) of each window of each text; a text without words has no window.

    A text is cut into equal windows of at most WINDOW_WORDS words, so that no feature depends on its length.
    Words and their first 4 to 6 bytes count once each where present, as do classes of the share of distinct words
    and of words that repeat the one before. Endings of three bytes, and the letter case
    at a word's ends with its length class, count by their share of the words.
    """
    data, offsets = W.utf8(column)
    value, first, end, bounds = W.words(data, offsets)
    top = np.uint64(DIMENSIONS - 1)
    if len(value):
        size = end - first
        tail = _ends(data, first, size, 3, True) & top
        shape = _KINDS[data[first]] * np.uint64(5) + _KINDS[data[end - 1]]
        shape = shape * np.uint64(5) + _KINDS[data[np.clip(first + 1, 0, len(data) - 1)]]
        shape = W.mix(shape * np.uint64(8) + np.minimum(size, 31).astype(np.uint64) // np.uint64(4) + np.uint64(1 << 50)) & top
        there = [value & top, *[_ends(data, first, size, k, False) & top for k in (4, 5, 6)]]
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n, out = -(-(stop - start) // WINDOW_WORDS), []
        cuts = [start + (stop - start) * i // n for i in range(n + 1)] if n else []
        for a, b in zip(cuts, cuts[1:]):
            fresh = len(np.unique(value[a:b])) / (b - a)
            again = (value[a + 1 : b] == value[a : b - 1]).mean() if b - a > 1 else 0.0
            habits = [1000 + int(20 * fresh) + 100 * min(5, (b - a).bit_length() // 2), 2000 + int(20 * again)]
            present = np.unique(np.concatenate([*[x[a:b] for x in there], W.mix(np.array(habits, np.uint64)) & top]))
            rest, times = np.unique(np.concatenate([tail[a:b], shape[a:b]]), return_counts=True)
            counts = np.concatenate([np.ones(len(present), np.float32), (4.0 * times / (b - a)).astype(np.float32)])
            out.append((np.concatenate([present, rest]).astype(np.int32), counts))
        yield out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text as (index, value, bounds): the mean of its windows."""
    index, weight, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [0]
    for windows in _windows(column):
        if len(windows) > 1:
            places, at = np.unique(np.concatenate([w[0] for w in windows]), return_inverse=True)
            mean = np.bincount(at, np.concatenate([w[1] for w in windows])) / len(windows)
            windows = [(places, mean.astype(np.float32))]
        for places, mean in windows:
            index.append(places)
            weight.append(mean)
        ends.append(ends[-1] + sum(len(w[0]) for w in windows))
    return np.concatenate(index), np.concatenate(weight), np.array(ends)


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The mean score of the worst WORST_SHARE of each text's windows, of one window at least; 0 without words.

    All windows are read. A mean over a share does not drift with the length, and a bad passage in a long clean
    text is not thinned out by the rest.
    """
    out = np.zeros(len(column))
    for i, windows in enumerate(_windows(column)):
        each = np.sort([(weights[index].astype(np.float64) * value).sum() for index, value in windows])
        if len(each):
            reach = max(1.0, WORST_SHARE * len(each))
            out[i] = (each * np.clip(reach - np.arange(len(each)), 0.0, 1.0)).sum() / reach
    return out


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..., one column each."""
    return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -60, 60)))


def contrast(times: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How much more frequent each feature is below some threshold than above: its largest log ratio of shares.

    times: texts with the feature, by feature and grade; totals: texts by grade. 0 where no difference reaches
    MIN_SIGMAS or fewer than MIN_TEXTS texts have the feature, so that words of single texts or of all texts play no part.
    """
    n, out, all_times = totals.sum(), np.zeros(len(times)), times.sum(axis=1)
    for k in range(1, len(totals)):
        above = totals[k:].sum()
        if 0 < above < n:
            high = times[:, k:].sum(axis=1)
            low, below = all_times - high, n - above
            spread = np.sqrt(np.maximum(all_times * (1 - all_times / n) / n, 1e-12) * (1 / above + 1 / below))
            ratio = np.log((low + 0.5) / (below + 1)) - np.log((high + 0.5) / (above + 1))
            out = np.maximum(out, np.where(low / below - high / above >= MIN_SIGMAS * spread, ratio, 0.0))
    return np.where(all_times >= MIN_TEXTS, out, 0.0)


def fit(texts: pa.Array, grades: np.ndarray, share: np.ndarray, levels: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all features and thresholds, for texts that lie in memory. share: the weight of each row."""
    index, value, ends = features(texts)
    owner = np.repeat(np.arange(len(grades)), np.diff(ends))
    used, place = np.unique(index, return_inverse=True)
    times = np.bincount(place * levels + grades[owner], minlength=len(used) * levels).reshape(-1, levels)
    scale = contrast(times, np.bincount(grades, minlength=levels))
    telling = scale >= MIN_RATIO
    kept = telling[place]
    weights, thresholds = fit_rows((np.cumsum(telling) - 1)[place[kept]], value[kept], owner[kept], grades, share, scale[telling], levels)
    whole = np.zeros(DIMENSIONS, np.float32)
    whole[used[telling]] = weights
    return whole, thresholds


def fit_rows(
    index: np.ndarray, value: np.ndarray, owner: np.ndarray, grades: np.ndarray, share: np.ndarray, scale: np.ndarray, levels: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the penalised cumulative-link likelihood.

    index, value, owner: the telling features of all rows, numbered from 0, and the row of each; scale: how well each
    feature marks lower grades; grades and share: grade and weight of each row. Thresholds are kept in order and LEAST_GAP apart. No weight is above 0: a text is
    held good until something speaks against it, so that short texts, which have few features, are not graded down.
    """
    value = value * scale[index]
    n, width, rows = len(grades), len(scale), np.arange(len(grades))
    share = share / share.sum()

    def slopes(score: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log likelihood by score and by threshold."""
        tail = np.hstack([np.ones((n, 1)), tails(score, thresholds), np.zeros((n, 1))])
        upper, lower = tail[rows, grades], tail[rows, grades + 1]
        chance = np.maximum(upper - lower, 1e-9)
        up, low = share * upper * (1 - upper) / chance, share * lower * (1 - lower) / chance
        return up - low, (np.bincount(grades + 1, low, levels + 1) - np.bincount(grades, up, levels + 1))[1:levels]

    reach = np.bincount(owner, value, n)
    step = 1.0 / (0.5 * np.bincount(index, (share * reach)[owner] * value, width) + PENALTY)  # bounds the curvature
    weights, thresholds = np.zeros(width), np.linspace(-1.0, 0.0, levels - 1)
    ahead = weights
    for k in range(ROUNDS):
        score = np.bincount(owner, ahead[index] * value, n)
        for _ in range(4):
            apart = LEAST_GAP * np.arange(levels - 1)
            thresholds = np.maximum.accumulate(thresholds + slopes(score, thresholds)[1] - apart) + apart
        by_weight = np.bincount(index, slopes(score, thresholds)[0][owner] * value, width) - PENALTY * ahead
        new = np.minimum(ahead + step * by_weight, 0.0)
        ahead = new + k / (k + 3) * (new - weights)
        weights = new
    return weights * scale, thresholds


def _chosen(reviewed: DataFrame, per_grade: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_grade` reviewed events of each grade by a hash of event_id, and how many each grade has.

    A threshold of the hash leaves little more than wanted of each grade before the rest is ranked.
    """
    grade = F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])[F.col("status")]
    rated = (
        reviewed.where(F.col("status").isin(*GRADES) & F.col("event_id").isNotNull())
        .groupBy("event_id").agg(F.min(grade).alias("grade")).withColumn("h", F.xxhash64("event_id"))
    )
    totals = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # 3 rows
    wanted = F.lit(False)
    for g, n in totals.items():
        reach = min(1.0, (1.1 * per_grade + 200) / n)
        wanted = wanted | ((F.col("grade") == g) & (F.col("h") <= min((1 << 63) - 1, int(reach * (1 << 64)) - (1 << 63))))
    rank = F.row_number().over(Window.partitionBy("grade").orderBy("h", "event_id"))
    return rated.where(wanted).withColumn("rank", rank).where(F.col("rank") <= per_grade).select("event_id", "grade"), totals


def _sampled_features(sample: DataFrame) -> DataFrame:
    """Features of the sampled texts, and their lowest shingle hash, by which copies are told."""
    schema = T.StructType([sample.schema["event_id"], *[T.StructField(n, t) for n, t in (
        ("grade", T.IntegerType()), ("h", T.LongType()), ("lowest", T.LongType()), ("index", T.ArrayType(T.IntegerType())), ("value", T.ArrayType(T.FloatType())))]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "extracted_text", 1 << 20):
                text = batch.column("extracted_text")
                index, value, ends = features(text)
                lowest = [int(x[0].astype(np.int64)) if len(x) else 0 for x in W.shingle_sets(text, SHINGLE_WORDS)]
                bounds = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("event_id"), batch.column("grade"), batch.column("h"), pa.array(lowest, pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(index, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32()))],
                    names=schema.names,
                )

    return sample.mapInArrow(read, schema)


def _telling(rows: DataFrame, totals: np.ndarray) -> dict[int, float]:
    """Scale of each feature that marks lower grades, out of counts that Spark sums; some thousands."""
    levels = len(totals)
    times = [F.sum((F.col("grade") == g).cast("long")).alias(f"g{g}") for g in range(levels)]
    counts = rows.select("grade", F.explode("index").alias("feature")).groupBy("feature").agg(*times)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scale = contrast(np.stack([batch.column(f"g{g}").to_numpy() for g in range(levels)], axis=1), totals)
            good = np.flatnonzero(scale >= MIN_RATIO)
            yield pa.record_batch({"feature": batch.column("feature").take(pa.array(good)), "scale": pa.array(scale[good])})

    return dict(map(tuple, counts.where(" + ".join(f"g{g}" for g in range(levels)) + f" >= {MIN_TEXTS}").mapInArrow(keep, "feature int, scale double").collect()))


def fit_ratings(
    findings: DataFrame, reviewed: DataFrame, per_grade: int = SAMPLE_PER_GRADE
) -> Model | None:
    """Fit on reviewed findings, at most `per_grade` of each status, chosen by a hash of event_id.

    Of copies in the sample, told by their lowest shingle hash, one is kept. The rest is weighted back to the shares
    that the statuses have in all reviews. Several reviews of a finding
    count as the lowest one. None if there is no usable review. Spark reads the sampled texts, counts their features and finds the telling
    ones; one task gets those features of each sampled text, as pairs of small numbers, and never a text.
    """
    chosen, totals = _chosen(reviewed, per_grade)
    if not totals:
        return None
    sample = findings.select("event_id", "extracted_text").join(
        F.broadcast(chosen), "event_id"  # per_grade rows a status at most
    ).select("event_id", "grade", F.xxhash64("extracted_text").alias("h"), "extracted_text")
    read = settle(_sampled_features(sample))
    place = F.struct("event_id", "h", "grade")
    one = read.groupBy("lowest").agg(F.min(place).alias("k")).select("lowest", "k.*")
    rows = settle(read.join(one, ["lowest", "event_id", "h", "grade"], "left_semi").dropDuplicates(["lowest"]))
    seen = dict(rows.groupBy("grade").count().collect())  # 3 rows
    if not seen:
        return None
    levels = len(GRADES)
    scale = _telling(rows, np.array([seen.get(g, 0) for g in range(levels)]))
    places = np.array(sorted(scale), np.int64)
    scales = np.array([scale[k] for k in places.tolist()])
    shared = findings.sparkSession.sparkContext.broadcast(places)  # some thousands
    share = {g: n / min(n, per_grade) for g, n in totals.items()}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column("index")
            index, value = lists.flatten().to_numpy(), batch.column("value").flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(known, index), max(0, len(known) - 1))
            good = known[at] == index if len(known) else np.zeros(len(index), bool)
            bounds = pa.array(np.searchsorted(owner[good], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.record_batch({
                "lowest": batch.column("lowest"), "grade": batch.column("grade"),
                "index": pa.ListArray.from_arrays(bounds, pa.array(at[good], pa.int32())),
                "value": pa.ListArray.from_arrays(bounds, pa.array(value[good], pa.float32())),
            })

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # telling features of the sample
        table = table.sort_by("lowest").combine_chunks()
        lists, grades = table["index"].combine_chunks(), table["grade"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(grades)), pa.compute.list_value_length(lists).to_numpy())
        w = np.array([share[g] for g in grades.tolist()])
        weights, thresholds = fit_rows(lists.flatten().to_numpy(), table["value"].combine_chunks().flatten().to_numpy(), owner, grades, w / w.mean(), scales)
        yield pa.record_batch({"weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "thresholds": pa.array([thresholds.tolist()])})

    narrowed = rows.select("lowest", "grade", "index", "value").mapInArrow(narrow, "lowest long, grade int, index array<int>, value array<float>")
    row = narrowed.repartition(1).mapInArrow(train, "weights array<double>, thresholds array<double>").first()
    weights = np.array(row[0])
    some = np.flatnonzero(weights)
    return (places[some], weights[some]), np.array(row[1])


def rate_findings(
    findings: DataFrame, model: Model | None, min_tail: float = MIN_TAIL
) -> DataFrame:
    """Add expected_grade, tail_probability (of the highest grade) and selected to every finding.

    findings: event_id, extracted_text, any other columns; columns of the three added names are replaced. A text
    that is null or has no words gets grade 0, tail 0 and is not selected. Without a model all others get the
    highest grade and are selected. Rows are neither dropped nor merged; an empty table stays empty.
    """
    added = ["expected_grade", "tail_probability", "selected"]
    base = findings.select(*[F.col(f"`{c}`") for c in findings.columns if c not in added])
    schema = T.StructType([*base.schema.fields, T.StructField("expected_grade", T.DoubleType()),
                           T.StructField("tail_probability", T.DoubleType()), T.StructField("selected", T.BooleanType())])
    shared = base.sparkSession.sparkContext.broadcast(model)  # the features that mark lower grades, some thousands

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None:
            (places, values), thresholds = shared.value
            weights = np.zeros(DIMENSIONS, np.float32)
            weights[places] = values
        for whole in batches:
            for batch in W.slices(whole, "extracted_text", 1 << 20):
                text = batch.column("extracted_text")
                if shared.value is None:
                    tail = np.ones((batch.num_rows, 2))
                else:
                    tail = tails(scores(text, weights), thresholds)
                bounds = W.words(*W.utf8(text))[3]
                tail[bounds[1:] == bounds[:-1]] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(tail.sum(axis=1)), pa.array(tail[:, -1]), pa.array((tail[:, -1] >= min_tail) & (bounds[1:] > bounds[:-1]))],
                    names=[*batch.schema.names, *added],
                )

    return base.mapInArrow(rate, schema)
