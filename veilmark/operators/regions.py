"""Where to hide what: keyframe interpolation, padding, merging and coverage of regions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions import geometry as geo
from veilmark.functions.numeric import clamp, ms_to_frame, round_up_half, whole
from veilmark.plans.ordered import chunk_by, running
from veilmark.schemas import BOX_PAD, MERGE_GAP_PX, MIN_SIDE_PX, TEMPORAL_PAD_MS

EVENT = ["video_id", "event_id"]
CHUNK_MS = 3_600_000


def frame_in_ranges(frame: Column, ranges: Column, fps: Column, pad_ms: int = 0) -> Column:
    """Whether a frame lies in any padded inclusive range; no ranges means always."""
    return (F.size(ranges) == 0) | F.exists(
        ranges,
        lambda r: frame.between(ms_to_frame(r["start_ms"] - pad_ms, fps), ms_to_frame(r["end_ms"] + pad_ms, fps)),
    )


def envelope_side(side: Column, share: float = BOX_PAD) -> Column:
    """Largest side plus a truncated share on both ends."""
    return side + whole(side * share) * 2


def keyframe_pairs(
    keyframes: DataFrame, fps: Column, order: list[str], chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Consecutive keyframes of an event as gaps to fill, with their frame numbers.

    Keyframes with a column `prior`, as a linking run gives it, name the keyframe before themselves and are not moved.
    """
    boxed = F.struct("time_ms", "x", "y", "w", "h")
    if "prior" in keyframes.columns:
        paired = keyframes.withColumnRenamed("prior", "a")
    else:
        paired = running(keyframes, EVENT, order, chunk_by("time_ms", chunk_ms), prior={"a": boxed})
    return paired.filter("a IS NOT NULL").select(
        *EVENT, "a", boxed.alias("b"), *[c for c in order if c != "time_ms"],
        ms_to_frame(F.col("a.time_ms"), fps).alias("start_frame"),
        ms_to_frame(F.col("time_ms"), fps).alias("end_frame"),
    )


def event_spans(keyframes: DataFrame, order: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per event: first and last keyframe, the largest sides and further aggregates where wanted."""
    place, point = F.struct(*order), F.struct("time_ms", "x", "y", "w", "h")
    return keyframes.groupBy(*EVENT).agg(
        F.min_by(point, place).alias("first"), F.max_by(point, place).alias("last"),
        F.max("w").alias("max_w"), F.max("h").alias("max_h"), F.max("confidence").alias("confidence"),
        *[value.alias(name) for name, value in (carry or {}).items()],
    )


def frame_limits(ranges: DataFrame, fps: float, pad_ms: int = TEMPORAL_PAD_MS) -> DataFrame:
    """Padded ranges (video_id, event_id, start_ms, end_ms) as runs of frames (_lo, _hi) of which no two share a frame."""
    rate = F.lit(float(fps))
    low, high = ms_to_frame(F.col("start_ms") - pad_ms, rate, "long"), ms_to_frame(F.col("end_ms") + pad_ms, rate, "long")
    known = low.isNotNull() & high.isNotNull()
    limits = ranges.select(
        *EVENT, F.when(known, low).otherwise(1).alias("_lo"), F.when(known, high).otherwise(0).alias("_hi")
    )
    along = Window.partitionBy(*EVENT).orderBy("_lo", "_hi")
    apart = F.col("_lo") > F.coalesce(F.max("_hi").over(along.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("_lo") - 1)
    return (
        limits.withColumn("_new", apart.cast("long")).withColumn("_island", F.sum("_new").over(along))
        .groupBy(*EVENT, "_island").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).drop("_island")
    )


def _frames_between(low: Column, high: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(empty)


def event_frames(
    keyframes: DataFrame, fps: float, order: list[str], pad_ms: int = TEMPORAL_PAD_MS,
    frame_w: Column | None = None, frame_h: Column | None = None, share: float = BOX_PAD,
    chunk_ms: int = CHUNK_MS, carry: dict[str, Column] | None = None, span: int | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """Every frame an event covers, with the box to hide there.

    The box has the event's envelope size; only its centre moves, linearly between keyframes, and
    holds before the first and after the last one. Each gap between two keyframes fills its own
    frames, so no as-of search is needed and a long event is spread over its gaps.

    `carry` names aggregates over an event's keyframes that its frames hold too. With `span`, the gaps of a video are cut
    and put together by spans of that many frames (column `_span`) before they are filled, so that the frames, which are
    many more, need not be moved to be merged. With `within`, runs of frames as `frame_limits` gives them, only frames in
    one of the event's runs are filled; events without any stay whole.
    """
    rate = F.lit(float(fps))
    pad_frames = int((pad_ms / 1000) * fps)
    spans = event_spans(keyframes, order, carry).withColumns({
        "env_w": envelope_side(F.col("max_w"), share), "env_h": envelope_side(F.col("max_h"), share),
        "first_frame": ms_to_frame(F.col("first.time_ms"), rate, "long"),
        "last_frame": ms_to_frame(F.col("last.time_ms"), rate, "long"),
    })
    told = ["confidence", *(carry or {})]
    edges = []
    if within is not None:
        spans, edges = spans.join(within, EVENT, "left"), ["_lo", "_hi"]
    head = spans.select(*EVENT, *told, "env_w", "env_h", "first", "last", "first_frame", "last_frame", *edges)
    t_first, t_last = F.col("first.time_ms").alias("t_first"), F.col("last.time_ms").alias("t_last")
    both = [*EVENT, *told, "env_w", "env_h", t_first, t_last, *edges]

    def mark(box: str) -> Column:
        cx, cy = geo.center(F.col(box))
        return F.struct(F.col(f"{box}.time_ms").alias("time_ms"), cx.alias("cx"), cy.alias("cy"))

    # Runs of frames (low, high) between two marks: held ones around the ends of an event, moving ones in its gaps.
    low, end = F.greatest(F.lit(0), F.col("first_frame") - pad_frames), F.col("last_frame") + pad_frames
    upto = F.least(F.col("first_frame") + 1, end)
    held = head.select(
        *both, mark("first").alias("a"), mark("last").alias("b"), F.lit(False).alias("moving"),
        F.explode(F.array(
            F.struct(low.alias("low"), upto.alias("high")),
            F.struct(F.greatest(low, F.col("last_frame") - 1, upto + 1).alias("low"), end.alias("high")),
        )).alias("run"),
    )
    # The head of an event goes to each chunk that its gaps may end in, so that a long event's gaps are filled by as many
    # tasks. A gap without length fills no frame.
    heads = head.filter("first.time_ms < last.time_ms").withColumn("_piece", F.explode(F.sequence(
        chunk_by(F.col("first.time_ms"), chunk_ms), chunk_by(F.col("last.time_ms"), chunk_ms)
    )))
    gaps = keyframe_pairs(keyframes, rate, order, chunk_ms).filter("a.time_ms < b.time_ms").select(
        *EVENT, "a", "b", "start_frame", "end_frame", chunk_by(F.col("b.time_ms"), chunk_ms).alias("_piece")
    ).join(heads, [*EVENT, "_piece"])
    moving = gaps.select(
        *both, mark("a").alias("a"), mark("b").alias("b"), F.lit(True).alias("moving"),
        F.struct(
            F.greatest(F.lit(0), F.col("start_frame") - 1).cast("long").alias("low"), (F.col("end_frame") + 1).cast("long").alias("high")
        ).alias("run"),
    )
    runs = held.unionByName(moving)
    if edges:
        runs = runs.withColumn("run", F.struct(
            F.greatest("run.low", "_lo").alias("low"), F.least("run.high", "_hi").alias("high")
        ))
    runs = runs.filter("run.low <= run.high")
    if span is not None:
        parts = F.explode(F.sequence(F.floor(F.col("run.low") / span), F.floor(F.col("run.high") / span)))
        edge = F.col("_span") * span
        # As many parts as set for shuffles: joining small ones would go by their size before they are filled.
        tasks = int(keyframes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = runs.withColumn("_span", parts).withColumn("run", F.struct(
            F.greatest("run.low", edge).alias("low"), F.least(F.col("run.high"), edge + (span - 1)).alias("high")
        )).repartition(tasks, "video_id", "_span")

    at = (F.col("frame_idx") / rate) * F.lit(1000)
    here = (at > F.col("t_first")) & (at < F.col("t_last"))
    done = (at - F.col("a.time_ms")) / (F.col("b.time_ms") - F.col("a.time_ms"))

    def along(c: str) -> Column:
        before, after = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(F.col("moving"), geo.lerp(before, after, done)).when(at <= F.col("t_first"), before).otherwise(after)

    frames = runs.withColumn("frame_idx", F.explode(F.sequence("run.low", "run.high"))).filter(
        F.when(F.col("moving"), here & (at > F.col("a.time_ms")) & (at <= F.col("b.time_ms"))).otherwise(~here)
    ).withColumns({"cx": along("cx"), "cy": along("cy")})
    x = whole(F.col("cx") - F.col("env_w") / 2)
    y = whole(F.col("cy") - F.col("env_h") / 2)
    if frame_w is not None and frame_h is not None:
        x = clamp(x, 0, frame_w - F.col("env_w"))
        y = clamp(y, 0, frame_h - F.col("env_h"))
    return frames.select(
        *EVENT, F.col("frame_idx").cast("int").alias("frame_idx"), *told,
        x.alias("x"), y.alias("y"), F.col("env_w").alias("w"), F.col("env_h").alias("h"), *(["_span"] if span is not None else []),
    )


def within_ranges(frames: DataFrame, ranges: DataFrame, fps: float, pad_ms: int = TEMPORAL_PAD_MS) -> DataFrame:
    """Keep frames of an event that fall in one of its padded ranges (video_id, event_id, start_ms, end_ms).

    Events without any range stay whole.
    """
    rate = F.lit(float(fps))
    limits = ranges.select(
        *EVENT, ms_to_frame(F.col("start_ms") - pad_ms, rate).alias("_lo"),
        ms_to_frame(F.col("end_ms") + pad_ms, rate).alias("_hi"),
    )
    inside = frames.join(
        limits,
        [frames[k] == limits[k] for k in EVENT] + [frames["frame_idx"].between(limits["_lo"], limits["_hi"])],
        "left_semi",
    )
    free = frames.join(limits.select(*EVENT).distinct(), EVENT, "left_anti")
    return inside.unionByName(free)


# ---- polygons --------------------------------------------------------------------------------

def polygon_frames(
    keyframes: DataFrame, fps: float, order: list[str], pad_ms: int = TEMPORAL_PAD_MS, chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Frames of events drawn as polygons: at keyframes, between them, and held around them.

    Keyframes carry `bbox` and a nullable `polygon`; shapes with equal vertex counts are blended.
    """
    rate = F.lit(float(fps))
    pad_frames = int((pad_ms / 1000) * fps)
    point = F.struct("time_ms", "bbox", "polygon")
    frame = ms_to_frame(F.col("time_ms"), rate)
    at_keys = keyframes.select(*EVENT, frame.alias("frame_idx"), "bbox", "polygon")
    pairs = running(keyframes, EVENT, order, chunk_by("time_ms", chunk_ms), prior={"a": point}).filter(
        "a IS NOT NULL"
    ).withColumn("f0", ms_to_frame(F.col("a.time_ms"), rate)).withColumn("f1", frame)
    between = pairs.filter("f1 - f0 > 1").withColumn(
        "frame_idx", F.explode(F.sequence(F.col("f0") + 1, F.col("f1") - 1))
    )
    t = (F.col("frame_idx") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    shape = F.when(
        F.col("a.polygon").isNotNull() & F.col("polygon").isNotNull(),
        geo.lerp_polygon(F.col("a.polygon"), F.col("polygon"), t),
    ).otherwise(F.col("a.polygon"))
    between = between.select(
        *EVENT, "frame_idx", geo.lerp_box(F.col("a.bbox"), F.col("bbox"), t).alias("bbox"),
        shape.alias("polygon"),
    )
    place = F.struct(*order)
    ends = keyframes.groupBy(*EVENT).agg(
        F.min_by(point, place).alias("first"), F.max_by(point, place).alias("last")
    )
    f_first, f_last = (ms_to_frame(F.col(f"{n}.time_ms"), rate) for n in ("first", "last"))
    before = ends.select(*EVENT, "first.bbox", "first.polygon", F.explode(
        _frames_between(F.greatest(F.lit(0), f_first - pad_frames), f_first - 1)
    ).alias("frame_idx"))
    after = ends.select(*EVENT, "last.bbox", "last.polygon", F.explode(
        _frames_between(f_last + 1, f_last + pad_frames)
    ).alias("frame_idx"))
    return at_keys.unionByName(between).unionByName(before).unionByName(after).withColumn(
        "frame_idx", F.col("frame_idx").cast("int")
    )


# ---- merging ---------------------------------------------------------------------------------

def rects_close(a: Column, b: Column, gap: int = MERGE_GAP_PX) -> Column:
    """Two rectangles overlap or are at most `gap` apart on both axes."""
    return (
        (a["x"] + a["w"] + gap >= b["x"]) & (b["x"] + b["w"] + gap >= a["x"])
        & (a["y"] + a["h"] + gap >= b["y"]) & (b["y"] + b["h"] + gap >= a["y"])
    )


_SIDES = ["x1", "y1", "x2", "y2"]


def _close_pairs(frame: np.ndarray, box: dict[str, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Near rectangles of a frame, by one plane sweep over all frames at once.

    Rows are sorted by frame and left side. Each is compared with the next one, then the one after it, and so on, as long as
    that one still starts within reach.
    """
    here, step, pairs = np.arange(len(frame)), 1, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(here):
        here = here[here + step < len(frame)]
        other = here + step
        reach = (frame[other] == frame[here]) & (box["x1"][other] <= box["x2"][here] + gap)
        here, other = here[reach], other[reach]
        near = (box["y1"][other] <= box["y2"][here] + gap) & (box["y1"][here] <= box["y2"][other] + gap)
        pairs.append((here[near], other[near]))
        step += 1
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is joined to by pairs (a, b)."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[a], top[b])
        before = top.copy()
        np.minimum.at(top, top[a], low)
        np.minimum.at(top, top[b], low)
        top = top[top]
        if (top == before).all():
            return top


def _unite(frame: np.ndarray, box: dict[str, np.ndarray], confidence: np.ndarray, rank: np.ndarray, members: np.ndarray, gap: int) -> tuple:
    """Unite near rectangles of each frame until none are near: (kept row, members, sides) of each result."""
    row = np.arange(len(frame))
    while True:
        order = np.lexsort((box["x1"], frame))
        frame, row, members = frame[order], row[order], members[order]
        box = {c: v[order] for c, v in box.items()}
        a, b = _close_pairs(frame, box, gap)
        if not len(a):
            return row, members, box
        top = _joined(len(frame), a, b)
        first = np.lexsort((rank[row], -confidence[row], top))
        heads = first[np.flatnonzero(np.diff(top[first], prepend=-1))]  # the surest row of each group
        group = np.cumsum(np.diff(top[first], prepend=-1) != 0) - 1
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        box = {c: (np.minimum if c.endswith("1") else np.maximum).reduceat(v[first], starts) for c, v in box.items()}
        frame, row, members = frame[heads], row[heads], np.add.reduceat(members[first], starts)


# Rows of one frame that are held before those whose corners share a cell are united.
_HELD_ROWS = 100_000
_COLUMNS = ["video_id", "frame_idx", "event_id", "confidence", "members", *_SIDES, "rank"]


def _best_rows(group: list[np.ndarray], box: dict[str, np.ndarray], confidence: np.ndarray, rank: np.ndarray, members: np.ndarray) -> tuple:
    """Unite rows that agree in all `group` columns: (kept row, members, sides) of each group."""
    order = np.lexsort((rank, -confidence, *group))
    change = np.zeros(len(order), bool)
    change[:1] = True
    for column in group:
        change[1:] |= np.diff(column[order]) != 0
    starts = np.flatnonzero(change)
    sides = {c: (np.minimum if c.endswith("1") else np.maximum).reduceat(v[order], starts) for c, v in box.items()}
    return order[starts], np.add.reduceat(members[order], starts), sides


def _unite_frames(gap: int, names: list[str]):
    """Unite the rectangles of whole frames, which arrive one after the other; rows with a polygon stay as they are."""
    shaped = "polygon" in names

    def numbered(table: pa.Table) -> np.ndarray:
        video = table["video_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        number = table["frame_idx"].to_numpy()
        return np.cumsum((np.diff(video, prepend=-2) != 0) | (np.diff(number, prepend=number[:1] - 1) != 0))

    def by_cell(table: pa.Table) -> pa.Table:
        """One row for all rectangles of a frame whose corners share a grid cell."""
        table = table.combine_chunks()
        box = {c: table[c].to_numpy().astype(np.int64) for c in _SIDES}
        rows, members, sides = _best_rows(
            [box["y1"] // gap, box["x1"] // gap, numbered(table)], box, table["confidence"].to_numpy(), table["rank"].to_numpy(),
            table["members"].to_numpy(),
        )
        new = {"members": pa.array(members), **{c: pa.array(v) for c, v in sides.items()}}
        kept = table.take(pa.array(rows))
        return pa.table({c: new.get(c, kept[c]) for c in _COLUMNS})

    def out(kept: pa.Table, members: np.ndarray, sides: dict[str, np.ndarray], polygon: pa.ChunkedArray | None = None) -> pa.RecordBatch:
        x1, y1, x2, y2 = (sides[c] for c in _SIDES)
        new = {"members": pa.array(members)} | {c: pa.array(v, pa.int32()) for c, v in zip("xywh", (x1, y1, x2 - x1, y2 - y1))}
        if shaped:
            shape = pa.list_(pa.list_(pa.int32()))
            new["polygon"] = pa.nulls(len(members), shape) if polygon is None else polygon.cast(shape)
        columns = [new[c] if c in new else kept[c] for c in names]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    def done(table: pa.Table) -> pa.RecordBatch:
        table = by_cell(table)
        row, members, sides = _unite(
            numbered(table), {c: table[c].to_numpy() for c in _SIDES}, table["confidence"].to_numpy(), table["rank"].to_numpy(),
            table["members"].to_numpy(), gap,
        )
        return out(table.take(pa.array(row)), members, sides)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key = lambda some, i: (some["video_id"][i].as_py(), some["frame_idx"][i].as_py())
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if shaped:
                alone = table["polygon"].is_valid()
                solo, table = table.filter(alone), table.filter(pc.invert(alone))
                if solo.num_rows:
                    yield out(solo, solo["members"].to_numpy(), {c: solo[c].to_numpy() for c in _SIDES}, solo["polygon"])
            if not table.num_rows:
                continue
            table = table.select(_COLUMNS)
            last = key(table, table.num_rows - 1)
            if not (held and key(held[0], 0) == last):
                # The last frame may go on in the next batch.
                low, high = 0, table.num_rows - 1
                while low < high:
                    middle = (low + high) // 2
                    low, high = (low, middle) if key(table, middle) == last else (middle + 1, high)
                if held or low:
                    yield done(pa.concat_tables([*held, table.slice(0, low)]))
                held, table = [], table.slice(low)
            held.append(table)
            if len(held) > 1 and sum(t.num_rows for t in held) > _HELD_ROWS:
                held = [by_cell(pa.concat_tables(held))]
        if held:
            yield done(pa.concat_tables(held))

    return step


def merge_regions(regions: DataFrame, gap: int = MERGE_GAP_PX, rank: str = "event_ord") -> DataFrame:
    """Unite the rectangles of each frame that overlap or nearly touch; the surest event is kept.

    regions: video_id, frame_idx, event_id, confidence, x, y, w, h and the `rank` column; where a column `polygon` is
    there, rows with a polygon are neither united nor do they draw others together, and the result has the column too.
    Regions with a column `_span` already lie together by (video_id, _span), as `event_frames` leaves them.

    Rectangles whose corners share a grid cell of the gap's size are near for certain, so they are
    united first. After that a frame holds at most one rectangle per cell,
    which bounds a frame by its area whatever the number of regions. One pass over whole frames then sweeps each
    and unites what is near, again and again until nothing is. Ties in confidence go to the lower `rank`.
    """
    shaped = "polygon" in regions.columns
    polygon = ["CASE WHEN size(polygon) > 0 THEN CAST(polygon AS ARRAY<ARRAY<INT>>) END AS polygon"] if shaped else []
    together = regions if "_span" in regions.columns else regions.repartition("video_id", "frame_idx")
    ready = together.selectExpr(
        "CAST(video_id AS STRING) video_id", "CAST(frame_idx AS LONG) frame_idx", "CAST(event_id AS STRING) event_id",
        "CAST(confidence AS DOUBLE) confidence", "1L members", "CAST(x AS LONG) x1", "CAST(y AS LONG) y1", "CAST(x + w AS LONG) x2",
        "CAST(y + h AS LONG) y2", f"CAST({rank} AS LONG) AS rank", *polygon,
    ).sortWithinPartitions("video_id", "frame_idx")
    names = ["video_id", "frame_idx", "event_id", "confidence", "members", *"xywh", *(["polygon"] if shaped else [])]
    kinds = dict(regions.dtypes)
    schema = "video_id string, frame_idx long, event_id string, confidence double, members long, x int, y int, w int, h int" + (", polygon array<array<int>>" if shaped else "")
    return ready.mapInArrow(_unite_frames(gap, names), schema).withColumn("frame_idx", F.col("frame_idx").cast(kinds["frame_idx"]))


# ---- overlay and hit tests -------------------------------------------------------------------

def active_at(
    probes: DataFrame, ranges: DataFrame, pad_ms: int = 0, bucket_ms: int = 60_000
) -> DataFrame:
    """Events that are active at a probe time, except rejected ones.

    Ranges are laid out over time buckets, so the join is on (video, bucket) and only near rows meet.
    """
    low, high = F.col("start_ms") - pad_ms, F.col("end_ms") + pad_ms
    laid = ranges.filter("status <> 'rejected'").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(low / bucket_ms), F.floor(high / bucket_ms)))
    )
    asked = probes.withColumn("_bucket", F.floor(F.col("at_ms") / bucket_ms))
    return asked.join(laid, ["video_id", "_bucket"]).filter(
        (F.col("at_ms") >= low) & (F.col("at_ms") <= high)
    ).drop("_bucket")


def _boxes_at(
    asked: DataFrame, keyframes: DataFrame, order: list[str], chunk_ms: int, once: bool = False
) -> DataFrame:
    """Asked rows (video_id, event_id, at_ms and others) with the event's `bbox` at the time; with `once` equal ones are one.

    The first keyframe of each time is a mark in its chunk of the event. Where two marks that follow each other lie in
    different chunks, both lie in each chunk from the one to the other, so that every chunk is swept on its own.
    """
    if "prior" not in keyframes.columns:
        keyframes = running(
            keyframes, EVENT, order, chunk_by("time_ms", chunk_ms), prior={"prior": F.struct("time_ms", "x", "y", "w", "h")}
        )
    box, place = F.struct("x", "y", "w", "h"), F.struct(*order)
    before = F.struct(*[F.col(f"prior.{c}").alias(c) for c in "xywh"])
    leads = F.col("prior").isNull() | (F.col("prior.time_ms") < F.col("time_ms"))
    piece = lambda at: chunk_by(at, chunk_ms)
    mark = lambda at, shape: F.struct(F.col(at).alias("time_ms"), shape.alias("box")).alias("_mark")
    own = keyframes.filter(leads).select(*EVENT, piece("time_ms").alias("_piece"), mark("time_ms", box))
    # Of keyframes with equal times the first counts, also for the chunks after it.
    tied = keyframes.filter(~leads).groupBy(*EVENT, F.col("time_ms").alias("_from")).agg(F.min_by(before, place).alias("_first"))
    crossing = keyframes.filter(leads & (piece("prior.time_ms") < piece("time_ms"))).select(
        *EVENT, F.col("prior.time_ms").alias("_from"), "time_ms", before.alias("_before"), box.alias("_box")
    ).join(tied, [*EVENT, "_from"], "left")
    onward = crossing.select(
        *EVENT, F.explode(F.sequence(piece("_from") + 1, piece("time_ms"))).alias("_piece"),
        mark("_from", F.coalesce("_first", "_before")),
    )
    back = crossing.select(
        *EVENT, F.explode(F.sequence(piece("_from"), piece("time_ms") - 1)).alias("_piece"), mark("time_ms", F.col("_box"))
    )
    rest = [c for c in asked.columns if c not in (*EVENT, "at_ms")]
    stacked = own.unionByName(onward).unionByName(back).withColumns({
        "at_ms": F.col("_mark.time_ms"), "_kind": F.lit(0)
    }).unionByName(asked.withColumns({"_piece": piece("at_ms"), "_kind": F.lit(1)}), allowMissingColumns=True)
    chunk = Window.partitionBy(*EVENT, "_piece")
    swept = stacked.withColumns({
        "hit": F.last("_mark", ignorenulls=True).over(
            chunk.orderBy("at_ms", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.last("_mark", ignorenulls=True).over(
            chunk.orderBy(F.desc("at_ms"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }).filter("_kind = 1").select(*EVENT, "_piece", "at_ms", *rest, "hit", "after")
    if once:
        swept = swept.dropDuplicates([*EVENT, "_piece", "at_ms", *rest])
    spans = keyframes.groupBy(*EVENT).agg(
        F.max("w").alias("max_w"), F.max("h").alias("max_h"), F.count("*").alias("n_keyframes"),
        F.min("time_ms").alias("t_first"), F.min_by(box, place).alias("only"),
        F.max_by(box, F.when(leads, F.col("time_ms"))).alias("final"),
    )
    (bx, by), (ax, ay) = geo.center(F.col("hit.box")), geo.center(F.col("after.box"))
    (fx, fy), (lx, ly) = geo.center(F.col("only")), geo.center(F.col("final"))
    t = (F.col("at_ms") - F.col("hit.time_ms")) / (F.col("after.time_ms") - F.col("hit.time_ms"))

    def along(first: Column, last: Column, before: Column, after: Column) -> Column:
        # Chunks without a mark lie before the first or after the last keyframe.
        return F.when(F.col("hit").isNull(), F.when(F.col("at_ms") < F.col("t_first"), first).otherwise(last)).when(
            F.col("after").isNull(), before
        ).otherwise(geo.lerp(before, after, t))

    cx, cy = along(fx, lx, bx, ax), along(fy, ly, by, ay)
    moved = geo.make_box(
        round_up_half(cx - F.col("max_w") / 2), round_up_half(cy - F.col("max_h") / 2),
        F.col("max_w"), F.col("max_h"),
    )
    return swept.join(spans, EVENT).select(
        *EVENT, "at_ms", *rest, F.when(F.col("n_keyframes") == 1, F.col("only")).otherwise(moved).alias("bbox")
    )


def box_at_time(
    asked: DataFrame, keyframes: DataFrame, order: list[str], chunk_ms: int = CHUNK_MS
) -> DataFrame:
    """Overlay box of each asked (video_id, event_id, at_ms).

    One keyframe gives its own box; else the envelope, centred between the keyframe at or before and
    the one after the time, rounded half up. Of keyframes with equal times the first counts. Keyframes with a column
    `prior`, as a linking run gives it, need no search for the one before.
    """
    return _boxes_at(asked.select(*EVENT, "at_ms"), keyframes, order, chunk_ms, once=True)


def hit_test(
    probes: DataFrame, ranges: DataFrame, keyframes: DataFrame, order: list[str], rank: str,
    bucket_ms: int = 60_000, chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Topmost active event under each probe point (probe_id, video_id, at_ms, px, py)."""
    active = active_at(probes, ranges, 0, bucket_ms).select(*EVENT, "at_ms", "probe_id", "px", "py", rank)
    return (
        _boxes_at(active, keyframes, order, chunk_ms)
        .filter(geo.contains_point(F.col("bbox"), F.col("px"), F.col("py")))
        .groupBy("probe_id").agg(F.max_by("event_id", rank).alias("event_id"))
    )


# ---- edits -----------------------------------------------------------------------------------

def upsert_keyframes(keyframes: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the box of keyframes at an edited time, or add a keyframe there.

    Edits are (video_id, event_id, time_ms, edit_seq, x, y, w, h); the last edit of a time counts. Keyframes and edits meet
    in one shuffle.
    """
    sides = F.struct(*[F.col(c) for c in "xywh"])
    key = [*EVENT, "time_ms"]
    others = [c for c in keyframes.columns if c not in key]
    newest = edits.groupBy(*key).agg(F.max_by(sides, "edit_seq").alias("_new"))
    met = keyframes.select(*key, F.struct(*others).alias("_old")).join(newest, key, "full_outer")
    kinds = dict(keyframes.dtypes)
    return met.select(*[
        F.col(c) if c in key
        else F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).cast(kinds[c]).alias(c) if c in "xywh"
        else F.col(f"_old.{c}").alias(c) for c in keyframes.columns
    ])


def manual_events(drawn: DataFrame, min_side: int = MIN_SIDE_PX) -> DataFrame:
    """Drawn corners or polygons become accepted events of one keyframe; small ones are refused.

    Columns: video_id, drawn_id, at_ms, x1, y1, x2, y2 and a nullable `polygon` of [x, y] shares.
    """
    poly = F.transform("polygon", lambda p: F.array(round_up_half(p[0]), round_up_half(p[1])))
    # The size test of a rectangle uses the exact sides, that of a polygon the rounded ones.
    exact_w, exact_h = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    rect = geo.make_box(
        round_up_half(F.least("x1", "x2")), round_up_half(F.least("y1", "y2")),
        round_up_half(exact_w), round_up_half(exact_h),
    )
    shaped = drawn.withColumn("polygon", F.when(F.col("polygon").isNotNull(), poly)).withColumn(
        "bbox", F.when(F.col("polygon").isNotNull(), geo.polygon_box(F.col("polygon"), False)).otherwise(rect)
    )
    w = F.when(F.col("polygon").isNotNull(), F.col("bbox.w").cast("double")).otherwise(exact_w)
    h = F.when(F.col("polygon").isNotNull(), F.col("bbox.h").cast("double")).otherwise(exact_h)
    return shaped.filter((w >= min_side) & (h >= min_side)).select(
        "video_id", F.sha2(F.concat_ws(":", F.lit("manual"), "video_id", F.col("drawn_id").cast("string")), 256)
        .alias("event_id"), "drawn_id",
        F.lit("manual").alias("source"), F.lit("manual").alias("pii_type"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("extracted_text"), F.col("at_ms").alias("start_ms"),
        F.col("at_ms").alias("end_ms"), "bbox", "polygon", F.lit("none").alias("tracking_method"),
        F.lit("accepted").alias("status"),
    )


def static_pins(events: DataFrame, videos: DataFrame) -> DataFrame:
    """Pin events for the whole duration of their video."""
    return events.join(videos.select("video_id", "duration_ms"), "video_id").withColumns({
        "start_ms": F.lit(0), "end_ms": F.col("duration_ms").cast("int"), "tracking_method": F.lit("none"),
    }).drop("duration_ms")


# ---- coverage and output ---------------------------------------------------------------------

def redaction_coverage(regions: DataFrame, videos: DataFrame) -> DataFrame:
    """Frames with a region and their share of the video (video_id, total_frames)."""
    covered = regions.select("video_id", "frame_idx").distinct().groupBy("video_id").agg(
        F.count("*").alias("covered_frames")
    )
    return videos.join(covered, "video_id", "left").select(
        "video_id", "total_frames", F.coalesce("covered_frames", F.lit(0)).alias("covered_frames"),
        (F.coalesce("covered_frames", F.lit(0)) / F.col("total_frames")).alias("coverage"),
    )


def even_size(side: Column) -> Column:
    """Nearest even number, halves to even, at least 2."""
    return F.greatest(F.lit(2), (F.bround(side / 2, 0) * 2).cast("int"))


# ---- fixed values: named output heights ------------------------------------------------------
OUTPUT_HEIGHTS = {"720p": 720, "1080p": 1080, "4K": 2160}


def output_size(
    w: Column, h: Column, resolution: Column, custom_w: Column, custom_h: Column
) -> tuple[Column, Column]:
    """Output width and height for a resolution setting."""
    height = F.try_element_at(
        F.create_map(*[F.lit(v) for pair in OUTPUT_HEIGHTS.items() for v in pair]), resolution
    )
    custom = (resolution == "custom") & (F.coalesce(custom_w, F.lit(0)) != 0) & (F.coalesce(custom_h, F.lit(0)) != 0)
    out_w = F.when(height.isNotNull(), even_size(w * (height / h))).when(custom, even_size(custom_w)).otherwise(even_size(w))
    out_h = F.when(height.isNotNull(), height).when(custom, even_size(custom_h)).otherwise(even_size(h))
    return out_w, out_h
