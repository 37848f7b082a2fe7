"""Linking candidates of one kind and place into time-ranged events.

A candidate joins the earliest opened event of its video and kind whose last keyframe is recent enough,
near enough and not behind a scene cut; else it opens an event. The rule is sequential, but an event
older than the gap can never be joined again, so the state at any moment is the few events still open.

Hence the time axis is cut into chunks and every (video, kind, chunk) is walked on its own, as a stream
over sorted partitions that keeps only the open events. The tail of the chunk before is replayed as a
warm-up to guess the state at the chunk's start. The guess is then checked against the true end state of
the chunk before; a chunk that guessed wrong (rare, since regions repeat from sample to sample) is walked
again from the true state. So the result is exact while a video that holds a third of all rows is
still spread over as many tasks as it has chunks.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.geometry import center_of
from veilmark.plans.ordered import chunk_by, latest_before, running
from veilmark.plans.session import settle, shared_folder
from veilmark.schemas import LINK_GAP_MS, LINK_TOLERANCE_PX

KIND = ["video_id", "pii_type"]
ORDER = ["time_ms", "cand_ord"]


def event_key(video: str, pii_type: str, start: str, first: str) -> Column:
    """Stable event id from the candidate that opened the event."""
    return F.sha2(F.concat_ws(":", video, pii_type, F.col(start).cast("string"), F.col(first).cast("string")), 256)


def with_last_cut(candidates: DataFrame, cuts: DataFrame, chunk_ms: int) -> DataFrame:
    """Add the latest scene cut strictly before each candidate.

    A cut lies strictly between an earlier time and the candidate exactly when this one does.
    """
    return latest_before(candidates, cuts, ["video_id"], "time_ms", "cut_ms", "last_cut", chunk_ms)


def gap_islands(candidates: DataFrame, gap_ms: int = LINK_GAP_MS, chunk_ms: int | None = None) -> DataFrame:
    """Candidates with the island they fall in by silence alone, named after its first candidate."""
    chunk = chunk_by("time_ms", chunk_ms or 64 * gap_ms)
    looked = running(candidates, KIND, ORDER, chunk, prior={"before_ms": F.col("time_ms")})
    opens = F.col("before_ms").isNull() | (F.col("time_ms") - F.col("before_ms") > gap_ms)
    return running(
        looked.withColumn("opens", opens), KIND, ORDER, chunk,
        last={"island": F.when(F.col("opens"), F.struct(*ORDER))},
    )


# Kinds of row that pass through the walk.
_ENTRY, _WARM, _OWN, _STATE_IN, _STATE_OUT, _END = range(6)


# The box and time of the keyframe before, where asked for.
_PRIOR = {"_prior_ms": pa.int64(), **{f"_prior_{c}": pa.int32() for c in "xywh"}}


def _walk(gap_ms: int, tolerance: float, chunk_ms: int, schema: T.StructType):
    """Walk sorted (video, kind, chunk) groups; rows come out with the event they belong to.

    A row's event is given by its opening candidate, or, for an event that was already open at the
    chunk's start, by that event's position in the start state. Besides the rows, the states at the
    chunk's start and end come out, for checking and stitching. A row with silence before and after it
    opens an event of its own and is not walked.
    """
    names = schema.fieldNames()
    reach = tolerance * tolerance
    prior = "_prior_ms" in names

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An open event: [last ms, last cx, last cy, last ord, seed ms, seed ord, position at start, last box]
        # The last box is a row of the batch at hand, or the box itself if that row is of a batch before.
        group, open_events, begun, ambiguous = None, [], False, False
        types = None

        def state_batch(places, states):
            """State rows (role, pos, event, ambiguous) as a batch, given their video, kind and chunk columns."""
            events = [e or [None] * 8 for _, _, e, _ in states]
            column = dict(zip(("video_id", "pii_type", "_chunk"), places)) | {
                "_role": [s[0] for s in states], "_pos": [s[1] for s in states], "_ambiguous": [s[3] for s in states],
                **{n: [e[k] for e in events] for n, k in (
                    ("time_ms", 0), ("_cx", 1), ("_cy", 2), ("cand_ord", 3), ("seed_ms", 4), ("seed_ord", 5), ("_ref", 6))},
            }
            if prior:
                column |= {c: [e[7] and e[7][k] for e in events] for k, c in enumerate("xywh")}
            return pa.RecordBatch.from_arrays([
                pa.nulls(len(states), types[n]) if n not in column
                else column[n] if isinstance(column[n], pa.Array) else pa.array(column[n], types[n]) for n in names
            ], names=names)

        def closing(chunk, events, unsure):
            border = (chunk + 1) * chunk_ms - gap_ms
            alive = [e for e in events if e[0] >= border]
            return [(_STATE_OUT, i, list(e), None) for i, e in enumerate(alive)] + [(_END, None, None, unsure)]

        for batch in batches:
            if types is None:
                types = {n: batch.schema.field(n).type for n in batch.schema.names}
                types |= {"seed_ms": pa.int64(), "seed_ord": pa.int64(), "_ref": pa.int32(), "_ambiguous": pa.bool_(), **_PRIOR}
            n = batch.num_rows
            if not n:
                continue
            video, kind = (batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy() for c in KIND)
            chunk, role, t = (batch.column(c).to_numpy() for c in ("_chunk", "_role", "time_ms"))
            key = lambda i: (batch.column("video_id")[i].as_py(), batch.column("pii_type")[i].as_py(), int(chunk[i]))  # noqa: B023, E731
            starts = np.zeros(n, bool)  # rows that begin a group
            starts[1:] = (np.diff(video) != 0) | (np.diff(kind) != 0) | (np.diff(chunk) != 0)
            own = role == _OWN
            fresh = starts.copy()  # rows before which no event is open
            fresh[1:] |= own[1:] & own[:-1] & (np.diff(t) > gap_ms)
            alone = np.zeros(n, bool)
            alone[:-1] = own[:-1] & fresh[:-1] & fresh[1:]
            first = key(0)
            if first != group:
                if group and begun:
                    states = closing(group[2], open_events, ambiguous)
                    yield state_batch([[k] * len(states) for k in group], states)
                group, open_events, begun, ambiguous = first, [], False, False

            chunks, times, orders, roles, freshly, starting = (
                v.tolist() for v in (chunk, t, batch.column("cand_ord").to_numpy(), role, fresh, starts))
            ends = np.append(starts[1:], False).tolist()  # rows that end a group within the batch
            across, down = batch.column("_cx").to_numpy(zero_copy_only=False).tolist(), batch.column("_cy").to_numpy(zero_copy_only=False).tolist()
            marks = batch.column("_cut")
            cuts = marks.to_pylist() if marks.null_count < n else None
            sides = [batch.column(c).fill_null(0).to_numpy() for c in "xywh"] if prior else []
            boxed = lambda e: [*e[:7], tuple(int(v[e[7]]) for v in sides) if isinstance(e[7], int) else e[7]] if prior else list(e)  # noqa: B023, E731
            seed_ms, seed_ord, refs = list(times), list(orders), [-1] * n
            before, carried = [-1] * n, []  # the row of the keyframe before, or that keyframe itself
            at, states = [], []  # state rows and the rows whose group they are of
            # Lone rows that end a group are visited as well, to close it.
            for i in np.flatnonzero(~alone | np.append(starts[1:], False)).tolist():
                if freshly[i]:
                    open_events = []
                    if starting[i]:
                        begun, ambiguous = False, False
                    else:
                        begun = True  # perhaps by a row that was passed over
                t0, order, cx, cy = times[i], orders[i], across[i], down[i]
                box = i if prior else None
                if roles[i] == _ENTRY:
                    open_events.append([t0, cx, cy, order, None, None, None, box])
                    continue
                own_row = roles[i] == _OWN
                if own_row and not begun:
                    begun = True
                    border = chunks[i] * chunk_ms - gap_ms
                    open_events = [e for e in open_events if e[0] >= border]
                    for pos, event in enumerate(open_events):
                        event[4:7] = [None, None, pos]
                        at.append(i)
                        states.append((_STATE_IN, pos, boxed(event), None))
                if open_events:
                    cut = cuts[i] if cuts else None
                    open_events = [
                        e for e in open_events if t0 - e[0] <= gap_ms and (cut is None or cut <= e[0])
                    ]
                chosen = None
                for event in open_events:
                    dx, dy = cx - event[1], cy - event[2]
                    if dx * dx + dy * dy <= reach:
                        if chosen is None:
                            chosen = event
                            if event[6] is None:
                                break
                        elif event[6] is not None:
                            ambiguous = True
                            break
                if chosen is None:
                    chosen = [t0, cx, cy, order, t0, order, None, box]
                    open_events.append(chosen)
                else:
                    if prior:
                        if isinstance(chosen[7], int):
                            before[i] = chosen[7]
                        else:
                            carried.append((i, chosen[0], *chosen[7]))
                    chosen[0:4] = [t0, cx, cy, order]
                    chosen[7] = box
                if own_row:
                    seed_ms[i], seed_ord[i] = chosen[4], chosen[5]
                    if chosen[6] is not None:
                        refs[i] = chosen[6]
                        if chosen[4] is None:
                            seed_ms[i] = seed_ord[i] = 0
                if ends[i]:
                    if begun:
                        done = closing(chunks[i], [boxed(e) for e in open_events], ambiguous)
                        at += [i] * len(done)
                        states += done
                    open_events, begun, ambiguous = [], False, False
            group, open_events = key(n - 1), [boxed(e) for e in open_events]
            if own.any():
                every = own.all()
                rows = batch if every else batch.filter(pa.array(own))
                column = lambda v, gone, kind: pa.array(v if every else v[own], kind, mask=gone if every else gone[own])  # noqa: B023, E731
                ref = np.array(refs, np.int64)
                open_before = ref >= 0
                extra = {
                    "seed_ms": column(np.array(seed_ms, np.int64), open_before, pa.int64()),
                    "seed_ord": column(np.array(seed_ord, np.int64), open_before, pa.int64()),
                    "_ref": column(ref, ~open_before, pa.int32()), "_ambiguous": pa.nulls(rows.num_rows, pa.bool_()),
                }
                if prior:
                    place = np.array(before, np.int64)
                    came = [v[place] for v in (t, *sides)]
                    none = place < 0
                    if carried:
                        where, *values = (np.array(v) for v in zip(*carried))
                        none[where] = False
                        for v, value in zip(came, values):
                            v[where] = value
                    extra |= {c: column(v, none, kind) for (c, kind), v in zip(_PRIOR.items(), came)}
                yield pa.RecordBatch.from_arrays(
                    [extra[n] if n in extra else rows.column(n) for n in names], names=names
                )
            if states:
                where = pa.array(at)
                yield state_batch([batch.column(c).take(where) for c in ("video_id", "pii_type", "_chunk")], states)
        if group and begun:
            states = closing(group[2], open_events, ambiguous)
            yield state_batch([[k] * len(states) for k in group], states)

    return step


def _walked(rows: DataFrame, gap_ms: int, tolerance: float, chunk_ms: int, prior: bool) -> DataFrame:
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema],
        T.StructField("seed_ms", T.LongType()), T.StructField("seed_ord", T.LongType()),
        T.StructField("_ref", T.IntegerType()), T.StructField("_ambiguous", T.BooleanType()),
        *([T.StructField(n, T.LongType() if n == "_prior_ms" else T.IntegerType()) for n in _PRIOR] if prior else []),
    ])
    return (
        rows.repartition(*KIND, "_chunk")
        .sortWithinPartitions(*KIND, "_chunk", "_role", "_pos", *ORDER)
        .mapInArrow(_walk(gap_ms, tolerance, chunk_ms, schema), schema)
    )


def _checked_chunks(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks that began with open events, with the verdict on their guess, and the end states moved on.

    A wrong order of events that were open at the start matters only where two of them were in reach.
    """
    place = [*KIND, "_chunk"]
    ends = walked.filter(F.col("_role") == _END).select(*place, "_ambiguous")
    true_in = (
        walked.filter(F.col("_role") == _STATE_OUT).withColumn("_chunk", F.col("_chunk") + 1)
        .join(ends.select(*place), place, "left_semi")
    )
    guessed = walked.filter(F.col("_role") == _STATE_IN).select(
        *place, *ORDER, F.col("_pos").alias("guess_pos")
    )
    compared = true_in.select(*place, *ORDER, F.col("_pos").alias("true_pos")).join(
        guessed, [*place, *ORDER], "full_outer"
    ).join(ends, place)
    same = F.col("guess_pos").isNotNull() & F.col("true_pos").isNotNull() & (
        (F.col("guess_pos") == F.col("true_pos")) | ~F.col("_ambiguous")
    )
    return compared.select(*place, (~same).alias("wrong")), true_in


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow events through the chunks of a video and kind: position at a start -> opening candidate."""
    key, known = None, {}
    for batch in batches:
        found_ms, found_ord = [], []
        for row in batch.to_pylist():
            here = (row["video_id"], row["pii_type"])
            if here != key:
                key, known = here, {}
            if row["_ref"] is None:
                seed = (row["seed_ms"], row["seed_ord"])
            else:
                seed = known[row["_chunk"] - 1, row["_ref"]]
            known[row["_chunk"], row["_pos"]] = seed
            known = {k: v for k, v in known.items() if k[0] >= row["_chunk"] - 1}
            found_ms.append(seed[0])
            found_ord.append(seed[1])
        names = ["video_id", "pii_type", "_chunk", "_ref", "found_ms", "found_ord"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("video_id"), batch.column("pii_type"), batch.column("_chunk"),
             batch.column("_pos"), pa.array(found_ms, pa.int64()), pa.array(found_ord, pa.int64())],
            names=names,
        )


class _Versions:
    """Walked chunks in one folder: a first version of all, and for each round of repair the chunks walked anew.

    States lie apart from rows, so that checking and stitching read the states only. A row of a chunk
    counts in its latest version.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count, self.redone, self.schema = spark, shared_folder(spark), 0, [], None

    def add(self, walked: DataFrame, chunks: DataFrame | None = None) -> None:
        """A further version, of the given chunks (of all at first)."""
        parts = walked.withColumns({"_version": F.lit(self.count), "_state": (F.col("_role") != _OWN).cast("int")})
        # Two files are open at a time, so that rows need not be sorted by the folder they go to.
        open_files = "spark.sql.maxConcurrentOutputFileWriters"
        set_before = self.spark.conf.get(open_files)
        self.spark.conf.set(open_files, 2)
        try:
            parts.write.partitionBy("_version", "_state").mode("append").parquet(self.folder)
        finally:
            self.spark.conf.set(open_files, set_before)
        if chunks is not None:
            self.redone.append(chunks.withColumn("_version", F.lit(self.count)))
        self.schema = parts.schema
        self.count += 1

    def _latest(self, part: DataFrame) -> DataFrame:
        if not self.redone:
            return part
        place = [*KIND, "_chunk"]
        newest = reduce(DataFrame.unionByName, self.redone).groupBy(*place).agg(F.max("_version").alias("_newest"))
        return part.join(newest, place, "left").where(F.col("_version") == F.coalesce("_newest", F.lit(0))).drop("_newest")

    def _read(self, state: int) -> DataFrame:
        table = self.spark.read.schema(self.schema).parquet(self.folder)
        written = (F.col("_state") == state) & (F.col("_version") < self.count)
        return self._latest(table.where(written)).drop("_state", "_version")

    def own(self) -> DataFrame:
        return self._read(0)

    def states(self) -> DataFrame:
        return self._read(1)


# Stitching tables up to this many rows are broadcast; larger ones are joined by shuffle.
_BROADCAST_ROWS = 200_000


class LinkRun:
    """Linked candidates to which further ones may be added.

    The walk of each (video, kind, chunk) is written to the shared folder once. `extend` walks the chunks that get new
    candidates, from the true state at their start, and after them only chunks whose start state has changed by that;
    all other chunks stay as written. The result is that of one run over all candidates together.
    """

    def __init__(
        self, candidates: DataFrame, cuts: DataFrame | None = None, gap_ms: int = LINK_GAP_MS,
        tolerance_px: float = LINK_TOLERANCE_PX, chunk_ms: int | None = None, warm_ms: int | None = None,
        prior: bool = False,
    ) -> None:
        self.prior = prior
        self.chunk_ms = max(chunk_ms or 900 * gap_ms, gap_ms)
        self.gap_ms, self.tolerance, self.cuts, self.columns = gap_ms, float(tolerance_px), cuts, candidates.columns
        warm_ms = max(warm_ms or 4 * gap_ms, gap_ms)
        at = F.col("time_ms")
        rows = (
            self._rows(candidates).withColumn("_at", F.col("_chunk"))
            .withColumn("_chunk", F.explode(F.when(
                at >= (F.col("_at") + 1) * self.chunk_ms - warm_ms, F.array(F.col("_at"), F.col("_at") + 1)
            ).otherwise(F.array(F.col("_at")))))
            .withColumn("_role", F.when(F.col("_chunk") == F.col("_at"), _OWN).otherwise(_WARM))
            .drop("_at")
        )
        self.inner = rows.columns
        self.versions = _Versions(rows.sparkSession)
        self.versions.add(self._walk(rows))
        self._repair()

    def _rows(self, candidates: DataFrame) -> DataFrame:
        """Candidates as rows of their own chunk."""
        cx, cy = center_of(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
        if self.cuts is None:
            rows = candidates.withColumn("_cut", F.lit(None).cast("long"))
        else:
            rows = latest_before(candidates, self.cuts, ["video_id"], "time_ms", "cut_ms", "_cut", self.chunk_ms)
        at = F.col("time_ms").cast("long")
        if self.prior:
            rows = rows.withColumns({c: F.col(c).cast("int") for c in "xywh"})
        return rows.withColumns({
            "time_ms": at, "cand_ord": F.col("cand_ord").cast("long"), "_cx": cx, "_cy": cy,
            "_pos": F.lit(0), "_chunk": F.floor(at / self.chunk_ms), "_role": F.lit(_OWN),
        })

    def _walk(self, rows: DataFrame) -> DataFrame:
        return _walked(rows, self.gap_ms, self.tolerance, self.chunk_ms, self.prior)

    def _again(self, starts: DataFrame, chunks: DataFrame, more: DataFrame | None = None) -> None:
        """Walk the given chunks from these states, with more rows where given, as a further version."""
        place = [*KIND, "_chunk"]
        entries = starts.join(chunks, place, "left_semi").withColumn("_role", F.lit(_ENTRY))
        rows = entries.select(self.inner).unionByName(
            self.versions.own().join(chunks, place, "left_semi").select(self.inner)
        )
        if more is not None:
            rows = rows.unionByName(more.select(self.inner))
        self.versions.add(self._walk(rows), chunks)

    def _repair(self) -> None:
        """Walk chunks that began in a wrong state again until there is none."""
        while True:
            checked, true_in = _checked_chunks(self.versions.states())
            self.n_states, n_wrong = checked.agg(F.count("*"), F.count_if("wrong")).first()
            if n_wrong == 0:
                return
            self._again(true_in, settle(checked.filter("wrong").select(*KIND, "_chunk").distinct()))

    def extend(self, candidates: DataFrame) -> None:
        """Take in further candidates, whose (time_ms, cand_ord) differ from those of the video and kind so far."""
        more = settle(self._rows(candidates.select(self.columns)))
        touched = settle(more.select(*KIND, "_chunk").distinct())
        starts = self.versions.states().filter(F.col("_role") == _STATE_OUT).withColumn("_chunk", F.col("_chunk") + 1)
        self._again(starts, touched, more)
        self._repair()

    def linked(self) -> DataFrame:
        """Candidates with the id of their event and the candidate that opened it.

        A run with `prior` adds the event's keyframe before each: a struct `prior` (time_ms, x, y, w, h), null on the first.
        """
        own, walked = self.versions.own(), self.versions.states()
        place = [*KIND, "_chunk"]
        seed = ["seed_ms", "seed_ord"]
        before = F.struct(F.col("_prior_ms").alias("time_ms"), *[F.col(f"_prior_{c}").alias(c) for c in "xywh"])
        more = [F.when(F.col("_prior_ms").isNotNull(), before).alias("prior")] if self.prior else []
        key = event_key("video_id", "pii_type", *seed)
        if self.n_states == 0:
            # No event was open at any chunk border.
            return own.select(*self.columns, *seed, *more).withColumn("event_id", key)
        _, true_in = _checked_chunks(walked)
        links = (
            true_in.select(*KIND, "_chunk", "_pos", *ORDER, *seed, "_ref")
            .join(
                walked.filter(F.col("_role") == _STATE_IN).select(*place, *ORDER, F.col("_pos").alias("at_start")),
                [*place, *ORDER],
            )
            .withColumn("_pos", F.col("at_start"))
            .repartition(*KIND).sortWithinPartitions(*KIND, "_chunk", "_pos")
            .select(*KIND, "_chunk", "_pos", *seed, "_ref")
            .mapInArrow(
                _resolve,
                "video_id string, pii_type string, _chunk long, _ref int, found_ms long, found_ord long",
            )
        )
        # One row per event open at a chunk border: few, and already counted.
        if self.n_states <= _BROADCAST_ROWS:
            links = F.broadcast(links)
        # Only rows of events that were open at a chunk's start are looked up, so that all others stay where they lie.
        opened = own.filter("_ref IS NULL").select(*self.columns, *seed, *more)
        carried = own.filter("_ref IS NOT NULL").join(links, place + ["_ref"], "left").select(
            *self.columns, F.col("found_ms").alias("seed_ms"), F.col("found_ord").alias("seed_ord"), *more
        )
        return opened.unionByName(carried).withColumn("event_id", key)


def link_candidates(
    candidates: DataFrame, cuts: DataFrame | None = None, gap_ms: int = LINK_GAP_MS,
    tolerance_px: float = LINK_TOLERANCE_PX, chunk_ms: int | None = None, warm_ms: int | None = None,
    prior: bool = False,
) -> DataFrame:
    """Candidates with the id of their event and the candidate that opened it, with `prior` the keyframe before as well.

    One row per keyframe; the events themselves come from `event_summary`. `chunk_ms` must be at
    least the gap. The walk is written to the shared folder once, since its check and its rows are
    both read from it; a round of repair writes the chunks that it walks again and no others.
    """
    return LinkRun(candidates, cuts, gap_ms, tolerance_px, chunk_ms, warm_ms, prior).linked()


def event_summary(linked: DataFrame) -> DataFrame:
    """One row per event: range, best confidence, first text, envelope and keyframe count.

    Events are grouped by the candidate that opened them, and their ids, which follow from it, are put on afterwards. What
    comes from a column that is not there is left out.
    """
    found = {
        "confidence": F.max("confidence"), "extracted_text": F.min_by("text", F.struct(*ORDER)),
        "env_w": F.max("w"), "env_h": F.max("h"),
    }
    source = {"extracted_text": "text", "env_w": "w", "env_h": "h"}
    found = {n: v.alias(n) for n, v in found.items() if source.get(n, n) in linked.columns}
    first = found.pop("confidence", None)
    events = linked.groupBy(*KIND, "seed_ms", "seed_ord").agg(
        F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"),
        *([] if first is None else [first]), F.count("*").alias("n_keyframes"), *found.values(),
    )
    rest = [c for c in events.columns if c not in (*KIND, "seed_ms", "seed_ord")]
    return events.select(
        *KIND, event_key("video_id", "pii_type", "seed_ms", "seed_ord").alias("event_id"), "seed_ms", "seed_ord", *rest
    )


def finished_events(
    summary: DataFrame, style: dict | None = None, secure: bool = False
) -> DataFrame:
    """Event rows ready for review: pending, automatic, with the default style."""
    from veilmark.schemas import DEFAULT_STYLE

    look = style or DEFAULT_STYLE
    text = F.lit(None).cast("string") if secure else F.col("extracted_text")
    return summary.select(
        "video_id", "event_id", F.lit("auto").alias("source"), "pii_type", "confidence",
        text.alias("extracted_text"), "start_ms", "end_ms", "n_keyframes", "env_w", "env_h",
        F.lit("csrt").alias("tracking_method"),
        F.struct(
            F.lit(look["type"]).alias("type"), F.lit(look["strength"]).alias("strength"),
            F.lit(look["color"]).alias("color"),
        ).alias("redaction_style"),
        F.lit("pending").alias("status"), "seed_ms", "seed_ord",
    )


def ordered_events(events: DataFrame) -> DataFrame:
    """Events of each video by start, ties in order of opening."""
    return events.orderBy("video_id", "start_ms", "seed_ord")


def relink_with_extra(
    candidates: DataFrame, extra: DataFrame, **options
) -> DataFrame:
    """Link again from scratch after the boundary frames brought more candidates."""
    return link_candidates(candidates.unionByName(extra), **options)


def replace_events(stored: DataFrame, fresh: DataFrame, key: str = "video_id") -> DataFrame:
    """A full scan replaces all events of the videos it covers."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def append_events(
    stored: DataFrame, fresh: DataFrame, range_ms: tuple[int, int] | None = None, key: str = "video_id"
) -> DataFrame:
    """A range or frame scan appends; with a range, earlier automatic events inside it give way."""
    if range_ms is not None:
        inside = (
            (F.col("source") == "auto") & (F.col("start_ms") >= range_ms[0])
            & (F.col("end_ms") <= range_ms[1])
        )
        covered = fresh.select(key).distinct().withColumn("_again", F.lit(True))
        stored = stored.join(covered, key, "left").filter(
            ~(F.coalesce("_again", F.lit(False)) & inside)
        ).drop("_again")
    return stored.unionByName(fresh)
