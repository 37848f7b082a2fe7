"""The full scan as one plan: boxes to candidates to linked, review-ready events."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame

from veilmark.operators.boxes import filter_boxes
from veilmark.operators.classify import classify
from veilmark.operators.link import LinkRun, event_summary, finished_events, link_candidates
from veilmark.operators.sampling import boundary_frames, even_subsample
from veilmark.plans.session import settle
from veilmark.schemas import BOUNDARY_FRAMES, DEFAULT_OVERRIDES, DEFAULT_THRESHOLD, REFINE_BUDGET, REFINE_MINIMUM


def full_scan(
    boxes: DataFrame, rules: DataFrame | Iterable[dict], spans: DataFrame | None = None,
    faces: DataFrame | None = None, cuts: DataFrame | None = None, threshold: float = DEFAULT_THRESHOLD,
    overrides: Mapping[str, float] | None = DEFAULT_OVERRIDES, secure: bool = False,
    style: dict | None = None, **link_options,
) -> DataFrame:
    """Pending events of all videos in the box table."""
    found = classify(filter_boxes(boxes), rules, spans, faces, threshold, overrides)
    linked = link_candidates(found, cuts, **link_options)
    return finished_events(event_summary(linked), style, secure)


def refined_scan(
    boxes: DataFrame, sampled: DataFrame, rules: DataFrame | Iterable[dict], fps: Column,
    spans: DataFrame | None = None, faces: DataFrame | None = None, cuts: DataFrame | None = None,
    threshold: float = DEFAULT_THRESHOLD, overrides: Mapping[str, float] | None = DEFAULT_OVERRIDES,
    secure: bool = False, style: dict | None = None, reach: int = BOUNDARY_FRAMES, budget: int = REFINE_BUDGET,
    minimum: int = REFINE_MINIMUM, **link_options,
) -> DataFrame:
    """Pending events of a scan of the sampled frames, refined around the events that it finds.

    Boxes of sampled frames (video_id, frame_idx) are linked first. Frames within `reach` of an event's ends that were
    not sampled are then looked at, at most `budget` a video and none where fewer than `minimum` remain, and what they
    hold is linked into the run: only chunks that get candidates, or whose start changes by them, are walked again.
    Frames without boxes count in the budget and find nothing.
    """
    place = ["video_id", "frame_idx"]
    looked = sampled.select(*place).distinct()

    def found(frames: DataFrame) -> DataFrame:
        at = lambda table: None if table is None else table.join(frames, place, "left_semi")
        return classify(filter_boxes(at(boxes)), rules, at(spans), at(faces), threshold, overrides)

    run = LinkRun(found(looked), cuts, **link_options)
    around = boundary_frames(event_summary(run.linked()), looked, fps, reach)
    run.extend(found(settle(even_subsample(settle(around), budget, minimum))))
    return finished_events(event_summary(run.linked()), style, secure)
