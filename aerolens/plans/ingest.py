"""The ingest job: vendor rows in, checked frame table and set-aside copies out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from aerolens.functions.camera import mounted_at_angle, with_rotation
from aerolens.operators import expect, normalise
from aerolens.operators.select import with_outline_terms
from aerolens.session import staged
from aerolens.sources.tables import publish


@dataclass(frozen=True)
class Survey:
    """How a survey names its folders and where its photos live."""

    image_base: str
    folder_prefix: str
    folder_suffix: str = "_3IN"


def source_rules(raw_frames: DataFrame, raw_eo: DataFrame, survey: Survey) -> DataFrame:
    """The rules vendor rows must pass, as (rule, n_bad)."""
    rows = {
        **expect.address_rules(survey.image_base, survey.folder_prefix, survey.folder_suffix),
        "shot name does not parse or match": expect.shot_grammar(),
        "date, time or zone does not parse": expect.unparsed_time(),
    }
    return expect.gather(
        expect.keys_missing(raw_frames, raw_eo, ["season_key"], "season present in frames but not EO"),
        expect.counts_equal(raw_frames, raw_eo, ["season_key"], "frames and EO row counts differ"),
        expect.pairs_agree(raw_frames, raw_eo, "pair names different photos"),
        expect.partnerless(raw_frames, raw_eo, "frame row without EO row"),
        expect.rules(raw_frames, rows),
    )


def result_rules(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """The rules the finished table must pass."""
    health = expect.outline_rules(frames) if "ring" in frames.columns else expect.rules(frames, expect.outline_health())
    return expect.gather(
        expect.rules(rows, {"local time and zone do not give the EO time": expect.distinct_from(F.col("eo_ts"), F.col("ts_utc"))}),
        expect.unique(frames, "filename", "name is not unique"),
        expect.conserved(frames, normalise.set_aside(rows), rows, "kept and set aside do not add up"),
        expect.incomplete_groups(frames, "exposure_id", "camera", 5, "exposure without exactly five cameras"),
        health.where("rule = 'frame without a footprint'"),
        expect.rules(frames, {"lens mounted at an angle": mounted_at_angle()}),
    )


def run(raw_frames: DataFrame, raw_eo: DataFrame, survey: Survey, out: str) -> tuple[DataFrame, DataFrame]:
    """Check, normalise, check again, publish; returns the two written tables."""
    expect.enforce(source_rules(raw_frames, raw_eo, survey))
    rows = staged(normalise.ranked_copies(normalise.paired(raw_frames, raw_eo)))
    frames = staged(with_rotation(with_outline_terms(normalise.normalised(normalise.kept(rows)))))
    expect.enforce(result_rules(rows, frames))
    kept = publish(frames, f"{out}/frames")
    aside = publish(normalise.set_aside(rows), f"{out}/frames_duplicates", ("season_key", "filename", "fid"))
    return kept, aside
