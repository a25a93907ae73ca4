"""Headline timings on one machine; prints one JSON line.

BENCH_SF_DIR names the test data, BENCH_CPUS the cores. Each query runs once to warm up and then
BENCH_RUNS times; the median counts. Results go to Spark's no-op sink, which computes every row.

Names without a prefix derive their tables from the star-schema test data on every run. Names with
``stored_`` read typed tables written beforehand, as one would work with cleaned tables.
"""

from __future__ import annotations

import json
import os
from statistics import median
import time

from cohortlens.operators import features, logit, report, usage
from cohortlens.plans import queries as q
from cohortlens.session import local_session, scratch_path
from cohortlens.sources import standins
from cohortlens.sources.tables import store

HEADLINE = (
    "share_within_group",
    "side_by_side_share",
    "outcome_rate_by_flag",
    "group_scorecard",
    "fk_violations",
    "clean_student_vle",
    "top_usage",
    "outcome_usage_ratio",
    "clicks_from_start",
    "submissions",
    "enrolment_report",
)


class Stored:
    """The operators on stored typed tables."""

    def __init__(self, spark, folder: str) -> None:
        names = ("student_info", "student_vle", "student_assessment", "assessments", "vle")
        tables = {name: standins.TYPED[name](spark, folder) for name in names}
        self.spark = spark
        self.t = store(tables, scratch_path(spark, "cleaned"), {"student_vle": "code_module"})

    def parts(self):
        return (
            self.t["student_info"],
            usage.clicks_from_start(self.t["student_vle"]),
            usage.submissions(self.t["student_assessment"], self.t["assessments"]),
        )

    def view_mean(self) -> None:
        report.mean_clicks(report.report_view(*self.parts())).collect()

    def report(self):
        return report.enrolment_report(*self.parts())

    def top_usage(self):
        return usage.top_usage(self.t["student_vle"], self.t["vle"], self.t["student_info"])

    def logit(self) -> None:
        types = standins.ACTIVITY_TYPES
        profile = usage.activity_profile(self.t["student_vle"], self.t["vle"], types)
        base = features.model_base(self.t["student_info"], q.IMD_RANKS)
        table = features.model_features(base, profile, types)
        for spec in logit.model_specs(q.MODEL_TYPES):
            logit.fit_model(table, spec, q.factors())


def timed(run, runs: int) -> float:
    run()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(median(seconds), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    seconds = {
        name: timed(lambda query=q.QUERIES[name]: drain(query(spark, folder)), runs)
        for name in HEADLINE
    }
    seconds["clean_and_write_student_vle"] = timed(
        lambda: q.QUERIES["clean_student_vle"](spark, folder).write.parquet(scratch_path(spark, "bench")),
        runs,
    )
    stored = Stored(spark, folder)
    published = report.materialise(stored.report(), "bericht_bench", scratch_path(spark, "report"))
    seconds["stored_mean_clicks_view"] = timed(stored.view_mean, runs)
    seconds["stored_mean_clicks_materialised"] = timed(
        lambda: report.mean_clicks(published).collect(), runs
    )
    seconds["stored_enrolment_report"] = timed(lambda: drain(stored.report()), runs)
    seconds["stored_top_usage"] = timed(lambda: drain(stored.top_usage()), runs)
    seconds["stored_four_logit_fits"] = timed(stored.logit, runs)
    print(
        json.dumps(
            {
                "metric": "total of the headline queries, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
