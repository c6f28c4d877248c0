"""Wall time of every registered query at one scale; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES an optional comma-separated
selection. Each query runs once; its result goes to the no-op sink, so every row is computed. The feature table and the
model that several queries share are built once, each under a key of its own (``stored_matrix``, ``model_training``).
When the run is ended from outside, the line holds what is done.
"""

from __future__ import annotations

import json
import os
import signal
import sys
import time

from creditloom.plans.catalog import all_queries
from creditloom.plans.model_queries import stored_matrix, trained
from creditloom.session import local_session
from creditloom.sources.testbed import Testbed

# Queries of the shared model, after its training.
MODEL_QUERIES = [
    "gbt_model", "isotonic_calibration", "training_summary", "model_scored_portfolio", "reloaded_model_scores", "tree_top_factors",
    "tree_global_importance", "surrogate_tree", "rule_predicates", "surrogate_fidelity", "baseline_logistic", "imbalance_study",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    queries = all_queries()
    shared = {"stored_matrix": stored_matrix, "model_training": lambda t: trained(t).test_scores}
    steps = {name: lambda spark, path, build=build: build(Testbed(spark, path)) for name, build in shared.items()}
    names = chosen.split(",") if chosen else [n for n in queries if n not in MODEL_QUERIES] + [*steps, *MODEL_QUERIES]
    spark = local_session("bench")
    # The first job of a session starts the executor threads and the Parquet reader.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}

    def report(*_) -> None:
        print(_line(sf_dir, seconds, failed), flush=True)

    def ended(*_) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in names:
        started = time.perf_counter()
        try:
            (steps | queries)[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # one broken query must not hide the others
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        print(f"{name} {seconds.get(name, failed.get(name))}", file=sys.stderr, flush=True)
    report()
    return 1 if failed else 0


def _line(sf_dir: str, seconds: dict[str, float], failed: dict[str, str]) -> str:
    result = {
        "metric": "total_wall_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    return json.dumps(result)


if __name__ == "__main__":
    raise SystemExit(main())
