"""Times the headline queries, warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

import duckdb

from stemma.operators import ancestors, enrich, findings, quality, statistics
from stemma.operators.duplicates import duplicate_candidates
from stemma.plans.dataset import from_fixtures
from stemma.plans.oracle import ORACLE
from stemma.plans.queries import QUERIES, _parsed
from stemma.plans.rendering import write_gedcom
from stemma.session import build_session
from stemma.sources import gedcom

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Timed runs after the warm-up; of a query that takes longer than SLOW seconds there is one.
RUNS, SLOW = 3, 6.0
#: Seconds given to DuckDB for each statement; those that compare all pairs take longer and are left out.
DUCKDB_QUERIES = ("gedcom_persons", "import_statistics", "births_by_year", "age_at_death", "life_events", "issues_all")


def finish(df) -> None:
    """Run a query to its last row without moving the rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def duckdb_seconds() -> dict[str, float]:
    """Seconds of the same results in DuckDB on as many threads."""
    connection = duckdb.connect(config={"threads": int(CPUS)})
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(SF_DIR) if f.endswith(".parquet")):
        path = f"{SF_DIR}/{name}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    times = {}
    for name in DUCKDB_QUERIES:
        each = []
        for _ in range(RUNS):
            start = time.perf_counter()
            connection.execute(ORACLE[name]).fetchall()
            each.append(time.perf_counter() - start)
        times[name] = round(median(each), 3)
    return times


def main() -> None:
    spark = build_session(
        "stemma-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        """The median of warm runs; the first run of all is the warm-up."""
        each: list[float] = []
        while len(each) < (2 if each and each[0] > SLOW else RUNS + 1):
            start = time.perf_counter()
            run()
            each.append(time.perf_counter() - start)
        times[name] = round(median(each[1:]), 3)

    # Warm the session up on the smallest shape of work.
    finish(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    ds = from_fixtures(spark, SF_DIR)
    # Tables that several queries share are timed under their own names and kept after.
    timed("conformed_tables", lambda: from_fixtures(spark, SF_DIR))
    timed("enriched_persons", lambda: finish(enrich.enrich_persons(ds.persons, ds.families, ds.parent_children, ds.events)))
    timed("duplicate_candidates", lambda: finish(duplicate_candidates(ds.enriched, ds.families, ds.parent_children)))
    timed("findings_by_severity", lambda: finish(findings.severity_totals(ds.findings)))
    timed("quality_score", lambda: finish(quality.quality_scores(quality.quality_inputs(ds.enriched))))
    edges = ancestors.ancestor_edges(ds.families, ds.parent_children)
    timed("ancestors", lambda: finish(ancestors.ancestors(ds.persons.select("person_id"), edges, ancestors.MAX_DEPTH)))
    timed("births_by_year", lambda: finish(statistics.persons_by_year(ds.enriched, "birth")))
    timed("age_at_death", lambda: finish(statistics.age_at_death(ds.enriched)))
    timed("life_events", lambda: finish(enrich.event_summary(ds.events)))
    timed("dashboard", lambda: finish(ds.dashboard()))

    folder = write_gedcom(spark, SF_DIR)
    parse = lambda: gedcom.parse_records(gedcom.read_records(spark, folder))
    timed("gedcom_scan", lambda: finish(parse()))
    lines = parse().selectExpr("sum(n_lines) as n").first()["n"]
    _parsed.clear()
    for name in ("gedcom_persons", "issues_all", "import_statistics", "fulltext_documents", "place_similarity", "name_similarity", "duplicate_groups"):
        timed(name, lambda name=name: finish(QUERIES[name](spark, SF_DIR)))

    people = ds.persons.count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "duckdb": duckdb_seconds(),
                "lines_per_second_and_core": round(lines / times["gedcom_scan"] / int(CPUS)),
                "candidate_pairs": {"kept": ds.candidates.count(), "all_pairs": people * (people - 1) // 2},
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
