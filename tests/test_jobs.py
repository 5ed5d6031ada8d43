"""Jobs as state: parts, repeats, refusals, and jobs that are never complete, over several runs of one stream."""

import json

from pyspark.sql import functions as F

from sitesieve.sources import requests as R
from sitesieve.streaming import jobs

PAGES = "job_id string, n_pages int, pos int, visit_id string, predicted_label string, reason string"


def test_jobs_over_four_runs(spark, tmp_path):
    folder, results, checkpoint = (str(tmp_path / p) for p in ("in", "results", "checkpoint"))

    def run(rows):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(PAGES).parquet(folder)
        jobs.start_responses(
            jobs.job_events(events.filter("reason is null"), events.filter("reason is not null").select("job_id", "reason")),
            results, checkpoint, expire_ms=1, part_pages=2,
        ).awaitTermination()
        return {(r["job_id"], r["part"]): (r["status"], r["last"], r["response"] and json.loads(r["response"]))
                for r in spark.read.schema(jobs.RESPONSES).parquet(results).collect()}

    page = lambda job, n, pos, label: (job, n, pos, f"{job}-{pos}", label, None)
    whole = [page("a", 5, p, f"L{p}") for p in (4, 0, 2, 1, 3)]
    done = run([*whole, whole[2], page("late", 3, 1, "x"), page("void", 0, 0, "x"), ("bad", None, None, None, None, "no domain_name"),
                (None, 1, 0, "v", "x", None)])
    assert done["a", 0] == ("done", False, {"visit_id": ["a-0", "a-1"], "category": ["L0", "L1"]})
    assert done["a", 2] == ("done", True, {"visit_id": ["a-4"], "category": ["L4"]}) and ("a", 3) not in done
    assert done["bad", 0] == ("refused", True, {"error": "no domain_name"})
    assert not any(job in ("late", None) and status == "done" for (job, _), (status, _, _) in done.items())
    before = len(done)
    again = run([page("b", 1, 0, "y")])
    # time has moved on: the incomplete job is given up, nothing else is said twice
    assert again["late", 0] == ("expired", True, None) and again["b", 0][0] == "done"
    assert len(again) == before + 2 - (("late", 0) in done)


def test_events_of_refusals_and_pages(spark):
    pages = spark.createDataFrame([("j", 2, 0, "v", 0.5, True)], "job_id string, n_pages int, pos int, visit_id string, prediction double, decision boolean")
    refused = spark.createDataFrame([("k", "unknown model"), (None, "unreadable line")], "job_id string, reason string")
    got = jobs.job_events(pages, refused).orderBy("job_id").collect()
    assert [(r["job_id"], r["n_pages"], r["prediction"], r["decision"], r["reason"]) for r in got] == [
        ("j", 2, 0.5, True, None), ("k", None, None, None, "unknown model")]


def test_number_of_pages_of_a_request(spark):
    schema = R.STORED_REQUESTS
    rows = spark.createDataFrame([("m", "j", [], ["a.be", "b.be"], ["x", "y"], ["", ""], [], None)], schema)
    assert [r["n_pages"] for r in R.explode_requests(rows, counted=True).collect()] == [2, 2]
    assert "n_pages" not in R.explode_requests(rows).columns
    assert R.explode_requests(rows).filter(F.col("pos") == 1).count() == 1
