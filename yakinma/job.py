"""The incremental model run as a job: ``python -m yakinma.job --store DIR --model ID --scorer package.module:factory``.

The factory makes the scorer of one Python worker. The counts of pending and cached records are printed at the end."""

from __future__ import annotations

import argparse
import importlib

from yakinma.operators import kpi, sentiment
from yakinma.session import build_session
from yakinma.sources.store import Store, store_path

#: Failed records named one by one; all of them are counted.
WARNINGS = 100


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--store", help="folder of the tables; else spark.yakinma.store, else yakinma-store in the working folder")
    p.add_argument("--model", required=True)
    p.add_argument("--scorer", required=True)
    p.add_argument("--version", default="1")
    p.add_argument("--company")
    p.add_argument("--start-date")
    p.add_argument("--end-date")
    p.add_argument("--master", help="where the job was not sent by spark-submit; else local")
    p.add_argument("--host", action="append", default=[], help="a site whose root pages may name the company")
    a = p.parse_args(argv)
    if a.start_date and a.end_date and a.start_date > a.end_date:
        p.error("the start lies after the end")
    return a


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    module, _, name = a.scorer.partition(":")
    make = getattr(importlib.import_module(module), name)
    spark = build_session(a.master)
    store = Store(spark, store_path(spark, a.store)).create()
    df = kpi.selected(store.read("complaints"), a.company, a.start_date, a.end_date, tuple(a.host))
    results, aspects = store.read("sentiment_results"), store.read("aspect_sentiment")
    todo = sentiment.pending(df, results, aspects, a.model, a.version).count()
    if todo:  # the model is not even looked for when everything is cached
        got = sentiment.run_job(df, results, aspects, a.model, a.version, make)
        store.commit({"sentiment_results": got.results, "aspect_sentiment": got.aspects})
        n = got.failed.count()
        for row in got.failed.orderBy("complaint_id").limit(WARNINGS).collect():
            print(f"record {row.complaint_id} could not be analysed: {row.failed} of {row.texts} texts failed")
        if n > WARNINGS:
            print(f"{n - WARNINGS} more records could not be analysed")
    print(f"analysed {todo} of {df.count()} records" if not todo or not n else f"analysed {todo - n} of {df.count()} records, {n} failed")


if __name__ == "__main__":
    main()
