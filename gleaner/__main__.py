"""Command line: one command per stage, each reading the tables of the one before.

    python -m gleaner discover --search pages/ --out products/
    python -m gleaner harvest  --products products/ --reviews landed/ --out reviews/
    python -m gleaner clean    --reviews reviews/ --out clean/ [--csv]
    python -m gleaner validate --reviews clean/ --out validation/ [--loader package.module:loader]
    python -m gleaner score    --reviews clean/ --out scored/     --classifier validation/classifier | --loader ...
    python -m gleaner topics   --reviews scored/ --out topics/ [--brand-terms acme,acmes]
    python -m gleaner temporal --reviews scored/ --topics topics/topics_out --out temporal/ [--events events.csv]
    python -m gleaner explorer --topics topics/ --out explorer/   [--labels "0=Name,1=Name"]
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner import constants as K, schemas
from gleaner.operators import scoring, topics
from gleaner.plans import jobs
from gleaner.session import get_session
from gleaner.sources import csv_files, responses, sinks, tables
from gleaner.streaming import incremental


def _write_all(reports: dict[str, DataFrame], out: str) -> None:
    for name, table in reports.items():
        sinks.write_csv(table, f"{out}/{name}")


def _loaded(args) -> jobs.Scorer:
    module, name = args.loader.split(":")
    return jobs.model_scorer(getattr(importlib.import_module(module), name), args.batch_size)


def _trained(model) -> jobs.Scorer:
    return lambda df: scoring.classify(df, model)


def discover(spark: SparkSession, args) -> None:
    pages = responses.read_search_json(spark, args.search)
    keywords = tables.keyword_table(spark, _listed(args.keywords))
    out = jobs.discover(pages.join(keywords, "category_keyword"))
    sinks.write_stage(out["products"], f"{args.out}/products")
    _write_all({"summary": out["summary"], "totals": out["totals"]}, args.out)


def harvest(spark: SparkSession, args) -> None:
    """Take in what has landed, then list the requests still to be made."""
    reviews = incremental.ingest(spark, args.reviews, responses.with_keyword(schemas.REVIEW_RESPONSE),
                                 responses.flatten_reviews, f"{args.out}/reviews", f"{args.out}/progress")
    products = spark.read.parquet(f"{args.products}/products")
    sinks.write_csv(jobs.harvest(products, reviews), f"{args.out}/plan")


def clean(spark: SparkSession, args) -> None:
    if args.csv:
        raw = csv_files.read_reviews_csv(spark, args.reviews, file_order=True)
    else:
        raw = spark.read.parquet(f"{args.reviews}/reviews").select(  # ingest_batch is a column of the table
            "*", F.col("_metadata.file_path").alias(csv_files.FILE_COLUMN),
            F.col("_metadata.row_index").alias(csv_files.ROW_COLUMN))
    cleaned = sinks.write_stage(jobs.clean(raw), f"{args.out}/reviews", ["year_month"])
    _write_all(jobs.clean_reports(cleaned), args.out)


def validate(spark: SparkSession, args) -> None:
    """Score a sample. Without a loader a classifier is trained on the star labels, saved, and validated on
    reviews whose keys it was not trained on."""
    cleaned = spark.read.parquet(f"{args.reviews}/reviews")
    if args.loader:
        scorer = _loaded(args)
    else:
        known, cleaned = scoring.split_held_out(cleaned, F.col("review_id"), args.held_out)
        model = scoring.train_text_classifier(known)
        model.write().overwrite().save(f"{args.out}/classifier")
        scorer = _trained(model)
    out = jobs.validate(cleaned, scorer, per_star=args.per_star, store=f"{args.out}/sample")
    out.pop("sample")
    _write_all(out, args.out)


def score(spark: SparkSession, args) -> None:
    cleaned = spark.read.parquet(f"{args.reviews}/reviews")
    if not (args.loader or args.classifier):
        raise SystemExit("score needs --loader, or --classifier with the folder that validate saved")
    scorer = _loaded(args) if args.loader else _trained(PipelineModel.load(args.classifier))
    sinks.write_stage(jobs.score_full(cleaned, scorer), f"{args.out}/reviews", ["year_month"])


def find_topics(spark: SparkSession, args) -> None:
    scored = spark.read.parquet(f"{args.reviews}/reviews")
    corpus = jobs.topic_corpus(scored, K.stopword_set(_listed(args.brand_terms)), threshold=args.threshold)
    docs = sinks.write_stage(corpus, f"{args.out}/corpus")
    fitted = jobs.select_topics(docs, [int(k) for k in _listed(args.k)] or K.K_VALUES, min_df=args.min_df)
    topics.save_model(fitted["model"], fitted["terms"], f"{args.out}/model")
    assigned = sinks.write_stage(jobs.assign_topics(docs, fitted), f"{args.out}/assigned")
    reports = jobs.topic_reports(assigned, fitted, _labels(args))
    sinks.write_stage(reports.pop("topics_out"), f"{args.out}/topics_out")
    _write_all({"coherence": fitted["sweep"], **reports}, args.out)


def temporal(spark: SparkSession, args) -> None:
    events = csv_files.read_csv(spark, args.events, schemas.EVENTS) if args.events else tables.event_table(spark, [])
    docs = spark.read.parquet(args.topics) if args.topics else None
    _write_all(jobs.temporal_reports(spark.read.parquet(f"{args.reviews}/reviews"), events, docs, titles=_labels(args)), args.out)


def explorer(spark: SparkSession, args) -> None:
    from gleaner.operators.explorer import write_explorer
    fitted = topics.load_model(spark, f"{args.topics}/model")
    assigned = spark.read.parquet(f"{args.topics}/assigned")
    titles = {t: _labels(args).get(t, f"Topic {t}") for t in range(fitted["k"])}
    write_explorer(jobs.explorer_tables(assigned, fitted, tables.topic_label_table(spark, titles)), args.out)


COMMANDS = {"discover": discover, "harvest": harvest, "clean": clean, "validate": validate, "score": score,
            "topics": find_topics, "temporal": temporal, "explorer": explorer}


def _labels(args) -> dict[int, str]:
    """Topic names written as 0=Name,1=Name; topics left out are 'Topic k'."""
    return {int(k): v for k, v in (x.split("=", 1) for x in _listed(args.labels))}


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("command", choices=list(COMMANDS))
    for name in ("search", "products", "reviews", "topics", "events", "loader", "classifier"):
        parser.add_argument(f"--{name}")
    for name in ("keywords", "brand-terms", "k", "labels"):
        parser.add_argument(f"--{name}", default="", help="comma-separated")
    parser.add_argument("--out", required=True)
    parser.add_argument("--csv", action="store_true", help="reviews are CSV files")
    parser.add_argument("--batch-size", type=int, default=K.SCORE_BATCH)
    parser.add_argument("--per-star", type=int, default=K.SAMPLES_PER_STAR)
    parser.add_argument("--held-out", type=float, default=0.2, help="share of the reviews that validation keeps from training")
    parser.add_argument("--threshold", type=float, default=K.CONFIDENCE_THRESHOLD)
    parser.add_argument("--min-df", type=int, default=K.VOCAB_MIN_DF)
    args = parser.parse_args(argv)
    COMMANDS[args.command](spark or get_session(), args)


if __name__ == "__main__":
    main()
