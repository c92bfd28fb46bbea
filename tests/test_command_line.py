"""The stages one after the other, from landed JSON to the explorer tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.__main__ import main
from gleaner.operators import scoring
from gleaner.session import scratch_path

WORDS = {"beef": "tough dry gristle fatty inedible chewy", "tea": "price packet smaller pricey shrink expensive"}


@pytest.fixture(scope="module")
def base(spark):
    random.seed(1)
    root = scratch_path(spark, "stages")
    os.makedirs(f"{root}/search"), os.makedirs(f"{root}/landed")
    with open(f"{root}/search/a.json", "w") as f:
        for kw in WORDS:
            hits = [{"product_uid": f"{kw}{i}", "name": kw, "reviews": {"total": 40}} for i in range(3)]
            f.write(json.dumps({"category_keyword": kw, "page": 1, "products": hits}) + "\n")
    with open(f"{root}/landed/a.json", "w") as f:
        for kw, words in WORDS.items():
            for p in range(2):
                results = []
                for i in range(40):
                    stars = 1 if i % 4 else 5
                    text = " ".join(random.choices(words.split() if stars == 1 else ["delicious", "favourite"], k=14))
                    results.append({"Id": f"{kw}{p}-{i}", "ProductId": f"{kw}{p}-P", "OriginalProductName": kw, "Rating": stars,
                                    "Title": "hm", "ReviewText": text, "SubmissionTime": f"2024-03-{(11, 15, 20)[i % 3]}T10:00:00.000+00:00"})
                f.write(json.dumps({"category_keyword": kw, "page": 1, "TotalResults": 40, "Results": results}) + "\n")
    return root


def test_all_stages(spark, base):
    def run(*args):
        main(list(args), spark)

    def csv(path):
        return spark.read.csv(f"{base}/{path}", header=True)

    run("discover", "--search", f"{base}/search", "--out", f"{base}/products")
    assert csv("products/totals").first()["products"] == "6"
    run("harvest", "--products", f"{base}/products", "--reviews", f"{base}/landed", "--out", f"{base}/raw")
    assert csv("raw/plan").count() == 2  # one product of each keyword has no reviews yet
    run("clean", "--reviews", f"{base}/raw", "--out", f"{base}/clean")
    assert csv("clean/summary").first()["reviews"] == "160"
    run("validate", "--reviews", f"{base}/clean", "--out", f"{base}/validation", "--per-star", "8", "--held-out", "0.5")
    assert float(csv("validation/accuracy").first()["accuracy"]) == 1.0
    assert {r["n"] for r in csv("validation/rating_counts").collect()} == {"8"}
    known, _ = scoring.split_held_out(spark.read.parquet(f"{base}/clean/reviews"), F.col("review_id"), 0.5)
    sample = spark.read.parquet(f"{base}/validation/sample")
    assert 0 < known.count() < 160 and sample.join(known, "review_id", "left_semi").count() == 0
    run("score", "--reviews", f"{base}/clean", "--out", f"{base}/scored", "--classifier", f"{base}/validation/classifier")
    assert spark.read.parquet(f"{base}/scored/reviews").filter("pred = 'negative'").count() == 120
    run("topics", "--reviews", f"{base}/scored", "--out", f"{base}/topics", "--k", "2,3", "--threshold", "0.5", "--min-df", "2")
    assert spark.read.parquet(f"{base}/topics/topics_out").count() == 120
    assert csv("topics/coherence").count() == 2
    with open(f"{base}/events.csv", "w") as f:
        f.write("event_date,event_label,event_type,color\n2024-03-16,outage,retail,\n2024-05-31,later,macro,\n")
    run("temporal", "--reviews", f"{base}/scored", "--topics", f"{base}/topics/topics_out", "--out", f"{base}/temporal", "--events", f"{base}/events.csv")
    assert csv("temporal/event_impact").count() == 1 and csv("temporal/topic_month").count() in (2, 3)
    assert [r["review_count"] for r in csv("temporal/monthly").collect()] == ["160"]
    run("explorer", "--topics", f"{base}/topics", "--out", f"{base}/explorer")
    assert spark.read.json(f"{base}/explorer/topics").count() in (2, 3)
    assert spark.read.json(f"{base}/explorer/cards").filter("title is null").count() == 0
