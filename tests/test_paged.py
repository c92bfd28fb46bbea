"""Request plans sent page by page, with fetch functions that read landed files (no network)."""

import json
import os

import pytest

from gleaner.sources import paged, requests, responses


def landing(folder, pages):
    for (key, page), body in pages.items():
        (folder / f"{key}-{page}.json").write_text(json.dumps(body))


def fetcher(folder, names, broken=(), flaky=(), log=None):
    """Reads the landed file of a request; broken requests always fail, flaky ones the first time."""
    folder = str(folder)

    def fetch(request):
        name = "-".join(str(request[n]) for n in names)
        with open(f"{folder}/asked-{name}-{os.getpid()}", "a") as f:
            f.write("x")
        if name in broken:
            raise ConnectionError("gone")
        marker = f"{folder}/tried-{name}"
        if name in flaky and not os.path.exists(marker):
            open(marker, "w").close()
            raise TimeoutError("slow")
        path = f"{folder}/{name}.json"
        return open(path).read() if os.path.exists(path) else "{}"
    return fetch


def asked(folder):
    out = {}
    for name in os.listdir(folder):
        if name.startswith("asked-"):
            key = name[6:].rsplit("-", 1)[0]
            out[key] = out.get(key, 0) + len((folder / name).read_text())
    return out


def hit(i):
    return {"product_uid": str(i), "name": f"n{i}", "reviews": {"total": i}, "retail_price": {"price": i / 10}}


@pytest.fixture
def search(tmp_path):
    full = [hit(i) for i in range(3)]
    landing(tmp_path, {("milk", 1): {"products": full}, ("milk", 2): {"products": full[:1]}, ("milk", 3): {"products": full},
                       ("tea", 1): {"products": full}, ("tea", 2): {"products": full}, ("tea", 3): {"products": full[:2]}, ("none", 1): {"products": []}})
    return tmp_path


def test_search_stops_at_the_first_short_page(spark, search):
    plan = requests.search_plan(spark.createDataFrame([("milk",), ("tea",), ("none",), ("never",)], "category_keyword string"), 5, 3)
    pages = paged.search_pages(plan, fetcher(search, ["category_keyword", "page"]), tasks=3)
    rows = pages.collect()
    assert sorted((r["category_keyword"], r["page"]) for r in rows) == [("milk", 1), ("milk", 2), ("never", 1), ("none", 1), ("tea", 1), ("tea", 2), ("tea", 3)]
    assert asked(search) == {f"{r['category_keyword']}-{r['page']}": 1 for r in rows} and all(r["attempts"] == 1 for r in rows)
    got = responses.flatten_search(paged.search_responses(spark.createDataFrame(rows, pages.schema)), ["page"])
    landed = [(k, p, i) for k, p, n in (("milk", 1, 3), ("milk", 2, 1), ("tea", 1, 3), ("tea", 2, 3), ("tea", 3, 2)) for i in range(n)]
    assert sorted((r["category_keyword"], r["page"], r["position"]) for r in got.collect()) == landed


def test_retries_failures_and_what_is_left(spark, search):
    plan = requests.search_plan(spark.createDataFrame([("milk",), ("tea",)], "category_keyword string"), 4, 3)
    fetch = fetcher(search, ["category_keyword", "page"], broken=("tea-2",), flaky=("milk-2",))
    pages = paged.search_pages(plan, fetch, attempts=2).cache()
    rows = {(r["category_keyword"], r["page"]): r for r in pages.collect()}
    assert set(rows) == {("milk", 1), ("milk", 2), ("tea", 1), ("tea", 2)}
    assert rows["milk", 2]["attempts"] == 2 and rows["milk", 2]["error"] is None and rows["milk", 2]["response"]
    assert rows["tea", 2]["error"] == "ConnectionError: gone" and rows["tea", 2]["response"] is None and rows["tea", 2]["attempts"] == 2
    more = plan.unionByName(requests.search_plan(spark.createDataFrame([("late",)], "category_keyword string"), 1, 3))
    left = paged.open_requests(more, pages, ["category_keyword"], "page").collect()
    assert sorted((r["category_keyword"], r["page"]) for r in left) == [("late", 1), ("tea", 2), ("tea", 3), ("tea", 4)]
    again = paged.search_pages(paged.open_requests(more, pages, ["category_keyword"], "page"), fetcher(search, ["category_keyword", "page"]))
    assert sorted((r["category_keyword"], r["page"]) for r in again.collect()) == [("late", 1), ("tea", 2), ("tea", 3)]
    pages.unpersist()


def test_reviews_end_at_the_total_or_the_cap(spark, tmp_path):
    review = {"Id": "r", "Rating": 4}
    landing(tmp_path, {("p1", 0): {"Results": [review] * 2, "TotalResults": 3}, ("p1", 2): {"Results": [review], "TotalResults": 3},
                       ("p2", 0): {"Results": [review] * 2, "TotalResults": 99}, ("p2", 2): {"Results": [review] * 2, "TotalResults": 99},
                       ("p3", 0): {"Results": [], "TotalResults": 9}})
    products = spark.createDataFrame([("p1", "tea", 9.0), ("p2", "tea", 4.0), ("p3", "milk", 9.0), ("p4", "milk", 0.0)], "product_uid string, category_keyword string, review_count double")
    plan = requests.harvest_plan(products, 50, 2)
    pages = paged.review_pages(plan, fetcher(tmp_path, ["product_uid", "offset"])).cache()
    assert sorted((r["product_uid"], r["offset"], r["limit"]) for r in pages.collect()) == [("p1", 0, 2), ("p1", 2, 2), ("p2", 0, 2), ("p2", 2, 2), ("p3", 0, 2)]
    assert responses.flatten_reviews(paged.review_responses(pages)).count() == 7
    pages.unpersist()


def test_empty_plan_and_answers_that_are_no_json(spark, tmp_path):
    plan = requests.search_plan(spark.createDataFrame([], "category_keyword string"), 2, 3)
    assert paged.search_pages(plan, fetcher(tmp_path, ["page"])).collect() == []
    (tmp_path / "1.json").write_text("<html>")
    one = requests.search_plan(spark.createDataFrame([("tea",)], "category_keyword string"), 2, 3)
    row, = paged.search_pages(one, fetcher(tmp_path, ["page"]), attempts=1).collect()
    assert row["error"].startswith("JSONDecodeError") and row["response"] is None


def test_landed_pages_are_read_from_small_folders(spark, tmp_path, monkeypatch):
    """A request reads the neighbours of its page, not all pages that landed."""
    import glob

    from gleaner.catalog import ingest

    monkeypatch.setattr(ingest, "FOLDER_PAGES", 2)
    rows = [(k, p, json.dumps({"products": [f"{k}{p}"]})) for k in ("a b/ü", "c") for p in range(1, 8)] + [(None, 1, "{}")]
    landed = ingest.land_pages(spark.createDataFrame(rows, "category_keyword string, page int, body string"), str(tmp_path / "pages"))
    assert landed.count() == 15
    folders = glob.glob(str(tmp_path / "pages/*/*"))
    assert max(spark.read.parquet(f).count() for f in folders) == 2
    fetch = ingest.landed_fetch(str(tmp_path / "pages"))
    for k, p, body in rows[:-1]:
        assert fetch({"category_keyword": k, "page": p}) == body
    assert [fetch({"category_keyword": k, "page": p}) for k, p in (("c", 8), ("c", 50), ("d", 1), (None, 1))] == ["{}"] * 4
