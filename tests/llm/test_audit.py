import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pandas as pd
import pyarrow.parquet as pq
import pytest

from gleaner.llm import audit, common, queries
from tests.llm.conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = random.Random(5)
    data = []
    for i in range(400):
        words = [rng.choice(["the", "And", "WATER", f"w{rng.randint(0, 400)}", f"é{rng.randint(0, 90)}"]) for _ in range(rng.choice([0, 3, 99, 100, 160]))]
        text = rng.choice([" ", "\n\t"]).join(words) + rng.choice(["", "", "$", " |"])
        data.append((i, text.upper() if i % 9 == 0 else text, rng.choice(["en", "de", None, ""]), "s", 1))
    data += [(1000 + i, data[i % 3][1], "en", "s", 1) for i in range(200)]  # a third of the rows are copies of three texts
    data += [(7, data[7][1], "en", "s", 1), (7, "other", None, "s", 1), (None, data[0][1], "de", "s", 1), (None, None, None, None, None),
             (3000, None, "en", "s", 1), (3001, "", "fr", "s", 1), (3002, "long text " * 30_000, "fr", "s", 1), (3003, "a b c " * 40, "fr", "s", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 3)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    return data, labels


def plain(data, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in data:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, *_ in data:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}.items() if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                seen = [(d, bool(d[1] & set(order[:k]))) for d in docs if d[0] == part]
                here = [d for d, earlier in seen if f in d[1] and not earlier]
                out[part, "".join(order), k + 1] = [
                    sum(f not in d[1] and not earlier for d, earlier in seen), len(here), sum(f in d[1] and earlier for d, earlier in seen),
                    sum(d[1] == {f} for d, _ in seen), sum(d[2] for d in here), sum(d[3] for d in here)]
                shapley[part, f] += len(here)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force_and_sql(spark, make, tmp_path):
    data, labels = corpus()
    make(data, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    make(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op12(spark, str(tmp_path)).collect()
    want = plain(data, labels)
    assert len(rows) == len(want) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows} == want
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    names = ["part", "filter_order", "step", *COLUMNS]
    found = db.execute(f"SELECT {', '.join(names)} FROM ({queries._OP12})").fetchall()
    assert {r[:3]: r[3:] for r in found} == want


@pytest.mark.parametrize("group_bytes", [16 << 20, 5_000])
def test_matrix_rows_and_dictionary(make, monkeypatch, group_bytes):
    monkeypatch.setattr(audit, "GROUP_BYTES", group_bytes)
    data, _ = corpus()
    docs = make([(i, t) for i, t, *_ in data], "doc_id long, text string", extra=False).repartition(6)
    shards, dictionary = audit.term_matrix(docs, ["doc_id", "text"])
    words = {r["column"]: r["word"] for r in dictionary.collect()}
    assert len(words) == dictionary.count() == len({w for _, t, *_ in data for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")})
    n = 0
    for shard in shards.collect():
        for k, row in enumerate(shard["rows"]):
            at = slice(shard["ends"][k], shard["ends"][k + 1])
            got = {words[c]: n for c, n in zip(shard["columns"][at], shard["counts"][at])}
            assert got == Counter(re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
            n += 1
    assert n == len(data)


def test_empty_tables(make):
    assert audit.audit(make([], DOCS), make([], LABELS)).collect() == []
    rows = audit.audit(make([(1, "a b", "en", "s", 1)], DOCS), make([], LABELS)).toPandas()
    assert len(rows) == 600 and isinstance(rows, pd.DataFrame) and set(rows["kept"]) == {0, 1}


def test_wide_stages_have_small_row_groups_and_batches(spark):
    made = spark.range(24, numPartitions=1).selectExpr("id", "transform(sequence(1, 500000), x -> xxhash64(id, x)) AS v")  # 4 MB each
    stored = common.stage(made, "wide", wide=True)
    files = [Path(f.removeprefix("file:")) for f in stored.inputFiles()]
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in groups) == 24 == stored.count()
    assert max(m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)) < 2 * common.WIDE_BYTES
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with common.small_batches(spark):
        assert spark.conf.get(key) == str(common.WIDE_BYTES)
    assert spark.conf.get(key) == before


def test_answers_of_a_shard_are_not_collected_in_the_jvm(make):
    docs = make([(i, f"a b{i % 7}") for i in range(50)], "doc_id long, text string", extra=False).repartition(3)
    rows = audit.row_counts(audit.term_matrix(docs, ["doc_id"])[0])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "MapInArrow" not in plan
    assert sorted((r["doc_id"], r["n_words"], r["n_distinct"]) for r in rows.collect()) == [(i, 2, 2) for i in range(50)]
