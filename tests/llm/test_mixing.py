from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import mixing, queries

from .conftest import ROWS, SCHEMA, write


def fill(sizes, weights, share=Fraction(3, 2)):
    """Brute force: deal, cap, deal the rest again until none is above."""
    total, capped = share * sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = total - 2 * sum(sizes[i] for i in capped)
        give = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        over = {i for i in rest if give[i] >= 2 * sizes[i]}
        if not over:
            return [Fraction(2 * sizes[i]) if i in capped else give[i] for i in range(len(sizes))]
        capped |= over


def test_targets_are_water_filled(spark):
    rng = np.random.default_rng(1)
    for n in (1, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 2000, n)]
        rows = [(f"s{i:03}" if i < n - 1 else None, x) for i, x in enumerate(sizes)]
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("queue").collect()
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(n)]) if sum(sizes) else [Fraction(0)] * n
        assert [r["source"] for r in got] == [s for s, _ in rows]
        for r, w in zip(got, want, strict=True):
            assert abs(r["target"] - float(w)) < 1e-6 and r["give"] == int(w)
        assert [r["give_before"] for r in got] == [sum(int(w) for w in want[:k]) for k in range(n)]


def queues(spark, limits):
    rows, give, needs = [], 0, 0
    for q, n in enumerate(limits):
        rows.append((q, n, give, -(-n // mixing.BLOCK), needs, sum(x > 0 for x in limits[:q])))
        give, needs = give + n, needs + -(-n // mixing.BLOCK)
    return spark.createDataFrame(rows, "queue long, give long, give_before long, needs long, needs_before long, dense long")


def test_schedule_equals_brute_force(spark):
    limits = [40_000, 0, 11_000, 256, 7]
    rows = {(r["queue"], r["block"]): r["slot"] for r in mixing.slots(queues(spark, limits)).collect()}
    needs = [-(-x // mixing.BLOCK) for x in limits]
    n, want, rank = sum(needs), {}, Counter()
    for i in range(n):
        point = (i + 1) * mixing.GOLDEN % mixing.CIRCLE
        q = max(k for k in range(len(limits)) if limits[k] and sum(limits[:k]) * mixing.CIRCLE // sum(limits) <= point)
        if rank[q] < needs[q]:
            want[q, rank[q]] = i
        rank[q] += 1
    for q in range(len(limits)):
        for b in range(rank[q], needs[q]):
            want[q, b] = n + sum(needs[:q]) + b
    assert rows == want
    # the start of the mix is near the weights
    order = [q for q, _ in sorted(rows, key=rows.get)]
    for m in range(20, 190, 10):
        assert abs(order[:m].count(0) - m * 40_000 / sum(limits)) < 5


def some_docs(spark):
    rng = np.random.default_rng(3)
    data = [(i, "w " * int(rng.integers(0, 400)), "en", ["s0", "s1", "s2", None][int(rng.integers(0, 4)) if i % 2 else 0], 0) for i in range(300)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(4)


def test_taken(spark, docs, no_docs):
    data, df = some_docs(spark)
    rows = mixing.taken(mixing.plan_mix(df)).collect()
    again = mixing.taken(mixing.plan_mix(df.repartition(2))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert len(rows) == 300 and all(r["taken"] <= 2 * r["size"] for r in rows)
    source = {d: s for d, _, _, s, _ in data}
    total = sum(r["size"] for r in rows)
    per = {s: sum(r["taken"] for r in rows if source[r["doc_id"]] == s) for s in set(source.values())}
    target = {source[r["doc_id"]]: r["target"] for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert all(0 <= target[s] - per[s] < 1 for s in per)
    # the schedule at work on the query's own rows: what comes first, up to any slot, is near the targets
    read_once = sorted((r["first_slot"], source[r["doc_id"]], r["taken"]) for r in rows if r["slots"] and r["taken"] <= r["size"])
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
    slots = sorted((p["slot"], source[p["doc_id"]], p["n_words"]) for p in mixing.plan_mix(df).pieces().collect())
    words = Counter()
    for slot, s, n in slots:
        words[s] += n
        if slot > 20 and slot < len({x for x, _, _ in slots}) - 10:
            for t in target:
                assert abs(words[t] - target[t] / (1.5 * total) * sum(words.values())) <= 4 * mixing.BLOCK
    assert read_once == sorted(read_once)
    odd = mixing.taken(mixing.plan_mix(docs)).collect()
    assert len(odd) == len(ROWS) and sum(r["size"] for r in odd if r["doc_id"] in (3, 4, 5)) == 0
    assert mixing.taken(mixing.plan_mix(no_docs)).count() == 0


def test_query_equals_sql(spark, docs, tmp_path):
    _, df = some_docs(spark)
    write(df.unionByName(docs.select(*df.columns).where("doc_id <> 9 and doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000)), tmp_path, "documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_mix"]).fetchall()
    names = [d[0] for d in con.description]
    got = queries.op9_mix(spark, str(tmp_path)).select(*names).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_pieces_tile_what_is_taken(docs):
    spans = {}
    for p in mixing.plan_mix(docs).pieces().collect():
        spans.setdefault((p["row"], p["epoch"]), []).append((p["start_word"], p["n_words"]))
    for parts in spans.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n


def test_mixed_documents(spark, docs, no_docs):
    docs = docs.withColumns({c: F.lit(1) for c in ("size_", "plan_key_", "part_", "file", "doc", "first_slot", "queue_own_")})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    taken = {r["doc_id"]: 0 for r in rows}
    for r in rows:
        taken[r["doc_id"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"]) and r["file"] == 1
    want = {}
    for r in mixing.taken(mixing.plan_mix(docs)).collect():
        if r["taken"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert taken == want
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mix_is_filed_by_slot(spark, tmp_path):
    _, df = some_docs(spark)
    mixing.mixed_documents(df).write.parquet(f"{tmp_path}/mix")
    rows = spark.read.parquet(f"{tmp_path}/mix").select("source", "text", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    share = {r["source"]: r["give"] for r in mixing.plan_mix(df).queues.collect()}
    words, all_ = Counter(), sum(share.values())
    for k, r in enumerate(rows):
        words[r["source"]] += len(r["text"].split())
        if 40 < k < len(rows) - 20:
            for s in share:
                assert abs(words[s] / sum(words.values()) - share[s] / all_) < 0.12
