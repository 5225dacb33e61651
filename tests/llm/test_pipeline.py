"""Each stage against its own input: what it must drop, keep and return."""

import corpus_pipeline
from driftbasket.llm import secrets
from test_ngram_join import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir).persist())
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:]))
    text = {r.doc_id: r.text for r in kept[1].collect()}
    roots = brute(list(text.items()))
    assert sorted(ids[2]) == sorted(i for i, (_, root) in roots.items() if root == i)
    leaked = set(ids[2]) - set(ids[3])
    assert all(text[r.doc_id] == r.text for r in kept[3].collect()) and len(leaked) < len(ids[2]) // 4
    for r in kept[4].collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
    assert set(ids[5]) == set(ids[4])
    total = {}
    for r in kept[5].collect():
        total[r.doc_id, r.doc_tokens] = total.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert all(n == got for (_, n), got in total.items())
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, kept[5].collect()))


def test_rows_of_null_and_repeated_ids(spark, sf_dir):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 8)
    kind = "doc_id long, text string, lang string"
    texts = [(None, words(1)), (None, words(1) + " end"), (None, words(2)), (5, words(2)), (4, words(3)), (4, words(3)), (4, words(4)), (3, words(5)), (2, words(5)), (9, None), (9, ""), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*x, "en") for x in texts], kind).repartition(3), sf_dir).collect()
    left = sorted((str(r.doc_id), str(r.text)[:4]) for r in got)
    assert left == sorted([("None", "w1x0"), ("5", "w2x0"), ("4", "w3x0"), ("4", "w4x0"), ("2", "w5x0"), ("9", "None"), ("9", ""), ("None", "None")])
    texts = [(None, item), (None, words(6)), (7, f"x {item} y"), (7, words(7)), (8, words(8)), (8, words(8))]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame([(*x, "en") for x in texts], kind), sf_dir).collect()
    assert sorted((str(r.doc_id), r.text[:4]) for r in got) == [("7", "w7x0"), ("8", "w8x0"), ("8", "w8x0"), ("None", "w6x0")]


def test_edges_in_every_stage(spark, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, and columns with the names the stages use."""
    words = lambda k, n: " ".join(f"Word{k}x{i % 977}y{i // 977}" for i in range(n))
    kind = "doc_id long, text string, lang string, source string, n_chars long, row long, row_ string, id long, own int, t string, key int, n int, part int, shard int, order string, doc_tokens int"
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a"), (None, None), (None, words(1, 40)), (None, words(1, 40)), (5, words(1, 40)), (5, words(2, 60)), (5, words(2, 60)), (6, words(3, 30_000)), (7, words(3, 30_000) + " tail"), (8, "w" * 300_000), (2**63 - 1, words(4, 30)), (-5, words(4, 30))]
    docs = spark.createDataFrame([(i, t, None, None, None, *(None,) * 11) for i, t in texts], kind).repartition(3)
    whole = lambda df: sorted((str(r.doc_id), len(r.text or ""), str(r.text)[:6]) for r in df.select("doc_id", "text").collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf_dir).count() == 0
    good = whole(corpus_pipeline.quality(spark, docs, sf_dir))
    assert {i for i, *_ in good} <= {"None", "5", "6", "7", "-5", str(2**63 - 1)} and len([x for x in good if x[0] == "5"]) == 3
    left = whole(corpus_pipeline.near_duplicates(spark, docs, sf_dir))
    assert [(i, n) for i, n, _ in left if n > 1500] == [("6", len(texts[10][1])), ("8", 300_000)]
    assert sorted(i for i, n, _ in left if n < 10) == ["1", "2", "3", "4", "None"] and sorted(i for i, n, _ in left if 10 < n < 1500) == ["-5", "5", "5"]
    assert whole(corpus_pipeline.decontamination(spark, docs, sf_dir)) == whole(docs) == whole(corpus_pipeline.secret_scan(spark, docs, sf_dir))
    rows = corpus_pipeline.sequences(spark, docs, sf_dir).collect()
    held = {}
    for r in rows:
        held.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    copies = {k: sum(n for _, n in v) // k[1] for k, v in held.items()}
    assert sum(copies.values()) == len(texts) and all(sum(n for _, n in v) == copies[k] * k[1] for k, v in held.items())
    assert corpus_pipeline.sequences(spark, docs.limit(0), sf_dir).count() == 0
