"""Files, streams, upserts, history and the shape of the plans."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tillweave.operators import categories, dashboard as da, vectors
from tillweave.sources import documents as src, history, tables as tb
from tillweave.streaming import ingest

TEXT = "Shop {n}\n01/0{n}/2024\nMilk $4.50\nTotal $4.50\n"


def _drop(folder, n):
    (folder / f"receipt_00{n}.txt").write_text(TEXT.format(n=n), encoding="utf-8")


def test_scan_reads_whole_files(spark, tmp_path):
    for n in (1, 2):
        _drop(tmp_path, n)
    (tmp_path / "notes.txt").write_text("not a receipt")
    rows = src.scan_text_files(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.raw_text) for r in rows] == [(f"receipt_00{n}.txt", TEXT.format(n=n)) for n in (1, 2)]


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()

    def run():
        ingest.load_new(ingest.stream_text_files(spark, str(inbox)), out, mark).awaitTermination()
        return sorted(r.filename for r in spark.read.parquet(out).select("filename").collect())

    _drop(inbox, 1)
    _drop(inbox, 2)
    assert run() == ["receipt_001.txt", "receipt_002.txt"]
    assert run() == ["receipt_001.txt", "receipt_002.txt"]
    _drop(inbox, 3)
    assert run() == ["receipt_001.txt", "receipt_002.txt", "receipt_003.txt"]


def test_a_small_batch_keeps_all_cores(spark, tmp_path, monkeypatch):
    """The documents of a batch were coalesced by their bytes and extracted by one task; known ones meet before extraction."""
    seen = []
    extract = ingest.extract_receipts
    monkeypatch.setattr(ingest, "extract_receipts", lambda own, **kw: seen.append(own) or extract(own, **kw))
    files = spark.createDataFrame([(f"r{n}", TEXT.format(n=n), f"p{n}", str(n)) for n in range(9)], "filename string, raw_text string, path string, content_sha256 string")
    root = str(tmp_path / "loaded")
    ingest.store_batch(files, "b", root)
    assert len(seen) == 1 and seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    known = spark.read.parquet(f"{root}/receipts")
    again = src.only_new(extract(files, keep=ingest.IDENTITY), known, ("content_sha256",))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") > plan.index("merchant_name") and again.count() == 0


def test_stored_hashes_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Every batch shuffled and sorted the hashes of all documents stored so far; a batch too large to send its own still does."""
    plans = []
    known = lambda *a: plans.append(new := src.only_new(*a)) or new
    monkeypatch.setattr(ingest, "only_new", known)
    schema = "filename string, raw_text string, path string, content_sha256 string"
    files = lambda *ns: spark.createDataFrame([(f"r{n}", TEXT.format(n=n), f"p{n}", str(n)) for n in ns], schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent, exchanges in ((ingest.HASHES_SENT, 1), (0, 2)):
            monkeypatch.setattr(ingest, "HASHES_SENT", sent)
            root = str(tmp_path / str(sent))
            for batch, ns in (("a", (1, 2, 3)), ("b", (3, 4, 1)), ("c", (4, 5))):
                ingest.store_batch(files(*ns), batch, root)
            rows = spark.read.parquet(f"{root}/receipts").select("batch", "filename").collect()
            assert sorted(map(tuple, rows)) == [("a", "r1"), ("a", "r2"), ("a", "r3"), ("b", "r4"), ("c", "r5")]
            assert plan_of(plans[-1]).count("hashpartitioning(content_sha256") == exchanges
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rendered_text_is_shuffled_by_order_alone(spark, sf_dir):
    """Narrow rows join first: the texts of lines were shuffled again by customer."""
    from tillweave.plans.render import rendered

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(rendered(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    last = next(line for line in plan.splitlines() if "Join" in line)
    assert "l_orderkey" in last and "o_custkey" not in last


def test_incremental_load_reads_a_folder_of_files(spark, tmp_path):
    """The documents table as one file and as a folder of several; the latter was read as empty."""
    from tillweave.plans import catalog

    docs = spark.createDataFrame([(n, f"Shop {n}\nMilk $4.50", "en", "web", 17) for n in range(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), tmp_path / "one" / "documents.parquet")
    for layout in ("many", "one"):
        rows = catalog.QUERIES["st1_incremental_load"](spark, str(tmp_path / layout)).collect()
        assert sorted(map(tuple, rows)) == [(n, f"Shop {n}") for n in range(6)]


def test_stream_ends_in_chunks(spark, tmp_path):
    """Files to receipts to five views: copies aren't taken, rewritten files are, a repeated batch adds nothing."""
    inbox, root, mark = tmp_path / "in", str(tmp_path / "loaded"), str(tmp_path / "mark")
    inbox.mkdir()

    def run():
        ingest.stream_chunks(ingest.stream_text_files(spark, str(inbox)), root, mark).awaitTermination()
        return loaded()

    def loaded():
        receipts = spark.read.parquet(f"{root}/receipts").select("filename", "merchant_name").collect()
        chunks = spark.read.parquet(f"{root}/chunks")
        assert chunks.count() == chunks.select("chunk_id").distinct().count()
        views = {r.chunk_type for r in chunks.select("chunk_type").distinct().collect()}
        assert views == {"receipt_summary", "item_detail", "merchant_info", "payment_method"}  # one item makes no group
        return sorted(map(tuple, receipts))

    one, two = ("receipt_001.txt", "Shop 1"), ("receipt_002.txt", "Shop 2")
    _drop(inbox, 1)
    _drop(inbox, 2)
    (inbox / "receipt_007.txt").write_text(TEXT.format(n=1), encoding="utf-8")  # a copy in the same batch
    assert run() == [one, two] and run() == [one, two]
    (inbox / "receipt_008.txt").write_text(TEXT.format(n=2), encoding="utf-8")  # a copy in a later batch
    _drop(inbox, 3)
    three = ("receipt_003.txt", "Shop 3")
    assert run() == [one, two, three]
    ingest.store_batch(src.scan_text_files(spark, str(inbox)), "s1", root)  # the second batch again, with more in it
    assert loaded() == [one, two, three]
    (inbox / "receipt_001.txt").write_text(TEXT.format(n=4), encoding="utf-8")
    assert run() == [one, two, three]
    for sweep in "ab":
        ingest.sweep_rewritten(spark, str(inbox), root, "2001-01-01T00:00:00", sweep)
        assert loaded() == sorted([one, two, three, ("receipt_001.txt", "Shop 4")])


def test_merge_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    path = tmp_path / "keyed"
    rows = spark.createDataFrame([(i, f"v{i}", 1, {"k": i}) for i in range(200)], "id bigint, v string, version int, m map<string,int>")
    tb.create_keyed(rows, str(path), ["id"], "version", buckets=8)
    files = lambda: {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in path.glob("*/*.parquet")}
    before = files()
    batch = spark.createDataFrame([(3, "new", 2, None), (3, "old", 0, None), (500, "more", 1, None)], rows.schema)
    for _ in range(2):
        touched = tb.merge_keyed(batch, str(path), ["id"], "version")
        after = files()
        assert {f"bucket_of_8={b}" for b in touched} >= {k for k in after if after[k] != before.get(k)} and len(touched) <= 2 < len(after)
        got = {r.id: (r.v, r.version) for r in tb.read_keyed(spark, str(path)).collect()}
        assert got == {i: (f"v{i}", 1) for i in range(200)} | {3: ("new", 2), 500: ("more", 1)}
    assert tb.merge_keyed(batch.limit(0), str(path), ["id"], "version") == [] and files() == after


def test_store_returns_the_rows_stored(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id bigint, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (5, "e", 1)], "id bigint, v string, version int")
    assert tb.store(old, new, ["id"], "version", str(tmp_path / "t")) == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a", 1), (2, "d", 3), (5, "e", 1)]


def test_late_versions_and_ties_change_nothing(spark):
    schema = "id bigint, v string, version int"
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 1), (3, "c", None)], schema)
    late = spark.createDataFrame([(1, "z", 2), (2, "x", 1), (4, None, 1)], schema)
    once = sorted(map(tuple, tb.upsert(old, late, ["id"], "version").collect()))
    assert once[0] == (1, "a", 5) and once[2:] == [(3, "c", None), (4, None, 1)]
    tie = tb.upsert(late.filter("id = 2"), old.filter("id = 2"), ["id"], "version").collect()
    assert [tuple(r) for r in tie] == [once[1]]
    with pytest.raises(Exception, match="must not be null"):
        tb.upsert(old, spark.createDataFrame([(2, "n", None)], schema), ["id"], "version").collect()


def test_equal_names_and_rewritten_files_are_new(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
    _drop(tmp_path / "a", 1)
    first = src.scan_text_files(spark, str(tmp_path / "a"))
    loaded = spark.createDataFrame(first.collect(), first.schema)
    assert src.only_new(src.scan_text_files(spark, str(tmp_path / "a")), loaded).count() == 0
    _drop(tmp_path / "b", 1)
    assert src.only_new(src.scan_text_files(spark, str(tmp_path / "b")), loaded).count() == 1
    (tmp_path / "a" / "receipt_001.txt").write_text(TEXT.format(n=2))
    assert src.only_new(src.scan_text_files(spark, str(tmp_path / "a")), loaded).count() == 1


def test_clear_leaves_an_empty_table(spark, tmp_path):
    df = spark.range(3)
    path = str(tmp_path / "t")
    tb.rebuild(df, path)
    assert tb.clear(spark, path, df.schema).count() == 0
    assert spark.read.parquet(path).dtypes == df.dtypes


def test_history_keeps_five(spark, tmp_path):
    e = spark.createDataFrame([(1, "q", "a", 0.7, [str(i) for i in range(9)])], "question_id bigint, question string, answer string, confidence double, receipts array<string>")
    for _ in range(2):
        history.save_history(e, str(tmp_path / "h"))
    rows = history.load_history(spark, str(tmp_path / "h")).collect()
    assert len(rows) == 2 and all(r.receipts == ["0", "1", "2", "3", "4"] for r in rows)


def test_metrics_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "merchant_name string, total_amount decimal(12,2), item_count int")
    row = da.global_metrics(empty).collect()[0]
    assert (float(row.total_spent), row.total_items, float(row.avg_receipt), row.unique_merchants) == (0.0, 0, 0.0, 0)


def test_extraction_and_chunking_shuffle_nothing(spark, tmp_path):
    from tillweave.operators.chunks import chunk_receipts
    from tillweave.operators.receipts import extract_receipts

    spark.createDataFrame([("f", "x")], "filename string, raw_text string").write.parquet(str(tmp_path / "raw"))
    plan = plan_of(chunk_receipts(extract_receipts(spark.read.parquet(str(tmp_path / "raw")))))
    assert "Exchange" not in plan and "Python" not in plan


def test_outputs_of_a_load_extract_once(spark, sf_dir):
    """Readable and damaged documents were extracted each for itself, and dates and totals twice in each."""
    from tillweave.plans import catalog

    plan = plan_of(catalog.QUERIES["s3_quarantine"](spark, sf_dir))
    assert "collect_list" not in plan and "parse_errors" in plan


def test_chunks_are_counted_without_their_text(spark, tmp_path):
    """The texts of all chunks, headers and totals were made where only their kinds are counted."""
    from tillweave.operators.chunks import chunk_receipts, chunk_statistics
    from tillweave.operators.receipts import extract_receipts

    spark.createDataFrame([("f", TEXT.format(n=1))], "filename string, raw_text string").write.parquet(str(tmp_path / "raw"))
    chunks = chunk_receipts(extract_receipts(spark.read.parquet(str(tmp_path / "raw"))))
    counted = chunk_statistics(chunks)
    plan = plan_of(counted)
    assert "Payment: " not in plan and "sha2" not in plan and "subtotal" not in plan
    assert {r.chunk_type: r.chunks for r in counted.collect()} == {"receipt_summary": 1, "item_detail": 1, "merchant_info": 1, "payment_method": 1}


def test_chunks_are_written_by_generated_code(spark, tmp_path):
    """The texts of items and groups were made inside array lambdas, which Spark interprets."""
    from tillweave.operators.chunks import chunk_receipts
    from tillweave.operators.receipts import extract_receipts

    spark.createDataFrame([("f", "x")], "filename string, raw_text string").write.parquet(str(tmp_path / "raw"))
    plan = plan_of(chunk_receipts(extract_receipts(spark.read.parquet(str(tmp_path / "raw")))))
    made = next(line for line in plan.splitlines() if "Item: " in line)
    assert "*(" in made and "lambda" not in made


def test_question_parameters_shuffle_nothing(spark):
    from tillweave.operators.questions import parse_questions

    df = spark.range(5).select(F.col("id").alias("question_id"), F.lit("how much").alias("text"), F.lit("2024-01-01").cast("timestamp_ntz").alias("reference_ts"))
    plan = plan_of(parse_questions(df))
    assert "Exchange" not in plan and "Python" not in plan


def test_matching_never_multiplies_blindly(spark, sf_dir):
    from tillweave.plans import catalog_answers as ca

    assert "BroadcastHashJoin" in plan_of(ca.qa1_filters(spark, sf_dir))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ca.qa1_filters(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "SortMergeJoin" in plan


def test_only_asked_keys_of_facts_are_shuffled(spark, sf_dir):
    """Every fact was shuffled with all its columns once per kind of key, whether or not a question had that very day."""
    from tillweave.operators import answers as qa
    from tillweave.plans import catalog_answers as ca, tables

    asked = ca.params(spark, sf_dir).filter("sum_basis = 'items'")
    keys = qa.question_keys(asked).filter(~qa._is_named())
    facts = tables.item_facts(spark, sf_dir)
    kept = qa._of_others(facts, keys, qa._kinds(keys), "item_id", "item_price")
    assert kept.count() < facts.count() / 50
    plan = ca.item_matches(asked, spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    semi = next(line for line in plan.splitlines() if "Join LeftSemi" in line)
    assert "_key" in semi and "strategy=broadcast" in semi
    assert "o_orderdate" in next(line for line in plan.splitlines() if "scalar-subquery" in line and "Filter" in line)  # bounds in time, at the scan


@pytest.mark.parametrize("name", ["v4_top_k_many", "qa7_evidence"])
def test_ranking_prunes_before_the_shuffle(spark, sf_dir, name):
    import __spark_entry__ as registered

    plan = plan_of(registered.queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("name", ["da3_top_merchants", "v3_filtered_top_k"])
def test_top_k_keeps_k_rows_per_task(spark, sf_dir, name):
    import __spark_entry__ as registered

    assert "TakeOrderedAndProject" in plan_of(registered.queries()[name](spark, sf_dir))


def test_no_query_crosses_tables(spark, sf_dir):
    """No query of the library's own plans a cartesian or nested-loop join, whatever the broadcast limit; queries that
    are maps over one table have none by their nature and are left out."""
    from tillweave.plans import catalog

    maps = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "i1", "i2", "i3", "i4", "i5", "i6", "ch", "m1", "m2", "m3", "m5", "m6", "m7", "tr", "qp", "me1", "me2", "me3", "me7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in catalog.QUERIES.items():
            if not name.startswith(maps):
                plan = plan_of(query(spark, sf_dir))
                assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as registered

    plan = plan_of(registered.queries()["v5_predicates"](spark, sf_dir))
    assert "PushedFilters: [In(l_returnflag" in plan or "PushedFilters: [" in plan and "GreaterThanOrEqual(l_quantity,10" in plan
    assert "l_extendedprice" not in plan


def test_questions_find_stored_texts(spark):
    rows = [(1, "milk bread and butter", "a"), (2, "laptop charger cable", "a"), (3, "butter croissant", "b"), (4, None, "a"), (5, "", "a")]
    texts = spark.createDataFrame(rows, "chunk_id long, text string, kind string").fillna({"text": ""})
    model = vectors.fit_text(texts, "text", 4096)
    made = vectors.text_vectors(model, texts)
    asked = spark.createDataFrame([(7, "Which charger?"), (8, "butter"), (9, "zebra"), (10, "")], "question_id long, text string")
    found = vectors.search_text(model, made, asked, "chunk_id", "question_id", k=1).collect()
    assert {(r.question_id, r.chunk_id) for r in found if r.score > 0} == {(7, 2), (8, 3)}
    only_a = vectors.search_text(model, made, asked, "chunk_id", "question_id", F.col("kind") == "a", k=1).collect()
    assert {(r.question_id, r.chunk_id) for r in only_a if r.score > 0} == {(7, 2), (8, 1)}


def test_terms_find_stored_texts(spark):
    from tillweave.operators import terms

    rows = [(1, "Milk bread, and BUTTER", "a"), (2, "laptop charger cable", "a"), (3, "butter croissant", "b"), (4, None, "a"), (5, "", "a"), (6, "日本語 ÉCLAIR", "a"), (7, "butter croissant", "a")]
    texts = spark.createDataFrame(rows, "chunk_id long, text string, kind string")
    model = terms.fit_terms(texts, "text", 4096)
    made = terms.term_vectors(model, texts)
    assert made.columns == ["chunk_id", "text", "kind", "embedding"]
    norms = {r.chunk_id: sum(x * x for x in r.embedding) for r in made.collect()}
    assert all(norms[i] == pytest.approx(0.0 if i in (4, 5) else 1.0) for i in norms)
    asked = spark.createDataFrame([(7, "Which charger?"), (8, "croissant"), (9, "zebra"), (10, None), (11, "éclair 日本語")], "question_id long, text string")
    found = vectors.search_text(model, made, asked, "chunk_id", "question_id", k=1).collect()
    assert {(r.question_id, r.chunk_id) for r in found if r.score > 0} == {(7, 2), (8, 3), (11, 6)}
    only_a = vectors.search_text(model, made, asked, "chunk_id", "question_id", F.col("kind") == "a", k=1).collect()
    assert {(r.question_id, r.chunk_id) for r in only_a if r.score > 0} == {(7, 2), (8, 7), (11, 6)}
    assert terms.fit_terms(texts.limit(0), "text", 8).weights.tolist() == [0.0] * 8


def test_rule_tables_mean_what_expressions_mean(spark):
    """Random rules of one letter on, overlapping and in any case, over random names."""
    import random

    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choices("abAcé ", k=rng.randint(low, high))).strip()
    names = [(i, w) for i, w in enumerate({word(0, 12) for _ in range(200)} | {None, "", "x"})]
    listed = [(f"c{i}", [w for w in {word(1, 5) for _ in range(4)} if w]) for i in range(12)]
    df = spark.createDataFrame(names, "id long, name string").withColumn("name", F.regexp_replace("name", r"\s+", " "))
    rules = spark.createDataFrame([(c, w, 11 - i) for i, (c, ws) in enumerate(listed) for w in ws], "category string, keyword string, rank int")
    rules = rules.withColumn("keyword", F.regexp_replace("keyword", r"\s+", " "))
    got = {r.id: r.categories for r in categories.categorise_by_table(df, "name", rules).collect()}
    lower = [(c, [" ".join(w.lower().split()) for w in ws]) for c, ws in reversed(listed)]
    want = {}
    for r in df.collect():
        found = [c for c, ws in lower if r.name is not None and any(w in r.name.lower() for w in ws)]
        want[r.id] = found or ["other"]
    assert got == want and sum(v != ["other"] for v in want.values()) > 100


def test_labels_merge_as_bits_and_as_sets(spark):
    rows = [(1, ["b", "a"]), (1, ["c"]), (1, ["b"]), (2, ["other"]), (3, [])]
    df = spark.createDataFrame(rows, "r long, labels array<string>")
    by_name = {1: (3, ["a", "b", "c"]), 2: (1, ["other"]), 3: (1, [])}
    got = lambda order: {r.r: (r.item_count, r.categories) for r in categories.categories_per_receipt(df, "r", "labels", order).collect()}
    assert got(None) == by_name
    assert got(["c", "b", "a", "other"]) == {1: (3, ["c", "b", "a"]), 2: (1, ["other"]), 3: (1, [])}
    plan = plan_of(categories.categories_per_receipt(df, "r", "labels", ["a", "b", "c", "other"]))
    assert plan.count("Exchange") == 1


def test_percentiles_are_exact(spark):
    """Against numpy: few rows, many rows, ties, one hot value, nulls, and all rows as one group."""
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"few": rng.normal(size=21), "one": [3.0], "many": rng.exponential(size=30_000), "ties": rng.integers(0, 4, 5000), "hot": [1.0] * 900 + list(range(100)), None: rng.normal(size=40)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("few", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for p in (0.95, 0.5, 0.0, 1.0, 0.999):
        for accuracy in (100, 10_000):
            got = {r.g: r.percentile for r in da.exact_percentile(df, "v", p, "g", accuracy=accuracy).collect()}
            assert got.keys() == {*groups, "void"} and got["void"] is None
            for g, vs in groups.items():
                assert got[g] == pytest.approx(float(np.quantile(np.array(vs, float), p)), abs=1e-12), (g, p, accuracy)
    whole = np.concatenate([np.array(v, float) for v in groups.values()])
    assert da.exact_percentile(df, "v", 0.95).first().percentile == pytest.approx(float(np.quantile(whole, 0.95)), abs=1e-12)


def test_rule_tables_know_letters_of_any_script(spark):
    rules = spark.createDataFrame([("bakery", "éclair"), ("coffee_shop", "café crème")], "category string, keyword string")
    names = spark.createDataFrame([("Fresh Éclair",), ("Café  Crème large",), ("clair",)], "name string")
    got = {r.name: r.categories for r in categories.categorise_by_table(names, "name", rules).collect()}
    assert got == {"Fresh Éclair": ["bakery"], "Café  Crème large": ["coffee_shop"], "clair": ["other"]}


def test_terms_are_counted_in_bounded_pieces(monkeypatch):
    """A batch of long texts was counted as a whole; its pieces hold the same rows in order."""
    import pyarrow as pa
    from tillweave.operators import terms

    monkeypatch.setattr(terms, "TERMS_AT_ONCE", 4)
    lists = [["a"] * n for n in (3, 0, 2, 9, 1)] + [None, ["b"]]
    batch = pa.record_batch([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], names=["id", "t"])
    pieces = list(terms._pieces(iter([batch, batch.slice(0, 0)])))
    assert [r for p in pieces for r in p.to_pylist()] == batch.to_pylist() and len(pieces) == 3


def test_spread_deals_rows_of_few_row_groups(spark, tmp_path):
    """A file of many splits whose rows all stand in one row group."""
    from tillweave.session import spread

    path = str(tmp_path / "one_group")
    spark.range(40_000).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16KB")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = spread(scan).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows[1] == 40_000 and rows[0] < 40_000 / spark.sparkContext.defaultParallelism
