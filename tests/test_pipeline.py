import json

from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import corpus, infer, merge, mining, profile, training, work
from factloom.sources import connectors, readers, sinks
from factloom.streaming import resume


def test_quota_is_not_one_window(spark):
    """An id beyond the first bucket's quota may still be kept by the second."""
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 1), ("a", "y", 2), ("c", "y", 3)], "id string, bucket string, rank int")
    got = {(r.id, r.bucket) for r in corpus.quotas(rows, [("x", 1), ("y", 2)], "id", "bucket", "rank").collect()}
    assert got == {("a", "x"), ("b", "y"), ("c", "y")}


def test_files_and_versions(spark):
    keys = spark.createDataFrame([("P1", "P1.1/f1.png", 1), ("P1", "P1.2/f1.gif", 2), ("P1", "P1.2/f1.jpg", 3), ("P1", "P1x.9/f1.jpg", 4)], "pmcid string, key string, n int")
    newest = corpus.latest_version(keys)
    assert sorted(r.key for r in newest.collect()) == ["P1.2/f1.gif", "P1.2/f1.jpg"]
    wanted = spark.createDataFrame([("P1", "f1.tif")], "pmcid string, graphic string")
    assert corpus.best_file(wanted, newest, ["pmcid"], "n").first().key == "P1.2/f1.jpg"
    three = spark.createDataFrame([("P1", "P1.2/f1.gif", 1), ("P1", "P1.2/f1.tiff", 2), ("P1", "P1.2/f1.tif", 3)], "pmcid string, key string, n int")
    assert corpus.best_file(wanted, three, ["pmcid"], "n").first().key == "P1.2/f1.tif"


def test_mining(spark):
    content = lambda **x: tuple(x.get(f.name) for f in schemas.CONTENT)
    sentence = "As Table 2 shows, the score of the new method rose to 14.5 points."
    doc = ("P1", "t", "cc", 1, 0, [("Results", [content(tag="p", text=f"Intro text. {sentence} See Table 2."), content(tag="table", label="Table 2", xref_id="t2a"), content(tag="table", label=None)]), ("More", [content(tag="table", label="Table 2", xref_id="t2b"), content(tag="fig", label="Algorithm 1")])])
    df = spark.createDataFrame([doc], schemas.DOCUMENT)
    got = mining.claims(df).collect()
    assert [(r.sentence, r.xref_id) for r in got] == [(sentence, "t2b")]
    s = mining.doc_summary(df).first()
    assert (s.n_sections, s.n_paragraphs, s.n_tables, s.n_figures) == (2, 1, 3, 1)


def test_routed_and_fallback(spark):
    p = lambda *rows: spark.createDataFrame(rows, "id string, pred_label string")
    base, better = p(("1", "a"), ("2", "b")), p(("2", "B"), ("3", "C"))
    assert {(r.id, r.pred_label, r.origin) for r in merge.with_fallback(base, better, "id").collect()} == {("1", "a", "baseline"), ("2", "B", "advisor")}
    rows = spark.createDataFrame([("1", "figure"), ("2", "table"), ("9", "table")], "id string, kind string")
    got = merge.routed(rows, "kind", {"figure": better, "table": better}, base, "id", strict=False)
    assert {(r.id, r.pred_label, r.route) for r in got.collect()} == {("1", "a", "fallback"), ("2", "B", "table"), ("9", None, "fallback")}
    try:
        merge.routed(rows, "kind", {"table": better}, base, "id").collect()
    except Exception as e:  # noqa: BLE001
        assert "no fallback for 9" in str(e)
    else:
        raise AssertionError("a missing fallback must be an error")


def test_prompt_takes_braces_literally(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(merge.prompt("A {a} B {b} {c}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "A {b} B x {c}"


def test_selection_orders(spark):
    rows = spark.range(20).withColumnRenamed("id", "n")
    done = spark.createDataFrame([(1,), (4,)], "n bigint")
    a = work.Selection(rows, "n").shard(1, 3).limit(3).resume(done, ["n"]).rows
    b = work.Selection(rows, "n").resume(done, ["n"]).limit(3).rows
    assert sorted(r.n for r in a.collect()) == [7] and sorted(r.n for r in b.collect()) == [0, 2, 3]


def test_ledger_is_idempotent(spark, tmp_path):
    calls = []
    rows = spark.range(5)

    def step(df):
        n = df.count()
        calls.append(n)
        return df.withColumn("found", F.col("id") != 3)

    work.process(rows, f"file://{tmp_path}/ledger", ["id"], step)
    out = work.process(rows, f"file://{tmp_path}/ledger", ["id"], step)
    assert calls == [5, 0] and out.count() == 5  # not-found rows are recorded and don't come again


def test_stream_resumes(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = schemas.TASK1_PRED
    spark.createDataFrame([("1", "Supported")], schema).write.json(source)
    go = lambda: resume.run_available(spark, source, schema, lambda d: d.withColumn("n", F.lit(1)), target, state)
    assert go() == 1 and go() == 0
    spark.createDataFrame([("2", "Refuted")], schema).write.mode("append").json(source)
    assert go() == 1
    assert {r.claim_id for r in resume.results(spark, target).collect()} == {"1", "2"}


def test_readers_and_sinks(spark, tmp_path):
    odd = "line sep"
    (tmp_path / "a.jsonl").write_text(json.dumps({"claim_id": "1", "pred_label": odd}, ensure_ascii=False) + "\n\n" + json.dumps({"claim_id": "2"}) + "\n", encoding="utf-8")
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), schemas.TASK1_PRED)
    assert {(r.claim_id, r.pred_label) for r in rows.collect()} == {("1", odd), ("2", None)}
    assert readers.json_lines(spark, str(tmp_path / "none"), schemas.TASK1_PRED, missing_ok=True).count() == 0
    assert sinks.json_array_file(rows, str(tmp_path / "model_a.json")) == 2
    back = readers.prediction_files(spark, str(tmp_path / "model_*.json"), schemas.TASK1_PRED)
    assert {(r.claim_id, r.model) for r in back.collect()} == {("1", "model_a"), ("2", "model_a")}
    (tmp_path / "map.json").write_text(json.dumps({"f1.png": {"num_panels": 2, "type": "bar", "confidence": 0.5}}))
    assert readers.json_map(spark, str(tmp_path / "map.json"), schemas.FIGURE_CLASS).first().num_panels == 2
    sinks.id_list(rows, "claim_id", str(tmp_path / "ids"))
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "ids")).collect()) == ["1", "2"]
    sinks.files(spark.createDataFrame([("x.bin", bytearray(b"ab"))], "name string, data binary"), str(tmp_path / "bin"))
    assert (tmp_path / "bin" / "x.bin").read_bytes() == b"ab"
    sinks.partitioned(rows, str(tmp_path / "cache"), "claim_id", 4)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
    xml = spark.createDataFrame([("<R><Contents><Key>a/b</Key><Size>3</Size></Contents><Contents><Key>c</Key><Size>4</Size></Contents></R>",)], "xml string")
    assert [(r.key, r.size) for r in readers.bucket_listing(spark, xml).collect()] == [("a/b", 3), ("c", 4)]


def test_connectors(spark, tmp_path):
    def service(ids):
        if "bad" in ids:
            raise OSError("down")
        return [(i, {"title": i}) for i in ids if i != "gone"]

    ids = spark.createDataFrame([("1",), ("gone",), ("2",)], "id string")
    got = {r.id: (r.found, r.body) for r in connectors.fetch(ids, "id", service).collect()}
    assert got["1"] == (True, '{"title": "1"}') and got["gone"] == (False, None)
    assert connectors.fetch(spark.createDataFrame([("bad",)], "id string"), "id", service).first().error.startswith("OSError")
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"pmcid": str(i), "title": f"T {i} forest", "licence": "cc"}) for i in range(5)))
    spark.dataSource.register(connectors.SearchSource)
    hits = spark.read.format("claim_search").option("path", str(tmp_path / "d.jsonl")).option("licences", "cc").option("phrase", "Forest").option("n", "3").load()
    assert [r.pmcid for r in hits.orderBy("rank").collect()] == ["0", "1", "2"]
    pushed = spark.read.format("claim_search").option("path", str(tmp_path / "d.jsonl")).option("n", "3").option("pushdown", "true").load()
    assert pushed.where("licence = 'by'").count() == 0 and pushed.where("licence in ('cc', 'by')").count() == 3
    assert hits.where("licence = 'by'").count() == 0 and hits.where("licence = 'cc' and pmcid = '1'").count() == 1


def test_files_that_exist(spark):
    rows = spark.createDataFrame([("1", "a/b.png"), ("2", "./a//c.png"), ("3", None)], "id string, path string")
    listing = spark.createDataFrame([("./a/b.png",), ("a/c.png",), ("x",)], "path string")
    assert sorted(r.id for r in readers.with_files(rows, "path", listing).collect()) == ["1", "2"]


def test_stage_counts(spark):
    rows = spark.createDataFrame([(1,), (5,), (9,), (None,)], "v int")
    got = {r.stage: r.n for r in profile.stage_counts(rows, {"big": F.col("v") > 2, "odd": F.col("v") > 7}).collect()}
    assert got == {"scanned": 4, "big": 2, "odd": 1}


def test_decisions(spark):
    rows = spark.createDataFrame([("Supported", "Refuted", None), ("Refuted", "Supported", None), ("Supported", "Supported", "evidence_id_2"), ("Refuted", "Refuted", None), (None, None, None), ("Supported", None, None)], "a string, b string, j string")
    got = [(r.x.label, r.x.mode) for r in rows.select(infer.decide_pair(F.col("a"), F.col("b"), F.col("j")).alias("x")).collect()]
    assert got == [("evidence_id_1", "decisive"), ("evidence_id_2", "decisive"), ("evidence_id_2", "fallback"), ("evidence_id_1", "fallback"), ("evidence_id_1", "fallback"), ("evidence_id_1", "decisive")]


def test_advisors_and_errors(spark):
    class Reader:
        def generate(self, items):
            if any("bad" in x["image_path"] for x in items):
                raise ValueError("unreadable")
            return ["text of " + x["image_path"] for x in items]

    infer.register_advisor("reader", "table", Reader)
    images = spark.createDataFrame([("a.png", "table"), ("b.png", "figure")], "image_path string, evi_type string")
    assert [(r.image_path, r.text) for r in infer.advise(images, "reader").collect()] == [("a.png", "text of a.png")]
    assert infer.advise(spark.createDataFrame([("bad.png", "table")], "image_path string, evi_type string"), "reader").count() == 0


def test_training(spark):
    rows = spark.createDataFrame([("PMC1", 0, "c", "x", "cap", None, "s.png", "r.png", "Category Swap", "figure", "d"), ("PMC1", 1, "c", "x", "cap", None, "s.png", None, None, "figure", "d")], "pmcid string, idx int, claim string, context string, caption string, perturbed_caption string, evidence string, perturbed_evidence string, operation string, evi_type string, domain string")
    assert sorted(r.claim_id for r in training.task1_records(rows).collect()) == ["PMC1_0_r", "PMC1_0_s", "PMC1_1_s"]
    side = training.evidence_sides(rows).collect()
    assert [(r.sample_id, r.evidence_id_2, r.label) for r in side] == [("PMC1_0", "s.png", "evidence_id_2")]
    pairs = spark.createDataFrame([(i, str(i // 2)) for i in range(20)], "id int, pair string")
    held = training.holdout(pairs, "pair", 3)
    assert held.where("held_out").count() == 6 and held.where("held_out").select("pair").distinct().count() == 3


def test_profile(spark):
    rows = spark.createDataFrame([("a", "x y"), ("a", "x"), (None, ""), ("b", "x y z")], "k string, t string")
    assert {(r.value, r.n) for r in profile.value_counts(rows, ["k"]).collect()} == {("a", 2), ("N/A", 1), ("b", 1)}
    r = profile.length_stats(rows, ["t"]).first()
    assert (r.n, r.least, r.most, r["mean"], r["median"]) == (3, 1, 3, 2.0, 2.0)
    r = profile.gaps(rows, ["k"]).first()
    assert (r.n, r.missing, r.duplicates) == (4, 1, 1)
    values = spark.createDataFrame([("t", float(i)) for i in range(1, 11)], "evi_type string, v double")
    assert {r.p90 for r in profile.footprint(values, "evi_type", "v").collect()} == {10.0}
    assert [r.field for r in profile.field_inventory(spark.createDataFrame([('{"b": 1, "a": 2}',), (None,)], "j string"), "j").collect()] == ["a", "b"]


def test_json_arrays_of_partitions(spark, tmp_path):
    from factloom.sources import readers, sinks

    schema = spark.createDataFrame([(1, "a")], "n int, t string").schema
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"x\n\u2028{i},]") for i in range(50)], schema)
    for rows in (df.repartition(7), df.limit(1), df.limit(0), df.repartition(40)):
        sinks.json_array(rows, f"file://{tmp_path}/a")
        assert sorted(map(tuple, readers.json_array(spark, f"file://{tmp_path}/a", schema).collect())) == sorted(map(tuple, rows.collect()))


def test_failed_calls_and_empty_objects(spark):
    from factloom.sources import connectors

    def service(ids):
        if 3 in ids:
            raise OSError("down")
        return [(i, b"" if i == 1 else bytes([0, 255, i])) for i in ids if i != 2]

    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 9, 9)], "id bigint")
    got = {r.id: (r.found, bytes(r.data) if r.data is not None else None, r.error) for r in connectors.fetch_binary(ids, "id", service, batch=1, calls=1).collect()}
    assert got == {1: (True, b"", None), 2: (False, None, None), 3: (None, None, "OSError: down"), 9: (True, b"\x00\xff\x09", None)}


def test_search_stops_at_a_short_page(spark):
    from factloom.sources import connectors

    def service(query, start, size):
        return [{"pmcid": f"{query}{i}"} for i in range(start, min(start + size, {"a": 25, "b": 0}[query]))]

    asked = spark.createDataFrame([("a", 100), ("b", 5), ("a", 7)], "query string, n int")
    got = connectors.search_pages(asked, service, page=10).groupBy("query").count().collect()
    assert {r.query: r["count"] for r in got} == {"a": 25 + 7}
