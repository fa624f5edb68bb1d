"""File sources, the paired sink and fail-fast behaviour."""

import json

import pytest
from pyspark.sql import functions as F

from polyview.operators import labels as L
from polyview.sources import detections, logs, tables
from polyview.streaming.hooks import score_batches


def obj(x, det=0.5):
    return {"position": [x, 0, x + 5, 9], "confidences": {"det": det}, "classification": {"status": "unavailable"}}


def test_detection_shapes(spark, tmp_path):
    payloads = {
        "0.json": {"skus": [{"classes": ["a"], "objects": [obj(1), obj(2)]}, {"classes": [], "objects": [obj(3)]}]},
        "1.json": [{"classes": ["a"], "objects": [obj(4)]}, {"classes": [], "objects": [obj(5)]}],
        "10.json": {"classes": ["a"], "objects": [obj(6)]},
        "2.json": {"classes": [], "objects": []},
        "notes.json": {"other": 1},
    }
    for name, body in payloads.items():
        (tmp_path / name).write_text(json.dumps(body))
    rows = detections.read_detections(spark, str(tmp_path)).collect()
    got = sorted((r["image_id"], r["object_id"], r["x1"]) for r in rows if r["object_id"] is not None)
    assert got == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (10, 0, 6.0)]
    assert [r["image_id"] for r in rows if r["object_id"] is None] == [2]
    assert json.loads(rows[0]["classification"]) == {"status": "unavailable"}


@pytest.mark.parametrize("text", ["{broken", '{"unknown": 1}', "7"])
def test_bad_payload_fails_the_read(spark, tmp_path, text):
    (tmp_path / "3.json").write_text(text)
    with pytest.raises(Exception, match="not a detection payload"):
        detections.read_detections(spark, str(tmp_path)).collect()


LOG = """Reference image file ID: {ref}
Matched ref 3 → target 1 (hit ratio: 0.85 34/40)
Matched ref 4 → target 2 (hit ratio: 0.50 20/40)
Matching objects between reference image {ref} and target image {tgt}
Found {n} matches in image {tgt}

done. Found correspondences in 1 images.
Found 2 matches across 1 images
"""


def write_log(folder, ref, tgt, n=2):
    (folder / str(ref)).mkdir()
    (folder / str(ref) / "matching_summary.txt").write_text(LOG.format(ref=ref, tgt=tgt, n=n))


def test_match_log(spark, tmp_path):
    for ref, tgt in ((0, 2), (2, 10), (10, 2), (10 + 1, 0)):
        write_log(tmp_path, ref, tgt)
    rows = logs.read_match_log(spark, str(tmp_path)).orderBy("edge_seq").collect()
    assert [(r["ref_idx"], r["tgt_idx"], r["ref_id"]) for r in rows] == [
        (0, 2, 3), (0, 2, 4), (11, 0, 3), (11, 0, 4), (2, 10, 3), (2, 10, 4)
    ]
    assert (rows[0]["hit_ratio"], rows[0]["matched"], rows[0]["total"]) == (0.85, 34, 40)
    assert logs.read_match_log(spark, str(tmp_path), 0.6).count() == 3


def test_match_log_count_mismatch(spark, tmp_path):
    write_log(tmp_path, 0, 1, n=3)
    with pytest.raises(Exception, match="footer count differs"):
        logs.read_match_log(spark, str(tmp_path)).collect()


def test_only_folders_named_by_digits_are_read(spark, tmp_path):
    write_log(tmp_path, 0, 1)
    before = logs.read_match_log(spark, str(tmp_path)).count()
    for name in ("7_old", "backup", "x1"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "matching_summary.txt").write_text(LOG.format(ref=3, tgt=4, n=2))
    assert before > 0 and logs.read_match_log(spark, str(tmp_path)).count() == before


def test_match_log_without_footer(spark, tmp_path):
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / "matching_summary.txt").write_text("Matched ref 1 → target 2 (hit ratio: 0.50 1/2)\n")
    with pytest.raises(Exception, match="lack a target group"):
        logs.read_match_log(spark, str(tmp_path)).collect()


def test_reports(spark, tmp_path):
    block = "(Recall): {}% (1/2)\n (Effectiveness): 40.5% (1/2)\n  (Precision): 7% (1/2)\n"
    (tmp_path / "a.txt").write_text(block.format(10) + "---\n" + block.format(20))
    (tmp_path / "b.txt").write_text("nothing")
    means = logs.report_means(logs.read_reports(spark, str(tmp_path))).collect()
    assert [(r["count"], r["avg_recall"], r["avg_effectiveness"], r["avg_precision"]) for r in means] == [(2, 15.0, 40.5, 7.0)]


def test_last_records(spark):
    lines = spark.createDataFrame([("a", 1, '{"x": 1}'), ("a", 2, '{"x": 2, "y": "z"}'), ("b", 1, '{"y": 0}')], "file string, seq int, text string")
    got = {r["file"]: (r["x"], r["y"]) for r in logs.last_records(lines, ["x", "y"]).collect()}
    assert got == {"a": ("2", "z"), "b": (None, "0")}


def test_csv_sources(spark, tmp_path):
    truth = tmp_path / "gt.csv"
    truth.write_text("reference_img,target_img,reference_id,target_id,img_src\n1,2,3,4,shelf_a\n1,3,5,6,shelf_b\n")
    rows = tables.read_truth(spark, str(truth), "_b").collect()
    assert [(r["pair"], r["target_id"]) for r in rows] == [("1_to_3", 6)]
    master = tmp_path / "m.csv"
    master.write_text("sku_id,manufacturer,brand,category,is_posm\n12, Acme ,NULL,soap,1\n012,a,b,c,0\n5,a,b,c,2\n7,a,b,c,0\n7,a,b,d,0\n")
    got = sorted((r["raw_id"], r["manufacturer"], r["brand"], r["error"]) for r in tables.read_master(spark, str(master)).collect())
    assert got == [("012", "a", "b", "id"), ("12", "Acme", None, None), ("5", "a", "b", "is_posm"), ("7", "a", "b", "duplicate"), ("7", "a", "b", "duplicate")]
    swapped = tmp_path / "s.csv"
    swapped.write_text("sku_id,brand,manufacturer,category,is_posm\n1,a,b,c,0\n")
    with pytest.raises(Exception):
        tables.read_master(spark, str(swapped)).collect()


def test_odometry(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("timestamp, frame, x, y, z, qx, qy, qz, qw\n0.5, 0, 0, 0, 0, 0, 0, 0, 1\n0.6, 1, 0, 0, 0, 0, 0, 0, 1\n0.6, 2, 0, 0, 0, 0, 0, 0, 1\n0.9, 4, 0, 0, 0, 0, 0, 0, 1\n")
    got = {r["frame"]: r["error"] for r in tables.odometry_errors(tables.read_odometry(spark, str(path))).collect()}
    assert got == {2: "timestamp", 4: "frame"}


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({
        "images": [{"id": 1, "file_name": "x"}, {"id": 2, "file_name": "y"}],
        "annotations": [{"id": 10, "image_id": 1, "category_id": 5}], "categories": [{"id": 5, "name": "box"}],
    }))
    _, rows = detections.read_annotations(spark, str(path))
    assert sorted((r["image_id"], r["annotation_id"], r["category"]) for r in rows.collect()) == [(1, 10, "box"), (2, None, None)]


def test_publish_is_all_or_nothing(spark, tmp_path):
    base = str(tmp_path / "pub")
    one, two = spark.range(3), spark.range(5)
    first = tables.publish(spark, base, {"a": one, "b": two}, lambda t: None)
    assert tables.read_published(spark, base, "b").count() == 5

    def refuse(t):
        raise ValueError("rejected")

    with pytest.raises(ValueError, match="rejected"):
        tables.publish(spark, base, {"a": two, "b": one}, refuse)
    assert tables.read_published(spark, base, "a").count() == 3
    left = [p.name for p in (tmp_path / "pub").iterdir() if p.is_dir()]
    assert left == [first]
    tables.publish(spark, base, {"a": two, "b": one}, lambda t: None)
    assert tables.read_published(spark, base, "a").count() == 5


def test_image_documents_split_large_images(spark):
    rows = spark.range(10).select(F.lit(1).alias("image_id"), F.col("id").alias("object_id"))
    docs = {r["part"]: (r["objects"], json.loads(r["document"])) for r in L.image_documents(rows, "image_id", ["object_id"], 4).collect()}
    assert {p: n for p, (n, _) in docs.items()} == {0: 4, 1: 4, 2: 2}
    assert [o["object_id"] for p in sorted(docs) for o in docs[p][1]["objects"]] == list(range(10))


def test_vote_order_and_ties(spark):
    votes = [(1, "b", "B", 0.5), (1, "a", "A", 0.5), (1, "0", "other", 0.9), (2, None, None, 0.1), (3, "x", "X", 0.2)]
    schema = "gid int, sku_id string, sku_name string, confidence double"
    for order in (votes, votes[::-1]):
        got = {r["gid"]: (r["status"], r["sku_id"]) for r in L.vote(spark.createDataFrame(order, schema), other_id="0").collect()}
        assert got == {1: ("conflict", "a"), 2: ("unavailable", None), 3: ("resolved", "x")}


def test_batch_scorer_length_check(spark):
    docs = spark.createDataFrame([(i, "t" if i % 5 else None) for i in range(40)], "doc_id int, text string")
    seen = score_batches(docs, "doc_id", "text", lambda b: [("ok", 1.0)] * len(b)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in seen} == {"ok": 32, "unavailable": 8}
    with pytest.raises(Exception, match="results for"):
        score_batches(docs, "doc_id", "text", lambda b: [("ok", 1.0)]).collect()


def test_strict_alignment_fails_without_common_frames(spark):
    from polyview.operators import ordered

    a, b = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in ((1, 2, 3), (3, 4)))
    assert [r["id"] for r in ordered.aligned_ids(a, b, "id", strict=True).collect()] == [3]
    with pytest.raises(ValueError, match="nothing can be aligned"):
        ordered.aligned_ids(a, b.filter("id > 3"), "id", strict=True)
    assert ordered.aligned_ids(a, b.filter("id > 3"), "id").count() == 0


def test_record_outcomes_read_each_record_once(spark):
    good = {"schema_version": "1.0.0", "source": L.RECORD_SOURCE, "project_id": L.PROJECT_ID, "status": "unavailable", "reason": "low_quality"}
    texts = [json.dumps(good), json.dumps({**good, "source": "x"}), json.dumps({**good, "more": 1}), "[1]", "{", None, json.dumps({**good, "reason": ""})]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, record string")
    out = L.record_outcomes(rows, "record")
    got = [r["outcome"] for r in out.orderBy("i").collect()]
    assert got == ["ok", "source", "schema", "object", "object", "object", "reason"]
    valid, rejects = L.validate_records(rows, "record")
    assert [r["i"] for r in valid.collect()] == [0] and {r["i"]: r["reason"] for r in rejects.collect()} == {i: g for i, g in enumerate(got) if i}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Scan") + plan.count("LogicalRDD") <= 1
