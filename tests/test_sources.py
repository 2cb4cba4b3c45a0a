import gzip
import json

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as T
from seqloom.operators.codes import TokenLayout
from seqloom.session import materialize, shared_root
from seqloom.sources import images as I, records as R, sinks as S, tables as Tb

LINES = [
    '{"reviewerID": " u1 ", "asin": "a", "unixReviewTime": 12.7}',
    "",
    "   ",
    "{'reviewerID': 'u2', 'asin': ['b', '', None, 'c'], 'unixReviewTime': '12', 'ok': True}",
    "junk",
    "[1, 2]",
    '"text"',
    '{"reviewerID": "u3", "asin": "a", "unixReviewTime": "abc"}',
    '{"reviewerID": "u4", "asin": "a", "unixReviewTime": null}',
    '{"reviewerID": "", "asin": "a"}',
    '{"reviewerID": "u5"}',
    '{"reviewerID": "u6\\u2003x", "asin": "d", "unixReviewTime": "12.7"}',
    '{"reviewerID": "u7", "asin": 5}',
]
WANT = [("u1", "a", 12), ("u2", "b c", 12), ("u3", "a", 0), ("u4", "a", 0), ("u6 x", "d", 0), ("u7", "5", 0)]


@pytest.mark.parametrize("name", ["r.json", "r.json.gz"])
def test_review_scan(spark, rows, tmp_path, name):
    path = tmp_path / name
    opener = gzip.open if name.endswith("gz") else open
    with opener(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(LINES))
    assert rows(R.read_interactions(spark, str(path)), "user_id", "item_id", "ts") == WANT


def meta_lines(spark, records):
    data = [(json.dumps(r), n) for n, r in enumerate(records)]
    return R.parse_records(spark.createDataFrame(data, "value string, line_order int"))


META = [
    {"asin": "a", "title": " First\t one ", "categories": [["A", "", "B"], ["C"]], "imUrl": " ", "imageURL": ["", " http://h/p/q.jpg?x=1 "]},
    {"asin": "zz", "title": "not wanted"},
    {"asin": "b", "title": ["x", "", None, "y z"], "categories": ["P", "Q"], "imageURLHighRes": "http://h/r.png"},
    {"asin": "a", "title": "after the end", "brand": "late"},
]


def test_last_record_of_all_lines_wins(spark, rows):
    both = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, item_idx int")
    got = rows(R.item_metadata(meta_lines(spark, META), both), "item_idx", "title", "categories", "image_url")
    assert got == [(0, "after the end", "", ""), (1, "x y z", "P > Q", "http://h/r.png")]
    first = rows(R.item_metadata(meta_lines(spark, META[:3]), both), "item_idx", "title", "categories", "image_url")
    assert first[0] == (0, "First one", "A > B", "http://h/p/q.jpg?x=1")
    more = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "item_id string, item_idx int")
    assert rows(R.item_metadata(meta_lines(spark, META), more), "item_idx", "title") == [(0, "after the end"), (1, "x y z")]
    texts = R.item_texts(meta_lines(spark, META), more, 9)
    assert rows(texts, "item_idx", "text", "has_meta") == [
        (0, "title: after the end ; brand: late", True), (1, "title: x y z ; categories: P > Q", True), (2, "c", False)
    ]
    assert tuple(R.coverage(texts, F.col("has_meta")).first()) == (2, 1)
    hints = R.image_hints(meta_lines(spark, META[:3]), both)
    assert rows(hints, "item_idx", "image_filename") == [(0, "q.jpg"), (1, "r.png")]


def test_line_order_follows_the_file(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("\n".join(json.dumps({"asin": "a", "title": f"t{n}"}) for n in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        more = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, item_idx int")
        lines = R.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 4
        assert R.item_metadata(R.parse_records(lines), more).first()["title"] == "t2999"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\t b\n", ["x", "", None, "y z"], "abc def", "http://h/p/q.jpg?x=1", "", [1, 2])], "t string, l array<string>, s string, u string, e string, c array<int>")
    r = df.select(
        T.clean_text("t"), T.clean_text_list("l"), T.truncate_text("s", 4), T.truncate_text("s", 7), T.file_name_of_url("u"), T.file_name_of_url("e"),
        T.clean_text(F.lit(None).cast("string")), T.item_text({"title": F.lit("")}, F.lit("B1")), T.target_text(F.lit(""), F.lit("A > B")),
        T.code_key("c"), T.parse_code_key(F.lit("1-2-3")),
    ).first()
    assert tuple(r) == ("a b", "x y z", "abc...", "abc def", "q.jpg", "", "", "B1", "A > B", "1-2", [1, 2, 3])


def test_white_space_is_that_of_python(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(ord(c), f"a{c}b") for c in chars], "n int, t string").select("n", T.clean_text("t").alias("t"))
    assert all(r["t"] == " ".join(f"a{chr(r['n'])}b".split()) for r in df.collect())


def test_images(spark, rows, tmp_path):
    root = tmp_path / "img"
    for name in ("i0.png", "i0.jpg", "given/p.bmp", "name.jpg", "i3/own.webp", "deep/er/Stem4.JPG", "deep/NAMED.jpeg", "note.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    files = I.list_images(spark, str(root))
    assert files.count() == 7
    names = ["i0", "i1", "i2", "i3", "stem4", "i5", "i6"]
    items = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "item_id string, item_idx int")
    hints = spark.createDataFrame(
        [(0, "x.png", "", "http://x"), (1, "", "given/p.bmp", ""), (2, "name.jpg", "", ""), (3, "own.webp", "", ""), (5, "named.JPEG", "", ""), (6, "", "", "http://y")],
        "item_idx int, image_filename string, image_path string, image_url string",
    )
    found = I.resolve_images(items, hints, files)
    got = {i: p and p.split("/img/")[1] for i, p in rows(found.filter("path is not null"), "item_idx", "path")}
    assert got == {0: "i0.jpg", 1: "given/p.bmp", 2: "name.jpg", 3: "i3/own.webp", 4: "deep/er/Stem4.JPG", 5: "deep/NAMED.jpeg"}
    assert rows(I.missing_downloads(found, hints), "item_id", "image_url") == [("i6", "http://y")]
    assert tuple(I.image_coverage(found).first()) == (6, 1)


def test_sinks_round_trip(spark, rows, tmp_path):
    root = str(tmp_path)
    samples = spark.createDataFrame([("train", 0, 1, 0, 0), ("train", 0, 2, 0, 1), ("val", 0, 3, 0, 0)], "split string, user_idx int, pos int, chunk_id bigint, slot int")
    S.write_samples(samples, f"{root}/s")
    assert [r["pos"] for r in Tb.in_chunk_order(Tb.read_samples(spark, f"{root}/s", "train")).collect()] == [1, 2]
    assert Tb.read_samples(spark, f"{root}/s").count() == 3
    with pytest.raises(ValueError):
        Tb.read_samples(spark, f"{root}/s", "test")
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_samples(samples, f"{root}/s")
    S.write_samples(samples.limit(1), f"{root}/s", overwrite=True)
    items = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, item_idx int")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "item_idx int, vec array<double>")
    S.write_id_maps(items, items, root)
    S.write_item_store(vecs, items, root)
    assert Tb.read_vectors(spark, f"{root}/item_vectors", 2, 2).count() == 2
    with pytest.raises(ValueError):
        Tb.read_vectors(spark, f"{root}/item_vectors", 3, 2)
    codes = spark.createDataFrame([(0, "a", [1, 2]), (1, "b", [1, 2])], "item_idx int, item_id string, code array<int>")
    S.write_codes(codes, vecs, f"{root}/q", {"method": "pq"})
    assert Tb.read_code_table(spark, f"{root}/q/item_codes").count() == 2
    assert spark.read.parquet(f"{root}/q/code_items").first()["items"] == ["a", "b"]
    assert json.loads(spark.read.json(f"{root}/q/manifest").first()["payload"]) == {"method": "pq"}
    odd = 'x "],\n  ] y'
    for name, payload in (("c", {odd: [1, 2], "b": [3, 4]}), ("g", {"1-2": ["a", odd]}), ("m", {"a": 0, odd: 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=2, ensure_ascii=False))
    assert rows(Tb.read_code_json(spark, f"{root}/c.json"), "item_id", "code") == [("b", [3, 4]), (odd, [1, 2])]
    assert rows(Tb.read_code_groups_json(spark, f"{root}/g.json"), "code", "items") == [([1, 2], ["a", odd])]
    assert rows(Tb.read_id_map_json(spark, f"{root}/m.json"), "item_id", "item_idx") == [("a", 0), (odd, 1)]


def test_tokenized_sink_and_records(spark, tmp_path):
    from seqloom.operators.checks import TOKENIZED_COLUMNS

    one = spark.range(3).select(F.when(F.col("id") < 2, "train").otherwise("val").alias("split"), *[F.array(F.lit(1)).alias(c) for c in TOKENIZED_COLUMNS])
    manifest = S.write_tokenized(one, str(tmp_path / "t"), TokenLayout((3, 4)))
    assert manifest["splits"]["train"]["num_samples"] == 2 and manifest["semantic_offsets"] == [5, 8] and manifest["vocab_size"] == 12
    with pytest.raises(KeyError):
        S.write_tokenized(one.drop("labels"), str(tmp_path / "u"), TokenLayout((3, 4)))
    S.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'
    with pytest.raises(ValueError):
        S.manifest_row(spark, "embedding", {"artifacts": [{"source_type": "audio"}]})
    metrics = spark.createDataFrame([("overall", 3, 0.5), ("cold", 1, 0.0), ("hot", 2, 1.0)], "group string, sample_count bigint, hit double")
    summary = spark.createDataFrame([(0, "cold", 4), (2, "hot", 5)], "group_id int, group string, num_items int")
    r = S.metrics_record(metrics, summary, {"split": "test"}).first()
    assert r["split"] == "test" and r["overall_metrics"]["hit"] == 0.5 and [g["num_items"] for g in r["group_metrics"]] == [4, 5]


def test_materialize_uses_the_shared_folder(spark):
    out = materialize(spark.range(5), "x")
    assert out.count() == 5 and shared_root(spark) in out.inputFiles()[0]


def test_lines_are_records_or_rejected_with_a_reason(spark, rows):
    lines = {
        '{"asin": "a", "x": 1}': "a",
        "{'asin': 'b', 'x': {1, 2}, 'y': (None, b'q')}": "b",
        '{"asin": "c", "x": NaN, "y": [Infinity, -Infinity]}': "c",
        "{'asin': 'd', 'x': 1e999}": "d",
        "[1, 2]": "not a record",
        "{broken": "neither JSON nor a literal",
        "junk()": "neither JSON nor a literal",
        "'text'": "not a record",
        None: "no line",
    }
    table = spark.createDataFrame([(t, n) for n, t in enumerate(lines)], "value string, line_order int")
    parsed = R.split_records(table)
    found = {r["value"]: r["k"] for r in parsed.records.select("value", R.text_field("asin").alias("k")).collect()}
    found |= {r["value"]: r["reason"] for r in parsed.rejected.collect()}
    assert found == lines
    kept = parsed.records.filter("line_order = 1").select(R._get("x", "array<int>").alias("x"), R._get("y", "array<string>").alias("y")).first()
    assert kept["x"] == [1, 2] and kept["y"] == [None, "q"]
    assert R.parse_records(table.limit(0)).count() == 0


ODD_NAMES = ['a', 'say \\"hi\\"', 'back\\\\', 'br]ack{et, :', 'line\nbreak', 'é中', '', 'x' * 300, '1-2', 'tail\\\\\\"']


@pytest.mark.parametrize("layout", [{"indent": 2}, {"indent": None}, {"separators": (",", ":")}, {"indent": 7, "ensure_ascii": False}])
def test_json_maps_of_any_layout_in_small_byte_ranges(spark, rows, tmp_path, layout):
    ids = {name: n - 1 for n, name in enumerate(ODD_NAMES)}
    codes = {name: [n, 2 * n, -1][: n % 4] for n, name in enumerate(ODD_NAMES)}
    groups = {f"{n}-{n + 1}": ODD_NAMES[: n % 5] for n in range(9)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for name, payload in (("ids", ids), ("codes", codes), ("groups", groups)):
            (tmp_path / name).write_text(json.dumps(payload, **layout))
        assert dict(rows(Tb.read_id_map_json(spark, str(tmp_path / "ids")), "item_id", "item_idx")) == ids
        assert dict(rows(Tb.read_code_json(spark, str(tmp_path / "codes")), "item_id", "code")) == codes
        got = {r["code_key"]: (r["code"], r["items"]) for r in Tb.read_code_groups_json(spark, str(tmp_path / "groups")).collect()}
        assert got == {k: ([int(x) for x in k.split("-")], v) for k, v in groups.items()}
        (tmp_path / "empty").write_text("{ }")
        assert Tb.read_id_map_json(spark, str(tmp_path / "empty")).count() == 0
        for text in ('{"a": "b"}', '{"a": {"b": 1}}', '{"a": 1.5}'):
            (tmp_path / f"wrong{len(text)}").write_text(text)
            with pytest.raises(Exception, match="no entry of the expected kind"):
                Tb.read_id_map_json(spark, str(tmp_path / f"wrong{len(text)}")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_roots(spark, tmp_path):
    one = lambda n, split=None: spark.range(n).withColumn("split", F.lit(split)) if split else spark.range(n)
    own, parts, flat, chunks = (str(tmp_path / n) for n in ("own", "parts", "flat", "chunks"))
    one(3).write.parquet(f"{own}/train")
    one(5).write.parquet(f"{own}/val")
    one(2, "train").union(one(4, "val")).write.partitionBy("split").parquet(parts)
    one(7).write.parquet(flat)
    for n in (0, 1):
        one(3).write.parquet(f"{chunks}/test/chunk_{n}")
    assert [Tb.read_samples(spark, own, s).count() for s in ("train", "val")] == [3, 5]
    assert [Tb.read_samples(spark, parts, s).count() for s in ("train", "val")] == [2, 4]
    assert Tb.split_root(spark, flat, "train") == flat and Tb.read_samples(spark, flat, "train").count() == 7
    assert Tb.read_samples(spark, chunks, "test").count() == 6
    for root, split in ((own, "test"), (parts, "test"), (str(tmp_path / "none"), "train")):
        with pytest.raises(ValueError, match="no samples"):
            Tb.read_samples(spark, root, split)


def test_stage_manifests(spark, rows):
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "item_idx int, vec array<double>")
    entry = S.vector_stage(vecs, "titles", "text", "/v", model="hashed")
    assert entry == {"source_name": "titles", "source_type": "text", "matrix_path": "/v", "dim": 2, "item_count": 2, "metadata": {"model": "hashed"}}
    raw = dict(dataset_name="d", dataset_root="/r", reviews_path="/a", meta_path="/b", image_root="/c")
    pre = dict(output_root="/o", split_mode="split", history_len=50, chunk_size=1000)
    whole = S.pipeline_manifest(raw, pre, [entry])
    assert whole["raw_data"]["item_embeddings_path"] is None and whole["fusion"] is None and whole["embeddings"] == [entry]
    assert json.loads(S.manifest_row(spark, "pipeline", whole).first()["payload"]) == whole
    for stage, given in (("embeddings", {**entry, "source_type": "audio"}), ("fusion", {"enabled": True}), ("raw_data", {**raw, "more": 1}), ("other", {})):
        with pytest.raises(ValueError):
            S.stage_entry(stage, **given)
    samples = spark.createDataFrame([("train", u, u % 2) for u in range(5)] + [("val", 1, 1)], "split string, user_idx int, target int")
    written = samples.filter("split = 'train' and user_idx < 4").withColumn("chunk_id", F.expr("user_idx div 2"))
    got = rows(S.stats_row(samples, written, {"k_core": 5}), "split", "total_samples_before_chunk_drop", "total_samples_written", "dropped_tail_samples", "num_chunks_written", "k_core")
    assert got == [("train", 5, 4, 1, 2, 5), ("val", 1, 0, 1, 0, 5)]
