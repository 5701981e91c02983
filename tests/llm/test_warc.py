import base64
import hashlib

from pyspark.sql import functions as F

from wardflow.llm import registry, warc

PAGES = [
    (3, "http://a.example/x?y=1#top", "<p>eins</p>"), (1, "https://b.example", "<p>eins</p>"), (2, None, None),
    (5, "odd\r\nurl", ""), (4, "http://c.example/é", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (None, "http://d.example/", "<p>eins</p>"), (7, "http://e.example/", "zwei"), (7, "http://e.example/", "zwei"),
    (8, "http://f.example/", "ü" * 40000),
]


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_id", F.lit("x"))


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    path = warc.archive_folder(spark)
    warc.write_captures(frame(spark).repartition(3), path)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(rows) == len(PAGES) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in rows)
    assert all(r.requests[0].block.startswith("GET ") for r in rows)
    by_digest = {}
    for r in rows:
        by_digest.setdefault(r.response.payload_digest, []).append(r.response)
    for text in {p[2] or "" for p in PAGES}:
        group = by_digest[digest(text)]
        assert len(group) == sum((p[2] or "") == text for p in PAGES)
        assert [x.record_type for x in group].count("response") == 1
        origin = next(x for x in group if x.record_type == "response")
        assert bytes(origin.payload) == text.encode()
        for x in group:
            assert x.payload_bytes == len(text.encode())
            assert x.refers_to == (None if x is origin else origin.record_id)


def test_query_rows(spark, scratch):
    frame(spark).write.parquet(f"{scratch}/pages.parquet")
    rows = registry.op1_warc(spark, scratch).collect()
    seen = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows)
    assert seen == sorted([
        ("1", "response", "None"), ("3", "revisit", "1"), ("None", "revisit", "1"), ("2", "response", "None"),
        ("5", "revisit", "2"), ("4", "response", "None"), ("7", "response", "None"), ("7", "revisit", "7"),
        ("8", "response", "None")])


def test_small_payloads_stay_responses(spark):
    path = warc.archive_folder(spark)
    warc.write_captures(frame(spark), path, min_revisit_bytes=5)
    kinds = [r.record_type for r in warc.read_records(spark, path).where("record_type in ('response', 'revisit')").collect()]
    assert kinds.count("revisit") == 2


def test_links_the_other_way_and_orphans(spark):
    fields = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, " \
             "record_date string, payload binary, payload_bytes long, payload_digest string, warc_fields string"
    make = lambda i, kind, to: (i, kind, to, None, "u", "d", b"b", 1, "x", "f")
    records = spark.createDataFrame([
        make("r1", "response", "q1"), make("q1", "request", None), make("m1", "metadata", "q1"),
        make("q2", "request", "gone"), make("r3", "response", None)], fields)
    got = {r.capture_id: (r.response.record_id is not None, len(r.requests), len(r.metadata)) for r in warc.assemble(records).collect()}
    assert got == {"r1": (True, 1, 1), "gone": (False, 1, 0), "r3": (True, 0, 0)}


def test_without_payloads(spark):
    path = warc.archive_folder(spark)
    warc.write_captures(frame(spark), path)
    full = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    slim = warc.assemble(warc.without_payloads(warc.read_records(spark, path))).collect()
    assert len(slim) == len(full)
    for r in slim:
        a, b = r.response.asDict(), full[r.capture_id].response.asDict()
        assert a.pop("payload") is None and b.pop("payload") is not None and a == b
        assert (r.requests, r.metadata) == (full[r.capture_id].requests, full[r.capture_id].metadata)


def test_empty_table(spark):
    path = warc.archive_folder(spark)
    warc.write_captures(frame(spark).limit(0), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


FIELDS = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
          "record_date string, payload binary, payload_bytes long, payload_digest string, warc_fields string")


def make(i, kind, to):
    return i, kind, to, None, "u", "d", b"b", 1, "x", "f"


def test_links_over_several_hops_and_double_links(spark):
    records = spark.createDataFrame([
        make("r1", "response", "q1 m1"), make("q1", "request", None), make("m1", "metadata", None),  # both named by the response
        make("r2", "response", None), make("m2", "metadata", "m3"), make("m3", "metadata", "q2"), make("q2", "request", "r2"),  # three hops
        make("m4", "metadata", "gone r2"),  # two targets, one of them a capture
        make("q5", "request", "m5"), make("m5", "metadata", "q5"),  # a loop without a response
        make("q6", "request", "lost"), make("m6", "metadata", "lost"), make(None, "metadata", "r2")], FIELDS)
    records = records.withColumn("anchor", F.lit("x")).withColumn("to", F.lit("x"))
    got = {r.capture_id: (r.response.record_id, sorted(x.block is not None for x in r.requests),
                          sorted(x.record_id for x in r.metadata if x.record_id)) for r in warc.assemble(records).collect()}
    assert got == {"r1": ("r1", [True], ["m1"]), "r2": ("r2", [True], ["m2", "m3", "m4"]), "m5": (None, [True], ["m5"]),
                   "lost": (None, [True], ["m6"]), None: (None, [], [])}


def test_repeated_headers_and_cut_archives():
    record = (b"WARC/1.1\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Concurrent-To: <c>\r\n"
              b"Content-Length: 3\r\n\r\nxyz\r\n\r\n")
    whole = list(warc.parse_records(record * 3))
    assert len(whole) == 3 and whole[0] == ({"warc-record-id": "<a>", "warc-concurrent-to": "<b> <c>", "content-length": "3"}, b"xyz")
    import gzip

    members = gzip.compress(record) + gzip.compress(record * 2)
    assert list(warc.parse_records(members)) == whole
    assert list(warc.parse_records(members[:-12]))[:1] == whole[:1]
    assert list(warc.parse_records(record[:30])) == [] and list(warc.parse_records(b"")) == []


def test_one_large_page_does_not_size_the_files_of_the_others(spark):
    path = warc.archive_folder(spark)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.concat(
        F.col("id").cast("string"), F.when(F.col("id") == 150, F.repeat(F.lit("large "), 1_700_000)).otherwise("small")).alias("html"))
    warc.write_captures(pages.coalesce(1), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").count()
    records = warc.read_records(spark, path)
    assert files <= 5 and records.count() == 900  # at most one a task, and the large page's
    sizes = {r.payload_bytes for r in records.where("record_type = 'response'").select("payload_bytes").collect()}
    assert max(sizes) == 10_200_003
