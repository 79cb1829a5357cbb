import hashlib
import zlib

from tidepool.llm import media, queries


def test_query_against_plain(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        stored = b"P5\n192 %d\n255\n" % (len(full) // 192) + full
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(full[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith(f"192x{len(full) // 192};")


def test_segments_stay_in_order():
    page = """<p>One<p>Two &amp; <b>three</b><figure><img src="sha256:aa" alt=x><figcaption>Cap <i>A</i></figcaption></figure>
    <img src=b.png alt="Bee"><script>"<p>"</script><p>End<video src='v.mp4'></video>tail"""
    got = [(s["position"], s["kind"], s["text"], s["ref"], s["caption"]) for s in media.parse(page)]
    assert got == [
        (0, "text", "One", None, None),
        (1, "text", "Two & three", None, None),
        (2, "media", None, "sha256:aa", "Cap A"),
        (3, "media", None, "b.png", "Bee"),
        (4, "text", "End", None, None),
        (5, "media", None, "v.mp4", None),
        (6, "text", "tail", None, None),
    ]
    assert media.parse(None) == media.parse("") == []


def test_odd_rows(spark):
    rows = [(1, None, "f"), (2, "", "f"), (3, "ü" * 96, "f"), (4, "ü" * 96, None), (None, "a\n\n<b> & 'c'", "f"), (4, "ü" * 96, None), (5, "long line\n" * 40_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = media.document_media(df).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].payload_bytes == 192
    assert by[3].feature == by[4].feature and by[3].payload_bytes == 192
    assert (by[None].position, by[None].caption) == (1, "a") and by[2].position == 0
    assert media.document_media(df.limit(0)).count() == 0


def test_unknown_references_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:00">'), (2, '<img src="x.png">')], "page_id long, html string")
    features = media.describe(media.store(spark.createDataFrame([(bytearray(192),)], "payload binary"))[0])
    assert [r.payload_sha256 for r in media.resolve(media.sequences(pages), features).collect()] == [None, None]


def test_store_keeps_each_payload_once(spark):
    rows = [(bytearray(192),), (bytearray(192),), (bytearray(384),), (None,)]
    stored, path = media.store(spark.createDataFrame(rows, "payload binary"))
    assert sorted(len(r.media) for r in stored.collect()) == [len(b"P5\n192 1\n255\n") + 192, len(b"P5\n192 2\n255\n") + 384]
    media.common.removed(spark, path)
