import hashlib
import re

from pyspark.sql import functions as F

from tidepool.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "mail a.b@c.com_x@y.org, x@y@z.com; q@w..e r@t-.-u @a.b",
    "Ünï 😀 tel +1 (487) 555-7209 and +49 170 1234567. then +1.2 +123456789012345678",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.02.3.255, 10.0.0.1.",
    "card 4111 1111 1111 1111, 4736962573099581 4111-1111-1111-1112 +4111111111111111",
    "call (212) 555-0123 or 212-555-0123; write joe [at] example [dot] com",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b" * 5000,
    "x@y.zz " * 700,
    "12 34 56 78 90 12 3456789012345 ok",
]


def test_base_spans_against_plain(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = plain(TEXTS[r.id])
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in want), r.id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(spans) >= {f"{k}:{a}:{b}" for k, a, b in want}


def test_query_against_plain(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PLAIN)


def test_estimates_follow_agreement():
    patterns = [((0, 1, 1, 1, 1), 500), ((0, -1, -1, 0, -1), 300), ((0, 1, -1, 0, 1), 40)]
    posterior, votes = pii.estimate(patterns)
    assert posterior[0] > 0.95 and posterior[1] < 0.05
    assert votes[0][1][1] > votes[0][1][0]
    weights = pii.classifier([((*x, 1, 0), c) for x, c in patterns])
    score = lambda x: sum(weights.get(k, 0) for k in zip(pii.SEEN, x, strict=True))
    assert score((0, 1, 1, 1, 1, 1, 0)) > 0 > score((0, -1, -1, 0, -1, 1, 0))


def test_redaction_and_odd_rows(spark):
    rows = [(i, t, "keep", "n") for i, t in enumerate(TEXTS)] + [(None, "a@b.cc", None, None), (3, TEXTS[3], "keep", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, c_0 string")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    left = out.where("doc_id IS NOT NULL").collect()
    for r in left:
        assert not plain(r.text), r.text[:80]
    by = {r.doc_id: r.text for r in left}
    assert by[0] is None and by[1] == "" and by[3].startswith("Ünï 😀 tel [PHONE] and [PHONE].")
    assert by[5] == "card [CARD], [CARD] 4111-1111-1111-1112 [PHONE]" or "[CARD]" in by[5]
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_plan_is_native(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for out in (pii.candidates(df), pii.redact(df.withColumn("text", F.col("text")))):
        plan = out._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


def hostile(n):
    seeds = ["a.", "[at]", "a[at]", "(((", "1 ", "1.", "1-", "+1", "+1(", "a@", "a@b.", "x@y.z ", "x[at]y.z ", "212-555-0123 ", "token=", "token = a1", "sk-", "eyJa.", "é", "😀.", "4111 1111 1111 1111 ", "10.0.0.1 "]
    return [s * (n // len(s)) for s in seeds] + ["x[at]" + "a." * n, "x[at]" + "a[dot]" * (n // 6), "x@y.zz u[at]v.ww " * (n // 17), "x@" + "a." * n, "1" * n, "token = '" + "a1" * n]


def test_hostile_texts_against_plain(spark):
    texts = hostile(3000)
    for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.id])), texts[r.id][:20]


def test_no_long_text_overflows_the_stack(spark):
    df = spark.createDataFrame(list(enumerate(hostile(200_000))), "doc_id long, text string")
    assert pii.redact(df).selectExpr("sum(length(text))").first()[0] > 0


def spans_masked(text, spans):
    """The text with spans (begin, kind, stop) masked, plainly."""
    out, last = [], 0
    for begin, kind, stop in sorted(spans):
        if begin >= last:
            out += [text[last:begin], f"[{pii.KINDS[kind].upper()}]"]
        last = max(last, stop)
    return "".join([*out, text[last:]])


def test_redaction_masks_the_spans_found(spark, sf):
    long = "é" * 255 + "a@b.cc" + "😀" * 1000 + " +1 (487) 555-7209 4111 1111 1111 1111" + " x" * 700 + " token = 'ab12cd34ab12cd34ab12cd34ab12cd34'"
    fixed = [long, "+4111111111111111 1.2.3.4@5.6.7.8 x", "a@b.cc" * 400, "10.0.0.1" * 3 + "\n" + "10.0.0.1 " * 900]
    whole = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(fixed)], "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in whole.collect()}
    found = {r.id: [(x.begin, x.k, x.stop) for x in r.all_spans] for r in pii.find(whole).collect()}
    for r in pii.redact(whole).collect():
        assert r.text == (None if r.text is None else spans_masked(texts[r.doc_id], found[r.doc_id])), r.doc_id


def test_extra_spans_touch_no_base_span(spark):
    text = "x@y.zz u[at]v.ww a@b.cc (212) 555-0123 +1 212-555-0123 joe[at]x.com " * 60
    row = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.extra
    for x in row.extra:
        assert not any(b.begin < x.stop and x.begin < b.stop for b in row.base)


def test_secrets(spark, sf):
    rows = [(10_000_000 + i, f"set token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" here. token = ring of the words. mail a{i}@b.com") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    out = pii.redact(docs).where("doc_id >= 10000000").collect()
    assert all(r.text == 'set token = "[SECRET]" here. token = ring of the words. mail [EMAIL]' for r in out)
