import hashlib
import random
import re

from geoloom.llm import pii
from geoloom.llm.queries import QUERIES
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, name in enumerate(PLAIN) for m in re.finditer(PLAIN[name], text or "", re.A) if ok(name, m[0]))


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


ODD = ["a.b@c.de x@y.z_w@q.rr é@ü.de", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112", "+49 (30) 123-456-78. +1 2", "", None, "🙂 me@x.org 🙂 +1.234.567.8901", "a" * 40000 + " " + "1" * 40000, "u@" + "a." * 5000 + "a", "+" * 3000 + "1 2 3 4 5 6 7 8 9", "1-2 3-4", "me@@you.com", "..@a.b", "+4111111111111111 a@b.c.", "192.168.1.1@x.de"]


def random_texts():
    rng = random.Random(6)
    return ["".join(rng.choice(["a", "@", ".", "1", "2", "+", "-", " ", "_", "(", "9", "é"]) for _ in range(rng.randint(0, 120))) for _ in range(400)]


def test_base_spans(spark):
    texts = ODD + random_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, start int")
    got = {r.doc_id: r.x for r in df.withColumn("s", pii.entities(F.coalesce("text", F.lit("")))).select("doc_id", pii.listed("s").alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == listed(plain(t)), (t or "")[:80]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op7_pii"](spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert not spans or set(listed(spans).split(",")) <= set(r.spans.split(","))


def test_disclosing_words_and_sanitising(spark):
    filler = [(100 + i, f"plain words about nothing number{i % 7} here") for i in range(60)]
    rows = [(1, "write Zephyrine at z@x.org today"), (2, "again Zephyrine uses z@x.org now"), (3, "about nothing z@x.org"), (4, None), (None, "Zephyrine z@x.org")]
    df = spark.createDataFrame([(*r, "k") for r in rows + filler], "doc_id bigint, text string, key string")
    got = {r.doc_id: r.s for r in pii.find(df).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert got[1] == "term:6:15,email:19:26" and got[3] == "email:14:21" and got[None] == "term:0:9,email:10:17"
    assert all(not got[i] for i, _ in filler)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[1] == "write  at [EMAIL] today" and clean[4] is None and clean[100] == filler[0][1]
    assert pii.sanitise(df).columns == df.columns and pii.find(df.limit(0)).count() == 0


def test_terms_far_from_the_entity(spark):
    far = "plain words about nothing here " * 12
    filler = [(100 + i, f"plain words about nothing number{i % 7} here") for i in range(60)]
    rows = [(1, f"Zephyrine {far} z@x.org and zephyrine"), (2, f"z@x.org {far} Zephyrine"), (3, f"z@x.org {far} ZEPHYRINE"), (4, "only Zephyrine, not Zephyrines"), (5, "z@x.org, z@x.org")]
    rows += [(6, "Björn@q.org"), (7, "Björn@q.org bjö")]
    df = spark.createDataFrame(rows + filler, "doc_id bigint, text string")
    got = {r.doc_id: r.s.split(",") for r in pii.find(df, threshold=0.8).select("doc_id", pii.listed("spans").alias("s")).collect()}
    for i, text in rows[:5]:
        assert [s for s in got[i] if s.startswith("term")] == [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\bzephyrine\b", text, re.I)], i
    assert got[7] == ["email:3:11"]
    assert {r.doc_id: r.text for r in pii.sanitise(df, threshold=0.8).collect()}[4] == "only , not Zephyrines"


def test_many_matches_in_one_text(spark):
    """16,000 addresses in a text: positions stay exact, and the time far from quadratic."""
    import time

    text = " ".join(f"u{i}@x{i % 97}.org" for i in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "é" + text), (3, None), (4, "a@b.c")], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r.x for r in df.withColumn("s", pii.entities(F.coalesce("text", F.lit("")))).select("doc_id", pii.listed("s").alias("x")).collect()}
    assert time.time() - began < 60
    assert got == {1: listed(plain(text)), 2: listed(plain("é" + text)), 3: "", 4: "email:0:5"}
