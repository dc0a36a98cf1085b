import random

from geoloom.llm import secret_scan as S
from pyspark.sql import functions as F


def corpus():
    rng = random.Random(8)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    key = lambda: "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16))
    words = ["the", "and", "house", "river", "stone", "light", "internationalization", "counterrevolutionary", "incomprehensibilities"]
    rows, secrets = [], {}
    for i in range(240):
        text = " ".join(rng.choices(words, k=40))
        if i % 4 == 0:
            secret = (key(), f"password={hexa(18)}", f'token = "{hexa(40)}"')[i // 4 % 3]
            text = f"{text[:60]} {secret} {text[60:]}"
            secrets[i] = secret
        rows.append((i, text, "src/a"))
    return rows, secrets


def test_findings(spark):
    rows, secrets = corpus()
    df = spark.createDataFrame([*rows, (500, None, None), (501, "", "x"), (None, rows[0][1], None)], "doc_id bigint, text string, source string").withColumn("label", F.lit(1))
    got = {r.doc_id: r for r in S.report(df).collect()}
    assert len(got) == 243 and got[500].n_candidates == 0
    assert sum(got[i].n_secrets > 0 for i in secrets) >= 0.97 * len(secrets)
    clean = [i for i in range(240) if i not in secrets]
    assert sum(got[i].n_candidates > 0 for i in clean) > 100 and sum(got[i].n_secrets > 0 for i in clean) <= 3
    start, end = map(int, got[0].spans.split(":"))
    assert rows[0][1][start:end] == secrets[0] and got[None].n_secrets == 1


def test_given_labels_decide(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = S.candidates(df, S.dictionary(df))
    none = found.select("features", F.lit(0.0).alias("label"))
    assert S.scan(df, labelled=none).where("kept").count() == 0
    long_ones = found.select("features", (F.get("features", 0) > 20).cast("double").alias("label"))
    kept = S.scan(df, labelled=long_ones).where("kept").select(F.length("value").alias("n")).toPandas()["n"]
    assert (kept > 18).all() and len(kept) > 50
    assert S.report(df.limit(0)).count() == 0


def test_names_of_environment_style(spark):
    key = "AKIA" + "Q7" * 8
    planted = {
        'DB_PASSWORD = "hunter2x"': "hunter2x", "db_password: s3cr3tpw": "s3cr3tpw", 'client_secret="abc123xy"': "abc123xy", "GITHUB_TOKEN=ghp_" + "a1B2" * 9: "ghp_" + "a1B2" * 9,
        f"AWS_KEY={key}": key, f"A_LONG_NAME_WITHOUT_MEANING={key}": key, "SECRET_KEY=s3cr3tpw": "s3cr3tpw", "app.token_prod: t0ken99": "t0ken99", "QUJDREVGR0hJSktMTU5P==": "QUJDREVGR0hJSktMTU5P==",
    }
    rows = [(i, f"x {text} y", "a") for i, text in enumerate(planted)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = S.candidates(df, frozenset())
    values = {(r.doc_id, r.value) for r in found.collect()}
    assert {(i, v) for i, v in enumerate(planted.values())} <= values
    assert sum(r.label for r in S.labelled_findings(found).collect()) == len(planted) - 1  # all but the padded value


def plain_features(text, start, end, words):
    """Length, transitions and coverage of a finding, over the whole value."""
    value = text[start:end]
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    low, covered, at = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(10, 2, -1) if low[at : at + k] in words and len(low[at : at + k]) == k), 0)
        covered, at = covered + size, at + max(size, 1)
    return [len(value), sum(a != b for a, b in zip(kind, kind[1:])) / len(kind), covered / len(value), *(kind.count(k) / len(kind) for k in "uldo")]


def test_features_cover_whole_values(spark):
    rng = random.Random(4)
    long = "".join(rng.choices("aB3", k=5000)) + "housestone" * 700
    texts = [f"a token={long} b", long, "river " + "Ab1_" * 8 + " stone"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    words = frozenset({"house", "stone"})
    found = S.candidates(df, words).collect()
    assert {r.doc_id for r in found} == {0, 1, 2}
    for r in found:
        want = plain_features(texts[r.doc_id], r.start, r.end, words)
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.features[:7], want))


def test_equal_rows_repeat_their_result(spark):
    text = 'x token = "a1b2c3d4e5f6a7b8" y'
    rows = [(1, text, "p"), (1, text, "p"), (1, "none", "p"), (None, text, "p"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((r.doc_id or 0, r.n_candidates, r.spans) for r in S.report(df).collect())
    assert len(got) == 6 and got[0] == got[1] == (0, 0, "") and got[-1] == got[-2] and got[-1][1] == 1
