"""Columns of any name beside the operators' own, credentials of any length, and targets that can't be reached."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm import html_crf, language_id, mixing, queries, secret_scan, warc

NAMES = ["_main", "_told", "_m", "_r", "_text", "_meta", "_conversion", "row", "result", "record", "kept", "told", "rate1", "conversion", "meta", "text1", "place", "of"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(1, "the house of the king is old"), (2, "das Haus und der Garten sind alt"), (3, None), (4, "")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES])


def untouched(df, many):
    rows = df.collect()
    return len(rows) == many and all(r[n] == n for r in rows for n in NAMES if n in df.columns) and set(NAMES) <= set(df.columns)


def test_columns_of_any_name_stay(spark, named):
    model = language_id.train(named.withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")))
    assert untouched(language_id.identify(named, model), 12)
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, label string")
    mix = mixing.train(named, labels)
    assert untouched(mixing.mix(named, mix, {"a": 0.5, "b": 0.5}), 12) and untouched(mixing.mix(named, None, {}), 12)
    assert untouched(secret_scan.scan(named), 12)
    pages = named.select("*", F.lit("<p>Some words of a page.</p>").alias("html"))
    assert untouched(html_crf.extract(pages, html_crf.Model([([html_crf.features(b) for b in html_crf.leaf_blocks("<p>Words.</p>")], [1])])), 12)
    source = warc.responses(pages.withColumns({"url": F.lit("http://a.b/c"), "page_id": F.col("doc_id")}))
    more = source.select("*", *[F.lit(n).alias(n) for n in NAMES if n not in source.columns])
    got = warc.derive(more, [n for n in NAMES if n not in warc.FIELDS])
    assert got.count() == 2 * more.count() and all(r[n] == n for r in got.collect() for n in NAMES)
    assert warc.derive(source).columns == list(warc.FIELDS)


@pytest.mark.parametrize("url", ["https://aws:" + "k" * 80 + "@host", "redis://:password1@h", "https://me:pa$sw+d@h", "https://" + "u" * 300 + ":geheimä@h", "amqp://a:b:c:d@h"])
def test_urls_with_credentials_of_any_kind(spark, url):
    """By the query's own rules; the SQL has the same regexes."""
    text = f"see {url}/x now"
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=secret_scan.RULES).first().secrets
    assert [(s.kind, s.start, s.end) for s in got if s.kind == "url"] == [("url", 4, text.index("@") + 1)]
    rule = next(r.regex for r in secret_scan.RULES if r.kind == "url")
    assert rule.replace("'", "''") in queries.ORACLE_SQL["op7_secret_scan"] and re.search(rule, text)


@pytest.mark.parametrize("text", ["https://host/path:8080@x", "https://h:80/a@b", "mailto:a@b", "https://me:pw@h", "http://a b:ccc@d"])
def test_urls_without_credentials(spark, text):
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=secret_scan.RULES).first().secrets
    assert [s.kind for s in got] == []


def test_long_runs_end(spark):
    text = "http://" + "z" * 300_000 + " http://x:" + "y" * 300_000 + "/@"
    assert secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=secret_scan.RULES).first().secrets == []


def test_targets_out_of_reach_are_told(spark):
    """Two domains of equal texts can't be parted, so one of two opposite targets is out of reach."""
    docs = spark.createDataFrame([(i, "same words in every text") for i in range(40)], "doc_id long, text string")
    model = mixing.train(docs, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("label")))
    with pytest.warns(UserWarning, match="miss"):
        for share in (0.7, 0.3):
            mixing.mix(docs, model, {"a": share, "b": 1 - share})
    even = spark.createDataFrame([([0.5, 0.5], 10)] * 4, "posterior array<double>, tokens long")
    assert abs(mixing.fit_rates(even, np.array([39.0, 1.0])).missed - 0.475) < 1e-6 and mixing.fit_rates(even, np.array([20.0, 20.0])).missed == 0


def test_rates_equal_a_dense_solver(spark):
    """Against projected gradients on one matrix, run until they stand: targets reached, and the rates nearest to 1 in tokens."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.5, 0.5], size=300)
    n = rng.integers(1, 200, size=300)
    sums = (p * n[:, None]).sum(0)
    targets = sums.sum() * np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(p, n))], "id long, posterior array<double>, tokens long")
    fit = mixing.fit_rates(df, targets)
    assert fit.missed < 1e-4
    got = {r.id: r.rate for r in df.select("id", mixing.rates(F.col("posterior"), fit).alias("rate")).collect()}
    rate = np.array([got[i] for i in range(300)])
    assert rate.min() >= 0 and np.abs((p * (n * rate)[:, None]).sum(0) - targets).max() < 1e-3 * sums.sum()
    dual = np.zeros(3)  # the nearest rates are max(0, 1 - p . dual) for some dual
    for _ in range(200):
        r = np.maximum(0, 1 - p @ dual)
        on = (r > 0)[:, None] * p * n[:, None]
        dual += np.linalg.solve(on.T @ p + 1e-9 * np.eye(3), (p * (n * r)[:, None]).sum(0) - targets)
    best = np.maximum(0, 1 - p @ dual)
    assert np.abs((p * (n * best)[:, None]).sum(0) - targets).max() < 1e-6 * sums.sum()
    assert (n * (rate - 1) ** 2).sum() <= 1.25 * (n * (best - 1) ** 2).sum()
