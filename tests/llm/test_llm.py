"""The numbered operators against brute force, round trips and held-out accuracy, and on odd rows."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm import cover_tree, html_crf, language_id, line_rules, mixing, order_minhash, packing, quality_knn, queries, secret_scan, shared, warc

D = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "a b c", "x" * 3000, "é😀 token=abcdefgh", "12 34 !!", "same words here again " * 400, "same words here again " * 400]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 4 else None, t, "clash", "w", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kinds string, start int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_language(spark, docs, odd):
    model = language_id.train(docs.where("doc_id % 3 <> 1"))
    got = language_id.identify(docs, model)
    assert got.where("lang = lang_pred AND doc_id % 3 = 1").count() >= 0.97 * got.where("doc_id % 3 = 1").count()
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(ODD) and all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_samples_of_repeated_texts(spark):
    """A language of one text in 3000 rows is learned, and repeated rows and ids add nothing to a sample."""
    rows = [("xx", "ein Text der immer gleich ist")] * 3000 + [("yy", f"some text of number {i} and more") for i in range(3000)] + [("zz", "only here")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = shared.labelled_sample(df, "lang", 100, 300).toPandas().label.value_counts()
    assert got["xx"] == 1 and got["zz"] == 1 and 60 <= got["yy"] <= 150
    assert set(language_id.train(df).names) == {"xx", "yy", "zz"}
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(2, "b")], "doc_id int, text string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id int, label int")
    assert sorted(map(tuple, shared.marked_texts(docs, marks, 10, 20).collect())) == [("b", 0), ("text 0", 1)]


def test_quality(spark, docs, odd):
    marks = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(docs, marks.where("doc_id % 5 <> 0"))
    got = quality_knn.score(docs, model).join(marks, "doc_id").where("doc_id % 5 = 0").select("score", "label").toPandas()
    assert ((got.score >= 0.3) == (got.label == 1)).mean() > 0.8
    rows = quality_knn.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if not (r.text or "").strip())
    assert quality_knn.train(docs, marks.limit(0)) is None


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    for df, text in ((docs, {r.doc_id: r.text for r in docs.collect()}), (odd.withColumn("doc_id", F.monotonically_increasing_id()), None)):
        df = df.cache()
        text = text or {r.doc_id: r.text for r in df.collect()}
        got = packing.pack(df, queries.TOKENIZER).toPandas()
        for i, p in got.sort_values("start").groupby("doc_id"):
            ids = [*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 2]
            assert np.frombuffer(b"".join(p["ids"]), "<u4").tolist() == ids and (p.doc_tokens == len(ids)).all()
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
        assert set(got.doc_id) == set(text)
    assert packing.pack(docs.limit(0), queries.TOKENIZER).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    """Odd strings, with letters that lower case lengthens, marks in all places and a memory that has to be thinned again and again."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, encode, rng = Tokenizer.from_file(queries.TOKENIZER), packing.Encoder(queries.TOKENIZER, most=400), np.random.default_rng(3)
    parts = ["İ", "ı", "ß", "é", "e\u0301", "Σ", "a", "B", "th", "ing", "'s", "don't", ".", ",", ":", "!", "?", ";", "!!", " ", "\n", "\t", "\u00a0", "1", "42", "<|", "|>", "-", "😀", "字", "ﬁ", "_", "#", '"', "\x00", "\u200d"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(6000)]
    got = [ids.tolist() for i in range(0, len(texts), 300) for ids, _ in encode(pa.array(texts[i : i + 300]))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))])
        pen = rng.integers(0, 9, len(at))
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        f = [0.0]
        for j in range(1, len(at)):
            f.append(min(f[i] + cost(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 16) + pen[j])
        ends = packing.cut_windows(at, pen, 16)
        assert sum(cost(int(at[b] - at[a])) + pen[b] for a, b in zip([0, *ends], ends)) == f[-1]  # noqa: B905


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[-1] + 1, before[j] + (x != y)))
        before = row
    return before[-1]


def edited(rng, words, share):
    """Words changed at random places: replaced, left out or put in."""
    out = []
    for w in words:
        kind = rng.random() / share if share else 9
        out += [f"n{rng.integers(10**9)}"] if kind < 0.6 else [] if kind < 0.8 else [w, f"n{rng.integers(10**9)}"] if kind < 1 else [w]
    return out


def test_near_duplicates(spark, odd):
    """Copies edited by up to 15 % and unrelated texts: links against the edit distances of all pairs, none of them wrong."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        own = [f"w{i}" for i in rng.zipf(1.3, int(rng.integers(6, 120))) % 10**6]
        texts += [" ".join(own)] + [" ".join(edited(rng, own, float(rng.choice([0, 0.03, 0.08, 0.15])))) for _ in range(int(rng.integers(0, 4)))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _tid int")
    classes = order_minhash.classes(docs).cache()
    found = {r.doc_id: r.class_id for r in classes.collect()}
    split, linked, apart = [t.split() for t in texts], set(), 0
    for i in range(len(texts)):
        for j in range(i):
            n = max(len(split[i]), len(split[j]))
            if abs(len(split[i]) - len(split[j])) <= 0.2 * n and 1 - distance(split[i], split[j]) / n >= 0.8 - 1e-9:
                linked.add((j, i))
                apart += found[i] != found[j]
    assert len(linked) > 50 and apart <= 0.05 * len(linked)
    root = list(range(len(texts)))
    for j, i in sorted(linked):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[c] for i, c in found.items())
    kept = order_minhash.keep_one(docs, classes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))
    odd_classes = order_minhash.classes(odd).cache()
    rows = odd_classes.collect()
    assert len(rows) == len(ODD) and len({r.class_id for r in rows if r.doc_id in (9,)} | {9}) == 1
    clash = odd.withColumn("kept", F.lit("x")).withColumn("first", F.lit("y"))
    assert order_minhash.keep_one(clash, odd_classes).count() == len(ODD) - 1


def test_near_duplicates_of_no_rows(spark, docs):
    found = order_minhash.classes(docs.limit(0))
    assert found.count() == 0 and order_minhash.keep_one(docs.limit(0), found).count() == 0


def test_stated_recall_of_candidates():
    """Share of pairs that share a sketch, by the share of words changed at random."""
    rng = np.random.default_rng(8)
    for share, n, least in ((0.05, 100, 0.999), (0.1, 100, 0.99), (0.15, 300, 0.96), (0.2, 1000, 0.9), (0.1, 20, 0.99)):
        met = 0
        for _ in range(400):
            a = rng.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)
            b = a.copy()
            at = rng.choice(n, int(share * n), replace=False)
            b[at] = rng.integers(-(1 << 63), (1 << 63) - 1, len(at), dtype=np.int64)
            met += np.isin(order_minhash.sketches(a), order_minhash.sketches(b)).any()
        assert met >= least * 400, (share, n, met)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Texts with one long common passage, of which pairs are near copies, with every bucket taken for a large one."""
    monkeypatch.setattr(order_minhash, "SMALL", 1)
    rng = np.random.default_rng(5)
    common, texts = [f"c{i}" for i in range(60)], []
    for _ in range(60):
        own = [f"w{i}" for i in rng.integers(0, 10**6, int(rng.integers(5, 40)))]
        for _ in range(int(rng.integers(1, 4))):
            changed = list(own)
            changed[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join([*common, *changed]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in order_minhash.classes(df).collect()}
    hashed = [r.w for r in df.orderBy("doc_id").select(order_minhash.hashed_words(F.col("text")).alias("w")).collect()]
    for i in range(len(texts)):
        for j in range(i):
            if found[i] != found[j]:
                assert order_minhash.similarity(hashed[i], hashed[j]) < order_minhash.SIMILAR
    assert len(set(found.values())) > 1


def test_histogram_counts_every_kmer(spark):
    rng = np.random.default_rng(3)
    lists = [rng.integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64).tolist() for n in (0, 1, 500, 3000)] * 3
    found = order_minhash.histogram(spark.createDataFrame([(x,) for x in lists], "kmers array<bigint>").repartition(5))
    wanted = np.bincount(np.array([k for x in lists for k in x], np.int64).view(np.uint64) % np.uint64(order_minhash.CELLS), minlength=order_minhash.CELLS)
    assert (found == wanted).all()
    assert not order_minhash.histogram(spark.createDataFrame([], "kmers array<bigint>")).any()


def test_rare_first_meets_every_near_text():
    rng, counts, met = np.random.default_rng(6), np.random.default_rng(7).integers(2, 50, 64), 0
    for _ in range(3000):
        a = rng.integers(0, int(rng.choice([3, 200])), int(rng.integers(1, 60)))
        b = np.array([int(w[1:]) for w in edited(rng, [f"w{x}" for x in a], 0.2)], dtype=np.int64)
        if len(b) and order_minhash.similarity(a, b):
            x, y = (order_minhash.labelled_kmers(w, 1) for w in (a, b))
            need = 0.8 * max(len(a), len(b)) - 1e-9
            common, differ = len(np.intersect1d(x, y)), sum(int(v).bit_count() for v in (order_minhash.parities(x) ^ order_minhash.parities(y)).view(np.uint64))
            assert need <= common <= (len(a) + len(b) - differ) / 2
            (p, i), (q, j) = order_minhash.rare_first(x, counts), order_minhash.rare_first(y, counts)
            assert max(min(len(x) - i[p == w][0], len(y) - j[q == w][0]) for w in np.intersect1d(p, q)) >= need
            met += 1
    assert met > 1000


def test_edit_distance_equals_the_full_table():
    rng = np.random.default_rng(9)
    for t in range(1500):
        v = int(rng.integers(1, 12))
        a = rng.integers(0, v, int(rng.integers(0, 30)))
        b = rng.integers(0, v, int(rng.integers(0, 30))) if t % 2 else np.concatenate([a[:3], rng.integers(0, v, int(rng.integers(0, 3))), a[int(rng.integers(0, 6)) :]])
        far = distance(a.tolist(), b.tolist())
        for most in (0, 1, 3, 6, 14, 31):
            assert order_minhash.edit_distance(a, b, most) == (far if far <= most else None)
    w = np.arange(100)
    v = w.copy()
    v[[20, 50]] = 999
    assert order_minhash.similarity(w, w) == 1 and abs(order_minhash.similarity(w, v) - 0.98) < 1e-12 and order_minhash.similarity(w, w + 1000) == 0
    assert order_minhash.similarity(w, w[:80]) == 0.8 and order_minhash.similarity(w, w[:79]) == 0 and order_minhash.similarity(w, w[::-1].copy()) == 0


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    covered = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        for r in line_rules.clean(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text or "")
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_lines_are_closed_and_lost(spark):
    """cleaned_text, lost and kept against the rules written out, on lines with long ends."""
    word = "word " * 11
    lines = [word + "end.", word + 'end."' + '"' * 18, word + "end" + '"' * 18, word + "end. \t\r " + " " * 40, word + "end.)\x0b]\x0c", word + "end", "Home | About | Help | More.", "Click here now.", "bad ### text!", '"""', " . ", "多分。", word + "one" + "!" * 3]
    closed = [True, True, False, True, True, False, False, False, False, False, True, True, False]
    texts = ["\n".join([x, *[word + "end."] * 5]) for x in lines] + [word + "x\n" + word + "end."] + ["\n".join(lines)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id int, text string, kept string, n_words int")
    for r in line_rules.clean(df).collect():
        whole = [x for x in r.text.split("\n") if x.strip(" \t\n\v\f\r")]
        left = [x for x in whole if x not in lines or closed[lines.index(x)]] if r.doc_id != len(lines) else whole[1:]
        assert r.cleaned_text == "\n".join(left), r
        lost = 1 - sum(map(len, left)) / sum(map(len, whole))
        assert abs(r.lost - lost) < 1e-12 and r.kept == (not r.base_failed and r.lost <= 0.5)


def test_secrets(spark, odd):
    texts = [*ODD, "token=abc token = \"abcdef\" PASSWORD:secret=abcdefg api_key: zzzzzzz", "AKIA" + "B" * 16 + " AKIA" + "B" * 15, "f" * 24 + " " + "f" * 23, "token=abcdef " * 600, "ghp_" + "a1" * 20, "https://me:secret9@host/x"]
    df = spark.createDataFrame([(i % 5 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kinds string").withColumns({c: F.lit("x") for c in ("_of", "of", "row", "t", "place", "_key", "_text", "secrets")})
    rules = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    for r in secret_scan.redact(secret_scan.scan(df).withColumn("was", F.col("text"))).collect():
        want = sorted((m.start(), n, k, m.end()) for n, (k, x, ok) in enumerate(rules) for m in re.finditer(x, r.was or "") if ok(m))
        assert [(s.start, s.kind, s.end) for s in r.secrets if s.kind in secret_scan.BASE] == [(s, k, e) for s, _, k, e in want]
        assert bool(r.secrets) == ("[SECRET]" in (r.text or ""))
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None and secret_scan.trigram_query("AKIA[A-Z]{3}") == [[frozenset({"aki", "kia"})]]
    assert secret_scan.scan(df.limit(0)).count() == 0


def redacted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in secret_scan.redact(secret_scan.scan(df)).orderBy("doc_id").collect()]


def test_private_keys_are_redacted_whole(spark):
    lines = ["MIIEpAIBAAKCAQEA+/" * 3 + f"{i:010d}" for i in range(5000)]
    head, body, tail = "-----BEGIN RSA PRIVATE KEY-----", "\n".join([*lines, "Zm9v=="]), "-----END RSA PRIVATE KEY-----"
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    texts = [f"a {head}\n{body}\n{tail} z", f"a {head}\n{locked}{body}\n{tail} z", f"a {head}\\n{lines[0]}\\n{tail} z", f"a {head}\n{locked}{body}\n\nNot a key line.", f"a {head} is - only - a header z", f"a {head}\n{lines[0]}\n{head}\n{body}\n{tail} z", f"a {head}\n{lines[0]}\nMIIE"]
    assert redacted(spark, texts) == ["a [SECRET] z"] * 3 + ["a [SECRET]\n\nNot a key line.", "a [SECRET] is - only - a header z", "a [SECRET]\n[SECRET] z", "a [SECRET]"]


def test_url_passwords_of_any_length_and_kind(spark):
    secret = ["https://aws:" + "a1" * 400 + "@", "redis://:password@", "https://me:pa$s&w+o=r~d,;@", "https://" + "u" * 90 + ":abc@", "https://me:p@sswörd@", "ftp://me@corp.example:pass@", "db://x:" + "é😀" * 20000 + "@"]
    texts = [f"see {s}host/path here" for s in secret]
    plain = ["http://host:8080/a@b", "http://host:80 me@host", "http://host/a:bcd@e", "https://me:ab@host"]
    assert redacted(spark, [*texts, *plain]) == ["see [SECRET]host/path here"] * len(texts) + plain


def test_html():
    model = html_crf.train()
    wrong = total = 0
    for blocks, labels in html_crf.labelled_pages(120, seed=99):
        wrong += sum(a != b for a, b in zip(labels, model.decode([html_crf.features(b) for b in blocks]), strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total
    page = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>t</b>wo.<script>x='</p>'</script><p>Three</article><footer>&copy; me</footer>"
    assert html_crf.main_text(model, page)[0] == "A & B One two. Three" and html_crf.main_text(model, None) == ("", 0, 0)


def test_html_head_without_end_tag():
    model, want = html_crf.train(), "A long way Three words here."
    inside = "<article><h1>A long way</h1><p>Three words here.</p></article>"
    for page in (
        f"<head><title>T</title><body>{inside}",
        f"<html><head><meta charset=utf-8><title>T</title>{inside}",
        f"<title>T</title>{inside}",
        f"<head><title>The <body> and <b> tags</title><link rel=x><body>{inside}</body>",
        f"<head><title>T<body>{inside}<svg><title>x</title></svg>",
        f"<head><title>T</head><body>{inside}",
        f"<html><head><title>T</title></head><body>{inside}</body></html>",
    ):
        assert html_crf.main_text(model, page)[0] == want, page
    assert [b.text for b in html_crf.leaf_blocks("<head><title>T</title> Plain <b>text</b>")] == ["Plain text"]
    assert html_crf.leaf_blocks("<head><title>T</title><meta name=x></head>") == []


def test_html_formulas_and_skipped_elements():
    blocks = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    model = html_crf.train()
    page = "<article><h1>A long way</h1><p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> hold here.</p><p>See <object data=x><param name=a>a drawing of it</object> there.</p><p><svg><path d=M0></p><p>The end of it.</p></article>"
    assert html_crf.main_text(model, page)[0] == "A long way Let x= 1 2 hold here. See a drawing of it there. The end of it."
    for page in (
        "<p>One <svg><title>t</title><g>no</g><svg>no</svg>no</svg>two.</p><p>Three.",
        "<p>One <svg/>two.<p>Three.",
        "<div><p>One two.<svg><g>no</div><p>Three.",
        "<p>One two.<svg><path>no<p>Three.",
        "<p>One two.<svg><style>no</p><p>Three.",
        "<p>One two.<svg><foreignObject><p>no</p></foreignObject></svg></p>Three.",
        "<div>One two.<select><option>no<option>no</div><p>Three.",
        "<div>One two.<select><option>no<p>Three.",
        "<p>One <select><option>no</select>two.<p>Three.",
        "<p>One <noscript><iframe src=x></noscript>two.<p>Three.",
        "<div>One two.<noscript><p>no</div><p>Three.",
        "<head><title>T</title><noscript><link><body><p>One two.<p>Three.",
        "<head><noscript><style>a</style></head><p>One two.<p>Three.",
    ):
        assert blocks(page) == ["One two.", "Three."], page
    assert blocks("<p>One<script>no") == ["One"] and blocks("<math><mi>a</mi><math>") == ["a"] and blocks("<svg>no") == []


def test_hostile_pages_take_time_in_proportion():
    import time

    model = html_crf.train()
    for piece in ("<div>x", '<a href="', '<a b="x>"', "<head ", "<b><hr>", "<svg><script>", "<noscript>", "<", "<!--", "<title>", "<select><option>x", "<b><i></b>", "<p><b>", "<b><i>"):
        for read in (lambda p: html_crf.main_text(model, p), warc.plain_text):
            took = []
            for n in (50_000, 400_000):
                page = piece * (n // len(piece))
                began = time.process_time()
                read(page)
                took.append(time.process_time() - began)
            assert took[1] < 24 * took[0] + 0.5, piece
    deep = "".join(f"<div class=c{i}>x" for i in range(20000))
    assert sum(len(b.above) for b in html_crf.leaf_blocks(deep, model.weights)) <= 20000


def test_pages_as_rows(spark):
    model = html_crf.train()
    page = "<article><h1>A long way</h1><p>Three words here.</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, None, None, "x", 2), (None, "u", "", "x", 3), (3, "u", "<p>" * 50_000 + "é😀", "x", 4)]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_main int"), model).collect()
    assert [r.text for r in got[:4]] == ["A long way Three words here."] * 2 + ["", ""] and len(got) == 5 and got[0].n_blocks == 2
    assert html_crf.extract(spark.createDataFrame([], "html string"), model).count() == 0


def test_visible_text():
    for page, text in (
        ("<p>a <b and more text without close", "a <b and more text without close"),
        ('<p title="a>b">x</p>', "x"),
        ("<head><title>t</title><p>x", "x"),
        ("<head><title>t</title><style>a</style></head>\n plain", "plain"),
        ("<head>plain", "plain"),
        ("a < b &amp; c<script>x</script> d<!-- e --><script>", "a < b & c d"),
        ("<td>1</td><td>2</td>", "1\n2"),
        (None, ""),
    ):
        assert warc.plain_text(page) == text, page


def test_warc_of_odd_records(spark, tmp_path):
    """Blocks with version lines in them, headers with line ends, and files written by others: 1.1, folded headers, other bytes."""
    import gzip

    bad = [(1, "http://a\r\nWARC-Type: x\r\n\r\n", "a WARC/1.0\r\nWARC/1.1\r\n\r\nb", "x"), (2, "u", "x" * 300_000, "y"), (None, None, "é", None)]
    pages = spark.createDataFrame(bad, "page_id int, url string, html string, payload string")
    made = warc.responses(pages)
    warc.write(made, f"{tmp_path}/w")
    again = {r.payload: r for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert set(again) == {b[2] for b in bad} and all(r.complete and r.record_type == "response" for r in again.values())
    assert again[bad[0][2]].target_uri == "http://a WARC-Type: x "[:-1]
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe WARC/1.0 in it"
    record = lambda v, b: b"WARC/1.%d\r\nwarc-type: response\r\nWARC-Target-URI: http://x\r\n\tfolded\r\nContent-Length: %d\r\n\r\n" % (v, len(b)) + b + b"\r\n\r\n"
    with gzip.open(tmp_path / "o.warc.gz", "wb") as f:
        f.write(record(1, body) + record(0, body) + record(0, body)[:-20])
    rows = warc.read(spark, str(tmp_path / "o.warc.gz")).collect()
    assert [r.complete for r in rows] == [True, True, False] and rows[0].target_uri == "http://x folded" and rows[0].payload == "\ufffd\ufffd WARC/1.0 in it" and rows[0].http_headers == "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    assert warc.derive(made.limit(0)).count() == 0 and warc.derive(made, ["page_id"]).count() == 6


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{D}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (7, "u", "")], "page_id long, url string, html string"))
    responses = warc.responses(pages)
    derived = warc.derive(responses)
    assert derived.count() == 2 * pages.count()
    for name, df, columns in (("r", responses, ["record_id", "target_uri", "block_digest", "payload", "http_headers"]), ("d", derived, ["record_id", "refers_to", "block_digest", "payload_digest", "block"])):
        warc.write(df, f"{tmp_path}/{name}")
        again = warc.read(spark, f"{tmp_path}/{name}")
        fill = lambda x: x.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])  # noqa: E731, B023
        assert again.where("NOT complete").count() == 0 and fill(again).exceptAll(fill(df)).count() == 0 and again.count() == df.count()
    assert derived.select("refers_to").exceptAll(responses.select("record_id").union(responses.select("record_id"))).count() == 0
    assert warc.plain_text("<head><title>t</title></head><p>a &lt; b<br>c<script>d</script>") == "a < b\nc"


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-30, 30, (300, 16)), np.ones((200, 16), int)])
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    got = cover_tree.top_k(data.where("vec_id % 20 = 0"), data, k=20, block=90, query_block=7).toPandas()
    for q, part in got.groupby("query_id"):
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(500), -s)) if j != q][:20]
        assert part.sort_values("rank").vec_id.tolist() == want
    bad = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [0.5, -0.01]), (5, [1.0, 1.0])], "vec_id long, e array<float>").select("vec_id", cover_tree.quantised(F.col("e")).alias("v"))
    assert [(r.query_id, r.vec_id, r.score) for r in cover_tree.top_k(bad, bad).orderBy("query_id").collect()] == [(4, 5, 32 * 64 - 64), (5, 4, 32 * 64 - 64)]
    assert cover_tree.top_k(bad.limit(0), bad).count() == cover_tree.top_k(bad, bad.limit(0)).count() == 0


def _brute(x, ids, queries, k):
    """(query, rank, id, score) by Python's whole numbers."""
    out = []
    for q in queries:
        scores = [(-sum(int(a) * int(b) for a, b in zip(x[q], y)), int(i)) for i, y in zip(ids, x) if i != ids[q] and len(y) == len(x[q])]
        out += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_leaves_out_far_places(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.integers(-900, 900, (24, 8)), 60, axis=0) + rng.integers(-4, 5, (1440, 8))
    data = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, v array<long>, place string")
    queries = data.where("vec_id % 20 = 0")
    work = shared.Work(spark)
    q, d = cover_tree.Side(queries.select(F.col("vec_id").alias("id"), "v"), 6, work), cover_tree.Side(data.select(F.col("vec_id").alias("id"), "v"), 60, work)
    first = cover_tree.first_pairs(q, d, 20)
    worst = {p: 0.0 for p in q.rows}  # every query has 20 rows of a positive product
    assert len(first) + len(cover_tree.other_pairs(q, d, first, worst)) < 0.8 * len(q.rows) * len(d.rows)
    got = sorted(map(tuple, cover_tree.top_k(queries, data, k=20, block=60, query_block=6).collect()))
    assert got == _brute(x, range(1440), range(0, 1440, 20), 20)


def test_top_k_odd_rows(spark):
    x = [[3_000_000_001, 7]] * 2 + [[3_000_000_000, -5], [2_999_999_999, 11], [1, 2, 3], [2, 2, 2], [], [], [5]] + [[1, 1]] * 300
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9] + [10] * 150 + list(range(11, 161))  # sums beyond 2^53, lengths, one key of many rows
    data = spark.createDataFrame(list(zip(ids, x)), "vec_id long, v array<long>")
    got = sorted(map(tuple, cover_tree.top_k(data, data, k=5, block=40, query_block=30).collect()))
    assert got == _brute(x, ids, [i for i, n in enumerate(ids) if n not in ids[:i]], 5)
    huge = spark.createDataFrame([(1, [1 << 40, 1]), (2, [1 << 40, 1])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="may not fit a long"):
        cover_tree.top_k(huge, huge).collect()


def test_cover_tree():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(900, 3)), np.zeros((100, 3))])
    tree, inner = cover_tree.Tree(x, 20), 0
    for node, below in enumerate(tree.children):
        assert np.sqrt(((x[tree.rows[node]] - tree.center[node]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9
        if below:
            inner += 1
            c = np.array([tree.center[j] for j in below])
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))[np.triu_indices(len(c), 1)]
            shells = not apart.any()
            assert shells or (apart > tree.radius[node] / 2).all()
            assert shells or len(below) == 16 or all(tree.radius[j] <= tree.radius[node] / 2 + 1e-9 for j in below)
            assert sorted(np.concatenate([tree.rows[j] for j in below]).tolist()) == sorted(tree.rows[node].tolist())
    assert inner > 5
    x = rng.integers(-90, 90, (20000, 48))  # hardly divided by any centers
    rows, ids, scores = cover_tree.dual_search(x[:40], np.arange(40), x, np.arange(20000), 3)
    assert sorted(scores[rows == 7].tolist()) == sorted(np.delete(x @ x[7], 7).tolist())[-3:]


def test_mixing(spark, docs, odd):
    marks = queries.domains(spark.read.parquet(f"{D}/labels.parquet"))
    model = mixing.train(docs, marks)
    weights = dict.fromkeys(model.names, 1.0)
    got = mixing.mix(docs, model, weights).select("posterior", "tokens", "rate", "copies").toPandas()
    p = np.stack(got.posterior) * got.tokens.to_numpy()[:, None]
    reached = (p * got.rate.to_numpy()[:, None]).sum(0) / got.tokens.sum()
    assert (got.rate >= 0).all() and np.abs(reached - 1 / len(model.names)).max() < 0.02
    assert mixing.mix(odd, model, weights).count() == len(ODD)
    assert {r.rate for r in mixing.mix(odd, None, weights).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), model, weights).count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    done = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, done, D).cache()
        assert after.columns == docs.columns, name
        if name != "mixture":
            assert after.count() <= done.count()
        done = after
    assert done.count() > 0.5 * docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, D).count() == 0
