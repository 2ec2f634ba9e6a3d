import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tablefold.llm import decontamination, ngram_join, quality_classifier
from tablefold.llm import textkit as tk
from tablefold.llm.shipping import stored

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    one = corpus_pipeline.quality(spark, docs, DATA).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns
    assert sum(labels[i] == (i in kept) for i in labels) >= 0.9 * len(labels)
    two = corpus_pipeline.near_duplicates(spark, one, DATA).cache()
    classes = {r.doc_id: r.class_id for r in ngram_join.similar_documents(one).collect()}
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(classes.values()))
    three = corpus_pipeline.decontaminate(spark, two, DATA).cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    held = {r.doc_id for r in decontamination.contaminated(two, bench).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - held
    four = corpus_pipeline.secrets(spark, three, DATA).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    assert all(r.text == before[r.doc_id].text or "[SECRET]" in r.text for r in four.collect())
    five = corpus_pipeline.mixture(spark, four, DATA)
    assert {r.doc_id for r in five.select("doc_id").collect()} <= {r.doc_id for r in four.collect()}


def grams(words: list[str], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id")
    data = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: grams(re.findall(r"[^\x20\x09-\x0D]+", t), 5) for i, t in data.items()}
    root = {}
    for i in sorted(sets):  # ascending, so that the first of a class is its least
        if i in root:
            continue
        front = [i]
        while front:
            at = front.pop()
            if at not in root:
                root[at] = i
                front += [j for j in sets if j not in root and sets[at] and sets[j] and len(sets[at] & sets[j]) >= 0.8 * len(sets[at] | sets[j])]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == sorted(set(root.values()))

    fold = lambda t: re.findall(r"[0-9a-z\u0080-\uffff]+", t.lower())
    items = [" ".join(fold(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    whole = {i for i, t in data.items() if any(f" {x} " in f" {' '.join(fold(t))} " for x in items)}
    assert whole and {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, DATA).collect()} == set(data) - whole

    keys = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    planted = f"one AKIA{'ABCD' * 4}, two {'0a1b' * 8} end"  # this small table may hold none of its own
    more = docs.unionAll(spark.createDataFrame([(10**9, planted, "en", "s", len(planted))], docs.schema))
    left = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, more, DATA).collect()}
    assert left[10**9] == "one [SECRET], two [SECRET] end"
    assert len(left) == len(data) + 1 and not any(keys.search(t or "") for t in left.values())


def test_run_equals_the_stages_and_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
    want = sorted((tuple(r) for r in docs.collect()), key=repr)
    assert len(want) > 50 and sorted((tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()), key=repr) == want


def test_quality_stage_against_a_plain_version(spark):
    """The same weights, but counts of n-grams and dot products one text at a time."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    w = quality_classifier.fit_quality(docs, quality_classifier.learnable(labels))

    def plain(text):
        tokens = [t.encode() for t in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0d]+", text or "")]
        cells = Counter()
        (hashes,) = [tk.Texts(pa.array([text]), tk.alnum_classes(punctuation=True))]
        assert len(tokens) == len(hashes.starts)
        for k in (1, 2):
            grams = (hashes.grams(hashes.hashes(), k)[1] >> np.uint64(64 - 18)).astype(int)
            cells.update(grams.tolist())
        pairs = list(zip(tokens, tokens[1:]))
        cells[0] += sum(any(i - lag >= 0 and pairs[i] == pairs[i - lag] for lag in range(1, 17)) for i in range(len(pairs)))
        cells[1] += sum(a == b for a, b in pairs)
        total = sum(cells.values())
        return 1 / (1 + np.exp(-(quality_classifier.SCALE * sum(n * w[c] for c, n in cells.items()) / max(1, total) + w[-1])))

    scored = {r.doc_id: r.score for r in quality_classifier.score_quality(docs.select("doc_id", "text"), w).collect()}
    data = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(scored[i] - plain(t)) < 1e-4 for i, t in data.items())
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    assert kept == {i for i, s in scored.items() if s >= 0.7}


def test_mixture_stage_against_a_plain_version(spark):
    """Weights by bisection over plain sums; each source's draws are its epochs in blocks, cut at its budget."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.source or "", len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    tokens, count = Counter(), Counter()
    for _, s, n in rows:
        tokens[s] += n
        count[s] += 1
    total = sum(tokens.values())
    low, high = 0.0, 1.0
    for _ in range(50):
        x = (low + high) / 2
        z = sum((t / total) ** x for t in tokens.values())
        ws = {s: (t / total) ** x / z for s, t in tokens.items()}
        fits = -sum(v * np.log(v) for v in ws.values()) <= 0.95 * np.log(len(ws)) + 1e-12 and max(ws[s] * total / t for s, t in tokens.items()) <= 4
        low, high = (low, x) if fits else (x, high)
    z = sum((t / total) ** high for t in tokens.values())
    number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    want = set()
    for s, t in tokens.items():
        budget, blocks = int((t / total) ** high / z * total), -(-count[s] // 1000)
        groups = int(np.ceil(np.sqrt(blocks)))
        own = [(number("mix", i), n, i) for i, source, n in rows if source == s]
        for epoch in range((budget - 1) // t + 1):
            order = sorted(own, key=lambda x: (number("mix", s, epoch, "group", x[0] % blocks % groups), number("mix", s, epoch, "block", x[0] % blocks), *x))
            at = epoch * t
            for _, n, i in order:
                want |= {(i, epoch, at)} if at < budget else set()
                at += n
    assert {(r.doc_id, r.epoch, r.tokens_before) for r in corpus_pipeline.mixture(spark, docs, DATA).collect()} == want


def test_stages_take_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables go through all stages, with their columns as they are."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, row int, hash string, id int, spans string, y double"
    text = " ".join(f"some{i} honest words of a quiet text" for i in range(20))
    data = [(1, text, "en", "a", 5, "s", 1, "h", 1, "p", 0.5), (1, text, "en", "a", 5, "s", 1, "h", 1, "p", 0.5), (2, text, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, "t", 2, "h", 2, "p", 0.1), (3, "", "en", "b", 0, "u", 3, "h", 3, "q", 0.2), (4, None, "en", "b", 0, "u", 3, "h", 3, "q", 0.2)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, str(tmp_path)))
            assert docs.dtypes == spark.createDataFrame([], schema).dtypes
            assert {(r.doc_id, r.score) for r in docs.collect()} <= {(r[0], r[5]) for r in rows}
        mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
        assert mixed.columns == [*docs.columns, "epoch", "tokens_before", "mix_order"] and (rows or mixed.count() == 0)


def test_registry():
    names = set(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert quality_classifier.HELD_OUT == (4, 2)
