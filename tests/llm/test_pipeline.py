"""The whole pipeline on a whole table, stage by stage against a plain version of each stage on that stage's own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_targets

import corpus_pipeline
from snapfold.llm import quality
from snapfold.llm.queries import quality_model

MASKED = [
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def brute_scores(docs, model):
    wide, names = quality.statistics(docs.select("doc_id", "text"))
    X = wide.select("doc_id", *names).toPandas()
    total = np.full(len(X), model.bias)
    for rule in model.rules:
        holds = np.ones(len(X), dtype=bool)
        for n, greater, c in rule.terms:
            holds &= (X[f"st_{n}"].to_numpy() > c) == greater
        total += rule.weight * holds
    return dict(zip(X.doc_id.tolist(), 1 / (1 + np.exp(-total)), strict=True))


def brute_redact(text):
    for pattern, ok in MASKED:
        text = re.sub(pattern, lambda m, ok=ok: "[SECRET]" if ok(m) else m[0], text)
    return text


def brute_rates(rows):
    """{(source, size): rate} of the bounded entropy balance, by bisection."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append(size(r.text))
    goal, out = brute_targets({s: sum(z) for s, z in per.items()}), {}
    for s, sizes in per.items():
        z = np.array([x for x in sizes if x], dtype=float)
        x, low, high = z / z.mean(), -500.0, 500.0
        for _ in range(200):
            b = (low + high) / 2
            low, high = (b, high) if (z * 3 / (1 + 2 * np.exp(np.clip(-b * x, -700, 700)))).sum() < goal[s] else (low, b)
        out |= {(s, int(n)): 3 / (1 + 2 * np.exp(np.clip(-b * n / z.mean(), -700, 700))) for n in z}
    return out, goal, size


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """The whole documents table with a secret at the end of every seventh text, and its labels."""
    folder = f"file://{tmp_path_factory.mktemp('planted')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" password=abcdefgh"), "doc_id")).otherwise(F.col("text"))
    docs.withColumn("text", hidden).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_end_to_end(spark, planted, monkeypatch):
    sf_dir = planted
    made = []
    whole = corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df: made.append(whole(df)) or made[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    stages = [docs.collect(), *(df.collect() for df in made)]
    assert len(stages) == len(corpus_pipeline.STAGES) and all(df.columns == docs.columns for df in made)

    score = brute_scores(docs, quality_model(spark, docs, sf_dir))
    assert {r.doc_id for r in stages[1]} == {i for i, s in score.items() if s >= 0.3} and len(stages[1]) > 100

    texts = {r.doc_id: r.text for r in stages[1]}
    component = {i: c for i, (_, c) in brute_components(list(texts.items()), 80).items()}
    assert {r.doc_id: r.text for r in stages[2]} == {i: t for i, t in texts.items() if component[i] == i} and len(stages[2]) < len(texts)

    assert {r.doc_id: r.text for r in stages[3]} == {r.doc_id: brute_redact(r.text) for r in stages[2]} and any("[SECRET]" in r.text for r in stages[3])
    assert all(r.n_chars == len(r.text) for r in stages[3])

    rate, goal, size = brute_rates(stages[3])
    copies = Counter(r.doc_id for r in stages[4])
    taken = Counter()
    for r in stages[3]:
        want = rate[r.source, size(r.text)]
        assert int(want + 1e-6) <= copies[r.doc_id] <= min(3, int(want + 1e-6) + 1)
        taken[r.source] += copies[r.doc_id] * size(r.text)
    largest = {s: max(size(r.text) for r in stages[3] if r.source == s) for s in goal}
    assert all(abs(taken[s] - goal[s]) <= max(largest[s], 0.05 * goal[s]) for s in goal)

    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, bins = Counter(), {}
    for r in stages[4]:
        ids = np.array([*hf.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        for p, (a, b) in enumerate([(0, first), *((s, s + 2048) for s in range(first, len(ids), 2048))]):
            want[r.doc_id, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
        assert len(parts) <= 48 and (len(parts) == 1 or sum(n * n for _, n in parts) <= 3 * 2048**2 // 4)
    assert len(bins) <= 1.25 * sum(r.length for r in packed) / 2048 + 1


def test_pipeline_has_its_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:]])
def test_stages_of_nothing(spark, sf_dir, stage):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert stage(spark, none, sf_dir).count() == 0
