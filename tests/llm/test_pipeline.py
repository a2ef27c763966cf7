"""The corpus pipeline against a brute-force version of its stages, and the registered queries."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from skein.llm import bpe, langid, mixing
from tests.llm.test_operators import brute_components, brute_lines, brute_simhash


def test_pipeline_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(docs)
    kept = {i: r.text for i, r in rows.items() if not langid.predict(model, [r.text])[3][0]}
    lined = dict(brute_lines(list(kept.items())))
    lined = {i: t for i, t in lined.items() if t == kept[i] or t.split()}
    ids = sorted(lined)
    fps = [brute_simhash(lined[i]) for i in ids]
    root = brute_components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    single = [i for k, i in enumerate(ids) if root[k] == k]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", lined[i])) for i in single}
    want = mix_times([(i, rows[i].source, size[i]) for i in single])
    tok = bpe.Bpe.load(bpe.default_path())
    expected = sorted((i, len(x := tok.encode([lined[i]])[0]), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i in single for _ in range(want[i]))
    got = sorted((g.doc_id, g.n_tokens, g.ids_sha256) for g in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == expected and len(got) > 50


def mix_times(rows):
    """How often each of (doc_id, source, size) is taken whole."""
    total, n = sum(s for *_, s in rows), 1 << mixing.SLOT_BITS
    sizes = defaultdict(int)
    for _, source, s in rows:
        sizes[source] += s
    order = sorted(sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        now = {s for s in order if 3 * sizes[s] < level * weight[s]}
        if now == capped:
            break
        capped = now
    out, at = {}, 0.0
    for source in order:
        target = min(3.0 * sizes[source], level * weight[source])
        slots = min(n, round(at * n / total + 1e-12)) , min(n, round((at + target) * n / total + 1e-12))
        at += target
        blocks = (sizes[source] - 1) * n // total + 1
        start = 0
        key = lambda r: (hashlib.md5(f"{mixing.SEED}{r[0]}".encode()).hexdigest(), r[0])
        for i, _, s in sorted((r for r in rows if r[1] == source), key=key):
            taken = slots[1] - slots[0]
            block = start * n // total
            out[i] = taken // blocks + (block < taken % blocks) if s else 1
            start += s
    return out


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).repartition(2)
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    empty = docs.where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf_dir).count() == 0


def test_stage_names_and_queries():
    import __spark_entry__ as e

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", q)[0] for q in e.queries() if re.match(r"op\d+_", q)}
    assert "pipeline" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows, shared and missing ids, extra columns with clashing names."""
    from tests.llm.test_operators import prose

    rows = [(k, prose(k, 60), "en", f"s{k % 3}", 5, 1, "x", 2) for k in range(30)]
    rows += [(None, prose(200, 60), "en", "s0", None, None, None, None), (None, prose(201, 60), None, None, 5, 1, "x", 2), (3, prose(202, 60), "en", "s1", 5, 1, "x", 2), (4, None, "en", "s0", 5, 1, "x", 2)]
    rows += [(5, "", "en", "s0", 0, 1, "x", 2), (6, prose(7, 50_000), "en", "s2", 5, 1, "x", 2), (7, prose(9, 60), "en", "s0", 5, 1, "y", 3), (7, prose(9, 60), "en", "s0", 5, 1, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, _h int")
    sent = {r[1] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    out = stages["language ID"](spark, docs, sf_dir).collect()
    assert {r.text for r in out} == sent - {None, ""} and len(out) == len(rows) - 2
    out = stages["line dedup"](spark, docs, sf_dir).collect()
    assert {r.text for r in out} == sent - {prose(9, 60)} | {prose(9, 60)} and sum(r.text is None for r in out) == 1
    out = stages["SimHash near-dedup"](spark, docs, sf_dir).collect()
    assert {r.text for r in out if r.text} == sent - {None, ""} and len(out) == len(sent) - 1 and sum(not r.text for r in out) == 1
    out = stages["mixing"](spark, docs, sf_dir).collect()
    assert sum(not r.text for r in out) == 2 and {r.text for r in out} <= sent and any(r.doc_id is None for r in out)
    out = stages["BPE"](spark, docs, sf_dir).collect()
    assert len(out) == len(rows) and sum(r.n_tokens == 0 for r in out) == 2


def test_near_copies_stage_by_stage(spark):
    """What of planted near copies (one word in a hundred changed) and exact copies each stage takes."""
    import random

    from tests.llm.test_operators import prose

    r, rows = random.Random(5), []
    for k in range(60):
        words = prose(5000 + k, 400).split()
        rows.append((k, " ".join(words)))
        for c in range(1, 3):
            near = words.copy()
            for i in r.sample(range(400), 1 if c == 1 else 0):
                near[i] = "changed"
            rows.append((1000 * c + k, " ".join(near)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    exact, near = sum(2000 + k in left for k in range(60)), sum(1000 + k in left for k in range(60))
    assert exact == 0 and near < 40 and set(range(60)) <= left
