"""Language ID over whole documents against a plain Kneser-Ney model; rows that share or lack ids; names of the line stage."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import langid, queries
from tests.llm.test_operators import docs_of, kneser_ney, lang_rows


def test_language_query_matches_plain_kneser_ney(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = docs.withColumn("h", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    span = F.length("text") - langid.SAMPLE_CHARS + 1
    hashed = hashed.withColumn("start", F.when(span > 1, F.pmod(F.xxhash64(F.lit("window"), "h"), span)))
    rows = hashed.collect()
    own = defaultdict(dict)
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and re.search(r"[^\W\d_]", r.text):
            own[r.lang][r.h] = r.text if r.start is None else r.text[r.start : r.start + langid.SAMPLE_CHARS]
    fitted = {lang: [t[h] for k, h in enumerate(sorted(t)[: langid.SAMPLE], 1) if k % langid.CALIBRATION] for lang, t in own.items()}
    langs = sorted(fitted)
    alphabet = len(np.unique(np.concatenate([langid._stream(fitted[lang])[0] for lang in langs]))) + 1
    models = [kneser_ney(fitted[lang], langid.ORDER, alphabet) for lang in langs]
    got = {g.doc_id: g for g in queries.op9_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    known = [dict() for _ in langs]
    right = []
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        x, _, counts = langid._stream([r.text or ""])
        at = np.flatnonzero(counts)
        if not len(at):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        grams = [(int(x[i]), tuple(x[i - langid.ORDER + 1 : i].tolist())) for i in at]
        e = []
        for p, seen in zip(models, known, strict=True):
            for gram in set(grams) - seen.keys():
                seen[gram] = np.log(p(*gram))
            e.append(-sum(seen[gram] for gram in grams) / len(at))
        best = min(range(len(langs)), key=lambda k: e[k])
        assert g.lang_pred == langs[best]
        assert g.cross_entropy == pytest.approx(e[best], rel=1e-4)
        assert g.score == pytest.approx(1 / sum(np.exp((e[best] - v) * min(len(at), langid.EVIDENCE)) for v in e), rel=1e-2)
        if g.held_out and r.lang:
            right.append(g.lang_pred == r.lang)
    assert len(right) > 20 and np.mean(right) > 0.9


@pytest.mark.parametrize("n", [40, 3000])
def test_languages_of_rows_without_ids_are_learned(spark, n):
    """Rows whose doc_id is null or repeated are told apart by their texts."""
    rows = lang_rows(n)
    rows = [(None if lang == "aa" else 8 if lang == "bb" else k, t, lang, s) for k, t, lang, s in rows]
    assert zlib.crc32(b"8") % 4 != 2
    model = langid.train(docs_of(spark, rows), sample=30)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.identify(docs_of(spark, rows), model).collect()
    assert sorted((g.doc_id is None, g.doc_id == 8, g.lang_pred) for g in got) == sorted((r[0] is None, r[0] == 8, r[2]) for r in rows)
    assert langid.accepted(docs_of(spark, rows), model).count() == len(rows)


def test_rows_of_one_text_are_one_of_the_sample(spark):
    rows = [(None, "aab abba baba", "aa", "s")] * 5000 + [(k, "xyz zyx yxz", "bb", "s") for k in (1, 3, 4)]
    model = langid.train(docs_of(spark, rows), sample=30)
    assert model.langs[0] == "aa"
    assert langid.predict(model, ["abba"])[0] == ["aa"]
    only = langid.train(docs_of(spark, rows[:5000]), sample=30)
    assert only.langs == ["aa"]


@pytest.mark.parametrize("names", [("n_lines", "n_removed", "emptied"), ("N_Lines", "N_Removed", "EMPTIED")])
def test_line_stage_leaves_columns_with_its_names_alone(spark, names):
    lines = "\n".join(f"a line of some {k} words that will stand here again and again" for k in range(6))
    rows = [(1, lines, "en", "s", len(lines), 111, 5, "mine"), (2, f"first words\n{lines}", "en", "s", len(lines) + 12, 222, 6, "yours"), (3, lines, "en", "s", len(lines), 333, 7, "theirs")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names[0]} int, {names[1]} int, {names[2]} string")
    out = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "first words", "en", "s", 11, 222, 6, "yours")]
