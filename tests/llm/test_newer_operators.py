"""Spelling variants, cross-tokenizer alignment and exact dedup against brute force and SQL, and on odd rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import align, exact_dedup, queries, spelling, sql

DOCS = "doc_id long, text string, digest string, row int, keep int, n long, word string, source string"


def docs_of(spark, rows):
    """rows: (doc_id, text); more columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "w", None) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_spelling", "op13_exact_dedup"])
def test_query_matches_sql(spark, sf_dir, name):
    path = f"{sf_dir}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    df = getattr(queries, name)(spark, sf_dir)
    rel = con.sql(sql.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in rel.columns) for r in df.collect()) == Counter(rel.fetchall())


# exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


ODD = [(1, "a b"), (2, "a b"), (None, "a b"), (3, None), (4, ""), (4, ""), (5, " "), (None, "only"), (None, "only"), (6, "long " * 200_000), (7, "long " * 200_000), (8, "A b"), (-9, "é"), (9, "é")]


@pytest.mark.parametrize("support", [1 / 2048, 1 / 4, 1 / 2])
def test_exact_matches_brute_force(spark, monkeypatch, support):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    rows = ODD + [(100 + k, f"t{k % 7 if k % 3 else 0}") for k in range(120)]
    got = exact_dedup.exact_duplicates(docs_of(spark, rows).repartition(5), support).collect()
    assert Counter(map(tuple, got)) == brute_exact(rows)


def test_heavy_hitters_are_exact_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    rows = [(k, "hot" if k % 3 else f"t{k}") for k in range(600)] + [(1000 + k, "warm") for k in range(150)]
    found = exact_dedup.rows(docs_of(spark, rows).repartition(6))
    heavy = exact_dedup.heavy_hitters(found, 1 / 8).collect()
    assert {h.n for h in heavy} >= {400, 150} and len(heavy) <= 8
    assert {h.keep.doc_id for h in heavy} >= {599, 1149}


def test_exact_runs_no_python_and_takes_empty_tables(spark):
    df = exact_dedup.exact_duplicates(docs_of(spark, ODD))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0
    assert exact_dedup.keep_last(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("support", [1 / 2048, 1 / 4])
def test_keep_last_keeps_one_row_of_each_text(spark, monkeypatch, support):
    monkeypatch.setattr(exact_dedup, "HEAVY", 2)
    df = docs_of(spark, ODD)
    got = exact_dedup.keep_last(df, support)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((i, t) for i, t in {t or "": max((j for j, u in ODD if (u or "") == (t or "") and j is not None), default=None) for _, t in ODD}.items() for i, t in [(t, i)])


# spelling


def brute_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {a: {b for b in words if a != b and near(a, b)} for a in words}


def brute_variants(counts, times=10):
    form = {}
    near = brute_near(counts)
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize(("seed", "letters", "per_part"), [(1, "ab", 3), (2, "abc", 10), (3, "abcdé", 1000), (4, "a", 2)])
def test_variants_match_brute_force(spark, seed, letters, per_part):
    r = random.Random(seed)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 7))): int(10 ** r.uniform(0, 5)) for _ in range(150)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), per_part=per_part).collect()
    assert len(got) == len(counts)
    assert {tuple(g) for g in got} == brute_variants(counts)


def test_light_words_that_differ_in_one_letter_meet_in_a_join(spark):
    """One word a part, so every node above two words is shared between tasks."""
    words = [f"{a}xx{b}" for a in "abcdefgh" for b in "klm"]
    counts = {w: 10 ** (k % 4) for k, w in enumerate(words)}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), per_part=1).collect()
    assert {tuple(g) for g in got} == brute_variants(counts)


def brute_words(rows, spoil):
    import regex

    counts = Counter()
    for i, t in rows:
        for w in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % spoil == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n > 1}


def test_words_match_brute_force(spark):
    long = "".join(random.Random(5).choices("abcdefg", k=100_000))
    texts = ["Straßenbahn straßenbahn ÉCOLES écoles école", "spelling Spelling speling2spellings", None, "", "1 2 3", f"{long} {long}b", "x" * 6 + " " + "x" * 7 + "Ā" + "x" * 7, "a×b÷cdefgh", "éééééééé " * 40]
    rows = [(None if k % 11 == 5 else k, t) for k, t in enumerate(texts * 30)]
    counted = spelling.words(docs_of(spark, rows), 31)
    assert {tuple(r) for r in counted.collect()} == set(brute_words(rows, 31).items())
    got = {r.word: r for r in spelling.variants(counted, per_part=2).collect()}
    near = brute_near(brute_words(rows, 31))
    assert {w: g.n_near for w, g in got.items()} == {w: len(x) for w, x in near.items()}


def test_no_words_give_no_rows(spark):
    for rows in ([], [(1, None), (2, "short words")]):
        assert spelling.variants(spelling.words(docs_of(spark, rows), 31)).count() == 0


# alignment


def brute_alignment(texts):
    p = align.Pair(*align.default_paths())
    docs = []
    for t in texts:
        a, b = ([], []) if not t else (p.a.encode(f" {t}", add_special_tokens=False).ids, p.b.encode(t))
        raw = f" {t}".encode()
        if not t or b"".join(p.bytes_a[i] for i in a) != raw or b"".join(p.bytes_b[i] for i in b) != raw:
            docs.append(None)
            continue
        spans = []
        for ids, names in ((a, p.bytes_a), (b, p.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(names[i]), i))
                at += len(names[i])
            spans.append(own)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        lo, groups, at = 0, [], [0, 0]
        for hi in cuts:
            sides = []
            for side in (0, 1):
                own = []
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= hi:
                    own.append(str(spans[side][at[side]][2]))
                    at[side] += 1
                sides.append(",".join(own))
            groups.append("|".join(sides))
            lo = hi
        assert lo == len(raw)
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs if d for x in set(d[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if not d else (*d[:3], len(d[3]), sum(count[x] == best[x[0]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


ODD_TEXTS = [
    "a▁b c d", "x <unk> y", " lead", "trail  \n", "\n", "  ", " ", "a\x00b c", "<|endoftext|> hi", "<s> </s> <0x0A>", "é é ﬁ Å", "a ́b", "tab\tb\xa0c　d   e", "\x1c a\x1d b", "😀 👩‍👩‍👧 x",
    "'s don't  'll", "中文 字 符", "a\n b\n  c d  e\r\n f", "x" * 3000 + " " + "y" * 3000, "a" * 50_000, " " * 20_000 + "b", "� ﻿ z", "a▁", None, "", "same text", "same text", "12 345 67,8 . . ; ;", "word " * 30_000,
]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 1])
def test_alignment_matches_brute_force(spark, sf_dir, monkeypatch, frequent):
    monkeypatch.setattr(align, "GATHER", 100_000)
    rows = [(None if k == 3 else k, t) for k, t in enumerate(ODD_TEXTS)] + [(k, t) for k, t in enumerate(ODD_TEXTS[:3])]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text").collect()]
    got = align.align(docs_of(spark, rows).repartition(3), frequent=frequent).collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(rows, brute_alignment([t for _, t in rows]), strict=True))


def test_alignment_of_no_rows_and_no_tokens(spark):
    assert align.align(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in align.align(docs_of(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
