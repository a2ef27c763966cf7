"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import io
import random
import zipfile
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import bpe, chat, embeddings, html_extract, langid, line_dedup, media, mixing, simhash, warc
from skein.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, rank int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); more columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 7, "x", 1) for i, t, lang, s in rows], DOCS)


WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, empty, blank and very long texts, repeated rows, near copies, ties."""
    base = prose(1, 300)
    rows = [(k, prose(k), "en", f"s{k % 3}") for k in range(10, 30)]
    rows += [(1, base, "en", "s0"), (2, base, "en", None), (3, base + " more", "de", "s1"), (4, None, None, None), (5, "", "fr", ""), (6, "  \n\t ", "fr", "s1")]
    rows += [(7, prose(7, 40_000), "en", "s0"), (None, base, "en", "s2"), (8, "x", None, "s2"), (8, "x", None, "s2"), (9, "\n".join(["same line " * 6] * 5), "en", "s2")]
    return rows


def brute_simhash(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked(i, j) and root[j] < root[i]:
                    root[i] = root[j]
                    changed = True
    return root


def test_simhash_matches_brute_force(spark, odd):
    rows = [r for r in odd if r[0] is not None and len(r[1] or "") < 10_000]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_simhash(r[1]) for r in rows}
    ids = sorted(fps)
    root = brute_components(len(ids), lambda i, j: (fps[ids[i]] ^ fps[ids[j]]).bit_count() <= 4)
    assert {(g.doc_id, g.fingerprint, g.component_id) for g in got} == {(d, f"{fps[d]:016x}", ids[root[k]]) for k, d in enumerate(ids)}


def test_slices_of_a_crowded_prefix_find_the_same_links(monkeypatch):
    """A group beyond UNFOLD is unfolded in slices."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 52, 30, np.uint64)
    fps = np.unique([int(s) ^ sum(1 << int(b) for b in r.choice(52, k, replace=False)) for s in seeds for k in range(6)]).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), 12, np.int32)), pa.array(np.zeros(len(fps), np.int64)), pa.array(fps)], ["bits", "k", "fp"])
    found = []
    for size in (1 << 30, 3000):
        monkeypatch.setattr(simhash, "UNFOLD", size)
        found.append({(a, b) for x in simhash._links_of(2)([batch]) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)})
    assert found[0] == found[1] and len(found[0]) > 30


@pytest.mark.parametrize("seed", range(3))
def test_ball_links_find_every_pair(spark, monkeypatch, seed):
    if seed == 2:  # prefixes that are dealt out by more bits
        monkeypatch.setattr(simhash, "CROWD", 3)
        monkeypatch.setattr(simhash, "UNFOLD", 500)
    r = np.random.default_rng(seed)
    seeds = r.integers(0, 1 << 63, 40, np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in r.choice(64, k, replace=False)) for s in seeds for k in range(0, 7)}
    fps = sorted(int(x) - (1 << 64 if x >= 1 << 63 else 0) for x in fps)
    got = {(g.node, g.root) for g in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    near = lambda i, j: ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4
    root = brute_components(len(fps), near)
    sizes = defaultdict(int)
    for x in root:
        sizes[x] += 1
    assert got == {(fps[k], fps[x]) for k, x in enumerate(root) if sizes[x] > 1}


def test_simhash_null_id_and_empty_table(spark, odd):
    got = simhash.near_duplicates(docs_of(spark, odd)).collect()
    assert len(got) == len(odd)
    assert {g.component_id for g in got if g.doc_id in (1, 2, None)} == {1}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    kept = simhash.keep_one(docs_of(spark, odd)).collect()
    assert sorted(k.doc_id for k in kept if k.doc_id in (1, 2, 8)) == [1, 8]


def test_keep_one_keeps_a_row_of_every_group(spark):
    """Null and repeated doc_ids with different texts are different groups, each of which keeps a row."""
    rows = [(None, prose(1), "en", "s0"), (None, prose(2), "en", "s0"), (None, prose(2), "en", "s1"), (5, prose(3), "en", "s0"), (5, prose(4), "en", "s0"), (5, prose(4), "en", "s0")]
    rows += [(7, prose(5), "en", "s0"), (None, prose(5), "en", "s0"), (6, prose(5), None, "s2"), (6, prose(5), "s2", None), (None, None, "en", "s0")]
    got = [sorted(map(str, simhash.keep_one(docs_of(spark, x)).collect())) for x in (rows, rows[::-1])]
    assert got[0] == got[1]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs_of(spark, rows).repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(None, prose(1)), (None, prose(2)), (5, prose(3)), (5, prose(4)), (6, prose(5)), (None, None)], key=str)


def test_components_long_path(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_mix_targets_and_caps(spark, odd):
    rows = odd + [(k, prose(k, 500), "en", "s1") for k in range(100, 160)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sum(g.taken for g in got) > 0
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        size[g.source] += g.size
        taken[g.source] += g.taken
        target[g.source] = g.target
        assert g.source_size is not None
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 2 + total / 2**16 and target[s] <= 3 * size[s] + 1e-9 for s in size)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_schedule_is_even(spark):
    goal = spark.createDataFrame([(0, "a", 1000, 1500.0), (1, "b", 1000, 500.0)], "sid long, source string, source_size long, target double")
    slots = sorted((r.slot, r.sid, r.epoch) for r in mixing.schedule(goal, 8).collect())
    assert [s for s, _, _ in slots] == list(range(256))
    for n in (32, 64, 128):
        assert abs(sum(sid == 0 for _, sid, _ in slots[:n]) - 0.75 * n) <= 2
    assert max(e for _, _, e in slots) <= 1


@pytest.mark.parametrize("big", ["bigint", "decimal(38,0)"])
def test_mix_keeps_sources_far_below_a_slot(spark, monkeypatch, big):
    """Sources below half a slot of 2^17 get their words too; with more sources than slots all of them do."""
    levels = mixing._levels
    monkeypatch.setattr(mixing, "_levels", lambda *a: (*levels(*a)[:2], big))
    rows = [(k, "w " * 40_000, "en", "big") for k in range(30)] + [(100, "one", "en", "a"), (101, "two words", "en", "z"), (102, "more", "en", "z"), (103, "w " * 9, "en", None)]
    got = {g.doc_id: g for g in mixing.mix(docs_of(spark, rows)).collect()}
    assert {k: got[k].taken for k in range(100, 104)} == {k: 3 * got[k].size for k in range(100, 104)}
    kept = [r.doc_id for r in mixing.mixed_documents(docs_of(spark, rows)).collect()]
    assert all(kept.count(k) == 3 for k in range(100, 104))
    many = [(k, prose(k, 200), "en", f"s{k % 40}") for k in range(400)]
    taken, target = defaultdict(int), {}
    for g in mixing.mix(docs_of(spark, many), slot_bits=4).collect():
        taken[g.source] += g.taken
        target[g.source] = g.target
    assert all(abs(taken[s] - t) <= t / mixing.LEAST_SLOTS + 1 for s, t in target.items()) and len(target) == 40
    words = defaultdict(int)
    for r in mixing.mixed_documents(docs_of(spark, many), slot_bits=4).collect():
        words[r.source] += 200
    assert all(abs(words[s] - t) < 200 + t / mixing.LEAST_SLOTS for s, t in target.items())


def test_mix_schedule_spreads_fine_slots(spark):
    goal = spark.createDataFrame([(0, "a", 1_000_000, 999_000.0), (1, "b", 1000, 1000.0)], "sid long, source string, source_size long, target double")
    got = mixing.schedule(goal, 8).collect()
    fine = sorted(r["at"] for r in got if r.sid == 1)
    assert mixing.LEAST_SLOTS <= len(fine) <= 2 * mixing.LEAST_SLOTS + 1 and all(r.slot == int(r["at"]) for r in got)
    assert max(abs(x - 256 * k / len(fine)) for k, x in enumerate(fine)) < 256 / 16 and {r.epoch for r in got if r.sid == 1} <= {0, 1}


def test_mix_without_words(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [g.taken for g in mixing.mix(docs_of(spark, [(1, None, None, None), (2, " ", "en", "a")])).collect()] == [0, 0]
    assert mixing.mixed_documents(docs_of(spark, [(1, "", "en", "a")])).count() == 1


def test_mixed_documents_near_target(spark):
    rows = [(k, prose(k, 50), "en", f"s{k % 3}") for k in range(300)]
    goal = {g.source: g.target for g in mixing.mix(docs_of(spark, rows)).collect()}
    got = mixing.mixed_documents(docs_of(spark, rows)).collect()
    words = defaultdict(int)
    for g in got:
        words[g.source] += 50
    assert got[0].asDict().keys() == docs_of(spark, []).first().asDict().keys() if docs_of(spark, []).count() else True
    assert all(abs(words[s] - goal[s]) <= 60 for s in goal)


def vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((60, 16))
    rows = []
    for k in range(400):
        v = base[k % 60] + r.standard_normal(16) * r.choice([0, 0.03, 0.1, 0.3])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 3) if k % 17 else None, "x"))
    rows += [(500, None, 1, "x"), (501, [0.0] * 16, 1, "x"), (502, [float("nan")] + [1.0] * 15, 1, "x"), (503, [None] + [1.0] * 15, 1, "x"), (504, [], 1, "x"), (505, [1.0, 0.0], 1, "x"), (506, [2.0, 0.0], 1, "x"), (507, [1.0, 0.0], 1, "x"), (508, [1e30, 0.0], 1, "x"), (508, [1e30, 0.0], 1, "x")]
    return rows


def test_embeddings_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOME_ROWS", 8)  # so that cells are dealt over salts
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cls string")).collect()
    n = len(rows)

    def linked(i, j):
        (_, a, la, _), (_, b, lb, _) = rows[i], rows[j]
        if i == j or la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
            return False
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return False
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98

    link = np.array([[linked(i, j) for j in range(n)] for i in range(n)])
    root = brute_components(n, lambda i, j: link[i, j])
    want = sorted((rows[k][0], int(link[k].sum()), rows[root[k]][0], rows[k][0] == rows[root[k]][0]) for k in range(n))
    assert sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in got) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav>Menu</nav><div class="ad">Buy</div>
<header>Top</header><article><h1>One &amp; two</h1><p>First&nbsp;<b>bo</b>ld<br>line<p class="notice">gone<p>Sec   ond</p><aside>side</aside>
<form>f</form><div id="comments">c</div><ul><li>a</li><li>b</li></ul></article><footer>&copy; x</footer></body></html>"""


def test_html_blocks():
    got = html_extract.blocks(PAGE)
    assert [t for k, t in got if k == "main"] == ["One & two", "First bold", "line", "Sec ond", "a", "b"]
    assert [t for k, t in got if k == "marked"] == ["Menu", "Buy", "Top", "gone", "side", "f", "c", "© x"] and not [t for k, t in got if k == "free"]
    assert html_extract.blocks(None) == html_extract.blocks("") == []
    assert html_extract.blocks("<p>cut of&am") == [("free", "cut of&am")]
    assert html_extract.blocks("<article>x<p")[0] == ("main", "x")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content search-results"><article>story</article></div>', [("main", "story")]),
        ('<article class="post sponsored">story</article>', [("main", "story")]),
        ('<article>story</article><article class="sponsored">advert</article>', [("main", "story"), ("marked", "advert")]),
        ('<div class="comments"><article class="comment">no</article></div>', [("marked", "no")]),
        ('<aside><article>no</article></aside>', [("marked", "no")]),
        ('<p title="see class=ad here">x', [("free", "x")]),
        ("<p>AT&<b>amp;</b> &amp; Co", [("free", "AT&amp; & Co")]),
        ("<p>a\x1cb\xa0 \u2003c", [("free", "a\x1cb c")]),
        ('<p>one <span class="ad">buy</span>two', [("free", "one two"), ("marked", "buy")]),
    ],
)
def test_html_marks(page, want):
    assert html_extract.blocks(page) == want


class Tree(HTMLParser):
    """Another reader of simple pages: a tree walk that keeps (kind, text) of blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.buf = [], [], {"shown": "", "marked": ""}

    def flush(self):
        for kind, text in self.buf.items():
            if text.split():
                inside = any(t in ("article", "main") for t, _ in self.open)
                self.out.append(("marked" if kind == "marked" else "main" if inside else "free", " ".join(text.split())))
        self.buf = {"shown": "", "marked": ""}

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.BLOCK:
            self.flush()
            if "p" in [t for t, _ in self.open]:
                while self.open.pop()[0] != "p":
                    pass
        if tag not in html_extract.VOID:
            words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).split()
            self.open.append((tag, tag in html_extract.OUT or bool({"ad", "notice", "comments"} & set(words))))

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.flush()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style", "title", "head") for t, _ in self.open):
            self.buf["marked" if any(m for _, m in self.open) else "shown"] += data


def brute_pages(rows):
    """page_id -> text by Tree, and by counting every run of six words outside articles on every page of the host."""
    parsed, seen = {}, defaultdict(set)
    for page_id, url, page in rows:
        tree = Tree()
        tree.feed(page or "")
        tree.close()
        tree.flush()
        stretches = [[]]
        for kind, text in tree.out:
            if kind == "main":
                stretches.append([])
            else:
                stretches[-1] += [(kind, w) for w in text.split()]
        parsed[page_id] = (url.split("/")[2], tree.out, stretches)
        for part in stretches:
            for k in range(len(part) - 5):
                seen[url.split("/")[2], tuple(w for _, w in part[k : k + 6])].add(str(tree.out))
    texts, gone_words = {}, 0
    for page_id, (host, out, stretches) in parsed.items():
        gone = []
        for part in stretches:
            hit = [False] * len(part)
            for k in range(len(part) - 5):
                if len(seen[host, tuple(w for _, w in part[k : k + 6])]) >= 3:
                    hit[k : k + 6] = [True] * 6
            gone += hit
        gone_words += sum(gone)
        words, at = [], 0
        for kind, text in out:
            if kind == "main":
                words += text.split()
                continue
            for w in text.split():
                if kind == "free" and not gone[at]:
                    words.append(w)
                at += 1
        texts[page_id] = " ".join(words)
    return texts, gone_words


@pytest.mark.parametrize("articles", [True, False])
def test_html_matches_brute_force(spark, sf_dir, articles):
    """On pages as they are, and with their articles as bare divs, so that the host's array decides on every word."""
    pages = spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").select("page_id", "url", "html")
    if not articles:
        pages = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)article", "<$1div"))
    rows = [tuple(r) for r in pages.collect()]
    want, gone = brute_pages(rows)
    assert {g.page_id: g.text for g in html_extract.extract(pages, shard_pages=5).collect()} == want and gone > 50
    n = html_extract.removed_words(pages).first()
    assert n["free_gone"] + n["marked_gone"] == gone and n["pages"] == len(rows) and (n["article"] > 0) == articles


def test_html_array_decides_beside_articles(spark):
    """Unmarked text outside an article goes where the host repeats it, and stays where it is unique."""
    line, lead = "Follow our channel for more stories like this", [prose(500 + k, 9) for k in range(8)]
    rows = [(k, f"https://h.example/{k}", f"<div>{line}</div><p>{lead[k] if k % 2 else ''}</p><article>{prose(k, 20)}</article>") for k in range(8)]
    rows += [(20, "https://other.example/1", f"<div>{line}</div><article>{prose(20, 20)}</article>"), (21, "https://h.example/21", f"<article>{line}</article>")]
    rows += [(30, "https://h.example/30", f"<p>{prose(30, 30_000)}</p><div>{line}</div>")]
    got = {g.page_id: g.text for g in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"{lead[k]} {prose(k, 20)}" if k % 2 else prose(k, 20)) for k in range(8))
    assert got[20] == f"{line} {prose(20, 20)}" and got[21] == line and got[30] == prose(30, 30_000)


def test_html_extract(spark):
    shared = "Read our terms of use and the privacy policy first"
    pages = [(k, f"https://h.example/{k}", f"<body><div>{shared}</div><p>{prose(k, 30)}</p></body>", 1) for k in range(5)]
    pages += [(10, "https://h.example/a", PAGE, 1), (11, None, None, 1), (None, "odd", "plain text", 1), (12, "https://h.example/12", f"<article>{shared}</article>", 1), (12, "https://h.example/12", f"<article>{shared}</article>", 1)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, host int")).collect()
    text = defaultdict(list)
    for g in got:
        text[g.page_id].append(g.text)
        assert g.n_chars == len(g.text)
    assert all(text[k] == [prose(k, 30)] for k in range(5))  # repeated on the host's pages: boilerplate
    assert text[10] == ["One & two First bold line Sec ond a b"] and text[11] == [""] and text[None] == ["plain text"] and text[12] == [shared] * 2
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_runs_are_decided_over_the_whole_host(spark):
    """A notice on few pages of each shard goes; an article without an article element at several addresses stays."""
    notice = "Please note our new opening hours from May"
    page = lambda *parts: "<body>" + "".join(f"<p>{x}</p>" for x in parts) + "</body>"
    rows = [(k, f"https://h.example/{k}", page(notice, prose(k, 20)) if k < 12 else page(prose(k, 20))) for k in range(120)]
    rows += [(200 + k, f"https://h.example/copy{k}", page(prose(999, 40))) for k in range(5)]
    rows += [(300 + k, f"https://g.example/{k}", page(notice, prose(k, 20))) for k in range(2)]
    got = {g.page_id: g.text for g in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=4).collect()}
    assert len(got) == len(rows) and all(got[k] == prose(k, 20) for k in range(120))
    assert all(got[200 + k] == prose(999, 40) for k in range(5)) and all(got[300 + k] == f"{notice}\n{prose(k, 20)}".replace("\n", " ") for k in range(2))


def test_runs_of_shards_match_brute_force():
    r = random.Random(6)
    for _ in range(300):
        streams = [[[r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 2))] for _ in range(r.randint(0, 5))]
        weight = [r.randint(1, 2) for _ in streams]
        least, most = r.randint(1, 4), r.randint(2, 4)
        total, seen = defaultdict(int), defaultdict(set)
        for half in (0, 1):
            for name, n in html_extract.shared_runs(streams[half::2], weight[half::2], least).items():
                total[name] += n
        for k, stream in enumerate(streams):
            for part in stream:
                for i in range(len(part) - least + 1):
                    seen[tuple(part[i : i + least])].add(k)
        gone = {name for name, n in total.items() if n >= most}
        for part in (p for s in streams for p in s):
            want = [False] * len(part)
            for i in range(len(part) - least + 1):
                if sum(weight[k] for k in seen[tuple(part[i : i + least])]) >= most:
                    want[i : i + least] = [True] * least
            assert html_extract.covered(part, gone, least) == want


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_against_zipfile(zip64):
    r = random.Random(2)
    data = {f"m{k}": r.randbytes(r.randint(0, 3000)) for k in range(12)}
    ours = io.BytesIO()
    w = warc.PackageWriter(ours, zip64)
    for k, v in data.items():
        w.add(k, v)
    w.close()
    with zipfile.ZipFile(io.BytesIO(ours.getvalue())) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == data
    theirs = io.BytesIO()
    with zipfile.ZipFile(theirs, "w") as z:
        for k, v in data.items():
            with z.open(k, "w", force_zip64=zip64) as f:
                f.write(v)
        z.comment = b"PK\x05\x06 a comment"
    for raw in (ours.getvalue(), theirs.getvalue()):
        assert {k: raw[a : a + n] for k, (a, n) in warc.directory(io.BytesIO(raw), len(raw)).items()} == data


def test_warc_round_trip(spark):
    big, other = "é" * 600, "z" * 2000
    rows = [(1, "u1", big, 1), (2, "u\r\n2", big, 1), (3, None, big, 1), (3, None, big, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (7, "u", "", 1), (8, "u", other, 1)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).collect()
    want = []
    for i, u, h, _ in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 3
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to or 0) for g in got) == sorted((*w[:4], w[4] or 0) for w in want)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_lines(rows):
    """(doc_id, text) with later copies removed."""
    seqs = {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: x[0]):
        seqs[i, t] = [k for k, line in enumerate(t.split("\n")) if line.split()]
    first, gone = {}, defaultdict(set)
    for (i, t), at in seqs.items():
        lines = t.split("\n")
        for p in range(len(at)):
            for n, ok in ((1, len(lines[at[p]].split()) >= 10), (4, p + 4 <= len(at))):
                if ok:
                    key = (n, *(lines[k] for k in at[p : p + n]))
                    if first.setdefault(key, (i, p)) != (i, p):
                        gone[i, t] |= set(at[p : p + n])
    return {(i, None if t is None else "\n".join([x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]])) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 12]))) for _ in range(12)]
    rows = []
    for k in range(60):
        rows.append((k, "\n".join(r.choice([*pool, "", " "]) for _ in range(r.randint(0, 14)))))
    rows += [(100, None), (101, ""), (102, "a"), (102, "a"), (103, "\n".join(pool)), (103, "\n".join(pool)), (104, "\n".join(["same"] * 50))]
    got = line_dedup.dedup_lines(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert len(got) == len(rows) and {(g.doc_id, g.text) for g in got} == brute_lines(rows)
    assert [g.n_removed for g in got if g.doc_id == 104] == [49]
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, [(None, None, None, None)])).count() == 1


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(docs_of(spark, []))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = ["", "  ", "a<|endoftext|>b <|startoftext|>", "Straße ΣΑΣ İstanbul ﬁ é ½ ² ①", "it's we'll'd I'M", "x" * 3000 + " " + "abc" * 300, "a\x1cb\x85c　d", "日本語 テキスト 😀👍🏽", "12345 ٣٤ \x00\x01", "don't!!! ...###$$$", "<|endoftext|", "ǅ ẞ ͅ"]


def test_bpe_matches_the_library(library, sf_dir):
    import pyarrow.parquet as pq

    texts = ODD_TEXTS + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    mine = bpe.Bpe.load(bpe.default_path())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert mine.encode(texts) == want
    assert [mine.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_query(spark, library):
    rows = [(k, t, "en", "s") for k, t in enumerate(ODD_TEXTS)] + [(None, None, None, None), (1, "x", "en", "s"), (1, "x", "en", "s")]
    got = bpe.digests(docs_of(spark, rows)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in rows}
    want = [(str(i), len(ids[t]), sha(" ".join(map(str, ids[t]))), sha(library.decode(ids[t], skip_special_tokens=False))) for i, t, _, _ in rows]
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)
    encoded = bpe.encode(docs_of(spark, rows))
    assert {r.text for r in bpe.decode(encoded).collect()} == {library.decode(x, skip_special_tokens=False) for x in ids.values()}
    assert bpe.digests(docs_of(spark, [])).count() == 0


CONVS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "no ### \\ </turn>\n"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "bye"),
    (4, 0, None, None), (5, 0, "a:b\\", "### x: y</turn>\n"), (5, 1, "assistant", ""), (5, 1, "assistant", "tie"), (6, None, "assistant", "\\"), (6, 3, "system", "\\</turn>"), (7, 0, "user", "hi"), (7, 1, "assistant", "yo"), (None, 0, "assistant", "n" * 5000),
]


def test_chat_round_trip(spark):
    got = chat.round_trip(spark.createDataFrame([(*c, 1) for c in CONVS], "conv_id long, turn long, role string, text string, path int")).collect()
    convs = defaultdict(list)
    for c, t, r, x in CONVS:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    want = {}
    for c, turns in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted = "".join(chat.format_turn(r, x)[0] for r, x in turns)
        assert chat.parse_turns(formatted) == turns
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    assert {g.conv_id: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256, g.formatted_chars) for g in got} == want and len(got) == len(want)
    assert chat.round_trip(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_pack_shares_turns():
    a, b, c = [("user", "q"), ("assistant", "1")], [("user", "q"), ("assistant", "1"), ("user", "r")], [("user", "q"), ("assistant", "2")]
    text, nodes, leaves = chat.pack([("c", c), ("a", a), ("b", b)])
    assert len(nodes) == 4 and text.count("### user: q") == 1
    ids = chat.position_ids(nodes)
    for name, turns in (("a", a), ("b", b), ("c", c)):
        leaf = next(x["node"] for x in leaves if x["path"] == name)
        formatted, _ = chat.unpack(text, nodes, leaf)
        assert chat.parse_turns(formatted) == turns
        spans = [*nodes[leaf]["ancestors"], nodes[leaf]]
        assert [i for s in spans for i in ids[s["start"] : s["end"]]] == list(range(len(formatted)))


def test_chat_crowded_first_turn(spark):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", "start" if t == 0 else f"{k % 7 if t == 1 else k}") for k in range(60) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = chat.packs(chat.paths(turns).select("path", "turns"), 8)
    assert packed.count() > 3 and chat.digests(packed).select("path").distinct().count() == 60


def lang_rows(n=400):
    letters = {"aa": "abcdeg", "bb": "xyzwvu", "cc": "aexyou"}
    rows = []
    for k in range(n):
        lang = list(letters)[k % 3]
        r = random.Random(k)
        rows.append((k, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(2, 7))) for _ in range(30)), lang, "s"))
    return rows


def test_language_id(spark):
    rows = lang_rows() + [(1000, None, "aa", "s"), (1001, "123 !?", "aa", "s"), (1002, "", None, None), (None, "abc abc", None, None), (1003, "жизнь это долгая дорога " * 5, None, "s"), (1004, "abc " * 30_000, None, "s"), (1004, "abc " * 30_000, None, "s")]
    docs = docs_of(spark, rows)
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] < 1000]
    assert all(by[r[0]].held_out for r in held) and np.mean([by[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(0 <= g.score <= 1 for g in got)
    assert by[1004].lang_pred == "aa"
    kept = {r.doc_id for r in langid.accepted(docs, model).collect()}
    assert not kept & {1000, 1001, 1002, 1003} and len(kept & {r[0] for r in held}) >= 0.99 * len(held)
    alone = langid.predict(model, [rows[5][1]])[2][0]
    assert alone == pytest.approx(by[5].cross_entropy, rel=1e-5)  # texts of a batch don't touch each other
    assert langid.train(docs_of(spark, [])) is None and langid.identify(docs_of(spark, []), None).count() == 0
    assert [g.lang_pred for g in langid.identify(docs_of(spark, [(1, "abc", None, None)]), None).collect()] == ["und"]


def test_languages_of_long_documents_are_learned(spark):
    """Documents longer than SAMPLE_CHARS are fitted on by a window, also where their letters stand at one end."""
    rows = [(k, (t + " ") * 120, lang, s) for k, t, lang, s in lang_rows(60)]
    assert all(len(r[1]) > langid.SAMPLE_CHARS for r in rows)
    rows += [(k, "1 " * 40_000 + "qrs tqr sst " * 9, "dd", "s") for k in range(100, 112)]
    model = langid.train(docs_of(spark, rows))
    assert model.langs == ["aa", "bb", "cc", "dd"]
    by = {g.doc_id: g for g in langid.identify(docs_of(spark, rows), model).collect()}
    assert all(by[r[0]].lang_pred == r[2] and not by[r[0]].rejected for r in rows)


@pytest.mark.parametrize("n", [1, 3, 4])
def test_a_rare_language_rejects_foreign_text(spark, n):
    """A language with too few documents for a calibration set has a finite limit: it keeps its own texts, not all else."""
    say = lambda letters, seed: " ".join("".join(random.Random(seed * 1000 + w).choices(letters, k=2 + w % 6)) for w in range(40))
    ids = [k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 4 != 2][:n]
    docs = docs_of(spark, lang_rows(120) + [(k, say("mnoprk", k), "dd", "s") for k in ids])
    model = langid.train(docs)
    assert "dd" in model.langs and np.isfinite(model.limit).all()
    foreign = ["жизнь это долгая дорога " * 5, say("abcdefghijklmnopqrstuvwxyz", 1), say("fhijlqst", 2), say("ßäöüéèñç", 3)]
    assert langid.predict(model, foreign)[3].all()
    own = langid.predict(model, [say("mnoprk", k) for k in range(3000, 3020)])
    assert own[0] == ["dd"] * 20 and not own[3].any()
    few = langid.train(docs_of(spark, [(k, "ab", "dd", "s") for k in ids]))  # nothing to calibrate with
    assert np.isfinite(few.limit).all()


def test_no_model_rejects_nothing(spark):
    docs = docs_of(spark, [(1, "abc", None, None), (2, None, None, None)])
    assert langid.train(docs) is None and langid.accepted(docs, None).count() == 2
    assert [(g.lang_pred, g.rejected) for g in langid.identify(docs, None).collect()] == [("und", False)] * 2


def test_kneser_ney_is_a_distribution():
    """The probabilities that follow a history sum to one over the alphabet and the unknown character."""
    model = langid.fit({"aa": ["abracadabra abba cab " * 3], "bb": ["xyz zyx yxz " * 3]})
    alphabet = sorted(set("abracadabra cabxyz "))
    for m, history in ((0, "abra"), (0, "cab"), (1, "zyx"), (0, "zzz")):
        total = 0.0
        for ch in [*alphabet, "q"]:
            (e1, e0), (n1, n0) = model.entropies([history + ch, history])
            total += np.exp(-(e1[m] * n1 - e0[m] * n0))
        assert total == pytest.approx(1, abs=1e-3)


def test_media_round_trip(spark, odd):
    got = media.round_trip(docs_of(spark, odd)).collect()
    assert len(got) == len(odd)

    def want(i, t):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wav = media.to_wav(padded)
        return str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media.feature(padded)

    assert sorted((str(g.doc_id), g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32, g.media_bytes, g.media_sha256, g.feature) for g in got) == sorted(want(i, t) for i, t, _, _ in odd)
    assert media.round_trip(docs_of(spark, [])).count() == 0


def test_gear_chunks():
    r = random.Random(4)
    data = r.randbytes(200_000)
    ends = media.chunk_ends(data)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends, strict=False))
    h, plain = 0, []
    for b in data[:5000]:
        h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
        plain.append(h)
    assert media.rolling(np.frombuffer(data[:5000], np.uint8))[31:].tolist() == plain[31:]
    moved = media.chunk_ends(b"in front" + data)
    assert len({e - 8 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert media.chunk_ends(b"") == [0] and media.chunk_ends(b"ab") == [2]


def test_media_store_shares_chunks(spark, tmp_path):
    """Tasks that don't see each other's chunks store copies; after compaction every chunk is stored once, and files come back."""
    r = random.Random(9)
    body = "".join(chr(r.randint(97, 122)) for _ in range(60_000))
    docs = docs_of(spark, [(k, f"{k} {body}", "en", "s") for k in range(6)])
    folder = f"file://{tmp_path}"
    size = lambda: sum(p.stat().st_size for p in tmp_path.glob("*.pack"))
    files, places, written = media.store(docs.repartition(3), folder)
    assert places.count() < 0.4 * sum(len(f.chunks) for f in files.collect()) and written.select("pack").distinct().count() == 3
    before = size()
    assert media.compact(places, written, folder, 1.0).count() == places.count() and size() == before
    places = media.compact(places, written, folder)
    assert size() < 0.6 * before and places.count() == places.select("digest").distinct().count()
    got = {bytes(x.media).hex(): x for x in media.rebuild(files, places, folder).collect()}
    for f in files.collect():
        text = f"{f.doc_id} {body}".encode()
        raw = text + bytes(-len(text) % 64)
        assert got[f.media_sha256].payload_sha256 == hashlib.sha256(raw).hexdigest()


def kneser_ney(text, order, alphabet):
    """Log probability function of an interpolated Kneser-Ney model over the training text's counted characters, from its definition."""
    x, _, counts = langid._stream(text)
    x = x.tolist()
    top = defaultdict(lambda: defaultdict(int))
    for i in np.flatnonzero(counts):
        top[tuple(x[i - order + 1 : i])][x[i]] += 1
    tables = [top]
    for _ in range(order - 1):  # continuation counts: how many characters stand before
        lower = defaultdict(lambda: defaultdict(int))
        for history, seen in tables[-1].items():
            for ch in seen:
                lower[history[1:]][ch] += 1
        tables.append(lower)
    discounts = []
    for t in tables:
        every = [c for seen in t.values() for c in seen.values()]
        n1, n2 = every.count(1), every.count(2)
        discounts.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(ch, history):
        if len(history) >= order:
            history = history[len(history) - order + 1 :]
        k = order - 1 - len(history)
        below = p(ch, history[1:]) if history else 1 / alphabet
        seen = tables[k].get(history)
        if not seen:
            return below
        total, d = sum(seen.values()), discounts[k]
        return max(seen.get(ch, 0) - d, 0) / total + d * len(seen) / total * below

    return p


def test_kneser_ney_matches_its_definition():
    samples = {"aa": ["abracadabra abba cab", "dab cab a bad cad"], "bb": ["xyz zyx yxz zzy", "cab xyz"]}
    alphabet = 30
    model = langid.fit(samples, alphabet=alphabet)
    for text in ["abra cadabra", "xyzzy", "cab zab", "qqq abba", "ж"]:
        e, n = model.entropies([text])
        for m, lang in enumerate(model.langs):
            p = kneser_ney(samples[lang], langid.ORDER, alphabet)
            x, _, counts = langid._stream([text])
            want = -sum(np.log(p(int(x[i]), tuple(x[i - langid.ORDER + 1 : i].tolist()))) for i in np.flatnonzero(counts)) / counts.sum()
            assert n[0] == counts.sum() and abs(e[0, m] - want) < 1e-4


def test_embeddings_string_labels_and_dense_clusters(spark, monkeypatch):
    """Labels of any type, and a cluster of many different vectors that are all near one another."""
    monkeypatch.setattr(embeddings, "HOME_ROWS", 64)
    monkeypatch.setattr(embeddings, "TILE", 50)
    monkeypatch.setattr(embeddings, "LEAF", 8)
    r = np.random.default_rng(4)
    near = (np.ones(16) + 0.01 * r.standard_normal((300, 16))).astype(np.float32)
    rows = [(k, v.tolist(), "x" if k % 3 else "y é") for k, v in enumerate(near)] + [(400, near[0].tolist(), None)]
    got = {g.vec_id: g for g in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    for label in ("x", "y é"):
        ids = [k for k, _, lab in rows if lab == label]
        v = near[ids].astype(float)
        v /= np.linalg.norm(v, axis=1)[:, None]
        links = (v @ v.T >= 0.98).sum(axis=1) - 1
        assert [got[k].n_links for k in ids] == links.tolist() and {got[k].component_id for k in ids} == {ids[0]}
    assert got[400].n_links == 0 and got[400].kept


def test_embedding_checks_fall_behind_all_pairs():
    """At 64 dimensions the blocks check under a third of all pairs of 20,000 vectors, and find every near one."""
    r = np.random.default_rng(1)
    x = r.standard_normal((20_000, 64))
    x[10_000:10_200] = x[:200] + 0.1 * r.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y, checks, found = x @ embeddings._rotation(64), 0, set()
    for where, budget in embeddings._plan(64, 0.98):
        for i, j, n in embeddings.near_pairs(y[:, where], y[:, where], budget, True):
            checks += n
            ok = (x[i] * x[j]).sum(axis=1) >= 0.98
            found |= {(min(p), max(p)) for p in zip(i[ok].tolist(), j[ok].tolist(), strict=True)}
    want = {(a, a + 10_000) for a in range(200) if x[a] @ x[a + 10_000] >= 0.98}
    assert checks < len(x) * (len(x) - 1) / 2 / 3 and found == want and len(want) > 100


def test_warc_packages_ranges_and_odd_rows(spark, tmp_path, monkeypatch):
    """Null page_ids, several packages of a task, more than one range; records and index lines are in form."""
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 3000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 400)
    r = random.Random(3)
    rows = [(None if k == 5 else k, f"http://h.example/{k}", "".join(r.choice("abcdefgh ") for _ in range(400 + k))) for k in range(30)]
    manifest = warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}")
    packages = [p.package.removeprefix("file://") for p in manifest.collect()]
    assert len(packages) > 3
    with open(packages[0], "rb") as f:
        raw = f.read()
    members = warc.directory(io.BytesIO(raw), len(raw))
    at, n = members[warc.INDEX]
    lines = raw[at : at + n].decode().splitlines()
    assert lines == sorted(lines) and all(x.startswith("example,h)/") and x.split(" ")[1] == "20000101000000" for x in lines)
    data_at, _ = members[warc.DATA]
    import json

    for x in lines:
        entry = json.loads(x.split(" ", 2)[2])
        start = data_at + int(entry["offset"])
        headers, block = warc.parse(raw[start : start + int(entry["length"])])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "Content-Length", "WARC-Target-URI"} <= headers.keys() and block.startswith(b"HTTP/1.1 200 OK")
    batches = [b for b in _arrow(manifest.select("package", "n_bytes"))]
    got = sorted((str(i), u, n) for out in warc._reader(batches) for i, u, n in zip(*(out.column(c).to_pylist() for c in ("page_id", "url", "payload_bytes")), strict=True))
    assert got == sorted((str(i), u, len(h)) for i, u, h in rows)


def _arrow(df):
    return df.toArrow().to_batches()


def test_line_dedup_long_texts_and_null_ids(spark):
    """A run of 3000 lines under a null id comes before its copy under an id; its later copies go, line by line of the longer text too."""
    run = [f"line number {k} of the long run" for k in range(3000)]
    rows = [(None, "\n".join(run)), (7, "\n".join(["head", *run, "tail"])), (8, "\n".join(["x y", "", *run[100:2000]])), (None, "alone")]
    got = line_dedup.dedup_lines(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {(g.doc_id, g.text) for g in got} == {(None, "\n".join(run)), (7, "head\ntail"), (8, "x y\n"), (None, "alone")}
    found = line_dedup.runs(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((g.doc_id, g.first, g.last, g.lines) for g in found) == [(7, 1, 3000, 3000), (8, 1, 1900, 1900)]


def test_line_names_are_independent(spark):
    """The halves of a line's ID: the second is no function of the first."""
    a, b = F.xxhash64(F.lit(1), "x"), F.xxhash64(F.lit(2), "x")
    rows = spark.createDataFrame([(f"line {k}",) for k in range(50)], "x string").select("x", a.alias("a"), b.alias("b")).collect()
    mine = {"a": 1, "b": 2}
    for r in rows:
        for c, salt in mine.items():
            seed = xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), 42)
            assert r[c] & (1 << 64) - 1 == xxhash.xxh64_intdigest(r.x.encode(), seed)
    assert len({r.a ^ r.b for r in rows}) == 50


def test_chat_very_long_text(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### word \\ " * 60_000), (2, 0, "user", "hi")]
    got = {g.conv_id: g for g in chat.round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].loss_chars == len(rows[1][3]) and got[1].loss_sha256 == hashlib.sha256(rows[1][3].encode()).hexdigest() and got[2].n_turns == 1
    text, nodes, leaves = chat.pack([("a", [("user", "q"), ("assistant", "1")])])
    nodes[1]["position"] += 1
    with pytest.raises(ValueError, match="position"):
        chat.unpack(text, nodes, 1)


def test_mixed_documents_by_row(spark):
    """Rows that share or lack a doc_id are told apart by source and text; repeated rows share a number."""
    rows = [(None, prose(k, 40), "en", f"s{k % 2}") for k in range(40)] + [(5, prose(100 + k, 40), "en", f"s{k % 3}") for k in range(40)] + [(9, "same text", "en", "s0")] * 2 + [(10, None, "en", None)]
    docs = docs_of(spark, rows)
    goal = {g.source: (g.target, g.source_size) for g in mixing.mix(docs).collect()}
    words, texts = defaultdict(int), set()
    for g in mixing.mixed_documents(docs).collect():
        words[g.source] += len((g.text or "").split())
        texts.add((g.doc_id, g.source, g.text))
    assert all(abs(words[s] - t) <= 41 for s, (t, _) in goal.items()) and (10, None, None) in texts and len(texts) > 50
    assert sum(g.doc_id == 9 for g in mixing.mixed_documents(docs).collect()) % 2 == 0


def test_ranks_of_distinct_rows_need_one_exchange(spark, monkeypatch):
    """Rows that are to be one meet by the range partitioning itself: a second exchange would undo the order of the ranks."""
    from skein.llm import ordering

    plans = []
    monkeypatch.setattr(ordering, "stage", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    rows = [(k % 7 if k % 5 else None, k % 3, k) for k in range(100)] * 2
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = ordering.ranked(df, [F.col("a").asc_nulls_first(), F.col("b"), F.col("c")], "r", distinct=["a", "b", "c"]).collect()
    assert plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    want = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.r)] == want and sorted(r.r for r in got) == list(range(len(want)))
