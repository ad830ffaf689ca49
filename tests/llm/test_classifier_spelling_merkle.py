"""Quality classifier, spelling variants and Merkle manifest against brute force, on odd rows and on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lexispark.llm")
import compare  # noqa: E402
from lexispark.llm import _text, classifier, merkle, quality, queries, spelling  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"Word{i % 700} the" for i in range(60_000))
ODD = [None, "", " ", "a", "ÀÉ ñ  b\t\n c", "日本 语", "x\n\ny\n", LONG, "Twice here", "Twice here"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, block long, word string, n long, x binary, held_out int, item string"
DATA = "doc_id, source, lang, n_chars, text".split(", ")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i, None if i % 4 == 0 else f"s{i % 3}", "e", i or None, t) for i, t in enumerate(ODD)]
    rows = [*rows, rows[5], rows[3], (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "g", 1, "w", 2, b"x", 3, "i") for r in rows], SCHEMA)


def table(rows):
    return sorted(map(str, rows))


# 13 Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    """The root, and for each leaf its siblings (left, right) by level."""
    paths, place, at = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(at) > 1:
        for path, k in zip(paths, place, strict=True):
            run = at[k // 16 * 16 :][:16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at, place = [digest("".join(at[i : i + 16])) for i in range(0, len(at), 16)], [k // 16 for k in place]
    return at[0], paths


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((leaf_of(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {s: tree_of([x[0] for x in by[s]]) for s in order}
    if not order:
        return []
    root, above = tree_of([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for (own, r), path in zip(by[s], trees[s][1], strict=True):
            x, path = own, path + up
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                x = leaf_of((*r[:4], r[4].translate(LOWER)))
            for left, right in path:
                x = digest(left + x + right)
            out.append((r[0], own, trees[s][0], root, digest("".join(a + b for a, b in path)), x, x == root))
    return out


def check_manifest(df):
    want = brute_manifest([tuple(r) for r in df.select(*DATA).collect()])
    assert table(map(tuple, merkle.manifest(df).collect())) == table(want)
    return want


def test_manifest(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verified = [r[-1] for r in check_manifest(docs)]
    assert True in verified and False in verified
    check_manifest(odd)
    check_manifest(odd.where("false"))
    check_manifest(spark.createDataFrame([(7, "one", None, None, "A")], odd.schema[:5]))


@pytest.mark.parametrize("n", [16, 17, 256, 257, 4096 + 1, 256 * 17 + 40])
def test_trees_of_any_size(spark, n):
    check_manifest(spark.createDataFrame([(i if i % 97 else None, "hot" if i else None, "e", 3, f"Ab{i}") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string"))


def test_many_rounds_and_short_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "STRIPE", 3)
    for n in (16 * 257, 16 * (256 * 3 + 17) - 5):
        check_manifest(spark.createDataFrame([(i, "x", None, None, "") for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string"))
    check_manifest(spark.createDataFrame([(i, f"s{i % 400}", None, None, None) for i in range(900)], "doc_id long, source string, lang string, n_chars long, text string"))


# 12 spelling variants


def brute_words(rows):
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_groups(rows):
    n = brute_words(rows)
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        found = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in (*letters, "")} - {w}
        found = [x for x in found if x in n]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w], near[w] = (best if best and n[best] >= 2 * n[w] else None), len(found)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out


def check_groups(df):
    want = brute_groups([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert table(map(tuple, spelling.groups(df).collect())) == table(want)
    return want


def test_groups(spark, sf, odd):
    assert sum(r[1] is not None for r in check_groups(spark.read.parquet(f"{sf}/documents.parquet"))) > 100
    check_groups(odd)
    check_groups(odd.where("false"))


def test_chains_ties_and_letters(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb", "ccbbbbbb"]
    rows = [(i, f"{w} " * (3 * 2**i)) for i, w in enumerate(chain)]
    rows += [(50, "Straße straßex strasse ÀÉÎÕÜ àÉÎÕÜ " * 4), (None, "tiesa " * 9 + "tiesb " * 9 + "ties " * 50 + "tiesc " * 3), (51, "zzzzz" * 4000 + " " + ("zzzzz" * 4000 + "y ") * 9), (52, "zzzzz" * 4000), (53, "zzzzz" * 4000)]
    got = {r[0]: r for r in check_groups(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got["aaaaa"][2] == "bbbbbb" and got["tiesc"][1] == "tiesa"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcß", min_size=1, max_size=6), min_size=1, max_size=8))
def test_neighbours_hold_every_edit(ws):
    for w in ws:
        flat, at = spelling._symbols(pa.array([w]))
        have = set(spelling.neighbours(flat[None, :])[0].tolist())
        some = {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in "abcßz"} - {""}
        for x in some:
            assert spelling.reduced(spelling._symbols(pa.array([x]))[0][None, :])[0] in have


def test_generated_rows_are_not_broadcast(spark):
    words = _text.stored(spelling.with_reduced(spark.createDataFrame([(w, 3) for w in ("abcde", "abcdx", "other")], "word string, n long")), "words")
    near = spelling.near_words(words)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    joins = [x.strip(" :+-") for x in plan.splitlines() if "Join [" in x]
    assert [j.split()[0] for j in joins] == ["SortMergeJoin", "BroadcastHashJoin"] and "BuildRight" in joins[1]  # the second is the filter of fixed size
    whole = spelling.groups(spark.createDataFrame([(1, "abcde " * 9 + "abcdx " * 3)], "doc_id long, text string"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in whole and "BroadcastHashJoin" not in whole
    assert sorted((r["word"], r["near"]) for r in near.collect()) == [("abcde", "abcdx"), ("abcdx", "abcde")]


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_merkle_manifest"])
def test_equal_to_sql(spark, sf, name):
    compare.same(spark, compare.duck(sf), sf, queries.queries()[name], queries.oracle_sql()[name])


# 11 quality classifier


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    pieces = text.split("\n")
    lines = pieces[:-1] if text.endswith("\n") or not text else pieces  # what a line end closes, and the rest
    full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    stop = {f for w in quality.STOP_WORDS for f in (w, w.capitalize())}
    share = lambda a, b: a / max(b, 1)
    own = {k: share(sum(c in v.decode() for c in text), len(text)) for k, v in classifier._KINDS.items()}
    letters = sum(c not in " \t\v\f\r\n" for c in text)
    own |= {
        "size": np.log1p(len(words)) / 20, "word_length": share(letters, len(words)) / 40, "line_words": np.log1p(share(len(words), len(full))) / 12,
        "distinct_words": share(len(set(words)), len(words)), "same_word_next": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "distinct_windows": share(len(set(windows)), len(windows)), "stop_words": share(sum(w in stop for w in words), len(words)),
        "distinct_lines": share(len(set(full)), len(full)), "wordless_lines": share(len(lines) - len(full), len(lines)),
    }
    return [min(1.0, max(0.0, own[k])) for k in classifier.STATISTICS]


TEXTS = st.text(st.sampled_from("aB é日|!.\n\n \t#the"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXTS | TEXTS.map(lambda t: f"{t}\n{t} the the {t}"), min_size=0, max_size=6))
def test_statistics(texts):
    got = classifier.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(classifier.STATISTICS))
    assert np.allclose(got, np.array([brute_statistics(t) for t in texts]).reshape(got.shape))


def brute_trees(cells, y, edges, start, trees):
    """Nested trees grown row by row, and the raw scores of all rows."""
    bins, raw, out = [[int(edges[c, j]) for j, c in enumerate(r)] for r in cells], [start] * len(y), []
    unit = lambda v: round(v * classifier.ONE)

    def grow(rows, g, h, depth, value):
        best = None
        if depth < classifier.DEPTH:
            total = sum(g[i] for i in rows) / classifier.ONE, sum(h[i] for i in rows) / classifier.ONE
            for f in range(len(classifier.STATISTICS)):
                for b in range(classifier.BINS - 1):
                    low = [i for i in rows if bins[i][f] <= b]
                    lg, lh = sum(g[i] for i in low) / classifier.ONE, sum(h[i] for i in low) / classifier.ONE
                    if lh < classifier.MIN_HESSIAN or total[1] - lh < classifier.MIN_HESSIAN:
                        continue
                    gain = lg**2 / (lh + classifier.PENALTY) + (total[0] - lg) ** 2 / (total[1] - lh + classifier.PENALTY) - total[0] ** 2 / (total[1] + classifier.PENALTY)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, f, b
        if not best:
            return value
        _, f, b = best
        parts = [i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]
        values = [classifier.RATE * (sum(g[i] for i in p) / classifier.ONE) / (sum(h[i] for i in p) / classifier.ONE + classifier.PENALTY) for p in parts]
        return (f, b, *[grow(p, g, h, depth + 1, v) for p, v in zip(parts, values, strict=True)])

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(trees):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        tree = grow(range(len(y)), [unit(b - a) for a, b in zip(p, y, strict=True)], [unit(a * (1 - a)) for a in p], 0, 0.0)
        out.append(tree)
        raw = [r + walk(tree, b) for r, b in zip(raw, bins, strict=True)]
    return out, raw


def test_trees_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    cells = rng.integers(0, classifier.CELLS, (150, len(classifier.STATISTICS)))
    cells[:, 2], cells[:, 3] = 0, cells[:, 4]
    y = ((cells[:, 0] + cells[:, 1] > 1000) | (cells[:, 5] < 200)).astype(float)
    rows = spark.createDataFrame([(c.astype("<u2").tobytes(), float(v)) for c, v in zip(cells, y)], "x binary, y double").repartition(3).persist()
    model = classifier.train(rows, trees=3)
    counts = np.stack([np.bincount(cells[:, j], minlength=classifier.CELLS) for j in range(cells.shape[1])], axis=1)
    assert (classifier.grid(rows) == counts).all()
    _, raw = brute_trees(cells.tolist(), y.tolist(), classifier.bins_of(counts), model.start, 3)
    assert np.allclose(model.raw(model.binned(cells)), raw)
    again = classifier.train(rows.repartition(1), trees=3)
    assert all(np.array_equal(a, b) for a, b in zip(model, again))
    assert ((raw > np.zeros(len(y))) == (y == 1)).mean() > 0.9


def test_bins_hold_equal_shares():
    counts = np.zeros((classifier.CELLS, 3), np.int64)
    counts[:, 0], counts[5, 1], counts[[1, 900], 2] = 7, 100, 50
    edges = classifier.bins_of(counts)
    assert (np.bincount(edges[:, 0], minlength=classifier.BINS) == classifier.CELLS // classifier.BINS).all()
    assert (np.diff(edges.astype(int), axis=0) >= 0).all() and edges[1, 2] < edges[900, 2]


def test_held_out_rows_are_judged_right(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op11_quality_classifier(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i]["predicted"], q) for i, q in labels.items() if i in got and got[i]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (7, None), (None, 1), (8, 1), (9, 1)], "doc_id long, quality int")
    for df, some in ((odd, labels), (odd.where("false"), labels), (odd, labels.where("false"))):
        rows = classifier.classify(df, some).collect()
        assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
        if some is not labels:
            assert {r["score"] for r in rows} == {0.5}
    known = {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}
    rows = classifier.classify(odd, labels).collect()
    assert len({r["score"] for r in rows if r["doc_id"] in (8, 9)}) == 1 and len(known) < len(rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)


def test_held_out_labels_are_not_learned(spark):
    docs = [(i, ("GOOD words here " if i % 2 else "bad || bad || ") * 9) for i in range(80)]
    flip = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = classifier.classify(df, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")).collect()
    two = classifier.classify(df, spark.createDataFrame([(i, (i + flip(i)) % 2) for i, _ in docs], "doc_id long, quality int")).collect()
    assert sorted(one) == sorted(two) and all(r["predicted"] == r["doc_id"] % 2 for r in one)
