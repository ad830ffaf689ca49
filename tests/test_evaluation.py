"""Evaluation queries on hand-made rows, against plain Python and their SQL."""

import ast
import collections

import compare
import duckdb
import pytest
from conftest import ROOT
from lexispark import catalog

#: doc_id, lang, n_chars; and doc_id, quality, toxic. Some texts have no label, no length or no language, one label has no text.
DOCS = [(1, "en", 1500), (2, "en", 1001), (3, "en", 1000), (4, "en", 199), (5, "de", 5000), (6, "de", 200), (7, None, 1200), (8, "fr", None), (9, "es", 1300), (10, "fr", 800), (None, "de", 4000)]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, 1, 0), (6, 0, 0), (7, 0, None), (8, 1, 1), (10, None, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, "x", lang, "s", n) for i, lang, n in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def stored(spark, at, docs, labels):
    """The same two tables of other rows, in the folder ``at``."""
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def both(spark, at, name, key):
    """The rows of a query by ``key``, which are also those of its SQL."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    compare.same(spark, con, at, catalog.queries()[name], catalog.oracle_sql()[name])
    return {r[key]: tuple(r.asDict().values())[1:] for r in catalog.queries()[name](spark, at).collect()}


def brute(rows):
    """Counts and scores for each key of rows (key, truth, guess), where None is unknown."""
    cells = collections.defaultdict(collections.Counter)
    for k, t, g in rows:
        cells[k]["na" if t is None or g is None else ("t" if t == g else "f") + ("p" if g else "n")] += 1
    out = {}
    for k, c in cells.items():
        tp, fp, fn = c["tp"], c["fp"], c["fn"]
        p, r = (tp / (tp + x) if tp + x else 0.0 for x in (fp, fn))
        f1, f05 = (round((1 + b) * p * r / (b * p + r), 6) if p or r else None for b in (1, 0.25))
        out[k] = (tp, fp, fn, c["tn"], c["na"], round(p, 6), round(r, 6), f1, f05)
    return out


def joined():
    """lang, n_chars, truth, toxic of each text."""
    known = {i: (q if q is None else q == 1, t if t is None else t == 1) for i, q, t in LABELS}
    return [(lang, n, *known.get(i, (None, None))) for i, lang, n in DOCS]


def length_guess(n):
    # an unknown length is not below 200, and its comparison is unknown
    return None if n is None or n < 200 else n > 1000


def test_scores_of_languages(spark, odd):
    want = brute((lang, truth, length_guess(n)) for lang, n, truth, _ in joined())
    assert both(spark, odd, "j05_scores", "lang") == want
    assert want["en"] == (1, 1, 1, 0, 1, 0.5, 0.5, 0.5, 0.5)


def test_no_name_is_defined_twice():
    """A second function of one name replaces the first in all its callers."""
    for path in [*(ROOT / "lexispark").rglob("*.py"), *ROOT.glob("*.py")]:
        names = collections.Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
        assert not [n for n, k in names.items() if k > 1], path


def test_curve_over_thresholds(spark, odd):
    rows = []
    for t in range(0, 101, 10):
        for _, n, truth, _ in joined():
            good, bad = (None, None) if n is None else (n % 97 - 48, 48 - n % 89)
            apart = n is not None and abs(good - bad) >= t
            rows.append((t, truth, True if apart and good >= 0 > bad else False if apart and good <= 0 < bad else None))
    want = brute(rows)
    assert both(spark, odd, "j06_precision_recall_curve", "threshold") == want
    assert len(want) == 11 and want[0] != want[100]


def test_curve_rounds_halves_like_its_sql(spark, tmp_path):
    """323 of 640 is 0.5046875, whose millionfold is below the half as a double."""
    docs = [(i, "x", "en", "s", 60) for i in range(640)]
    at = stored(spark, tmp_path, docs, [(i, int(i < 323), 0) for i in range(640)])
    got = both(spark, at, "j06_precision_recall_curve", "threshold")
    assert got[0] == got[20] == (323, 317, 0, 0, 0, 0.504687, 1.0, 0.67082, 0.56018)
    assert got[30] == (0, 0, 0, 0, 640, 0.0, 0.0, None, None)


def test_scores_of_variations(spark, odd):
    rows = []
    for lang, n, truth, toxic in joined():
        guess = length_guess(n)
        english = None if lang is None else lang == "en"
        rows += [("length", truth, guess), ("lang", truth, english), ("toxic", truth, toxic), ("toxic_by_length", toxic, guess), ("self", truth, truth)]
    want = brute(rows)
    assert both(spark, odd, "j07_all_variations", "variation") == want
    assert want["self"][5:] == (1.0,) * 4


def test_variations_of_texts_with_several_labels(spark, tmp_path):
    """The SQL joins labels twice for the toxic variations, so k labels of a text count k * k times there."""
    docs = [(1, "en", 1500), (2, "en", 1200), (2, "en", 1200), (3, "de", 900), (4, "fr", 100), (5, None, None), (None, "en", 2000)]
    labels = [(1, 1, 0), (1, 0, 1), (1, 0, 1), (2, 1, 1), (2, 1, 1), (2, None, 1), (2, 0, None), (3, 0, 0), (5, 1, 0), (5, 1, 1), (None, 1, 1), (None, 0, 0)]
    at = stored(spark, tmp_path, [(i, "x", lang, "s", n) for i, lang, n in docs], labels)
    known = collections.defaultdict(list)
    for i, q, t in labels:
        if i is not None:
            known[i].append((q if q is None else q == 1, t if t is None else t == 1))
    rows = []
    for i, lang, n in docs:
        guess, english, mine = length_guess(n), None if lang is None else lang == "en", known.get(i, [(None, None)])
        for truth, _ in mine:
            rows += [("length", truth, guess), ("lang", truth, english), ("self", truth, truth)]
            rows += [r for _, toxic in mine for r in (("toxic", truth, toxic), ("toxic_by_length", toxic, guess))]
    want = brute(rows)
    assert both(spark, at, "j07_all_variations", "variation") == want
    assert sum(want["length"][:5]) == 16 and sum(want["toxic"][:5]) == 48


def test_variations_round_halves_like_their_sql(spark, tmp_path):
    at = stored(spark, tmp_path, [(i, "x", "en", "s", 1500) for i in range(640)], [(i, int(i < 323), int(i < 41)) for i in range(640)])
    got = both(spark, at, "j07_all_variations", "variation")
    assert (got["length"][5], got["toxic_by_length"][5]) == (0.504687, 0.064062)
