"""The ten operators against brute force, round trips and planted cases, on odd rows and on the smallest tables."""

import collections
import hashlib
import itertools
import math
import re
import statistics
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lexispark.llm")
tokenizers = pytest.importorskip("public_tokenizers")
import compare  # noqa: E402
from lexispark.llm import _shingles, chat, linededup, neardup, packing, pii, quality, queries, spiece, spotsigs, tokenbin, urlfilter  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

BYTE, WORD, PIECE = (tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"w{i} the" for i in range(3000))
BASE = " ".join(f"tok{i}" for i in range(120))
TEXTS = [None, "", " ", "a", "one two", BASE, BASE, BASE.replace("tok60", "other"), LONG, "x\n\ny", "ÀÉ ñ  b\t\n c", "日本 语 <|endoftext|> z", "don't  stop's", "mail a.b@c.de now +49 (30) 1234-567"]
SCHEMA = "doc_id long, text string, d long, h string, node string, _row int, words int, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, 7, "x", "y", 1, 2, len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (5, "one two", 7, "x", "y", 1, 2, 7)], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def ids_of(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# 1 quality rules


def brute_quality(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, odd, docs):
    repeats = spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h i j"), (2, "the " * 50), (3, "l\nl\n\nm\nl")], "doc_id long, text string")
    for df in (odd, docs, repeats):
        got = quality.judge(df).collect()
        want = [(i, *brute_quality(t)) for i, t in rows_of(df)]
        key = lambda r: tuple(map(str, r))
        assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=key) == sorted(want, key=key)


def test_quality_keeps_clean_documents(spark, docs, sf):
    judged = quality.judge(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() <= 0.01 * judged.where("quality = 1").count()
    assert judged.where("quality = 0 and kept").count() <= 0.1 * max(10, judged.where("quality = 0").count())


def test_quality_filter_keeps_columns(odd, none):
    assert quality.filter_documents(odd).columns == odd.columns
    assert quality.filter_documents(none).count() == 0 and quality.judge(none).count() == 0


def test_quality_plan_is_native(odd):
    assert "Python" not in quality.judge(odd)._jdf.queryExecution().toString()


# 2 packing


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_length_once(counts):
    patterns = packing.plan(counts, 64)
    used = collections.Counter()
    for p, times in patterns:
        assert sum(p) <= 64 and times > 0
        for x in p:
            used[x] += times
    assert used == collections.Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert -(-total // 64) <= sum(t for _, t in patterns) <= max(1, 2 * total // 64 + 1)
    assert sum(t for _, t in patterns) <= sum(t for _, t in packing.best_fit(counts, 64))
    exact = packing.exact_fillings(counts, 64)
    assert all(sum(p) == 64 and t > 0 for p, t in exact)
    left = collections.Counter(counts)
    for p, t in exact:
        left.subtract({x: n * t for x, n in collections.Counter(p).items()})
    assert min(left.values(), default=0) >= 0
    open_ = [x for x in left.elements()]
    assert not any(sum(c) == 64 for k in (1, 2) for c in itertools.combinations(open_, k))


@pytest.mark.parametrize("counts, best", [({600: 2, 424: 2}, 2), ({600: 3, 300: 3, 124: 3}, 3), ({512: 4, 256: 2, 128: 4}, 3), ({1024: 5}, 5), ({400: 1, 300: 1, 200: 1, 124: 1}, 1)])
def test_exact_fillings_are_found(counts, best):
    assert sum(t for _, t in packing.plan(counts)) == best


def test_plan_of_documents_is_near_the_bound(docs):
    counts = {r["length"]: r["count"] for r in packing.pieces(docs, BYTE).groupBy("length").count().collect()}
    patterns, bound = packing.plan(counts), -(-sum(k * v for k, v in counts.items()) // 1024)
    assert sum(t for _, t in patterns) <= bound + 1
    assert {len(p) for p, _ in patterns if sum(p) == 1024} >= {1, 2, 3}


def test_packing(odd, docs, none):
    encode = ids_of(BYTE)
    for df in (odd, docs.limit(60)):
        got = packing.pack(df, BYTE).collect()
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in by_seq.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 1024
        want = collections.Counter()
        for i, t in rows_of(df):
            ids = [*encode(t), 2]
            first = len(ids) % 1024 or min(1024, len(ids))
            starts = [0, *range(first, len(ids), 1024)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                want[i, k, a, b - a, crc(ids[a:b])] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(none, BYTE).count() == 0


# 3 personal data


def brute_pii(t):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


@given(st.text("a@.b-_%+019 5(", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE] == brute_pii(text)


def test_pii_rows(odd, docs, none):
    for df in (odd, docs):
        got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_card"]) for r in pii.detect(df).collect())
        want = []
        for i, t in rows_of(df):
            s = brute_pii(t)
            want.append((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(), sum(k == "email" for k, *_ in s), sum(k == "card" for k, *_ in s)))
        assert got == sorted(want)
    assert pii.detect(none).count() == 0


def test_added_kinds_and_context():
    assert [s.kind for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert not pii.find("IBAN DE89 3704 0044 0532 0130 01 ok")
    assert [s.kind for s in pii.find("ssn 123-45-6789")] == ["id"] and not pii.find("part 123-45-6789")
    a, b = (pii.find(f"{w} 10.1.2.3")[0].score for w in ("server", "version"))
    assert a > b


def test_masking(odd, none):
    out = {r["text"] for r in pii.masked(odd).collect()}
    assert "mail [EMAIL] now [PHONE]" in out and BASE in out and None in out
    assert pii.masked(odd).columns == odd.columns and pii.masked(odd).count() == odd.count() and pii.masked(none).count() == 0


# 4 token files


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_block_round_trip(lists):
    ids = np.array([x for y in lists for x in y], "<u4")
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    block = tokenbin.Block(tokenbin.encode_block(np.arange(len(lists)), starts, ids))
    assert [i.tolist() for _, _, i in block.documents()] == lists
    assert [block[i] for i in range(len(ids))] == ids.tolist()


def test_random_access_far_into_a_block():
    ids = np.random.default_rng(1).integers(0, 70_000, 20_000).astype("<u4")
    block = tokenbin.Block(tokenbin.encode_block(np.arange(1), np.zeros(1, int), ids))
    for i in (0, 511, 512, 4095, 4096, 9_999, 19_999):
        assert block[i] == ids[i]
    assert (block.range(3_333, 17_001) == ids[3_333:17_001]).all()


def test_token_files(odd, docs, none):
    encode = ids_of(WORD)
    for df in (odd, docs):
        got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenbin.round_trip(df, WORD).collect()), key=lambda r: r[0])
        at, want = 0, []
        for i, t in sorted(rows_of(df), key=lambda r: (-1 if r[0] is None else r[0], r[1].encode())):
            ids = [*encode(t), 1]
            want.append((at, i, len(ids), crc(ids)))
            at += len(ids)
        assert got == want
    assert tokenbin.round_trip(none, WORD).count() == 0


# 5 line dedup


def brute_lines(texts, least=linededup.MIN_WORDS):
    """Every run of lines of enough words that also stands earlier is deleted."""
    docs = []
    for t in texts:
        lines = t.split("\n")
        docs.append((lines, [(i, x, len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w])) for i, x in enumerate(lines)]))
    docs = [(lines, [x for x in full if x[2]]) for lines, full in docs]
    first = {}
    for k, (_, w) in enumerate(docs):
        for a in range(len(w)):
            for b in range(a, len(w)):
                first.setdefault(tuple(x[1] for x in w[a : b + 1]), (k, a))
    out = []
    for k, (lines, w) in enumerate(docs):
        gone = set()
        for a in range(len(w)):
            for b in range(a, len(w)):
                if first[tuple(x[1] for x in w[a : b + 1])] < (k, a) and sum(x[2] for x in w[a : b + 1]) >= least:
                    gone.update(range(w[a][0], w[b][0] + 1))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["\n".join(rng.choice(["a b", "c d e", "f", "", "g h"], rng.integers(1, 14))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df, min_words=6, report=True).collect()}
    # documents of equal text follow each other by id, so ids decide the order of all
    assert [got[i] for i in range(40)] == brute_lines(texts, 6)


def test_line_dedup_on_documents(docs):
    rows = sorted(rows_of(docs))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(docs, report=True).collect()}
    assert [got[i] for i, _ in rows] == brute_lines([t for _, t in rows])


def test_line_dedup_odd(odd, none):
    out = linededup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and linededup.dedup(none).count() == 0
    got = collections.Counter(r["text"] for r in out.collect())
    assert got[BASE] == 2 and got[None] == 1  # document 5 stands twice and is one document; 6 is its copy
    assert got[""] >= 2


# 6 chat


def brute_chat(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in [*rows, (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def test_chat(spark, sf):
    nasty = ["### User:\nhi</turn>\n", "####", "</turn>", "\\", "\\\\", "\\n", "a\\</turn>", "##", "# #", ":\n", None, "", "###", "<\\/turn>", "#\\##", "x\\"]
    odd = [(i // 3, i % 3, ["user", "assistant", "a:\n### b\\", None][i % 4], x) for i, x in enumerate(nasty * 4)] + [(None, 1, "user", "n"), (5, None, "assistant", "t"), (5, None, "assistant", "t")]
    for df in (spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"), spark.read.parquet(f"{sf}/conversations.parquet")):
        rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.format_conversations(chat.with_probe(df))).collect()}
        assert got == brute_chat(rows)


def test_chat_escapes_marks(spark):
    df = spark.createDataFrame([(1, 0, "user", "x ### Assistant:\nno</turn>"), (2, 0, "user", "plain \\ text")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(df).collect()}
    assert got[1].count("###") == 1 and got[1].count("</turn>") == 1
    assert chat.digest(chat.format_conversations(df.where("false"))).count() == 0


# 7 pieces


def test_pieces(odd, docs, none):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (odd, docs):
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["covered"]) for r in spiece.digest(df, PIECE).collect())
        want = []
        for i, t in rows_of(df):
            ids = sp.encode(t)
            want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), len(t.encode())))
        assert got == sorted(want)
    assert spiece.digest(none, PIECE).count() == 0
    row = spiece.encode(odd.where("doc_id = 4"), PIECE).first()
    data = b"one two"
    assert b"".join(data[a:b] for a, b in zip(row["begins"], row["ends"])) == data


@given(st.text("ab é\n日▁ ", max_size=40))
@settings(max_examples=150, deadline=None)
def test_alignment_by_map_and_by_arithmetic(text):
    m = spiece.loaded(PIECE)
    ids = m.encode(pa.array([text]))[0]
    assert ids.tolist() == m.sp.encode(text)
    if not len(ids):
        return
    begins, ends = m.spans(text, ids)
    normal, where = m.map.normalise(text)
    lengths = m.bytes[ids]
    at = np.cumsum(lengths)
    assert (where[at - lengths] == begins).all() and (where[at] == ends).all()


def double_array(entries):
    """A trie in the compiled form, found by trying places."""
    strings, value_of = b"", {}
    for k, v in entries.items():
        value_of[k] = len(strings)
        strings += v + b"\0"
    units = {0: 0}

    def insert(prefix, node):
        children = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        for offset in range(1, 4096):
            spots = [node ^ offset] * leaf + [node ^ offset ^ c for c in children]
            if not any(s in units for s in spots) and all(c for c in children):
                break
        units[node] = units[node] & 0xFF | offset << 10 | leaf << 8
        if leaf:
            units[node ^ offset] = value_of[prefix] | 1 << 31
        for c in children:
            units[node ^ offset ^ c] = c
        for c in children:
            insert(prefix + bytes([c]), node ^ offset ^ c)

    insert(b"", 0)
    blob = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(max(units) + 257))
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_of_a_compiled_map():
    m = spiece.CharMap(double_array({b"a": b"x", b"ab": b"yy", b"abc": b"", "é".encode(): b"e"}))
    assert m.longest(b"abd", 0) == (2, b"yy") and m.longest(b"abc", 0) == (3, b"") and m.longest(b"zz", 0) is None
    normal, where = m.normalise("é abd", dummy_prefix=False)
    assert normal.decode() == "e▁yyd" and where.tolist() == [0, 2, 2, 2, 3, 3, 5, 6]


# 8 URLs


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_urls(spark, sf):
    urls = [None, "", "no scheme", "http://", "http://NET/x", "http://a.net", "http://a.net/", "x://b.example.net/en/1?q", "http://example.net/en", "http://example.com/de/#f", "http://o.org/fr/", "http://xorg/fr/", "http://ÄB.org/fr/z", "a\nb://c.org/fr/", "http://q://r.net/"]
    odd = spark.createDataFrame(list(enumerate([*urls, urls[4]])), "page_id long, url string")
    for df in (odd, spark.read.parquet(f"{sf}/pages.parquet")):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()}
        assert len(got) == df.count()
        for r in df.collect():
            host, path, rule = brute_rule(r["url"])
            assert got[r["page_id"]][:3] == (host, path, rule.name if rule else None)
            if rule or not host:
                assert got[r["page_id"]][3] == ("block" if rule and not rule.allow else "allow")
    assert urlfilter.judge(odd.where("false")).count() == 0


def test_url_model_tells_classes_apart(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i}.example.{'org/fr' if i % 2 else 'net'}/{'read' if i % 2 else 'cheap-pills'}-{i}") for i in range(200)]
    new = [(1000 + i, f"http://site{i}.example.com/{'read' if i % 2 else 'cheap-pills'}-{i}") for i in range(40)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows + new, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(40)) >= 36


def brute_url_model(rows):
    """Counts of (class, context, next character) and of (class, context), of rows (folded, good)."""
    after, seen = {}, {}
    for folded, good in rows:
        for i, c in enumerate(folded):
            before = ("^^^" + folded)[: i + 3]
            for k in range(4):
                x = before[len(before) - k :]
                after[good, x, c] = after.get((good, x, c), 0) + 1
                seen[good, x] = seen.get((good, x), 0) + 1
    return after, seen


def brute_url_ratio(model, folded):
    after, seen = model
    total = 0.0
    for i, c in enumerate(folded):
        before, p = ("^^^" + folded)[: i + 3], {True: 1 / 40, False: 1 / 40}
        for k in range(4):
            x = before[len(before) - k :]
            if (True, x) in seen or (False, x) in seen:
                p = {g: (after.get((g, x, c), 0) + 4 * p[g]) / (seen.get((g, x), 0) + 4) for g in p}
        total += math.log(p[True]) - math.log(p[False])
    return total / len(folded)


def test_url_model_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.lit("x").alias("folded"), F.lit(1).alias("ratio"))
    long = spark.createDataFrame([(-1, "http://a.net/" + "ab/" * 20_000), (-2, "http://free.de/" + "cd-" * 20_000)], "page_id long, url string")
    pages = pages.unionByName(long.selectExpr("*", "'x' folded", "1 ratio"))
    rows = pages.select("page_id", "url", urlfilter.fold(F.coalesce("url", F.lit(""))).alias("f")).withColumn("half", F.pmod(F.xxhash64("f"), F.lit(2))).collect()
    rule = {r["page_id"]: brute_rule(r["url"])[2] for r in rows}
    ruled = [(r["f"], rule[r["page_id"]].allow, r["half"]) for r in rows if rule[r["page_id"]]]
    halves = [brute_url_model([(f, g) for f, g, h in ruled if h != k]) for k in (0, 1)]
    cached = {f: brute_url_ratio(halves[h], f) for f, _, h in ruled}
    of = {g: [cached[f] for f, good, _ in ruled if good == g] for g in (True, False)}
    mean, dev = ({g: fn(of[g]) for g in of} for fn in (statistics.fmean, statistics.pstdev))
    cut = (mean[True] * (dev[False] + 1e-9) + mean[False] * (dev[True] + 1e-9)) / (dev[True] + dev[False] + 2e-9)
    model = brute_url_model([(f, g) for f, g, _ in ruled])
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert len(got) == len(rows) and min(map(len, of.values())) > 5
    for r in rows:
        mine = got[r["page_id"]]
        assert mine["cut"] == pytest.approx(cut, abs=1e-9)
        if r["f"]:
            ratio = brute_url_ratio(model, r["f"])
            assert mine["ratio"] == pytest.approx(ratio, abs=1e-9)
            if not rule[r["page_id"]] and abs(ratio - cut) > 1e-9:
                assert mine["verdict"] == ("allow" if ratio >= cut else "block")


def test_url_model_keeps_rare_contexts_of_large_tables(spark):
    few = spark.createDataFrame([("qzj.net/de", False), ("example.net/en/common", True)], "folded string, good boolean")
    many = few.unionByName(spark.range(3000).select(F.lit("example.net/en/common").alias("folded"), F.lit(True).alias("good")))
    small, large = ({(r["length"], r["context"]): r["bad_c"] for r in urlfilter.train(df).collect()} for df in (few, many))
    assert small == large and large[3, "qzj"] == 1


def test_urls_without_a_host_are_judged(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i}.example.{'org/fr' if i % 2 else 'net'}/{'read' if i % 2 else 'cheap-pills'}-{i}") for i in range(200)]
    new = [(1000, "file:///cheap-pills-7"), (1001, "file:///read-7"), (1002, "cheap-pills-7"), (1003, "file://"), (1004, None)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows + new, "page_id long, url string")).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1004)] == ["block", "allow", "block", "allow"]


# 9 fingerprints


def brute_signatures(text):
    w = re.sub(r"[^\w\x20\x09-\x0D]|_", "", text).lower()
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    stop = set(quality.STOP_WORDS)
    out = set()
    for i, x in enumerate(w):
        if x in stop:
            chain = [y for y in w[i:] if y not in stop][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return out or {text}


def test_fingerprints(docs, none):
    order = sorted(rows_of(docs), reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(docs).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r, a, b, c = got[i], brute_signatures(t), brute_signatures(edited), brute_signatures(following)
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_signatures"] == len(a)
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
    assert spotsigs.compare_edited(none).count() == 0


def test_fingerprints_odd(odd):
    got = spotsigs.compare_edited(odd).collect()
    count = collections.Counter
    assert count((r["doc_id"], r["n_chars"]) for r in got) == count((r["doc_id"], len(r["text"] or "")) for r in odd.collect())
    same = {r["fingerprint"] for r in got if r["doc_id"] in (6,)} | {r["fingerprint"] for r in got if r["doc_id"] == 5 and r["n_chars"] == len(BASE)}
    assert len(same) == 1


def test_near_pairs_by_signatures(docs):
    sigs = {}
    for i, t in rows_of(docs):
        s = frozenset(brute_signatures(t))
        sigs[s] = min(i, sigs.get(s, i))
    want = {tuple(sorted((sigs[a], sigs[b]))) for a in sigs for b in sigs if sigs[a] < sigs[b] and len(a & b) >= 0.8 * len(a | b) - 1e-12}
    assert {tuple(sorted((r["a"], r["b"]))) for r in spotsigs.near_pairs(docs).collect()} == want


def test_near_pairs_of_null_ids(spark):
    text = " ".join(f"the w{i} v{i}" for i in range(60))
    rows = [(None, text), (None, text + " the other end"), (7, "the first " + text), (8, "unlike the rest of them")]
    got = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x or 0 for x in sorted((r["a"], r["b"]), key=lambda x: x or 0)) for r in got) == [(0, 0), (0, 7), (0, 7)]


# 10 near-duplicates


def labelled(text):
    """Five-word shingles with the number of their occurrence, by plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen = collections.Counter()
    out = []
    for r in runs:
        seen[r] += 1
        out.append((r, seen[r]))
    return out


def lcs(a, b):
    """Length of the longest common subsequence, by bits of long integers."""
    at, mask = collections.defaultdict(int), (1 << len(a)) - 1
    for i, x in enumerate(a):
        at[x] |= 1 << i
    v = mask
    for y in b:
        u = v & at[y]
        v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def brute_links(texts):
    s = [labelled(t) for t in texts]
    where = collections.defaultdict(list)
    for i, x in enumerate(s):
        for v in x:
            where[v].append(i)
    pairs = collections.Counter((a, b) for v in where.values() for i, b in enumerate(v) for a in v[:i])
    enough = lambda m, a, b: m >= 0.8 * (len(s[a]) + len(s[b]) - m) - 1e-9
    return [(a, b) for (a, b), n in pairs.items() if enough(n, a, b) and enough(lcs(s[a], s[b]), a, b)]


def brute_classes(rows):
    texts = [t for _, t in rows]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = brute_links(texts)
    by_text = {}
    linked += [(by_text.setdefault(t, i), i) for i, t in enumerate(texts)]
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = collections.defaultdict(set)
    for i in range(len(texts)):
        out[find(i)].add(rows[i][0])
    return {frozenset(x) for x in out.values()}


def found_classes(df):
    got = collections.defaultdict(set)
    for r in neardup.classes(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    return {frozenset(x) for x in got.values()}


def edited(base, rng, n, tag):
    w = list(base)
    for at in rng.integers(0, len(w), n):
        w[at] = f"{tag}x{at}"
    return w


def test_near_duplicates_without_a_common_centre(spark):
    """Chains of versions, two groups that share a passage, moved halves, pairs whose edits meet, all in the same buckets."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts, w = [], list(base)
    for i in range(25):  # each version edits the one before
        w = edited(w, rng, 2, f"v{i}")
        texts.append(w)
    other = [f"o{i}" for i in range(100)] + base[:50]
    texts += [edited(other, rng, k % 4, f"p{k}") for k in range(12)]
    texts += [base[75:] + base[:75], base[76:] + base[:76]]
    for k in range(12):  # far from the base, but near to one another in pairs
        far = edited(base, rng, 6, f"f{k}")
        texts += [far, edited(far, rng, 1, f"g{k}")]
    texts += [base[:i] + [f"h{i}{k}"] + base[i + 1 :] for i in range(20, 30) for k in "ab"]
    data = list(enumerate(" ".join(t) for t in texts))
    assert found_classes(spark.createDataFrame(data, "doc_id long, text string")) == brute_classes(data)


def test_recall_of_sketches(docs):
    """Share of the true links, by brute force, that have a sketch in common."""
    texts = sorted({t for _, t in rows_of(docs)})
    linked = brute_links(texts)
    sketches = neardup.sketch(pa.array(texts))[1]
    assert linked and all((sketches[a] == sketches[b]).any() for a, b in linked)


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):  # a group around one text, at all distances
        w = list(base)
        for at in rng.integers(0, 150, i // 6):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    for data in (rows, sorted(rows_of(docs))):
        df = spark.createDataFrame(data, "doc_id long, text string")
        assert found_classes(df) == brute_classes(data)


def test_near_duplicates_odd(odd, none):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count() and neardup.classes(none).count() == 0
    of = {(r["doc_id"], r["class_rows"]): r["class_id"] for r in got}
    assert of[7, 4] == of[6, 4] == of[5, 4] == 5
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns and kept.where(F.col("text") == BASE).count() == 1 and kept.where("text is null").count() == 1
    assert neardup.keep_first(none).count() == 0


def test_links_behind_a_centre_that_is_too_long(spark):
    def three(seed):
        w = [f"s{seed}w{i}" for i in range(160)]
        return [" ".join(x) for x in (w + [f"s{seed}x{i}" for i in range(50)], w, [*w[:80], f"s{seed}y", *w[81:]])]

    def met(texts):  # A is in a bucket of B and C
        a, b, c = neardup.sketch(pa.array(texts))[1]
        return np.any((a == b) & (b == c))

    texts = next(t for t in map(three, range(200)) if met(t))
    n = neardup.sketch(pa.array(texts))[0]
    assert n[1] < neardup.SIMILARITY * n[0] and n[2] < neardup.SIMILARITY * n[0]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["class_rows"]) for r in got} == {0: (0, 1), 1: (1, 2), 2: (1, 2)}
    assert {r["doc_id"]: r["n_links"] for r in got} == {0: 0, 1: 1, 2: 1}


@given(st.lists(st.integers(0, 9), max_size=14), st.lists(st.integers(0, 9), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_the_longest_common_subsequence(a, b):
    a, b = (np.array(list(dict.fromkeys(x)), np.uint64) for x in (a, b))
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    m = best[-1, -1]
    like = m / (len(a) + len(b) - m) if m else 0.0
    assert neardup.matched(a, b, np.argsort(b), 0.5) == (pytest.approx(like) if like >= 0.5 else 0.0)


def test_shingles_are_of_five_words():
    s, at = _shingles.shingles(pa.array(["a b c d e f", " a\tb c  d e\n", "a b c d e f", "", "a b", "x x x x x x"]))
    assert np.diff(at).tolist() == [2, 1, 2, 0, 1, 2] and s[0] == s[2] and len(set(s[at[5] : at[6]].tolist())) == 2


# all


def test_registered(spark, sf):
    names = queries.queries()
    assert len(names) == 10 and all(n.startswith(f"op{i}_") for i, n in enumerate(names, 1))
    con = compare.duck(sf)
    for name, sql in queries.oracle_sql().items():
        compare.same(spark, con, sf, names[name], sql)


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    rows = [r for r in sorted(docs.collect(), key=lambda r: r["doc_id"])]
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in kept]
    rows = [(i, t) for (i, _), t in zip(rows, brute_lines([t for _, t in rows])) if t.split()]
    heads = {min(c) for c in brute_classes(rows)}
    rows = [(i, pii.mask(t, pii.find(t))) for i, t in rows if i in heads]
    encode = ids_of(BYTE)
    want = collections.Counter({i: len(encode(t)) + 1 for i, t in rows})
    got = collections.Counter()
    for r in pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert columns is None
