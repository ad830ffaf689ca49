"""Memory of Python workers does not follow the batches that they get."""

import tracemalloc

import pyarrow as pa
from lexispark.llm import neardup
from lexispark.llm._text import batches
from lexispark.llm._tokens import ranges

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_hashing_a_batch_takes_little_memory():
    texts = pa.array([" ".join(f"w{(i * 31 + j * j) % 997}" for j in range(400)) for i in range(2500)])
    assert sum(map(len, texts.to_pylist())) > 4_000_000
    tracemalloc.start()
    for lo, hi in ranges(texts, neardup.CHARS):
        neardup.sketch(texts.slice(lo, hi - lo))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_batches_are_small_inside_the_block_only(spark):
    def sizes(frames):
        for b in frames:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    def most():
        return max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())

    before = spark.conf.get(ROWS)
    with batches(spark, neardup.BATCH_ROWS):
        assert most() <= 1000
        with batches(spark, 5000):
            assert most() <= 1000  # not more than the session asks for
    assert spark.conf.get(ROWS) == before and most() > 1000


def test_near_duplicates_ask_for_small_batches(spark, monkeypatch):
    seen, sketched = [], neardup.sketched
    monkeypatch.setattr(neardup, "sketched", lambda docs: seen.append(int(spark.conf.get(ROWS))) or sketched(docs))
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n o p"), (4, None)]
    before = spark.conf.get(ROWS)
    got = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]
    assert seen == [neardup.BATCH_ROWS] and spark.conf.get(ROWS) == before


def test_the_words_that_a_worker_keeps_are_bounded():
    import public_tokenizers
    from lexispark.llm._tokens import encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    few, many = encoder(path, 1000), encoder(path)
    for k in range(8):
        texts = pa.array([f"word{k * 300 + i} and its neighbours, été {i}" for i in range(300)])
        a, b = few.encode(texts), many.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert len(few.words.number) <= 1000 < len(many.words.number)
