import random
import re

import pytest
from pyspark.sql import functions as F
from test_near_and_lines import union_find

import corpus_pipeline
from foretrace.llm import packing, quality
from foretrace.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [a + b for a in "the and of ing tion".split() for b in "er on at re st nd".split()]
    line = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))
    rows = []
    for k in range(60):
        rows.append((k, "\n".join(line(rng.randrange(6, 20)) for _ in range(rng.randrange(3, 8)))))
    items = [line(30) for _ in range(3)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + "\n" + line(9))]  # copies
    rows += [(102, line(25) + " " + items[0] + "\n" + line(12)), (103, "few words"), (104, None), (105, " "), (106, "#x|*" * 3 + " QQ$$ ZZ## " * 60)]
    rows.append((107, " ".join(line(1) for _ in range(2500))))
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    texts, seen = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names
        seen[name] = texts
        docs = out.checkpoint()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "quality rules":
            assert 60 - 3 <= len(set(texts) & set(range(60))) and not {103, 104, 105, 106} & set(texts) and {100, 101, 102, 107} <= set(texts)
        if name == "line dedup":
            assert 100 not in texts and "\n" not in texts[101] and 3 in texts and texts[107] == seen[name][107]
        if name == "decontamination":
            assert set(seen[name]) - set(texts) == {102}
    packed = corpus_pipeline.best_fit_packing(spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_near_stage_keeps_one_of_each_group(spark, folder):
    rng = random.Random(3)
    rows = []
    for _ in range(5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(6):
            rows.append((len(rows), " ".join(w if rng.random() > 0.01 else "new" for w in base)))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, "no id " * 9), (None, "no id " * 9), (201, None), (202, ""), (203, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, folder).collect()]
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = union_find(len(rows), pairs)
    ids = lambda pairs: sorted((i, hash(t)) for i, t in [(-1 if i is None else i, t) for i, t in pairs])
    assert ids(kept) == ids([rows[k] for k in sorted(set(root))])


def test_run_equals_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).checkpoint()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert got.agg(F.countDistinct("sequence_id")).first()[0] == -(-got.agg(F.sum("length")).first()[0] // 2048)


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_quality_stage_agrees_with_its_operator(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdict = {r.doc_id for r in quality.judged(docs).filter("__kept__").select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, folder).collect()} == verdict


def test_packed_sequences_hold_the_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    packed = packing.pack(packing.encoded_pieces(docs, tokenizer(), with_ids=True)).cache()
    streams = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert bytes(streams[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
    assert all(len(x) <= 4 * 2048 for x in streams.values())
