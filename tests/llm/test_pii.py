import re

import pytest
from pyspark.sql import functions as F

from foretrace.llm import pii

TEXT = ("Call +1 (017) 555-7713 or +1 (017) 555 7713; mail Joe.9@Mail3.example.com, JOE.9@MAIL3.EXAMPLE.COM. "
        "Card 4952935900253052 and 4952 9359 0025 3052, host 169.122.221.182, "
        'key "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", KEY "B44E15E09FD311C3CF3163B66D5A9875B883D8CE"!! '
        "ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, Mrs Anna Schmidt met Mr. Schmidt and госпожа; Госпожа Анна Иванова.")


def run(docs, rows, key="k"):
    return {r.doc_id: r for r in pii.anonymised(docs(rows), key).collect()}


def test_kinds_and_formats(spark, docs):
    df = spark.createDataFrame([(TEXT,)], "text string").select(F.explode(pii.mentions(F.col("text"))).alias("m"))
    got = [(r.k, r.m) for r in df.select(pii.kind_of(F.col("m")).alias("k"), "m").collect()]
    assert [k for k, _ in got] == ["phone", "phone", "email", "email", "card", "card", "ip", "secret", "secret", "ssn", "iban", "name", "name", "name"]
    out = run(docs, [(1, TEXT)])[1]
    assert out["__entities__"] == 14 and not any(m in out.text for _, m in got)
    new = [r.m for r in spark.createDataFrame([(out.text,)], "text string").select(F.explode(pii.mentions(F.col("text"))).alias("m")).collect()]
    shape = lambda s: re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", s))
    assert len(new) == 14
    for (kind, old), m in zip(got, new):
        if kind not in ("email", "ip", "name", "secret"):
            assert shape(m) == shape(old)
    by = list(zip([k for k, _ in got], new))
    flat = lambda s: re.sub(r"\W", "", s).lower()
    for a, b in ((0, 1), (2, 3), (4, 5), (7, 8)):
        assert flat(new[a]) == flat(new[b]) and new[a] != new[b]
    assert new[3].isupper() and new[8].isupper() and new[0].startswith("+1 (") and new[10].startswith("DE")
    digits = [int(c) for c in new[4]]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 and new[4][0] == "4"
    anna, herr, ivanova = (m for k, m in by if k == "name")
    assert anna.startswith("Mrs ") and anna.split()[1].endswith("na") and herr.split()[1] == anna.split()[2]
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+на [А-Я][а-я]+", ivanova)
    assert re.sub("|".join(map(re.escape, new)), "#", out.text) == re.sub("|".join(map(re.escape, sorted((m for _, m in got), key=len, reverse=True))), "#", TEXT)


def test_one_surrogate_for_an_entity_and_one_entity_for_a_surrogate(spark, docs):
    rows = [(k, f"x 10.0.{k % 40}.7 y m{k % 7}@h.com") for k in range(200)]
    out = run(docs, rows)
    pairs = {(rows[k][1].split()[i], out[k].text.split()[i]) for k in range(200) for i in (1, 3)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 47
    assert run(docs, rows)[3].text == out[3].text != run(docs, rows, key="other")[3].text


def test_collisions_are_drawn_again(spark, docs, monkeypatch):
    def few(kind, entity, draw, key):
        return F.concat(F.lit("s"), ((F.abs(F.xxhash64(entity, draw)) % 40)).cast("string"))

    monkeypatch.setattr(pii, "surrogate", few)
    entities = spark.createDataFrame([("ip", f"s{k}") for k in range(5)] + [("ip", f"e{k}") for k in range(15)], "kind string, entity string")
    got = pii.distinct_surrogates(entities, "k").collect()
    assert len({r.surrogate for r in got}) == len(got) == 20 and not {r.surrogate for r in got} & {f"s{k}" for k in range(5)}
    monkeypatch.setattr(pii, "MAX_DRAWS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda *a: F.lit("same"))
    with pytest.raises(RuntimeError):
        pii.distinct_surrogates(entities, "k")


def test_nulls_repeats_clashes_and_clean_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "no data 1.2.3 here, version 2.0."), (4, "a@b.com"), (4, "a@b.com"), (None, "a@b.com end"), (5, "@ a@ 1234 " + "x" * 5000)]
    df = spark.createDataFrame([(i, t, "e", "k", 1) for i, t in rows], "doc_id long, text string, entity string, kind string, pos int")
    out = pii.anonymised(df, "k")
    assert out.columns == [*df.columns, "__entities__"] and out.count() == len(rows)
    by = {r.doc_id: r.text for r in out.collect()}
    assert (by[1], by[2], by[3], by[5]) == (None, "", rows[2][1], rows[6][1]) and by[None] == by[4] + " end" and by[4] != "a@b.com"
    assert pii.anonymised(df.limit(0), "k").count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = pii.anonymised(docs([(1, "a@b.com")]), "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
