import re

from lodestone.llm import exact_dedup

from . import brute


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), first, brute.sha(text)))
            first = False
    return out


def key(r):
    return (str(r[0]), r[4], r[3])


def test_assign(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (2, ""), (2, ""), (None, "a b"), (None, "z"), (7, " a b"), (8, " a b"), (1, "q" * 200000)]
    rows += [(100 + i, "hot\n copy") for i in range(5000)] + [(6000 + i, f"t {i}") for i in range(3000)]
    got = exact_dedup.assign(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    assert exact_dedup.winners(exact_dedup.digest_table(frame(spark, rows), "doc_id", "text")).count() == 1


def test_drop_keeps_columns_and_one_row_each(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (None, "a b"), (2, ""), (2, ""), (4, None)] + [(50 - i, "hot") for i in range(30)]
    got = exact_dedup.drop_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "kept"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, ""), (3, "a\tb"), (21, "hot")]


def test_empty(spark):
    assert exact_dedup.assign(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_columns_of_any_name(spark):
    names = ["__digest", "__n", "__keep", "__place", "__id", "__whole", "__row", "a.b"]
    rows = [(i, "same" if i else "other", *[f"{n}{i}" for n in names]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = exact_dedup.drop_duplicates(df)
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == rows[:2]
    renamed = df.withColumnsRenamed({"doc_id": "__keep2", "text": "t.x"})
    assert sorted(map(tuple, exact_dedup.drop_duplicates(renamed, "__keep2", "t.x").collect())) == rows[:2]


def test_a_hot_text_under_one_id_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 20_000).selectExpr("if(id % 3 = 0, id, 7) AS doc_id", "if(id % 3 = 0, string(id), 'same') AS text")
    got = exact_dedup.drop_duplicates(df)
    assert got.count() == 6667 + 1 and got.where("text = 'same'").count() == 1
    assert "row_number(), 1, Partial" in got._jdf.queryExecution().executedPlan().toString()
