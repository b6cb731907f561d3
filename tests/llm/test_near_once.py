"""The texts of kept documents are exchanged once."""

from test_llm_operators import frame

from tidemark.llm import near_dup


def test_near_copies_exchange_the_texts_once(spark, folder):
    base = " ".join(f"w{n}" for n in range(60))
    frame(spark, [(1, base), (2, base + " end"), (3, "another text of a few words only"), (4, None)]).write.parquet(f"{folder}/docs")
    left = near_dup.drop_near_copies(spark.read.parquet(f"{folder}/docs"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("whole") and plan.count("text#") and plan.count("Join LeftOuter") == 1 and "Union" not in plan
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_repeated_near_copies_leave_one_row(spark):
    base = " ".join(f"w{n}" for n in range(60))
    docs = frame(spark, [(1, base)] * 3 + [(None, "five words are in here")] * 2 + [(2, base + " end"), (5, "alone"), (6, ""), (6, "")])
    left = near_dup.drop_near_copies(docs)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "five words are in here"), (1, base), (5, "alone"), (6, ""), (6, "")]
