"""Token counts of texts: in their row, with the rows of a repeated key added up."""

import math

from cartulary.operators.embedding import token_weights


def test_rows_of_a_key_are_added_up_and_no_tokens_are_grouped_without_need(spark):
    rows = [("a", "one two two"), ("b", "two"), ("a", "Two 三"), (None, "x"), (None, "x y"), ("c", None), ("d", "")]
    texts = spark.createDataFrame(rows, "document_id string, text string")
    found = {(r["document_id"], r["token"]): (r["occurrences"], r["weight"]) for r in token_weights(texts, ["document_id"]).collect()}
    expected = {("a", "one"): 1, ("a", "two"): 3, ("a", "三"): 1, ("b", "two"): 1, (None, "x"): 2, (None, "y"): 1}
    assert {k: v[0] for k, v in found.items()} == expected
    assert all(math.isclose(weight, 1.0 + math.log(n)) for n, weight in found.values())

    single = token_weights(texts.filter("document_id in ('b', 'c', 'd')"), ["document_id"])
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange hashpartitioning" not in plan
    assert [tuple(r) for r in single.collect()] == [("b", "two", 1, 1.0)]
