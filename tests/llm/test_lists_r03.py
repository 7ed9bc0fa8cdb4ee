"""Near duplicates: which lists a node keeps and who leads them."""

from scenelake.llm import jaccard


def test_a_node_keeps_the_smallest_lists_that_no_link_can_miss(spark):
    rows = [(10, 1, 1, 0, 2), (11, 1, 1, 0, 5), (12, 1, 1, 0, 9), (12, 2, 2, 0, 9), (11, 2, 2, 0, 5), (11, 3, 3, 0, 5)]
    lists = spark.createDataFrame(rows, "key long, node long, root long, few int, size int")
    groups = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "node long, need int")
    got = {(r["key"], r["node"]) for r in jaccard._first(lists, groups).collect()}
    # one and two share two lists, of which both keep the smaller; three is in fewer lists than a link implies
    assert got == {(10, 1), (11, 1), (11, 2)}


def test_the_root_of_the_largest_class_leads(spark):
    rows = spark.createDataFrame([(7, 5, 5, -9), (7, 6, 5, -9), (7, 1, 1, -1), (8, 1, 1, -1)], "key long, node long, root long, few int")
    got = {(r["key"], r["lead"], r["size"]) for r in jaccard._lists(rows, "few").collect()}
    assert got == {(7, 5, 3)}
    assert {r["lead"] for r in jaccard._lists(rows).collect()} == {1}
