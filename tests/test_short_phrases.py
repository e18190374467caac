from quern.plans import retrieval_queries, verify_queries


def test_phrases_of_one_and_two_words_are_found(spark):
    """Both may match inside longer words."""
    tables = {
        "documents": spark.createDataFrame([(1, "of the action taken"), (2, "an act"), (3, "one two three four")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(1, "the act"), (2, "act"), (3, "one two three"), (4, "")], "item_id long, text string"),
    }
    want = {(1, 1), (1, 2), (2, 2), (3, 3)}
    got = verify_queries.anchor_exact(tables.get).where("item_id <> 4").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.phrases for r in retrieval_queries.phrase_bonus(tables.get).collect()} == {1: 2, 2: 1, 3: 1}
