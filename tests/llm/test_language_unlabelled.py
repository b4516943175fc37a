from tallyforge.llm import language_id


def test_documents_stay_where_nothing_could_be_learned(spark):
    df = spark.createDataFrame([(1, "der die und das", None), (2, None, None), (3, "12 ...", None), (4, "the and of", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.accepted(df).collect()) == [1, 4]
