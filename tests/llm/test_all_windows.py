"""op8 looks at every window that can be similar to an item, also where no shingle keeps its place."""


def test_item_with_its_halves_exchanged_inside_a_longer_text(spark):
    from flowtide.llm.decontaminate import leaks

    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    x, y = [f"x{i}" for i in range(90)], [f"y{i}" for i in range(90)]
    docs = spark.createDataFrame([(1, " ".join(x + b + a + y)), (2, " ".join(x + a + y)), (2, " ".join(b + y)), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(a + b))], "item_id long, text string")
    got = [tuple(r) for r in leaks(docs, items).select("doc_id", "item_id", "start_word", "n_words", "similarity").collect()]
    assert got == [(1, 7, 90, 80, 0.9)]
