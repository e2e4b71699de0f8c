"""op6 holds a bounded number of chunks at once, whatever the shuffle's partitions."""

from flowtide.llm import pseudolikelihood as pl


def test_parts_files_and_batches_follow_the_chunks(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    net = pl.Gate()
    want = {r[0]: r[1:] for r in pl.scores(docs, net).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    seen = []
    kept = pl.small_batches
    monkeypatch.setattr(pl, "small_batches", lambda s, rows: seen.append(rows) or kept(s, rows))
    try:
        chunks, totals = pl.counted(docs, 400)  # dozens of chunks
        n = chunks.count()
        parts = {r[0] for r in totals.select("part").distinct().collect()}
        assert n > 40 and len(parts) > 2 and max(parts) < -(-n // pl.CHUNKS_A_PART)
        files = chunks.selectExpr("_metadata.file_path AS f").groupBy("f").count().agg({"count": "max"}).first()[0]
        assert files <= pl.CHUNKS_A_FILE and seen == [pl.CHUNKS_A_BATCH]
        got = {r[0]: r[1:] for r in pl.scores(docs, net, 400).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
