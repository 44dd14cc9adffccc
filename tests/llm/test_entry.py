import corpus_pipeline
from cohortflow.llm.queries import ORACLE, QUERIES


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {
        r[0] for r in kept.select("doc_id").collect()}
    assert 0.5 * docs.count() < kept.count() < docs.count()
    key = lambda r: str(r[:3])
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole), key=key) == sorted(
        map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect()), key=key)


def test_small_batches_keep_a_size_of_the_session(spark):
    from cohortflow.llm.common import small_batches
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    own.conf.set(key, "32MB")
    small_batches(own)
    assert own.conf.get(key) == "32MB"
    other = spark.newSession()
    small_batches(other)
    assert other.conf.get(key) == "4MB"
