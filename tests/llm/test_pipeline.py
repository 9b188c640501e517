import corpus_pipeline
from costweave.llm import mixing, packing, simhash
from costweave.llm.common import staged


def test_stages_in_order_on_what_the_one_before_kept(spark, docs):
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "pii", "source_mixing", "length_buckets"]
    kept, seen = staged(documents, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(kept)
        kept = staged(stage(spark, kept, ""), name)
        if name != "length_buckets":
            assert kept.columns == documents.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert set(ids(documents)) - set(ids(seen[1])) == {300, 301, 302, 303}
    firsts = {r.component_id for r in simhash.near_duplicates(seen[1]).collect()}
    assert ids(seen[2]) == sorted(firsts)  # one row of each group, of repeated rows too
    assert ids(seen[3]) == ids(seen[2])
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3].dropDuplicates(["doc_id"])).collect()} if len(set(ids(seen[3]))) == len(ids(seen[3])) else {}
    if copies:
        assert ids(seen[4]) == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted(map(str, kept.collect())) == sorted(map(str, packing.pack(seen[4]).collect()))


def test_run_reads_documents(spark, tmp_path, docs, empty):
    for name, df in (("some", docs.where("doc_id < 60")), ("none", empty)):
        df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_entry_registers_every_query(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
