import __spark_entry__ as entry
import corpus_pipeline as cp
from wirelore.llm import queries


def test_registered_names():
    names = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert names == set(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "benchmark_leaks", "pii", "packing"]


def test_stages_on_planted_cases(spark, make_docs, words, tmp_path):
    clean = [(i, words(15 + 2 * i)) for i in range(1, 41)]
    insults = "idiot moron scum loser worthless pathetic"
    toxic = [(100 + i, words(10 + 5 * i) + " you " + insults + " " + words(10)) for i in range(12)]
    copies = [(200, clean[0][1]), (201, clean[1][1] + " tail")]
    item = words(40)
    leaks = [(300, words(20) + " " + item + " " + words(5))]
    private = [(400, words(20) + " write to bob@mail.example.org " + words(5)), (401, words(20) + " bob at mail dot example dot org")]
    odd = [(500, None), (501, ""), (None, words(30))]
    docs = make_docs(clean + toxic + copies + leaks + private + odd).select("doc_id", "text", "lang", "source", "n_chars")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(cp.STAGES)

    def step(name, docs):
        path = f"{sf}/after-{name}"
        stage[name](spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        return out, {r[0] for r in out.select("doc_id").collect()}

    everything = {r[0] for r in docs.collect()}
    docs, ids = step("toxicity", docs)
    assert ids == everything - {i for i, _ in toxic} and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs, ids = step("near_duplicates", docs)
    assert ids == everything - {i for i, _ in toxic} - {200, 201}
    docs, ids = step("benchmark_leaks", docs)
    assert ids == everything - {i for i, _ in toxic} - {200, 201, 300}
    docs, ids = step("pii", docs)
    texts = {r.doc_id: r for r in docs.collect()}
    assert "<EMAIL>" in texts[400].text and texts[401].text.endswith("<EMAIL>") and texts[400].n_chars == len(texts[400].text) and texts[500].text is None
    _, packed = step("packing", docs)
    assert packed == ids
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == ids


def test_stages_keep_no_tables_made_on_the_way(spark, make_docs, words, written, tmp_path):
    """A stage leaves its numbered rows and the rejected ids; sketches, classes, links and the like are gone."""
    docs = make_docs([(i, words(30 + i, seed=i)) for i in range(20)] * 2).select("doc_id", "text", "lang", "source", "n_chars")
    rows = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert written() == ["numbered", "rejected"] and sorted(r.doc_id for r in rows.collect()) == list(range(20))
