import corpus_pipeline
from test_trees_and_joins import brute_classes
from verlog.llm import decontaminate, language_id

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, step in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = step(spark, docs, SF)
        after[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert docs.columns == columns and after[name] == {i for i, t in before.items() if len(language_id.slots_of(t))}
        elif name == "near_duplicates":
            classes = brute_classes(sorted(before.items()))
            assert docs.columns == columns and after[name] == {i for i, (_, c) in classes.items() if c == i}
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            pairs = {b.item_id: decontaminate.pairs_of(decontaminate.words_of(b.text)) for b in bench}
            leaked = set()
            for i, t in before.items():
                own = decontaminate.pairs_of(decontaminate.words_of(t))
                leaked |= {i for p in pairs.values() if len(p & own) >= 0.8 * len(p)}
            assert docs.columns == columns and after[name] == before.keys() - leaked and leaked
        else:
            assert after[name] == before.keys() and docs.where("not round_trip").count() == 0


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_ids", "ids", "round_trip"]


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names, no rows."""
    from pyspark.sql import functions as F

    en = [" ".join(f"the house{(i * 7 + k) % 50} and a cat{(i + k * 3) % 41}" for k in range(12)) for i in range(30)]
    leaked = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(en)]
    odd = [(100, None, None, None, None), (101, "", "en", None, 0), (102, "½ 12 !?", None, "s", 7), (None, en[3] + " more", None, None, None), (103, "the cat " * 200_000, None, "s", 1), (104, en[5], "en", "s", 1),
           (104, en[5], "en", "s", 1), (105, "the cat sat " + leaked, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("__id", "__at", "at", "same", "nth", "cls", "ids", "n_ids", "round_trip", "score", "proportions", "lang_pred", "shingle")})
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF).count() == 0
        docs = step(spark, docs, SF).cache()
        ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.select("doc_id").collect())
        if name == "sentencepiece":
            assert docs.columns == ["doc_id", "n_ids", "ids", "round_trip"] and docs.where("not round_trip").count() == 0
        else:
            assert docs.columns == columns
        if name == "language_id":
            assert ids == [-1, *range(30), 103, 104, 104, 105]
        elif name == "near_duplicates":
            assert ids == [-1, *range(30), 103, 105]  # copies of 5 go; rows without an id stay
        else:
            assert ids == [-1, *range(30), 103]
