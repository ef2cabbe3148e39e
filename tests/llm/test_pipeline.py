"""The pipeline against its stages done by brute force."""

import random

import corpus_pipeline
from lumenark.llm import quality
from tests.llm import brute


def test_stages_in_order(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    passage = text(60)
    rows = [(i, text(80)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110 + i, f"{text(40)} {passage} {text(40)}") for i in range(4)]
    rows += [(120 + i, f"{text(30)}\n{items[i][1]}\n{text(30)}") for i in range(3)] + [(130, "too short"), (131, (text(6) + " ") * 1 + "la la la la la la la la " * 20), (132, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(str(tmp_path / f"out{i}"))
            docs = spark.read.parquet(str(tmp_path / f"out{i}"))
            seen.append({x.doc_id: x.text for x in docs.collect()})
    good = {i: t for i, t in rows if brute.quality(t)[0] >= 10 and 5 * brute.quality(t)[4] <= brute.quality(t)[0]}
    assert seen[0] == good
    kept = {i: t for i, t in good.items() if brute.near(good.items())[i][1] == i}
    assert seen[1] == kept and not any(100 <= i < 110 for i in kept)
    cut = brute.repeats(kept.items())
    assert {i: len(brute.words(t)) for i, t in seen[2].items()} == {i: n - gone for i, (n, gone, _) in cut.items()}
    assert set(seen[3]) == set(seen[2]) - {120, 121, 122}
    assert {x.doc_id for x in docs.collect()} == set(seen[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() and quality.RISK < 0.05
