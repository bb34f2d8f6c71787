"""Further columns pass every stage untouched, whatever their names: those that operators use inside, spaces, dots and quotes too."""

import corpus_pipeline
import pytest
from docloom.llm import decontaminate, lines, neardup, quality, work

NAMES = [
    "row id", "row text", "gone id", "gone text", "gone lines", "map word", "map bit", "map bits", "may occur", "document", "marks", "marks_", "id", "th", "w", "line", "key", "n", "m", "node", "band", "component", "label",
    "a b", "x.y", "q`r", "text.text", "SUM(x)", "kept", "first", "at", "oid", "bands", "want", "doc", "*", "words, two", "k1", "h1",
]
PROSE = " ".join(f"word{i} of" for i in range(40))


def docs_of(spark, id_column="doc_id", text_column="text"):
    rows = [(1, PROSE), (2, PROSE + " more"), (3, "a line that is repeated here, twice\n" + " ".join(f"t{i} x{i * 7}" for i in range(50))), (4, "a line that is repeated here, twice\n" + " ".join(f"u{i} y{i * 3}" for i in range(50))), (5, None), (6, "one more " + " ".join(f"v{i} z{i * 5}" for i in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, c in enumerate(NAMES):
        df = df.select("*", (df["doc_id"] * 100 + k).cast("string" if k % 2 else "long").alias(c))
    return df.withColumnsRenamed({"doc_id": id_column, "text": text_column})


def untouched(df, id_column="doc_id"):
    got = df.collect()
    assert [c for c in df.columns if c in NAMES] == NAMES
    for r in got:
        assert [str(r[df.columns.index(c)]) for c in NAMES] == [str(r[df.columns.index(id_column)] * 100 + k) for k in range(len(NAMES))]
    return {r[df.columns.index(id_column)] for r in got}


def test_each_operator(spark):
    bench = spark.createDataFrame([("i", " ".join(f"v{i} z{i * 5}" for i in range(50)))], "item_id string, text string")
    docs = docs_of(spark)
    assert untouched(neardup.apply(docs)) == {1, 3, 4, 5, 6}
    assert untouched(lines.apply(docs)) == {1, 2, 3, 4, 5, 6}
    assert untouched(decontaminate.apply(docs, bench)) == {1, 2, 3, 4, 5}
    assert untouched(decontaminate.apply(docs, bench, mode="spans")) == {1, 2, 3, 4, 5, 6}
    assert untouched(quality.apply(docs)) >= {3, 4, 6}


def test_lines_under_other_names(spark):
    out = lines.apply(docs_of(spark, "my id", "my.text"), id_column="my id", text_column="my.text")
    assert untouched(out, "my id") == {1, 2, 3, 4, 5, 6}
    cut = {r[0]: r[1] for r in out.collect()}
    assert cut[3].startswith("a line") and cut[4].startswith("u0 y0")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage(spark, tmp_path, stage):
    docs = docs_of(spark).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS LONG) AS n_chars", *(f"`{c.replace('`', '``')}`" for c in NAMES))
    spark.createDataFrame([("i", "nothing of it")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    if stage == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6}
    else:
        assert out.columns == docs.columns and untouched(work.table(out, "stage")) >= {3, 4, 6}
