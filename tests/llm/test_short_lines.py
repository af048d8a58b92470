import corpus_pipeline
from strandline.llm.queries import op1_line_dedup


def test_exact_repeats_of_short_lines(spark, docs, tmp_path):
    rows = [(1, "All rights reserved.\nsome words of a text"), (2, "all  rights reserved.\n\n \nAll rights\n東京都"), (3, "東京都\nAll rights reserved\nsome words of text")]
    docs(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.exact, r.near, r.dropped) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    # Four words are too few for a near line; three that differ are no repeat.
    assert got == {1: (0, 0, ""), 2: (1, 0, "0"), 3: (1, 0, "0")}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows), str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "\n \nAll rights\n東京都", 3: "All rights reserved\nsome words of text"}
