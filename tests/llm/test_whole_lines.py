import corpus_pipeline
from strandline.llm.queries import op1_line_dedup


def test_long_lines_are_judged_whole(spark, docs, tmp_path):
    line = [f"n{i}" for i in range(600)]
    other = line[:256] + [f"m{i}" for i in range(300)]
    tail = [f"t{i}" for i in range(514)]
    rows = [(1, " ".join(line)), (2, " ".join(line[:10] + ["put", *line[10:]])), (3, " ".join(line[:400] + line[401:])), (4, " ".join(other)), (5, " ".join(tail)), (6, "  ".join(tail)), (7, " ".join(line[:5] + ["x"] + line[6:500] + ["y"] + line[501:])), (8, " ".join(line[:-1]))]
    docs(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.exact, r.near) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0), 6: (1, 0), 7: (0, 0), 8: (0, 1)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(rows), str(tmp_path)).collect()}
    assert left == {d: t for d, t in rows if d in (1, 4, 5, 7)}
