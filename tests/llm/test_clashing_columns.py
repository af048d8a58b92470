"""Columns of the input that bear names which the operators use themselves."""

from pyspark.sql import functions as F

from strandline.llm import kneser_ney, toxicity

NAMES = ["score", "bias", "label", "toxic", "quality", "row", "key", "text_key", "bits", "n", "gram", "order", "part", "feature", "perplexity", "limit", "keep"]


def with_clashes(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES) if c not in df.columns])


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_toxicity(spark, docs):
    rows = [(i, f"you are a {'vile' if i % 2 else 'kind'} person. So it is, number {i}.") for i in range(40)] + [(40, None), (41, "")]
    plain, clashing = docs(rows), with_clashes(docs(rows))
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    more = labels.select("*", F.lit("z").alias("text"), F.lit(1).alias("lang"))
    model = toxicity.train(plain, labels)
    assert toxicity.train(clashing, more) == model
    same(toxicity.score(clashing, *model), toxicity.score(plain, *model))


def test_quality(spark, docs):
    rows = [(i, f"A line of plain words, the number {i % 7}, and more of them.", "en", "a") for i in range(40)] + [(40, "zzzz qqqq " * 9, "en", "a"), (41, None, "en", "a"), (42, "", None, "a")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(40, 0, 0)], "doc_id long, quality int, toxic int")
    more = labels.select("*", F.lit("z").alias("text"), F.lit(1).alias("lang"))
    same(kneser_ney.score_quality(with_clashes(docs(rows)), more), kneser_ney.score_quality(docs(rows), labels))
