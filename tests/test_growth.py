"""What the engine does for larger inputs grows with them and not faster."""

from patchloom.functions import text as T
from patchloom.operators import diff
from patchloom.plans import queries as Q

from .conftest import DATA


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_match_every_line_once(spark):
    """What the parts of a report share is kept: none of them starts from the documents' lines again."""
    a = Q._reported(spark, DATA)
    assert all("documents.parquet" not in _plan(df) for df in (a.findings, a.category_scores))


def test_a_shown_text_is_computed_once(spark):
    """However often a cut looks at its text, the text is made once; it used to be made for every length tried."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    def made(x):
        calls.add(1)
        return "é" * 150 + x

    text = F.udf(made)(F.col("id").cast("string"))
    shown = spark.range(3, numPartitions=1).select(T.truncated(text).alias("s")).collect()
    assert [len(r["s"].encode()) for r in shown] == [203] * 3 and calls.value == 3


def test_patches_are_written_and_parsed_in_an_exchange_each(spark):
    """The parts of a patch are exchanged once as documents, and its lines once when they are parsed."""
    patches = Q.as_patches(spark, DATA)
    assert _plan(patches).count("Exchange hashpartitioning") == 1
    rows = spark.createDataFrame([("p", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b")], "patch_id string, text string")
    assert _plan(diff.parse(rows).lines).count("Exchange hashpartitioning") == 1


def test_many_patches_of_a_file_are_one_batch(spark, tmp_path):
    from patchloom.streaming.incremental import arriving_tables

    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b"
    spark.createDataFrame([(f"p{k}", text) for k in range(2500)], "patch_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = arriving_tables(spark, f"file://{tmp_path}/in").writeStream.foreachBatch(lambda b, k: seen.append(b.count()))
    stream.option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert seen == [2500]


def test_findings_share_states(spark, tmp_path):
    """The stream's groups do not grow with the findings; 3,000 of them used to be 3,000 groups, each with its own cost.
    What is told is what a plain walk over every finding's times tells."""
    from pyspark.sql import functions as F

    from patchloom.streaming import stateful

    hours = F.filter(F.sequence(F.lit(1000), F.lit(1030)), lambda h: F.pmod(F.xxhash64("id", h), F.lit(6)) == 0)
    rows = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("repo"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("fingerprint"), F.explode(hours).alias("hour"))
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("hour") * 3600)).cache()
    states = []
    for low, high in ((1000, 1012), (1012, 1031)):
        rows.where(F.col("hour").between(low, high - 1)).drop("hour").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("repo string, fingerprint string, at timestamp").parquet(f"file://{tmp_path}/in")
        told = stateful.told_once(stream, 6 * 3600).writeStream.format("parquet").option("path", f"file://{tmp_path}/out")
        run = told.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        states += [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    assert 0 < max(states) <= stateful.BUCKETS
    times: dict = {}
    for r in rows.collect():
        times.setdefault((r["repo"], r["fingerprint"]), []).append(r["hour"])
    want = []
    for key, found in times.items():
        met: list[list[int]] = []
        for h in sorted(found):
            if met and h - met[-1][-1] <= 6:
                met[-1].append(h)
            else:
                met.append([h])
        want += [(*key, "opened", m[0], m[0], 0) for m in met]
        # The watermark comes to an hour before the last row.
        want += [(*key, "closed", m[-1], m[0], len(m)) for m in met if m is not met[-1] or m[-1] + 6 < 1029]
    out = spark.read.parquet(f"file://{tmp_path}/out")
    hour = lambda c: (F.unix_timestamp(c) / 3600).cast("int")
    assert sorted(want) == sorted(map(tuple, out.select("repo", "fingerprint", "event", hour("at"), hour("first_at"), "times").collect()))


def test_word_edges_are_ascii_whatever_the_case(spark):
    """As in RE2: letters that only fold to ASCII ones are no word characters, and an edge is one look behind where it can be."""
    from pyspark.sql import functions as F

    from patchloom.functions.patterns import to_java

    cases = [(r"(?i)\bage\b", "page"), (r"(?i)\bage\b", "ſage"), (r"(?i)\bage\b", "x AGE."), (r"(?i)end\b", "endK"), (r"(?i)\bkey", " Key"), (r"\ba?-", "x-"), (r"\ba?-", "-")]
    row = spark.range(1).select(*[F.lit(text).rlike(to_java(p)).alias(f"c{k}") for k, (p, text) in enumerate(cases)]).collect()[0]
    assert list(row) == [False, True, True, True, False, True, False]
    assert to_java(r"\bage").count("(?") == 2
