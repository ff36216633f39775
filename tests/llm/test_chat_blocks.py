"""Where a long conversation is cut into parts does not change what is recovered."""

from pyspark.sql import functions as F

from larder.llm import chat


def test_any_block_gives_the_same(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id < 100")
    model = chat.train(chat.raw_transcripts(turns).select("states", chat.observe(F.split("text", "\n")).alias("obs")))
    order = F.row_number().over(chat.Window.partitionBy(F.col("conv_id") % 5).orderBy("conv_id", "turn"))
    chained = turns.select((F.col("conv_id") % 5).alias("conv_id"), (order - 1).alias("turn"), "role", "text")
    assert chained.groupBy("conv_id").count().agg(F.min("count")).first()[0] > 64
    seen = []
    for block in (16, 64, 10**6):
        found = chat.decode_conversations(chat.raw_transcripts(chained, block), model)
        rows = found.select("conv_id", "block", F.array_join("found", " ").alias("found"), F.size("turns").alias("n")).orderBy("conv_id", "block").collect()
        seen.append({c: (" ".join(r.found for r in rows if r.conv_id == c)) for c in range(5)})
    assert seen[0] == seen[1] == seen[2]


def test_assistant_first(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    model = chat.train(chat.raw_transcripts(turns).select("states", chat.observe(F.split("text", "\n")).alias("obs")))
    texts = spark.createDataFrame([("Assistant: yo\n\nUser: hi",), ("Answer: 42",)], "text string")
    first = [r.turns[0] for r in chat.format_transcripts(texts, model).collect()]
    assert [(t.role, t.text) for t in first] == [("assistant", "yo"), ("assistant", "42")]
