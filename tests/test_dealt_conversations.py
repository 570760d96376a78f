"""Conversations of one small file run in all tasks."""

from pyspark.sql import functions as F

from tessera.plans import agents as A


def test_conversations_of_one_partition_are_dealt_out(spark):
    def place(messages):
        from pyspark import TaskContext

        return f"task {TaskContext.get().partitionId()}"

    one = spark.range(200).coalesce(1).select("id", F.lit("go").alias("prompt"), F.lit("x").alias("truth"))
    said = A.run_loop(one, lambda: A.AGENT_LOOPS.get("single_turn")(place), "id", "prompt", "truth").select("id", F.array_join("response", " ").alias("at")).collect()
    assert sorted(r.id for r in said) == list(range(200)) and len({r.at for r in said}) == 4
    user = A.interact(one, lambda: A.Interaction(lambda text, truth: True), place, "id", "prompt", "truth", 2)
    assert user.rdd.getNumPartitions() == 4 and user.count() == 200
