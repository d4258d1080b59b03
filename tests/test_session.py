from trapline.session import INITIAL, apply_adaptive

ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_get_a_few_megabytes_of_a_shuffle(spark):
    """Neither the number of cores nor of shuffle partitions decides how much a task holds."""
    session = spark.newSession()
    apply_adaptive(session)
    rows = session.range(12_000_000).selectExpr("id", "xxhash64(id) AS mixed").repartition("mixed")
    assert session.conf.get("spark.sql.shuffle.partitions") == "4" and rows.rdd.getNumPartitions() > 12


def test_chosen_sizes_win(spark):
    session = spark.newSession()
    session.conf.set(ADVISED, "5m")
    session.conf.set("spark.sql.shuffle.partitions", "3000")
    apply_adaptive(session)
    assert session.conf.get(ADVISED) == "5m" and session.conf.get(INITIAL) == "3000"
