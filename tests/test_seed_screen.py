import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gapwise.functions.digests import Keys
from gapwise.functions.hashing import hash_rank
from gapwise.plans import experiments
from gapwise.plans.seed_screen import SeedScreen


def table(spark, n):
    """Separable rows along x1; every fiftieth lies at the margin."""
    ids = spark.range(n, numPartitions=3)
    y = F.when(F.pmod("id", F.lit(2)) == 0, 1.0).otherwise(-1.0)
    far = F.when(F.pmod("id", F.lit(50)) < 2, 0.5).otherwise(0.8 + F.pmod(F.col("id") * 37, F.lit(101)) / 101.0)
    return ids.select("id", F.lit(0.0).alias("x0"), (y * far).alias("x1"), y.alias("y")).persist()


def test_ranks_of_many_keys_equal_the_column_expression(spark):
    texts = ["", "7", "123456789", "x" * 49, "x" * 50, "x" * 51, "long " * 40, "é", None]
    for seed in (3, "1/12", "s" * 60):
        expected = [int(hashlib.md5("|".join([str(seed), *([] if t is None else [t])]).encode()).hexdigest()[:15], 16)
                    for t in texts]
        assert Keys(pa.array(texts)).ranks(seed).tolist() == expected
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(hash_rank(seed, "t")).collect()
        assert [r[0] for r in rows] == expected


def test_screen_rules_out_no_certain_seed_and_most_others(spark):
    df, seeds = table(spark, 3000), list(range(1, 25))
    results = experiments.check_corruptions(df, "id", ["x0", "x1"], "y", 0.004, seeds, 1e-3)
    certain = {r["seed"] for r in results if r["is_certain"]}
    screen = SeedScreen(df, "id", ["x0", "x1"], "y", 0.004, 1e-3, 1e-3, [r["model"] for r in results[:8]])
    out = screen.ruled_out(seeds)
    screen.close()
    assert certain and not out & certain
    assert len(out) >= 0.5 * (len(seeds) - len(certain)) > 0


def test_rows_of_one_key_are_left_to_the_full_check(spark):
    df = table(spark, 600).withColumn("id", F.least("id", F.lit(300)))
    model = experiments.check_corruptions(df, "id", ["x0", "x1"], "y", 0.02, [1], 1e-3)[0]["model"]
    screen = SeedScreen(df.withColumn("id", F.nullif("id", F.lit(3))), "id", ["x0", "x1"], "y", 0.02, 1e-3, 1e-3, [model])
    assert screen.ruled_out([1, 2, 3]) == set()


def test_search_trains_each_seed_once_and_only_those_in_doubt(spark, monkeypatch):
    df, trained = table(spark, 3000), []
    check = experiments.check_corruptions
    monkeypatch.setattr(experiments, "SEED_LIMIT", 40)

    def counted(rows, key, features, label, rate, seeds, l2):
        trained.extend(seeds)
        return [r | {"is_certain": False} for r in check(rows, key, features, label, rate, seeds, l2)]
    monkeypatch.setattr(experiments, "check_corruptions", counted)
    row = experiments.search_seed(df, "id", ["x0", "x1"], "y", 0.02, "r", max_attempts=120, l2=1e-3).collect()[0]
    assert (row["is_found"], row["seed"], row["n_failures"], row["n_checked"]) == (False, None, 120, 120)
    drawn = {experiments.candidate_seed("r", a) for a in range(120)}
    assert len(trained) == len(set(trained)) < len(drawn)
