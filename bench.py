"""Wall times of the headline queries: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from perilattice.plans.queries import QUERIES

NAMES = (
    "radial_distribution", "radial_distribution_tilted", "mean_squared_displacement", "velocity_autocorrelation", "van_hove", "voxel_density", "bond_angles", "rmsd",
    "qn_species", "linkages", "dump_round_trip",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
