"""`python -m corpusloom STAGE ...`; under spark-submit the session is that of the cluster."""

import sys

from pyspark.sql import SparkSession

from .plans.commands import run

if __name__ == "__main__":
    print(run(SparkSession.builder.appName("corpusloom").getOrCreate(), sys.argv[1:]))
