from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from heronbase.server import server
from heronbase.session import Engine

if __name__ == "__main__":
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    server(Engine(spark, os.environ.get("WAREHOUSE_PATH")), int(sys.argv[1]) if len(sys.argv) > 1 else 8080).serve_forever()
