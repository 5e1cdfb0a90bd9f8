"""Facts with two clocks, a search, a replaced fact. Run: python examples/quickstart.py FOLDER"""

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.memory import FactStore  # noqa: E402


def main(folder: str, spark: SparkSession | None = None) -> None:
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with FactStore(spark, folder) as store:
        store.remember("The harbour office of Lisbon opens at nine", ["Lisbon"], source="leaflet")
        store.remember("The night train calls at Porto and Lisbon", ["Porto"])
        for hit in store.query("when does the harbour office open?", 2):
            print(f"[{hit['score']:.3f}] {hit['content']}")
        store.remember("The harbour office of Lisbon opens at seven", ["Lisbon"], effective_at="2099-01-01")
        print("active:", [r.content for r in store.active().collect()])
        store.remember("The harbour office of Lisbon opens at ten", ["Lisbon"])
        for r in store.list(include_deprecated=True).where("deprecated").collect():
            print(f"replaced: {r.content} (by {r.replaced_by})")


if __name__ == "__main__":
    main(sys.argv[1])
