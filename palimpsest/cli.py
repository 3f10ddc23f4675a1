"""A small shell over a product store: python -m palimpsest.cli FOLDER [COMMAND ...]; without a command it reads lines.

A product is stored under its id as name|category|price; a second store leads from a category to the product put last.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import resolve
from palimpsest.schema import BusyError
from palimpsest.sources.store import SecondaryIndex, Store

HELP = """load PATH        add the products of a file: a header, then id,name,category,price
put ID NAME CATEGORY PRICE
get ID           one product
find CATEGORY    all products of a category
last CATEGORY    the product of a category that was put last
list             all products by id
del ID           remove a product, and its category's entry if that leads to it
compact          merge all runs
snap             show the products, then hold a snapshot and show them again
help, quit"""
HEADER = f"{'ID':<8} {'NAME':<28} {'CATEGORY':<16} PRICE"


class Shell:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.main, index = Store.open(spark, f"{folder.rstrip('/')}/main"), Store.open(spark, f"{folder.rstrip('/')}/by_category")
        self.index = SecondaryIndex(index, self.main)

    def products(self, log: DataFrame | None = None) -> DataFrame:
        """id, name, category, price of what is live."""
        live = resolve.live(self.main.log() if log is None else log).select(F.col("key").cast("string").alias("id"), F.col("value").cast("string").alias("v"))
        return live.select("id", *[codec.field(F.col("v"), i).alias(n) for i, n in enumerate(("name", "category", "price"))])

    def lines(self, rows: DataFrame) -> Iterator[str]:
        """Rows by id, as they arrive: the driver never holds all of them."""
        n = 0
        yield HEADER
        for r in rows.orderBy("id").toLocalIterator():
            n += 1
            yield f"{r['id']:<8} {r['name']:<28} {r['category']:<16} {r['price']}"
        yield f"{n} found"

    def add(self, rows: DataFrame) -> None:
        """rows (id, name, category, price): the products first, then their categories' entries."""
        self.main.put(rows.select(F.col("id").alias("key"), codec.joined("name", "category", "price").alias("value"), F.monotonically_increasing_id().alias("at")), order="at")
        entries = rows.select(F.col("category").alias("key"), F.col("id").alias("value"), F.monotonically_increasing_id().alias("at"))
        self.index.index.put(entries, order="at")

    def run(self, command: str) -> Iterator[str]:
        name, *args = command.split() or [""]
        if name == "load" and len(args) == 1:
            rows = codec.read_products(self.spark, args[0])
            counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
            if counts.get("loaded"):
                self.add(rows.where("status = 'loaded'").drop("status"))
            yield f"{counts.get('loaded', 0)} loaded, {counts.get('error', 0)} errors"
        elif name == "put" and len(args) == 4:
            self.add(self.spark.createDataFrame([tuple(args)], "id string, name string, category string, price string"))
            yield "OK"
        elif name == "get" and len(args) == 1:
            value = self.main.get(args[0].encode())
            yield "NOT_FOUND" if value is None else value.decode(errors="replace")
        elif name == "find" and len(args) == 1:
            yield from self.lines(self.products().where(F.col("category") == args[0]))
        elif name == "last" and len(args) == 1:
            value = self.index.get(args[0].encode())
            yield "NOT_FOUND" if value is None else value.decode(errors="replace")
        elif name == "list" and not args:
            yield from self.lines(self.products())
        elif name == "del" and len(args) == 1:
            yield self.delete(args[0])
        elif name == "compact" and not args:
            try:
                yield f"{len(self.main.compact().runs)} runs"
            except BusyError as e:
                yield f"BUSY: {e}"
        elif name == "snap" and not args:
            with self.main.snapshot() as s:
                yield f"snapshot at {s.seq}"
                yield from self.lines(self.products(s.log()))
        elif name == "help":
            yield HELP
        elif name:
            yield "unknown command; try help"

    def delete(self, product: str) -> str:
        value = self.main.get(product.encode())
        if value is None:
            return "NOT_FOUND"
        category = (value.decode(errors="replace").split("|") + ["", ""])[1]
        key = self.spark.createDataFrame([(category.encode(),)], "key binary")
        if category and self.index.lookup_primary(category.encode()) == product.encode():
            self.index.delete(key)
        self.main.delete(self.spark.createDataFrame([(product.encode(),)], "key binary"))
        return "OK"


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("palimpsest").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell = Shell(spark, argv[0])
    for line in [" ".join(argv[1:])] if len(argv) > 1 else sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        for out in shell.run(line):
            print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
