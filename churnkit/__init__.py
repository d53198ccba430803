"""churnkit: customer-attrition analytics on Spark.

Load untyped customer, product and activity exports, profile their
quality, clean them into typed staging tables, analyse churn, and publish
a wide reporting table and a star schema. Every step is a DataFrame
operator on built-in Spark expressions.

    from churnkit.config import BANK
    from churnkit.plans.warehouse import Warehouse
    from churnkit.plans.queries import QUERIES

    wh = Warehouse.from_csv(spark, {"customers": ..., "products": ..., "activity": ...}, BANK)
    QUERIES["eda_02_rate_by_province"](wh).show()

Packages: ``functions`` (column expressions), ``sources`` (raw schemas,
CSV, fixture adapters, sinks), ``operators`` (table operators),
``plans`` (the pipeline and its queries), ``streaming`` (the load as a
restartable stream).
"""

__version__ = "0.1.0"
