"""The pipeline's layers, each built once per session and read as a table.

``raw`` (CSV loaded once into all-string tables) -> ``staging`` (typed, cleaned) -> ``base``
(customers joined to activity) -> ``churn_analysis`` (wide table) and the
star schema (``dim_customer``, ``dim_product``, ``dim_date``,
``fact_churn``). Each layer is written as Parquet under the shared
checkpoint folder on first use, then read back, as the reference writes
each step into a table for the next script: later steps start from files,
not from a long lineage, and a lost executor costs a re-read, not a
rebuild of every upstream layer.

Tables with exactly one row per customer id (staging customers, the
earliest-join-date anchors, product portfolio, both dimensions) are
written bucketed by ``customer_id`` with
one bucket count: their buckets are balanced by construction, and joins
among them read co-located buckets without a shuffle. Tables that may hold
many rows for one customer (activity, products, and what is built from
them) are written unbucketed: a hot customer would make one bucket, and
every later task reading it, hold that customer's share of the table.
Their joins go through ``skew_join`` instead, with the hot keys that were
observed while the layer was written. The counting checks of the raw tables are
observed in the same way while the exports are loaded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.config import FIXTURE, ChurnConfig
from churnkit.functions import folded
from churnkit.operators import model, segments
from churnkit.operators.joins import HotKeys, key_metrics, observed_keys
from churnkit.operators.ordering import quantile_sketches
from churnkit.plans import staging
from churnkit.plans.profile import profile_metrics
from churnkit.session import materialize, materialize_bucketed, materialize_observed, recorded, remove_scratch, Scratch, scratch_path
from churnkit.sources.csv import MALFORMED, read_raw_csv, write_raw_csv
from churnkit.sources.fixtures import raw_tables
from churnkit.sources.schemas import RAW_SCHEMAS
from churnkit.sources.sinks import publish_tables


#: The customer id as it was exported, in the raw tables of a warehouse that folds text.
AS_LOADED = "_customer_id_as_loaded"


class Warehouse:
    def __init__(self, spark: SparkSession, raw_paths: dict[str, str], cfg: ChurnConfig,
                 buckets: int | None = None, multi_line: bool = False):
        self.spark = spark
        self.multi_line = multi_line
        self.cfg = cfg
        self.raw_paths = dict(raw_paths)
        self._buckets = buckets
        self._tables: dict[str, DataFrame] = {}
        self._hot: dict[str, dict[str, HotKeys]] = {}
        self._seen: dict[str, dict] = {}
        self._made = Scratch()

    # -- construction -----------------------------------------------------

    @classmethod
    def from_csv(cls, spark: SparkSession, raw_paths: dict[str, str], cfg: ChurnConfig,
                 buckets: int | None = None, multi_line: bool = False) -> "Warehouse":
        """A pipeline over CSV exports: paths for ``customers``, ``products``, ``activity``.

        ``multi_line`` reads quoted fields that hold line breaks; each file is then read by one task.
        """
        return cls(spark, raw_paths, cfg, buckets, multi_line)

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, cfg: ChurnConfig = FIXTURE,
                      buckets: int | None = None) -> "Warehouse":
        """A pipeline over the adapter tables of ``sf_dir``, exported once as CSV."""
        root = scratch_path(spark, "raw")
        paths = {}
        for name, df in raw_tables(spark, sf_dir).items():
            paths[name] = f"{root}/{name}"
            write_raw_csv(df, paths[name])
        out = cls(spark, paths, cfg, buckets)
        out._made.folders.append(root)  # the export is made for this warehouse
        return out

    # Raw customer export per bucket of the one-row-per-customer tables: one task sorts,
    # writes and joins a whole bucket, so this bounds its memory and its time.
    BUCKET_SOURCE_BYTES = 8 * 1024 * 1024
    # Buckets are files, listed by the driver: beyond this many (an export of 400 GB) they grow instead.
    MOST_BUCKETS = 50_000

    @property
    def buckets(self) -> int:
        """Bucket count shared by the one-row-per-customer tables.

        Given explicitly, or sized from the raw customer export, about
        ``BUCKET_SOURCE_BYTES`` of CSV per bucket (file lengths only; no
        content is read).
        """
        if self._buckets is None:
            files = self.spark.read.format("binaryFile").load(self.raw_paths["customers"])
            size = files.agg(F.sum("length")).first()[0] or 0
            self._buckets = min(self.MOST_BUCKETS, max(1, -(-size // self.BUCKET_SOURCE_BYTES)))
        return self._buckets

    # -- layers, and what was observed while they were written --------------------

    def _stored(self, name: str, df: DataFrame, keys: tuple[str, ...] = (), metrics: dict[str, Column] | None = None) -> DataFrame:
        """Write a layer once; the hot values of ``keys`` and ``metrics`` are taken in the same pass."""
        wanted = dict(metrics or {})
        for key in keys:
            wanted |= key_metrics(self.spark, key)
        table, seen = materialize_observed(df, name, wanted)
        self._hot[name] = {key: observed_keys(self.spark, seen, key) for key in keys}
        self._seen[name] = seen
        return table

    def hot(self, name: str, key: str = "customer_id") -> HotKeys:
        """The hot values of a stored layer's column."""
        return self._hot[name][key]

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            with recorded(self._made):
                self._tables[name] = build()
        return self._tables[name]

    # -- raw ----------------------------------------------------------------

    def loaded(self, name: str) -> DataFrame:
        """The loaded raw table with ``MALFORMED``: the text of each row that does not fit the columns, else NULL.

        The CSV export is parsed once and stored as all-string Parquet.
        Profiling checks and staging builds then read only the columns they
        use, instead of parsing the whole CSV again for each of them.

        With ``fold_text`` the customer id is stored folded, so that joins, groups,
        hot keys and buckets of all layers are those of a plain string, and ``AS_LOADED`` keeps its spelling.
        """
        def build() -> DataFrame:
            rows = read_raw_csv(self.spark, self.raw_paths[name], RAW_SCHEMAS[name], self.multi_line, MALFORMED)
            if self.cfg.fold_text:
                rows = rows.withColumns({AS_LOADED: F.col("customer_id"), "customer_id": folded("customer_id")})
            return self._stored(f"raw-{name}", rows, ("customer_id",), profile_metrics(name, self.cfg))

        return self._table(f"raw_{name}", build)

    def profile(self, name: str) -> dict[str, int | None]:
        """The counts of ``profile_metrics``, taken while the table was loaded."""
        self.loaded(name)
        return {metric: self._seen[f"raw-{name}"][metric] for metric in profile_metrics(name, self.cfg)}

    def raw_hot(self, name: str) -> HotKeys:
        self.loaded(name)
        return self.hot(f"raw-{name}")

    def raw(self, name: str) -> DataFrame:
        """The loaded raw table's own columns."""
        return self.loaded(name).drop(MALFORMED, AS_LOADED)

    # -- staging -------------------------------------------------------------

    def _by_customer(self, df: DataFrame, name: str) -> DataFrame:
        """A table with one row per customer, bucketed by ``customer_id``."""
        return materialize_bucketed(df, name, "customer_id", self.buckets)

    def join_anchors(self) -> DataFrame:
        """Every raw customer id with its earliest join dates (one row per id)."""
        return self._table("join_anchors", lambda: self._by_customer(
            staging.join_anchors(self.raw("customers"), self.cfg), "join-anchors"))

    def staging_customers(self) -> DataFrame:
        return self._table("stg_customers", lambda: self._by_customer(
            staging.stage_customers(self.raw("customers"), self.cfg, self.raw_hot("customers")), "staging-customers"))

    def staging_products(self) -> DataFrame:
        return self._table("stg_products", lambda: materialize(
            staging.stage_products(self.raw("products"), self.raw("customers"), self.cfg, self.join_anchors(), self.raw_hot("products")),
            "staging-products"))

    def staging_activity(self) -> DataFrame:
        return self._table("stg_activity", lambda: self._stored(
            "staging-activity", staging.stage_activity(self.raw("activity"), self.raw("customers"), self.cfg, self.join_anchors(), self.raw_hot("activity")),
            ("customer_id",)))

    def activity_hot(self) -> HotKeys:
        self.staging_activity()
        return self.hot("staging-activity")

    def base(self) -> DataFrame:
        return self._table("base", lambda: self._stored(
            "base", staging.analysis_base(self.staging_customers(), self.staging_activity(), self.activity_hot()), ("customer_id",)))

    def base_hot(self) -> HotKeys:
        self.base()
        return self.hot("base")

    def rates(self) -> DataFrame:
        """Rows and churned rows of the base by every key of the rate queries (``segments.rate_sets``), in one pass."""
        return self._table("rates", lambda: materialize(segments.rate_sets(self.base(), staging.rate_keys()), "rates"))

    def quantiles(self) -> DataFrame:
        """Mergeable quantile sketches of the base's measures, in one pass (``ordering.quantile_sketches``)."""
        return self._table("quantiles", lambda: materialize(quantile_sketches(
            self.base(), staging.sketch_keys(), staging.SKETCHED), "quantiles"))

    # -- reporting model -------------------------------------------------------

    def holdings(self) -> DataFrame:
        return self._table("holdings", lambda: self._by_customer(
            model.portfolio(self.staging_products(), self.cfg.product_names, self.cfg.fold_text), "holdings"))

    def churn_analysis(self) -> DataFrame:
        return self._table("churn_analysis", lambda: materialize(
            model.wide_table(self.staging_customers(), self.staging_activity(), self.holdings(),
                             self.cfg.product_names, self.activity_hot()), "churn-analysis"))

    def dim_customer(self) -> DataFrame:
        return self._table("dim_customer", lambda: self._by_customer(
            model.dim_customer(self.staging_customers(), stable_input=True), "dim-customer"))

    def dim_product(self) -> DataFrame:
        return self._table("dim_product", lambda: self._by_customer(
            model.dim_product(self.holdings(), self.cfg.product_names, stable_input=True), "dim-product"))

    def dim_date(self) -> DataFrame:
        return self._table("dim_date", lambda: model.date_dimension(
            self.spark, self.cfg.calendar_start, self.cfg.calendar_end))

    def fact_churn(self) -> DataFrame:
        return self._table("fact_churn", lambda: self._stored(
            "fact-churn", model.fact_churn(self.staging_activity(), self.dim_customer(), self.dim_product(), self.activity_hot()),
            ("customer_key", "product_key")))

    def fact_hot(self, key: str) -> HotKeys:
        self.fact_churn()
        return self.hot("fact-churn", key)

    # -- publishing ------------------------------------------------------------

    PUBLISHED = {
        "staging.customers": "staging_customers",
        "staging.products": "staging_products",
        "staging.activity": "staging_activity",
        "staging.churn_analysis": "churn_analysis",
        "staging.dim_customer": "dim_customer",
        "staging.dim_product": "dim_product",
        "staging.dim_date": "dim_date",
        "staging.fact_churn": "fact_churn",
    }

    def publish(self, root: str, fmt: str = "parquet", keep: int = 2) -> dict[str, str]:
        """Write every finished table under ``root`` as one version and make it the current one (``sinks.publish_tables``)."""
        return publish_tables(self.spark, {name: getattr(self, attr) for name, attr in self.PUBLISHED.items()}, root, fmt, keep)

    def close(self) -> None:
        """Forget the layers, and remove the catalog tables and folders that were made for them.

        Published tables stay. Frames made from the layers can't be read any more.
        """
        self._tables.clear()
        for key in [k for k, wh in _WAREHOUSES.items() if wh is self]:
            del _WAREHOUSES[key]
        remove_scratch(self.spark, self._made)


_WAREHOUSES: dict[tuple, Warehouse] = {}


def fixture_warehouse(spark: SparkSession, sf_dir: str, cfg: ChurnConfig = FIXTURE) -> Warehouse:
    """The session's warehouse over the fixture tables of ``sf_dir`` (built on first use)."""
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"), id(cfg))
    wh = _WAREHOUSES.get(key)
    if wh is None:
        wh = Warehouse.from_fixtures(spark, str(sf_dir).rstrip("/"), cfg)
        _WAREHOUSES[key] = wh
    return wh

