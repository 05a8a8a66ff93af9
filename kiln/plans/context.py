"""Per-call context: base tables and derived views for one (session, data dir)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from kiln.sources.tables import Tables
from kiln.sources.views import spark_view


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    def view(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, name, self.t)

    @cached_property
    def sensor(self) -> DataFrame:
        return self.view("v_sensor")

    @cached_property
    def tickets(self) -> DataFrame:
        return self.view("v_tickets")

    @cached_property
    def cases(self) -> DataFrame:
        return self.view("v_cases")

    @cached_property
    def vendors(self) -> DataFrame:
        return self.view("v_vendors")

    @cached_property
    def queries(self) -> DataFrame:
        return self.view("v_queries")

    @cached_property
    def tool_log(self) -> DataFrame:
        return self.view("v_tool_log")

    @cached_property
    def routing(self) -> DataFrame:
        return self.view("v_routing")

    @cached_property
    def raw_machine(self) -> DataFrame:
        return self.view("v_raw_machine")

    @cached_property
    def vendor_keys(self) -> DataFrame:
        return self.view("v_vendor_keys")
